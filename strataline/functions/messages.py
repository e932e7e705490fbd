"""Column functions over one conversation: ``array<struct<role, content>>``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def with_role(messages: Column, role: str) -> Column:
    return F.filter(messages, lambda m: m["role"] == role)


def turn_count(messages: Column) -> Column:
    return F.size(messages).cast("bigint")


def num_assistant_turns(messages: Column) -> Column:
    return F.size(with_role(messages, "assistant")).cast("bigint")


def has_assistant(messages: Column) -> Column:
    return F.exists(messages, lambda m: m["role"] == "assistant")


def has_role(messages: Column, role: str) -> Column:
    return F.exists(messages, lambda m: m["role"] == role)


def chars_by_role(messages: Column, role: str) -> Column:
    return F.aggregate(
        with_role(messages, role), F.lit(0).cast("bigint"),
        lambda total, m: total + F.coalesce(F.length(m["content"]), F.lit(0)))


def first_message(messages: Column, role: str) -> Column:
    return F.coalesce(F.get(with_role(messages, role), F.lit(0))["content"], F.lit(""))


def last_assistant(messages: Column) -> Column:
    """Content of the last assistant message; null when there is none or it is empty."""
    content = F.try_element_at(with_role(messages, "assistant"), F.lit(-1))["content"]
    return F.when(content != "", content)


def before_last_assistant(messages: Column) -> Column:
    """The messages before the last assistant message; empty when there is none."""
    seen = F.array_max(F.transform(messages, lambda m, i: F.when(m["role"] == "assistant", i)))
    return F.slice(messages, F.lit(1), F.coalesce(seen, F.lit(0)))


def last_user_before(messages: Column) -> Column:
    users = with_role(before_last_assistant(messages), "user")
    return F.coalesce(F.try_element_at(users, F.lit(-1))["content"], F.lit(""))


def prior_context(messages: Column) -> Column:
    """Everything said before the last assistant message, system text included."""
    return F.array_join(F.transform(before_last_assistant(messages), lambda m: m["content"]), "\n\n")


def as_messages(text: Column, role: str = "user") -> Column:
    """Wrap a plain string as a one-message conversation, so both prompt forms share a type."""
    return F.array(F.struct(F.lit(role).alias("role"), text.alias("content")))


def message_text_union(messages: Column, role: str | None = None, limit: int | None = None) -> Column:
    """Contents joined by newlines: all messages, or one role's; each cut at ``limit`` if given."""
    chosen = with_role(messages, role) if role else messages
    return F.array_join(
        F.transform(chosen, lambda m: m["content"].substr(1, limit) if limit else m["content"]), "\n")
