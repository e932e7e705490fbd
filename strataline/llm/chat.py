"""Chat formatting with column expressions: turns to one training text per conversation, and back.

The template writes a block for each run of turns of one role:

    <s>[INST]role[/INST]text[NEXT]text</s>

with one text per turn. Control strings inside roles and texts get a backslash after their first character, and
backslashes are doubled, which ``unescape`` undoes exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, ROLE_END, NEXT, CLOSE = "<s>[INST]", "[/INST]", "[NEXT]", "</s>"
#: Every string that the template gives a meaning, in two parts: the first character, and the rest.
_CONTROL = r"(<(?=/?s>)|\[(?=/?INST\]|NEXT\]))"
_ESCAPED = r"(<(?=\\/?s>)|\[(?=\\/?INST\]|\\NEXT\]))\\"
_TURNS = "array<struct<role:string,text:string>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, _ESCAPED, "$1"), F.lit("\\\\"), F.lit("\\"))


def merge_turns(turns: Column) -> Column:
    """Runs of turns of one role: array<struct<role, texts>>.

    Where runs begin is found first, so each turn is looked at a fixed number of times.
    """
    def starts(t: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1)))
        begins = F.filter(places, lambda i: (i == 1) | (F.get(t, i - 1)["role"] != F.get(t, i - 2)["role"]))
        return _let(begins, lambda s: F.transform(s, lambda start, n: _block(t, start, F.coalesce(F.get(s, n + 1), F.size(t) + 1))))

    def _block(t: Column, start: Column, stop: Column) -> Column:
        part = F.slice(t, start, stop - start)
        return F.struct(F.get(t, start - 1)["role"].alias("role"), F.transform(part, lambda x: x["text"]).alias("texts"))

    return F.when(F.size(turns) > 0, _let(turns, starts)).otherwise(F.array().cast("array<struct<role:string,texts:array<string>>>"))


def render(blocks: Column) -> Column:
    """The formatted text of merged turns."""
    return F.array_join(F.transform(blocks, lambda b: F.concat(
        F.lit(OPEN), escape(b["role"]), F.lit(ROLE_END), F.array_join(F.transform(b["texts"], escape), NEXT), F.lit(CLOSE))), "")


def loss_spans(blocks: Column, role: str = "assistant") -> Column:
    """array<struct<start, stop>>: where texts of ``role`` lie in the formatted text, in code points, end exclusive."""
    span = "array<struct<start:bigint,stop:bigint>>"
    pieces = F.flatten(F.transform(blocks, lambda b: F.transform(b["texts"], lambda t, i: F.struct(
        # what the template writes before this text, and whether a block ends after it
        F.when(i == 0, len(OPEN) + F.length(escape(b["role"])) + len(ROLE_END)).otherwise(len(NEXT)).alias("lead"),
        F.length(escape(t)).alias("size"),
        F.when(i == F.size(b["texts"]) - 1, len(CLOSE)).otherwise(0).alias("trail"),
        (b["role"] == role).alias("learned")))))

    def step(acc, p):
        start = acc["at"] + p["lead"]
        one = F.array(F.struct(start.alias("start"), (start + p["size"]).alias("stop")))
        return F.struct((start + p["size"] + p["trail"]).alias("at"),
                        F.when(p["learned"], F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(span).alias("spans"))
    return F.aggregate(pieces, begin, step, lambda acc: acc["spans"])


def format_chats(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """(``id_col``, formatted, loss_spans): one row per conversation.

    Turns are sorted by number, then role and text, so equal numbers have a fixed order and repeated rows are
    turns of their own; a null number comes first. Null roles and texts count as empty. Rows with a null id are
    one conversation. Other columns are not looked at. A conversation becomes one text, so its turns meet in one
    row, as they must; they are collected map-side first and nothing larger than a conversation is gathered.
    """
    turn = F.struct(F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chats = rows.groupBy(F.col(id_col)).agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    plain = F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).cast(_TURNS)
    both = _let(merge_turns(plain), lambda blocks: F.struct(render(blocks).alias("formatted"), loss_spans(blocks, loss_role).alias("loss_spans")))
    return chats.select(id_col, both.alias("_chat")).select(id_col, "_chat.*")


def parse_chat(formatted: Column) -> Column:
    """The turns of a formatted text again: array<struct<role, text>>, unescaped."""
    blocks = F.filter(F.split(formatted, r"\Q" + CLOSE + r"\E", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        halves = F.split(F.substring(block, len(OPEN) + 1, 2 ** 31 - 1), r"\Q" + ROLE_END + r"\E", 2)
        return _let(halves, lambda h: F.transform(F.split(F.get(h, F.lit(1)), r"\Q" + NEXT + r"\E", -1), lambda t: F.struct(
            unescape(F.get(h, F.lit(0))).alias("role"), unescape(t).alias("text"))))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """What lies under the loss mask, unescaped, with nothing between the texts."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")
