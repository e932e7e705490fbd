"""Registered queries: every operator on the shared tables, with an independent SQL oracle."""

from . import conversations, corpus, lineage, ordering, profiles, results, runs, storage, texts, vectors  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
