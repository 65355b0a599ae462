"""Dimensions of fixed size: sections, papers and item types with their places in a full paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECTIONS = ["moji", "bunpo", "dokkai", "choukai"]
MINUTES = {"moji": 30, "bunpo": 25, "dokkai": 45, "choukai": 40}
PAPERS = {"moji": (["moji"], 30), "bunpo_dokkai": (["bunpo", "dokkai"], 70), "choukai": (["choukai"], 40)}
#: Type, section, number of the task, items in a full paper, whether it needs a passage.
TYPES = [
    ("kanji_reading", "moji", 1, 8, False), ("orthography", "moji", 2, 6, False), ("context", "moji", 3, 11, False),
    ("paraphrase", "moji", 4, 5, False), ("usage", "moji", 5, 5, False), ("grammar_form", "bunpo", 1, 13, False),
    ("sentence_order", "bunpo", 2, 5, False), ("text_grammar", "bunpo", 3, 5, True), ("reading_short", "dokkai", 4, 4, True),
    ("reading_mid", "dokkai", 5, 6, True), ("reading_long", "dokkai", 6, 4, True), ("info_retrieval", "dokkai", 7, 2, True),
    ("listening", "choukai", None, 28, False), ("vocab_meaning", "moji", None, 0, False), ("kanji_meaning", "moji", None, 0, False),
    ("grammar_misc", "bunpo", None, 0, False),
]
DEFAULT_TYPE = {"moji": "vocab_meaning", "bunpo": "grammar_misc", "dokkai": "reading_short", "choukai": "listening"}


def types(spark: SparkSession) -> DataFrame:
    rows = [(k, *t) for k, t in enumerate(TYPES)]
    return spark.createDataFrame(rows, "ord int, type string, section string, mondai int, want int, passage boolean")


def chosen(c: Column, pairs: dict) -> Column:
    """A CASE over a small map; null where `c` is not in it."""
    out = F
    for k, v in pairs.items():
        out = out.when(c == k, F.lit(v))
    return out


def section_of(kind: Column) -> Column:
    return chosen(kind, {t: s for t, s, *_ in TYPES})


def mondai_of(kind: Column) -> Column:
    return chosen(kind, {t: m for t, _, m, *_ in TYPES if m})


def needs_passage(kind: Column) -> Column:
    return kind.isin(*[t for t, *_, p in TYPES if p])
