"""A table cut down to the rows whose id may be among some wanted ones, without a shuffle of that table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from elastiq.sources.staging import stage

# A wanted id takes 10 bits, of which it sets 3 in one 64-bit word. About one unwanted id in forty passes.
_BITS, _MARKS = 10, 3


def _place(value: Column, words: int) -> tuple[Column, Column]:
    """The word of an id and the bits it sets there."""
    word = F.pmod(F.xxhash64(value), F.lit(words)).cast("int")
    h = F.xxhash64(value, F.lit(1))
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftright(h, 6 * k), F.lit(64)).cast("int"))
    marks = one(0)
    for k in range(1, _MARKS):
        marks = marks.bitwiseOR(one(k))
    return word, marks


def sieved(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows whose ``column`` is in ``wanted`` (one column, distinct values), and a few others; rows without an id go.

    The wanted ids become a blocked Bloom filter: a table of about 2 bytes per id, eight times smaller than the ids, which
    Spark broadcasts where its size allows, so that only rows that are needed go on. Callers join by the id later, which drops the others.
    """
    wanted = stage(wanted, "sieve-ids")
    words = max(1, wanted.count() * _BITS // 64)
    word, marks = _place(F.col(wanted.columns[0]), words)
    filled = wanted.select(word.alias("sieve_word"), marks.alias("marks")).groupBy("sieve_word").agg(F.bit_or("marks").alias("sieve_bits"))
    filled = stage(filled, "sieve-words")
    own_word, own_marks = _place(F.col(column), words)
    at = rows.filter(F.col(column).isNotNull()).join(filled, own_word == F.col("sieve_word"))
    return at.filter(F.col("sieve_bits").bitwiseAND(own_marks) == own_marks).select(*[rows[f"`{c}`"] for c in rows.columns])
