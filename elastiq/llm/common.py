"""What the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once however often ``body`` uses it.

    A lambda that refers to a plain expression would compute it again for every array element.
    """
    return F.transform(F.array(value), body)[0]


def ascii_lower(word: Column) -> Column:
    """A-Z in lower case, all other letters as they are. Words without capitals skip the slow path."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, UPPER, UPPER.lower()))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text, mod 3, is 1; an id that is null is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def may_learn(doc_id: Column) -> Column:
    """Rows that a model may learn from: a known id that is not held out."""
    return doc_id.isNotNull() & ~held_out(doc_id)


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, or a longer one where the input already has such a column."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def keep_rows(docs: DataFrame, verdict: DataFrame, keep: str) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose (doc_id, hash of text) ``verdict`` keeps.

    ``verdict`` has doc_id, text_hash and the boolean column ``keep``, one row per distinct pair.
    """
    own_id, own_hash = fresh("kept_id", docs.columns), fresh("kept_hash", docs.columns)
    good = verdict.filter(F.col(keep)).select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash))
    same = docs["doc_id"].eqNullSafe(good[own_id]) & (F.xxhash64(docs["text"]) == good[own_hash])
    return docs.join(good, same, "left_semi")
