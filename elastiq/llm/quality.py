"""Quality rules: cross-document line frequency on top of per-document counts.

Only DataFrame functions. Lines are normalised (lower case, white space and digits made alike), hashed, and for every
host (the column ``source``) the distinct documents with a line are counted. A document is a text here: exact copies
count once, so that copies alone never empty a document. Lines in more than ``least_share`` of their host's documents (and in
more than a few) are boilerplate and go, so a host twice as large loses the same lines; a document that keeps too few words is
rejected, as is one that fails a base rule.

The text is read once. Its counts and the hashes of its lines are written to the shared folder and counted with partial
aggregation, so a line or host with a third of all rows arrives as one row per task.

Defined results: null text is empty and has no words, lines or symbols; a null host is a host of its own; equal rows have
equal results; other columns are ignored; an empty table gives an empty result. Windows of eight words are compared by a
64-bit hash within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from elastiq.llm.common import BLANKS, let
from elastiq.sources.staging import stage

_SYMBOLS = "[#*$%&|<>]"
_BLANK = r"[\x20\x09-\x0D]"
_KEY = ["doc_id", "source", "text_hash"]


def words_of(text: Column) -> Column:
    """Words of a text that is not null."""
    pieces = F.split(F.regexp_replace(text, f"^{BLANKS}", ""), BLANKS)
    return let(pieces, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def normalised(line: Column) -> Column:
    line = F.regexp_replace(F.regexp_replace(line, BLANKS, " "), "[0-9]+", "0")
    return F.lower(F.trim(line))


def repeated_words(words: Column, width: int = 8) -> Column:
    """How many words lie in windows of ``width`` words that occur more than once."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(ordered: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(ordered, k)["h"] == x["h"], F.lit(False))
            found = F.filter(ordered, lambda x, k: same(x, k - 1) | same(x, k + 1))
            return F.sort_array(F.transform(found, lambda x: x["i"]))

        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-width).alias("last"))
        step = lambda a, p: F.struct(
            (a["n"] + F.least(F.lit(width), p - a["last"])).alias("n"), p.alias("last")
        )
        count = F.aggregate(let(pairs, places), start, step, lambda a: a["n"])
        # Nearly all texts have no repeated window; those are told by a hash set and need no sorting.
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(count)

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.xxhash64(F.slice(words, i, width)))
    return F.when(F.size(words) > width, let(hashes, covered)).otherwise(F.lit(0).cast("bigint"))


def text_counts(docs: DataFrame) -> DataFrame:
    """The base counts, and of every line with a word its hash and number of words."""
    text = F.coalesce("text", F.lit(""))
    by_words = let(words_of(text), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"), repeated_words(w).alias("n_repeat_words")
    ))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_lines = let(lines, lambda ls: F.struct(
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("n_dup_lines"),
        F.transform(ls, lambda x: F.struct(
            F.xxhash64(normalised(x)).alias("line"),
            F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
        )).alias("lines"),
    ))
    return docs.select(
        "doc_id",
        "source",
        F.xxhash64("text").alias("text_hash"),
        by_words.alias("w"),
        (F.length(text) - F.regexp_count(text, F.lit(_BLANK))).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(_SYMBOLS)).cast("bigint").alias("n_symbols"),
        by_lines.alias("l"),
    ).select(*_KEY, "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.lines")


def frequent_lines(counts: DataFrame, least_documents: int, least_share: float) -> DataFrame:
    """source, line: lines in more distinct texts of a host than ``least_documents`` and ``least_share`` of its texts."""
    texts = counts.groupBy("source", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    hosts = texts.groupBy(F.col("source").alias("host")).agg(F.count(F.lit(1)).alias("texts"))
    lines = counts.select("source", "text_hash", F.explode(F.array_distinct("lines.line")).alias("line"))
    per_line = lines.distinct().groupBy("source", "line").agg(F.count(F.lit(1)).alias("n"))
    frequent = per_line.filter(F.col("n") > least_documents).join(hosts, F.col("source").eqNullSafe(F.col("host")))
    return frequent.filter(F.col("n") > least_share * F.col("texts")).select("source", "line")


def judge(
    docs: DataFrame,
    least_documents: int = 3,
    least_share: float = 0.05,
    least_words: int = 20,
    most_removed: float = 0.5,
) -> DataFrame:
    """Per row of ``docs``: its key, the base counts, base_failed, the words and lines removed, and ``kept``.

    ``removed`` lists the hashes of the lines to take out; ``without_lines`` does so.
    """
    counts = stage(text_counts(docs), "quality-counts")
    frequent = stage(frequent_lines(counts, least_documents, least_share), "quality-lines")
    each = counts.select(*_KEY, F.explode("lines").alias("x")).select(*_KEY, "x.line", "x.words").distinct()
    frequent = frequent.select(F.col("source").alias("host"), F.col("line").alias("line_f"))
    hit = each.join(frequent, each["source"].eqNullSafe(frequent["host"]) & (each["line"] == frequent["line_f"]))
    hit = hit.groupBy(*[F.col(c).alias(f"{c}_h") for c in _KEY]).agg(F.collect_set("line").alias("removed"))
    same = [counts[c].eqNullSafe(hit[f"{c}_h"]) for c in _KEY]
    rows = counts.join(hit, same, "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<bigint>")))
    gone = F.filter("lines", lambda x: F.array_contains("removed", x["line"]))
    n_gone = F.when(F.size("removed") > 0, F.aggregate(gone, F.lit(0).cast("bigint"), lambda a, x: a + x["words"])).otherwise(0)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumn("words_removed", n_gone).withColumn("base_failed", failed)
    depleted = (F.col("n_words") - F.col("words_removed") < least_words) | (
        F.col("words_removed") > most_removed * F.col("n_words")
    )
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "words_removed", "removed"]
    return rows.select(*_KEY, *own, (~F.col("base_failed") & ~depleted).alias("kept"))


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines whose hash is in ``removed``."""
    stays = lambda x: ~F.array_contains(removed, F.xxhash64(normalised(x))) | ~x.rlike(r"[^\x20\x09-\x0D]")
    return F.array_join(F.filter(F.split(text, "\n"), stays), "\n")
