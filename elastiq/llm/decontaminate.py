"""Benchmark decontamination with a distributed positional inverted index.

Only DataFrame functions. Words are runs of digits, letters a-z (A-Z in lower case) and non-ASCII characters.

1. The terms of the benchmark are counted over the whole corpus.
2. Every window of a benchmark item (``width`` consecutive words; an item with fewer is one window) is searched for by its
   rarest terms: two for phrases, and two more than words may differ for proximity. Of those, two stand where
   they should in every match, so nothing is lost. Terms that the corpus lacks count among the rarest then. Windows
   of an item overlap, so a few term places per item serve them all.
3. The index holds the postings (document, position) of the picked terms. A posting less its term's offset in the
   item is the place where the item would start. Posting lists are intersected on (document, item, start): a start stays
   if two of the rarest terms of some window speak for it (one, if the window has one word that must agree).
4. The windows left over that lie within the text are compared word by word: ``exact`` are phrase matches; ``near`` are windows of which at least
   ``near_words`` words stand where they should, the proximity matches. With ``near_words`` equal to ``width`` there are
   phrase matches only, and only the two rarest terms are looked up.

Texts are dealt out by document once; their postings, starts and comparisons stay in that partitioning, so no posting is
shuffled and a frequent term is never gathered in one task. Nothing is broadcast unless Spark finds its written size small.

Defined results: null and empty texts have no words; items without words match nothing; an item_id that is null is
matched but has no id to list; repeated item rows count once; equal documents have equal results; other columns are
ignored; with an empty benchmark no word is hit; an empty corpus gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from elastiq.llm.common import ascii_lower, let
from elastiq.sources.staging import stage

# What separates words; capitals are word characters here, since splitting comes before lower case.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _pieces(text: Column) -> Column:
    """Words, and an empty string behind the last separator or for a text without words."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), f"^{_BETWEEN}", ""), _BETWEEN)


def raw_words(text: Column) -> Column:
    """The words of a text before they are put in lower case; null has none."""
    full = lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p)
    return let(_pieces(text), full)


def words_of(text: Column) -> Column:
    return F.transform(raw_words(text), ascii_lower)


# Stands for a null doc_id in keys. Rows are told apart by this and their text, on which alone the result rests.
_NO_ID = -(2**63)
_KEY = ["doc_key", "text_hash"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("doc_key"), F.xxhash64("text").alias("text_hash"), "text"
    )


def tokens_of(texts: DataFrame) -> DataFrame:
    """The key, position and term of every word of the texts."""
    each = texts.select(*_KEY, F.posexplode(_pieces(F.col("text"))).alias("position", "raw"))
    return each.filter("raw != ''").select(*_KEY, "position", ascii_lower(F.col("raw")).alias("term"))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item (a hash), item_id (as text), words: distinct items that have words."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
    items = items.filter(F.size("words") > 0)
    return items.select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words").distinct()


def search_plans(items: DataFrame, frequency: DataFrame, width: int, near_words: int) -> DataFrame:
    """Each item with its windows that the corpus may have: the offsets of the rarest terms of each, and how many must speak.

    ``frequency`` has term, n_corpus. A window that lacks more terms in the corpus than words may differ
    occurs nowhere. Equally rare terms are taken in order of their offset.
    """
    places = items.select("item", F.size("words").alias("n"), F.posexplode("words").alias("offset", "term"))
    places = places.join(frequency, "term", "left").withColumn("n_corpus", F.coalesce("n_corpus", F.lit(0)))
    size = F.least(F.lit(width), F.col("n"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("offset") - size + 1), F.least(F.col("offset"), F.col("n") - size))
    changes = F.greatest(F.lit(0), size - near_words)
    windows = places.select("item", "offset", "n_corpus", size.alias("size"), changes.alias("changes"), F.explode(starts).alias("at"))
    windows = windows.groupBy("item", "at", "size", "changes").agg(
        F.sum((F.col("n_corpus") == 0).cast("int")).alias("missing"), F.sort_array(F.collect_list(F.struct("n_corpus", "offset"))).alias("by_count")
    )
    rarest = F.transform(F.slice("by_count", F.lit(1), F.least(F.col("size"), F.col("changes") + 2)), lambda x: x["offset"])
    windows = windows.filter(F.col("missing") <= F.col("changes")).select("item", "at", "changes", rarest.alias("need"))
    least = F.greatest(F.lit(1), F.size("need") - F.col("changes")).alias("least")
    plans = windows.groupBy("item").agg(F.collect_list(F.struct("at", "need", least)).alias("windows"))
    return items.join(plans, "item").withColumn("size", F.least(F.lit(width), F.size("words")))


def find_windows(docs: DataFrame, benchmark: DataFrame, width: int = 10, near_words: int = 8) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_words and ``matches``.

    A match is an item at one start: item_id, size (of a window), exact and near (first word positions of windows).
    """
    items = stage(benchmark_items(benchmark), "items")
    terms = stage(items.select(F.explode("words").alias("term")).distinct(), "item-terms")
    frequency = tokens_of(_keyed(docs)).join(terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n_corpus"))
    plans = stage(search_plans(items, stage(frequency, "term-counts"), width, near_words), "search-plans")
    picked = plans.select("item", "words", F.explode(F.array_distinct(F.flatten("windows.need"))).alias("offset"))
    picked = stage(picked.select("item", "offset", F.element_at("words", F.col("offset") + 1).alias("term")), "picked-terms")

    # Both uses of the dealt-out texts read the same three columns, so Spark shuffles them once.
    texts = _keyed(docs).repartition(*_KEY)
    postings = tokens_of(texts).join(picked, "term")
    starts = postings.groupBy(*_KEY, "item", (F.col("position") - F.col("offset")).alias("start")).agg(
        F.collect_set("offset").alias("spoken")
    )
    enough = lambda w: F.size(F.array_intersect(w["need"], F.col("spoken"))) >= w["least"]
    found = starts.join(plans, "item").select(*_KEY, "item_id", "words", "size", "start", F.filter("windows", enough).alias("windows"))
    places = F.transform("windows", lambda w: w["at"]).alias("places")
    found = found.filter(F.size("windows") > 0).groupBy(*_KEY).agg(
        F.collect_list(F.struct("item_id", "words", "size", "start", places)).alias("found")
    )

    def compared(words: Column) -> Column:
        def match(x: Column) -> Column:
            agreeing = lambda at: F.size(F.filter(
                F.sequence(at, at + x["size"] - 1),
                lambda k: F.coalesce(F.get(words, x["start"] + k) == F.get(x["words"], k), F.lit(False)),
            ))
            within = F.filter(x["places"], lambda at: (x["start"] + at >= 0) & (x["start"] + at + x["size"] <= F.size(words)))
            counted = F.transform(within, lambda at: F.struct((x["start"] + at).alias("first"), agreeing(at).alias("n")))
            several = lambda few: F.struct(
                x["item_id"].alias("item_id"),
                x["size"].alias("size"),
                F.transform(F.filter(few, lambda c: c["n"] == x["size"]), lambda c: c["first"]).alias("exact"),
                F.transform(
                    F.filter(few, lambda c: (c["n"] < x["size"]) & (c["n"] >= near_words)), lambda c: c["first"]
                ).alias("near"),
            )
            return let(counted, several)

        return F.transform("found", match)

    read = let(
        raw_words(F.col("text")),
        lambda raw: F.struct(
            F.size(raw).cast("bigint").alias("n_words"),
            F.when(F.col("found").isNotNull(), let(F.transform(raw, ascii_lower), compared)).alias("matches"),
        ),
    )
    doc_id = F.when(F.col("doc_key") != _NO_ID, F.col("doc_key")).alias("doc_id")
    return texts.join(found, _KEY, "left").select(doc_id, "text_hash", read.alias("read")).select("doc_id", "text_hash", "read.*")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_words, n_hit (words inside windows found), item_ids (sorted)."""
    matches = find_windows(docs, benchmark, width, near_words=width)
    exact = F.filter(F.coalesce("matches", F.array()), lambda m: F.size(m["exact"]) > 0)
    inside = lambda m: F.flatten(F.transform(m["exact"], lambda first: F.sequence(first, first + m["size"] - 1)))
    hit = let(exact, lambda ms: F.struct(
        F.size(F.array_distinct(F.flatten(F.transform(ms, inside)))).cast("bigint").alias("n_hit"),
        F.array_sort(F.array_distinct(F.filter(F.transform(ms, lambda m: m["item_id"]), lambda i: i.isNotNull()))).alias("item_ids"),
    ))
    return matches.select("doc_id", "text_hash", "n_words", hit.alias("hit")).select("doc_id", "text_hash", "n_words", "hit.*")


def proximity(docs: DataFrame, benchmark: DataFrame, width: int = 10, near_words: int = 8) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_exact, n_near (windows found of all items) and near_ids (sorted)."""
    matches = F.coalesce("matches", F.array())
    total = lambda kind: F.aggregate(matches, F.lit(0).cast("bigint"), lambda a, m: a + F.size(m[kind]))
    ids = F.transform(F.filter(matches, lambda m: F.size(m["near"]) > 0), lambda m: m["item_id"])
    near_ids = F.array_sort(F.array_distinct(F.filter(ids, lambda i: i.isNotNull())))
    found = find_windows(docs, benchmark, width, near_words)
    return found.select("doc_id", "n_words", total("exact").alias("n_exact"), total("near").alias("n_near"), near_ids.alias("near_ids"))
