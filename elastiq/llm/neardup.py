"""MinHash near-duplicates with bottom-k sketches from one hash function.

1. A text is the set of its hashed word shingles. One hash gives its sketch: the ``k`` smallest values. Texts with equal
   sets form a class, and a class goes on as one node, so copies are never compared.
2. Inverted lists of retained values generate candidates. Two sets that are similar enough share most retained values, so each
   node need only be listed under its rarest few (prefix filter): as many that a similar node can't miss all of them.
   Rare values come first, so common shingles hardly make a list.
3. A list is not paired off. Its members are held against a few hubs of the list (of those with most values in common with others,
   the one with the least hash, for each of several seeds), at most ``hubs`` per node, best overlap first. Pairs pass if the sketch of their union estimates enough similarity, and are then
   decided by exact Jaccard of the full sets. Links make components. A second round with other hubs does the same for
   members that are not in the component of their hub yet.
4. Only pairs of one list whose ends are still in different components can matter now. They are compared inside the join of
   the lists, so only those come out that may be links: a parity signature of each full set (bit h mod 1024 says whether an odd number
   of its shingles have hash h) differs in at most as many bits as the sets differ in shingles, which excludes nearly all
   pairs below the limit and no link. A pair comes out of the first open list that both are in. What comes out is decided as in 3.
5. Components come from alternating large-star and small-star rounds, each written to the shared folder.

Sketches and texts are fetched for the ends of pairs only, through a sieve of the wanted ids, so the corpus is never shuffled.

The allowance in 2 and 3 is ``slack`` standard deviations of a bottom-k estimate. With 4.5, k = 64 and sets well above 64 shingles, a
pair exactly at the limit is missed in 3 (fewer than 37 of 64 values) with a chance of 1.4e-5 and in 2 (fewer than 36) of up to 4.2e-6,
by the binomial tail; pairs that are more alike are missed less often. Sets of up to 0.8 ``k`` shingles are compared without any loss.

Defined results: null and empty texts have no shingles and link with nothing; fewer words than ``width`` make one shingle; rows that
share a doc_id are one vertex; a row without doc_id belongs to the class of its equals, if one has an id, and otherwise to
none (component_id is null). Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from elastiq.llm.common import fresh, let
from elastiq.llm.graph import components
from elastiq.llm.sieve import sieved
from elastiq.sources.staging import stage

_PIECE = 1 << 20
# Bits of a parity signature, kept as 64-bit words.
_SIGNATURE = 1024
_WORDS = [f"s{k}" for k in range(_SIGNATURE // 64)]
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Limits:
    """Words per shingle, similarity in percent, values per sketch, hubs per node and round, allowance in standard deviations."""

    width: int = 5
    percent: int = 80
    k: int = 64
    hubs: int = 6
    rounds: int = 2
    slack: float = 4.5

    def least_shared(self, values: int) -> int:
        """Retained values that a sketch of ``values`` shares at least with that of a similar set."""
        t = self.percent / 100
        if values <= t * self.k:  # a similar set fits its sketch too
            return math.ceil(t * values - 1e-9)
        return max(1, math.floor(t * values - self.slack * math.sqrt(values * t * (1 - t))))

    def prefix(self, values: int) -> int:
        return values - self.least_shared(values) + 1

    @property
    def least_estimate(self) -> float:
        t = self.percent / 100
        return t - self.slack * math.sqrt(t * (1 - t) / self.k)


def _word_hashes(data: bytes) -> np.ndarray:
    """A hash per word, piece by piece so that a long text's words are not all held at once."""
    parts, at = [], 0
    while at < len(data):
        stop = min(len(data), at + _PIECE)
        while stop < len(data) and data[stop] not in b" \t\n\r\x0b\x0c":
            stop += 1
        words = data[at:stop].lower().split()
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        at = stop
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_set(data: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    words = _word_hashes(data)
    if not words.size:
        return words
    width = min(width, words.size)
    h = np.full(words.size - width + 1, width, np.uint64)
    for k in range(width):
        h = (h ^ words[k : k + h.size]) * np.uint64(_ODD[0])
        h ^= h >> np.uint64(29)
    h *= np.uint64(_ODD[1])
    return np.unique(h ^ (h >> np.uint64(32)))


def parity_signature(own: np.ndarray) -> np.ndarray:
    """A bit per residue of the hashes: whether an odd number of them has it."""
    counts = np.bincount((own % np.uint64(_SIGNATURE)).astype(np.int64), minlength=_SIGNATURE)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _bytes(cell: pa.Scalar) -> bytes:
    buffer = cell.as_buffer()
    return buffer.to_pybytes() if buffer is not None else b""


def sketch_texts(docs: DataFrame, limits: Limits) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest (of the set), sketch (the smallest hashes, ascending), signature (of the parities)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sketches, signatures = [], [], [], []
            for cell in batch["text"]:
                own = shingle_set(_bytes(cell), limits.width)
                sizes.append(own.size)
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                sketches.append((own[: limits.k] ^ np.uint64(1 << 63)).view(np.int64))
                signatures.append(parity_signature(own))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_hash"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(sketches, pa.list_(pa.int64())), pa.array(signatures, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_shingles", "digest", "sketch", "signature"],
            )

    texts = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    found = "doc_id bigint, text_hash bigint, n_shingles bigint, digest binary, sketch array<bigint>, signature array<bigint>"
    return texts.mapInArrow(run, found)


def retained_lists(nodes: DataFrame, limits: Limits) -> DataFrame:
    """v, node, n, place, common: the nodes under the rarest of their retained values, without values that only one node retains.

    ``place`` is that of the value in one order of all values; ``common`` says in eighths of a sketch how many of a node's values others retain too.
    """
    values = nodes.select("node", "n", F.size("sketch").alias("values"), F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    values = values.join(shared, "v")
    table = F.array(*[F.lit(limits.prefix(k) if k else 0) for k in range(limits.k + 1)])
    own = Window.partitionBy("node", "n")
    # Values of one node alone are the rarest of all, so they use up the first places.
    values = values.withColumn("alone", F.col("values") - F.count(F.lit(1)).over(own))
    values = values.withColumn("place", F.row_number().over(own.orderBy("df", "v")) + F.col("alone"))
    common = F.floor((F.col("values") - F.col("alone")) * 8 / limits.k).alias("common")
    return values.filter(F.col("place") <= F.get(table, F.col("values"))).select("v", "node", "n", "place", common)


def _similar_sizes(a: Column, b: Column, limits: Limits) -> Column:
    return 100 * F.least(a, b) >= limits.percent * F.greatest(a, b)


def _in_order(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _labelled(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The lists with each node's component, without lists that lie in one component."""
    if labels is None:
        at = lists.withColumn("component", F.col("node"))
    else:
        at = lists.join(labels.withColumnRenamed("node", "labelled"), F.col("node") == F.col("labelled"), "left")
        at = at.select("v", "node", "n", "place", "common", F.coalesce("component", "node").alias("component"))
    mixed = at.groupBy("v").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    return at.join(mixed.select("v"), "v", "left_semi")


def hub_pairs(lists: DataFrame, limits: Limits, seed: int = 0) -> DataFrame:
    """Each node with the hubs of its lists that it shares most lists with, if in another component."""

    def least(k: int) -> Column:
        hash_of = F.xxhash64("node", F.lit(seed * limits.hubs + k)).alias("h")
        rank = (-F.col("common")).alias("rank")
        return F.min(F.struct(rank, hash_of, F.col("node").alias("hub"), F.col("n").alias("n_hub"), F.col("component").alias("at")))

    hubs = lists.groupBy("v").agg(F.array_distinct(F.array(*map(least, range(limits.hubs)))).alias("hubs"))
    pairs = lists.join(hubs, "v").select("v", "node", "n", "component", F.explode("hubs").alias("x")).select("*", "x.*")
    pairs = pairs.filter("component != at").filter(_similar_sizes(F.col("n"), F.col("n_hub"), limits))
    pairs = pairs.groupBy("node", "hub").agg(F.countDistinct("v").alias("shared"))
    best = Window.partitionBy("node").orderBy(F.desc("shared"), F.xxhash64("hub"), "hub")
    pairs = pairs.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= limits.hubs)
    return _in_order(pairs.select(F.col("node").alias("a"), F.col("hub").alias("b"))).distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("used")).distinct()


def crossing_pairs(open_lists: DataFrame, nodes: DataFrame, limits: Limits) -> DataFrame:
    """The pairs of the open lists that lie in different components and whose signatures don't exclude a link, once each."""
    own = open_lists.groupBy("node", "n", "component").agg(F.sort_array(F.collect_list("v")).alias("values"))
    own = stage(own, "near-crossing")
    words = [F.col("signature")[k].alias(c) for k, c in enumerate(_WORDS)]
    facts = sieved(nodes, "node", own.select(F.col("node").alias("used")).distinct())
    facts = facts.select(F.col("node").alias("own"), F.col("n").alias("own_n"), *words)
    own = own.join(facts, (F.col("node") == F.col("own")) & (F.col("n") == F.col("own_n")))
    rows = own.select("node", "n", "component", "values", *_WORDS, F.posexplode("values").alias("place", "v"))
    rows = rows.withColumn("before", F.slice("values", F.lit(1), F.col("place"))).drop("values", "place")

    # Both sides are renamed alike, so that Spark shuffles the lists once and reads them twice.
    one, two = (rows.select(*[F.col(c).alias(f"{c}_{side}") for c in rows.columns]) for side in "ab")
    differing = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in _WORDS), F.lit(0))
    possible = differing * (100 + limits.percent) <= (F.col("n_a") + F.col("n_b")) * (100 - limits.percent)
    earlier = F.arrays_overlap("before_a", "before_b")
    test = (F.col("v_a") == F.col("v_b")) & (F.col("component_a") < F.col("component_b"))
    test = test & _similar_sizes(F.col("n_a"), F.col("n_b"), limits) & possible & ~earlier
    return _in_order(one.join(two, test).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))


def estimated(pairs: DataFrame, nodes: DataFrame, limits: Limits) -> DataFrame:
    """Pairs that may be similar enough by the sketch of their union."""
    nodes = sieved(nodes, "node", _ends(pairs))
    one = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"))
    two = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"))
    both = pairs.join(one, "a").join(two, "b")
    union = F.slice(F.sort_array(F.array_union("sketch_a", "sketch_b")), 1, limits.k)
    size = F.least(F.lit(limits.k), F.greatest(F.size("sketch_a"), F.size("sketch_b")))
    common = both.withColumn("common", F.array_intersect("sketch_a", "sketch_b"))
    common = common.filter(F.size("common") >= limits.least_estimate * size)  # the estimate can't be higher
    inside = let(union, lambda u: F.size(F.array_intersect(u, F.col("common"))) >= limits.least_estimate * F.size(u))
    return common.filter(inside).select("a", "b").distinct()


def texts_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, text of the given nodes and a few others."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("node"), F.col("text").cast("binary").alias("text"))
    return sieved(texts, "node", nodes.select(F.col("node").alias("used")).distinct())


def confirmed(pairs: DataFrame, texts: DataFrame, limits: Limits) -> DataFrame:
    """The pairs whose full sets are similar enough. Sets are made anew from the texts (node, text) of the pairs' nodes."""

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(_bytes(cell), limits.width).tobytes() for cell in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(sets, pa.binary())], ["node", "own"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for one, two in zip(batch["one"], batch["two"]):
                x, y = np.frombuffer(_bytes(one), np.uint64), np.frombuffer(_bytes(two), np.uint64)
                both = np.intersect1d(x, y, assume_unique=True).size
                good.append(100 * both >= limits.percent * (x.size + y.size - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    sets = stage(texts.mapInArrow(to_sets, "node bigint, own binary"), "near-sets")
    one = sets.select(F.col("node").alias("a"), F.col("own").alias("one"))
    two = sets.select(F.col("node").alias("b"), F.col("own").alias("two"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(compare, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_shingles, component_id."""
    rows = stage(sketch_texts(docs, limits), "near-sketches")
    classes = rows.filter("n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("signature").alias("signature")
    )
    classes = stage(classes, "near-classes")
    nodes = classes.filter("node is not null").select("node", "n", "sketch", "signature")
    lists = stage(retained_lists(nodes, limits), "near-lists")

    labels = None
    for seed in range(limits.rounds + 1):
        at = stage(_labelled(lists, labels), "near-open-lists")
        pairs = hub_pairs(at, limits, seed) if seed < limits.rounds else crossing_pairs(at, nodes, limits)
        likely = stage(estimated(stage(pairs, "near-pairs"), nodes, limits), "near-likely")
        texts = texts_of(_ends(likely).withColumnRenamed("used", "node"), docs)
        found = stage(confirmed(likely, texts, limits), "near-links")
        # Components found so far go on as stars.
        links = found if labels is None else found.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        labels = stage(components(links), "near-labels")

    ids = classes.select(F.col("digest").alias("own"), "node").join(labels.withColumnRenamed("node", "labelled"), F.col("node") == F.col("labelled"), "left")
    ids = ids.select("own", F.coalesce("component", "node").alias("component"))
    out = rows.join(ids, rows["digest"] == ids["own"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", own.alias("component_id"))


def one_of_each(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their component; of several rows with one doc_id the first.

    Rows without doc_id stay unless a row with an id, or another of them, has the same text.
    """
    found = near_duplicates(docs, limits).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    named = found.filter("doc_id is not null").groupBy("doc_id").agg(F.min("text_hash").alias("text_hash"))
    kept = named.unionByName(found.filter("doc_id is null").select("doc_id", "text_hash").distinct())
    own = [fresh(x, docs.columns) for x in ("near_id", "near_hash", "near_place")]
    kept = kept.select(F.col("doc_id").alias(own[0]), F.col("text_hash").alias(own[1]))
    rows = docs.join(kept, docs["doc_id"].eqNullSafe(kept[own[0]]) & (F.xxhash64(docs["text"]) == kept[own[1]]))
    order = [F.col(f"`{f.name}`") for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType) and f.name != "text"]
    place = F.row_number().over(Window.partitionBy(own[0], own[1]).orderBy(*order, F.lit(0)))
    return rows.withColumn(own[2], place).filter(F.col(own[2]) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
