"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. A source's size is the number of its words; weights 5, 2, 1, repeating over the sources in order, share
   the total, and no target exceeds ``cap`` times its source (water filling).
2. Documents fall by hash into blocks of about ``block_words`` words. The blocks of a source are permuted
   by hash. A target is met by whole passes over the source and one part pass; the number of
   block draws this takes is the source's exact quota. The last block drawn is cut after its last word
   needed, so a source gives its target to the word.
3. The tree splits the vector of quotas over the output shards: at every node the left half's share is one
   multivariate hypergeometric draw, seeded by the node, down to one shard. Leaves hold consecutive
   ranges of a source's draws, so shards are disjoint.
4. A document gets the draws of its block. ``materialise`` writes out the texts, by shard, in hashed order.

Only block and source sums move besides (id, size) rows; positions of blocks are prefix sums in two
levels, so no source is summed in one task. The tree works on one number per source; its subtrees are spread
over tasks, each walking down from the root by the same seeds.

Defined results: null and empty texts have size 0 and are drawn with their block; sources sort by code point, null
last and a source of its own; equal rows fall into one block and may differ in ``taken`` only at a cut.
An empty table gives an empty result; columns besides doc_id, text and source are not used.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from elastiq.llm.common import BLANKS, WORD
from elastiq.sources.staging import stage

WEIGHTS = (5, 2, 1)
# numpy draws from at most 10**9 blocks in all; beyond this many, blocks grow instead.
MOST_BLOCKS = 10**8
_TASKS = 16


def document_sizes(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "text").alias("text_hash"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = 3) -> DataFrame:
    """Per source: source_size, target. The windows run over one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = Window.partitionBy()
    by_name = F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (by_name % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("double")).withColumn("most", (cap * F.col("source_size")).cast("double"))
    # Sources in the order in which they reach their cap; level: the share of one weight if all before are capped.
    order = whole.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    per = per.withColumn("level", left / F.sum("weight").over(onward))
    free = F.col("most") > F.col("level") * F.col("weight")
    level = F.min(F.when(free, F.struct(F.col("most") / F.col("weight"), F.col("level").alias("level")))).over(whole)["level"]
    target = F.when(free, F.least("most", level * F.col("weight"))).otherwise(F.col("most"))
    return per.select("source", "source_size", target.alias("target"))


def _hypergeometric(quotas: np.ndarray, shards: tuple[int, int], seed: int) -> np.ndarray:
    """How many of each source's draws go to the left half of the shards of a node."""
    low, high = shards
    middle = (low + high) // 2
    total = int(quotas.sum())
    left = total * (middle - low) // (high - low)
    draw = np.random.default_rng([seed, low, high])
    return draw.multivariate_hypergeometric(quotas, left, method="marginals")


def shard_ranges(quotas: np.ndarray, shards: int, seed: int, task: int = 0, tasks: int = 1) -> Iterator[tuple[int, int, int, int]]:
    """(source, shard, first draw, number of draws) of the leaves that belong to ``task``.

    Nodes at the depth where there are ``tasks`` of them are dealt out; the ones above are cheap.
    """
    stack = [(quotas.astype(np.int64), np.zeros(len(quotas), np.int64), (0, shards), 0, 0)]
    depth_of_tasks = max(0, tasks - 1).bit_length()
    while stack:
        own, first, (low, high), depth, number = stack.pop()
        if depth == depth_of_tasks and number % tasks != task:
            continue
        if high - low <= 1:
            if depth >= depth_of_tasks or task == 0:
                yield from ((i, low, int(first[i]), int(own[i])) for i in np.flatnonzero(own))
            continue
        left, middle = _hypergeometric(own, (low, high), seed), (low + high) // 2
        stack.append((left, first, (low, middle), depth + 1, 2 * number))
        stack.append((own - left, first + left, (middle, high), depth + 1, 2 * number + 1))


def split_quotas(quotas: DataFrame, shards: Column, seed: int) -> DataFrame:
    """The leaves of the tree for ``quotas`` (source, quota): source, shard, first, n.

    The list that each task gets holds one number per source.
    """
    one = quotas.groupBy().agg(
        F.sort_array(F.collect_list(F.struct("source", "quota"))).alias("all"), F.max(shards).alias("shards")
    )
    tasks = one.filter(F.size("all") > 0).withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(_TASKS - 1))))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                names = [x["source"] for x in row.all]
                vector = np.array([x["quota"] for x in row.all], np.int64)
                leaves = list(shard_ranges(vector, int(row.shards), seed, int(row.task), _TASKS))
                for k in range(0, len(leaves), 50_000):
                    cut = leaves[k : k + 50_000]
                    yield pd.DataFrame(
                        {"source": [names[x[0]] for x in cut], "shard": [x[1] for x in cut],
                         "first": [x[2] for x in cut], "n": [x[3] for x in cut]}
                    )

    return tasks.repartition(_TASKS, "task").mapInPandas(run, "source string, shard bigint, first bigint, n bigint")


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    cap: int = 3,
    block_words: int = 2048,
    shard_words: int = 2_000_000,
    seed: int = 20,
) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, size, source_size, target, taken, and its ``draws``.

    A draw has the shard, the pass over the source, the words taken (all of them but at a cut) and an order
    within the shard. ``taken`` is their sum.
    """
    sizes = stage(document_sizes(docs), "mix-sizes")
    per = targets(sizes, weights, cap)
    total = F.sum("source_size").over(Window.partitionBy())
    words = F.greatest(F.lit(block_words), total / MOST_BLOCKS)
    goal = F.round("target").cast("bigint")
    per = per.select(
        "*",
        F.greatest(F.lit(1), F.ceil(F.col("source_size") / words)).alias("hashed_to"),
        F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("bigint").alias("passes"),
        F.when(F.col("source_size") > 0, goal % F.col("source_size")).otherwise(0).cast("bigint").alias("rest"),
        F.greatest(F.lit(1), F.ceil(total / F.lit(shard_words))).cast("bigint").alias("shards"),
    )
    per = stage(per, "mix-sources")

    def source_of(other: DataFrame, name: str = "source_of") -> tuple[DataFrame, Column]:
        renamed = per.withColumnRenamed("source", name)
        return renamed, other["source"].eqNullSafe(renamed[name])

    dim, same = source_of(sizes)
    block = F.pmod(F.xxhash64("text_hash", F.lit(seed)), F.col("hashed_to"))
    placed = sizes.join(dim.select("source_of", "hashed_to", "source_size", "target"), same).select(
        "doc_id", "text_hash", "size", "source", "source_size", "target", block.alias("block")
    )
    # Blocks in permuted order, with the number of blocks and words before each, by sums in two levels.
    place = F.xxhash64("block", F.lit(seed + 1))
    blocks = placed.groupBy("source", "block").agg(F.sum("size").alias("words")).withColumn("place", place)
    blocks = blocks.withColumn("part", F.shiftright("place", 52))
    parts = blocks.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("part_words"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.col("source").alias("source_p"),
        F.col("part").alias("part_p"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("part_words").over(earlier), F.lit(0)).alias("words_before"),
    )
    inside = Window.partitionBy("source", "part").orderBy("place", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "source", "block", "words", "part",
        F.coalesce(F.count("words").over(inside), F.lit(0)).alias("rank"),
        F.coalesce(F.sum("words").over(inside), F.lit(0)).alias("start"),
    )
    same = blocks["source"].eqNullSafe(parts["source_p"]) & (blocks["part"] == parts["part_p"])
    blocks = blocks.join(parts, same).select(
        "source", "block", "words",
        (F.col("rank") + F.col("n_before")).alias("rank"),
        (F.col("start") + F.col("words_before")).alias("start"),
    )
    dim, same = source_of(blocks)
    blocks = blocks.join(dim.select("source_of", "passes", "rest", "shards"), same).drop("source_of")
    blocks = stage(blocks, "mix-blocks")

    quotas = blocks.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_blocks"),
        (F.max("passes") * F.count(F.lit(1)) + F.count_if(F.col("start") < F.col("rest"))).alias("quota"),
        F.max("shards").alias("shards"),
    )
    quotas = stage(quotas, "mix-quotas")
    leaves = split_quotas(quotas.select("source", "quota", "shards"), F.col("shards"), seed)
    # A draw finds its leaf by equal slots of a source's draws; a leaf is listed under the slots it touches.
    counts = quotas.select(
        F.col("source").alias("source_q"), "n_blocks",
        F.greatest(F.lit(1), F.ceil(F.col("quota") / F.col("shards"))).alias("slot_width"),
    )
    slots = leaves.join(counts, leaves["source"].eqNullSafe(counts["source_q"])).select(
        F.col("source").alias("source_l"), "shard", "first", "n",
        F.explode(F.sequence(F.floor(F.col("first") / F.col("slot_width")), F.floor((F.col("first") + F.col("n") - 1) / F.col("slot_width")))).alias("slot_l"),
    )
    draws = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("passes"))))
    draws = draws.filter((F.col("pass") < F.col("passes")) | (F.col("start") < F.col("rest")))
    draws = draws.join(counts, draws["source"].eqNullSafe(counts["source_q"]))
    draws = draws.withColumn("draw", F.col("pass") * F.col("n_blocks") + F.col("rank"))
    draws = draws.withColumn("slot", F.floor(F.col("draw") / F.col("slot_width")))
    same = draws["source"].eqNullSafe(slots["source_l"]) & (F.col("slot") == F.col("slot_l"))
    within = (F.col("draw") >= F.col("first")) & (F.col("draw") < F.col("first") + F.col("n"))
    # keep: words of the block that this draw may take; the cut falls into one block per source at most.
    keep = F.when(F.col("pass") < F.col("passes"), F.col("words")).otherwise(F.least(F.col("words"), F.col("rest") - F.col("start")))
    by_block = draws.join(slots, same & within).groupBy("source", "block").agg(
        F.sort_array(F.collect_list(F.struct("pass", "shard", keep.alias("keep")))).alias("of_block")
    )
    by_block = by_block.select(F.col("source").alias("source_b"), F.col("block").alias("block_b"), "of_block")

    ahead = Window.partitionBy("source", "block").orderBy("text_hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("ahead", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    same = placed["source"].eqNullSafe(by_block["source_b"]) & (placed["block"] == by_block["block_b"])
    own_words = lambda x: F.greatest(F.lit(0), F.least(F.col("size"), x["keep"] - F.col("ahead")))
    draw = lambda x: F.struct(
        x["shard"].alias("shard"),
        x["pass"].alias("pass"),
        own_words(x).cast("bigint").alias("words"),
        F.xxhash64(x["shard"], x["pass"], F.col("text_hash"), F.lit(seed)).alias("place"),
    )
    drawn = F.transform(F.coalesce("of_block", F.array().cast("array<struct<pass:bigint,shard:bigint,keep:bigint>>")), draw)
    drawn = F.filter(drawn, lambda x: (x["words"] > 0) | (F.col("size") == 0))
    out = placed.join(by_block, same, "left").select(
        "doc_id", "text_hash", "source", "size", "source_size", "target", drawn.alias("draws")
    )
    taken = F.aggregate("draws", F.lit(0).cast("bigint"), lambda a, x: a + x["words"])
    return out.select("doc_id", "text_hash", "size", "source_size", "target", taken.alias("taken"), "draws")


def materialise(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """One row per draw: the columns of ``docs``, then shard, pass, words_taken; each shard in hashed order.

    A document cut at the end of a target keeps its first words, joined by blanks, with n_chars (if there) to match.
    """
    own = [f"mix_{k}" for k in range(7)]
    own = [x if x not in docs.columns else f"_{x}" for x in own]
    plan = mixed.filter(F.size("draws") > 0).distinct()
    plan = plan.select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "text_hash", "size", "draws"), own)])
    same = docs["doc_id"].eqNullSafe(plan[own[0]]) & (F.xxhash64(docs["doc_id"], docs["text"]) == plan[own[1]])
    rows = docs.join(plan, same).withColumn(own[4], F.explode(own[3]))
    words = F.filter(F.split("text", BLANKS), lambda w: w != "")
    cut = F.array_join(F.slice(words, 1, F.col(f"{own[4]}.words").cast("int")), " ")
    text = F.when(F.col(f"{own[4]}.words") < F.col(own[2]), cut).otherwise(F.col("text"))
    whole = F.col(f"{own[4]}.words") == F.col(own[2])
    kept = []
    for c in docs.columns:
        if c == "text":
            kept.append(text.alias(c))
        elif c == "n_chars":
            kept.append(F.when(whole, F.col(c)).otherwise(F.length(text)).cast("bigint").alias(c))
        else:
            kept.append(F.col(f"`{c}`"))
    added = {"shard": "shard", "pass": "pass", "words_taken": "words"}
    for name, part in added.items():
        while name in docs.columns:
            name = f"mix_{name}"
        kept.append(F.col(f"{own[4]}.{part}").alias(name))
    shard, place = F.col(f"{own[4]}.shard"), F.col(f"{own[4]}.place")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, shard).sortWithinPartitions(shard, place).select(*kept)
