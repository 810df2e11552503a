import random

import numpy as np
import pytest
from helpers import documents, repeated

from elastiq.llm import suffixes
from elastiq.llm.suffixes import Limits
from elastiq.sources.staging import stage


def spans_of(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in df.collect())


def wanted(rows, length):
    found = zip(rows, repeated(rows, length))
    return sorted((i is None, i or 0, n, runs, kept) for (i, _), (n, runs, kept) in found)


def some_rows(seed, alphabet, n=40):
    r = random.Random(seed)
    passage = "".join(r.choice(alphabet) for _ in range(60))
    rows = []
    for k in range(n):
        own = "".join(r.choice(alphabet) for _ in range(r.randrange(80)))
        cut = r.randrange(40)
        rows.append((k, own[:20] + (passage[cut : cut + r.randrange(40)] if k % 3 == 0 else "") + own[20:]))
    return rows


EDGES = [(900, None), (901, ""), (902, "short"), (None, "x" * 30), (903, "ab" * 40), (904, "é🙂" * 20), (905, "twice " * 9), (905, "twice " * 9)]


@pytest.mark.parametrize(
    "limits",
    [
        Limits(length=12, gram=4),
        Limits(length=13, gram=8, in_memory=5, lanes_from=2, lanes=3),
        Limits(length=9, gram=4, in_memory=1, lanes_from=1, lanes=100),
    ],
)
def test_equals_brute_force(spark, limits):
    rows = [*some_rows(1, "abcdefgh"), *[(100 + i, t) for i, t in some_rows(2, "ab", 25)], *EDGES]
    got = suffixes.remove_repeats(documents(spark, rows), limits)
    assert spans_of(got) == wanted(rows, limits.length)


def test_production_length(spark):
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    shared, edited = text(900), text(1500)
    near = edited[:700] + "#" + edited[701:]
    rows = [(1, text(500) + shared + text(50)), (2, shared[100:800]), (3, edited), (4, near), (5, text(3000)), (6, text(399) * 3)]
    assert spans_of(suffixes.remove_repeats(documents(spark, rows))) == wanted(rows, 400)


def test_empty_table(spark):
    assert suffixes.remove_repeats(documents(spark, [])).collect() == []


SPLIT_SOON = {
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0",
}


def test_rows_of_a_hot_gram_can_be_split(spark, monkeypatch):
    plans = {}

    def recorded(df, name):
        df.collect()
        plans[name] = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        return stage(df, name)

    monkeypatch.setattr(suffixes, "stage", recorded)
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    hot, limits = "QRSTUVWXYZQRZZY", Limits(length=12, gram=4)
    rows = [(k, text(30) + hot + text(10)) for k in range(500)]
    before = {k: spark.conf.get(k, None) for k in SPLIT_SOON}
    try:
        for k, v in SPLIT_SOON.items():
            spark.conf.set(k, v)
        got = suffixes.remove_repeats(documents(spark, rows).repartition(8), limits)
        assert spans_of(got) == wanted(rows, limits.length)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "skew=true" in plans["suffix-shared"]
    grams = [x for x in plans["suffix-ranges"].splitlines() if "SortMergeJoin" in x and "[gram#" in x and "Inner" in x]
    assert len(grams) == 1 and "skew=true" in grams[0]


def test_long_texts_are_sampled_in_pieces_alike(monkeypatch):
    data = np.frombuffer(("abcab" * 300 + "".join(random.Random(1).choices("abcd", k=4000))).encode(), np.uint8)
    limits = Limits(length=50, gram=8)
    whole = suffixes.sampled(data, limits)
    monkeypatch.setattr(suffixes, "_PIECE", 97)
    assert suffixes.sampled(data, limits) == whole
    assert [a for _, a, _, _ in whole[1:]] == [b + 1 for _, _, b, _ in whole[:-1]]
    assert whole[0][1] == 0 and whole[-1][2] == len(data) - limits.length


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_queues_on_disk_find_what_arrays_find(block):
    r, length = random.Random(block), 8
    texts = ["".join(r.choices("ab", k=6)) + "core" + "".join(r.choices("ab", k=8)) for _ in range(60)]
    texts = sorted((t.encode() for t in texts), key=lambda t: t[6:])
    strings = [t[6 : 6 + length] for t in texts]
    left = np.array([list(t[:6][::-1]) for t in texts], np.uint8)
    low, high = np.zeros(60, np.int32), np.array([r.randrange(7) for _ in texts], np.int32)
    prefix = suffixes.common_prefixes(strings, np.zeros(1, int), length)
    item, level = suffixes.induce(np.zeros(60, int), prefix, left, low, high, length)
    queue, stored = suffixes.ByteQueues(block), suffixes.StoredSuffixes(6)
    stored.add(left, low=low, high=high)
    for k in range(0, 60, block):
        queue.put(0, np.arange(k, min(60, k + block)), prefix[k : k + block])
    got = [(i, lv) for items, lv in suffixes.induce_on_disk(queue, stored.open(), length, block) for i in items]
    assert len(got) == len(set(got)) and set(got) == set(zip(item.tolist(), level.tolist()))
    for lv in range(7):
        own = {k: t[6 - lv : 6 - lv + length] for k, t in enumerate(texts) if high[k] >= lv}
        again = {k for k, s in own.items() if sum(s == x for x in own.values()) > 1}
        assert {i for i, at in got if at == lv} == again
