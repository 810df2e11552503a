import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from elastiq.llm import graph, simhash
from elastiq.llm.simhash import Limits, golay, keys_of
from helpers import documents, prose


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    values = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def all_pairs(rows):
    """doc_id -> least doc_id reachable, by comparing every two fingerprints."""
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    parent = {i: i for i, _ in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, x) in enumerate(prints):
        for j, y in prints[k + 1 :]:
            if (x ^ y).bit_count() <= 3:
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    return {i: find(i) for i in parent}, dict(prints)


def changed(text, seed, times=1):
    r, words = random.Random(seed), text.split()
    for _ in range(times):
        words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
    return " ".join(words)


def corpus():
    rows = []
    for k in range(15):
        base = prose(k, 200 + 40 * k)
        rows += [(20 * k + j, changed(base, j, j)) for j in range(5)]
    hot = prose(99, 300)
    rows += [(1000 + k, changed(hot, k)) for k in range(150)]  # one large group of near copies
    rows += [(2000 + k, hot) for k in range(100)]  # copies
    rows += [(3000, None), (3001, ""), (3002, " \t"), (3003, "one"), (3004, "ONE"), (3005, "One  two\n"), (3006, "one two")]
    return rows + [(3007, prose(5, 30_000)), (3008, "É é Ä"), (3009, "É é ä")]


def test_equals_all_pairs(spark):
    rows = corpus()
    got = simhash.near_duplicates(documents(spark, rows).repartition(3)).collect()
    components, prints = all_pairs(rows)
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == components
    assert len({c for i, c in components.items() if 1000 <= i < 1150}) < 100 and len(got) == len(rows)


def near_clusters(r):
    """Fingerprints at 3 to 6 bits from a few centres: chains of links that no single hub can see."""
    out = []
    for _ in range(3):
        centre = r.getrandbits(64)
        for _ in range(120):
            flips = sum(1 << b for b in r.sample(range(12), r.randrange(2, 5)))
            out.append(centre ^ flips)
    return out + [r.getrandbits(64) for _ in range(50)]


def test_links_in_dense_groups_equal_all_pairs(spark, monkeypatch):
    prints = sorted(set(near_clusters(random.Random(4))))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(signed)], "doc_id bigint, fingerprint bigint")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, limits: docs)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows).collect()}
    parent = list(range(len(prints)))
    for i, x in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j]).bit_count() <= 3 and parent[i] != parent[j]:
                low, high = sorted((parent[i], parent[j]))
                parent = [low if p == high else p for p in parent]
    assert got == dict(enumerate(parent))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
def test_fingerprints_within_three_bits_share_a_key(one, flips):
    two = one ^ sum(1 << b for b in flips)
    first, second = keys_of(np.array([one, two], np.uint64))
    assert set(first) & set(second) and len(first) == len(set(first)) <= 6**3 + 6 * 6


def test_golay_code_is_perfect():
    assert len(set(golay().error.tolist())) == 2048  # one error pattern of at most three bits per syndrome
    words = np.arange(0, 1 << 23, 1013, dtype=np.int64)
    code = words ^ golay().error[golay().syndromes(words)]
    assert not golay().syndromes(code).any()
    assert max(int(x).bit_count() for x in words ^ code) == 3


@given(st.lists(st.sampled_from(["a", "B", "é", "ccc"]), max_size=12), st.integers(1, 9))
def test_pieces_do_not_change_a_fingerprint(words, piece):
    text = " ".join(words)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(simhash, "_PIECE", piece)
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_missing_ids_repeated_rows_and_clashing_columns(spark):
    one, two = prose(1, 80), prose(2, 80)
    rows = [(5, one), (5, one), (None, one), (None, prose(3, 40)), (7, two), (7, one), (9, two), (None, None)]
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(documents(spark, rows)).collect())
    none = [("None", "5"), ("None", "None"), ("None", "None")]
    assert got == sorted([("5", "5"), ("5", "5"), ("7", "5"), ("7", "5"), ("9", "5"), *none])
    assert simhash.near_duplicates(documents(spark, []), Limits()).collect() == []


def test_components_of_chains_stars_and_loops(spark):
    links = [(k, k + 1) for k in range(60)] + [(500, k) for k in range(501, 700)] + [(100, 99), (99, 98), (7, 7), (900, 900), (None, 3)]
    got = graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    want = {**{k: 0 for k in range(61)}, **{k: 500 for k in range(500, 700)}, **{k: 98 for k in (98, 99, 100)}}
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
