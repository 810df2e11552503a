import random

from helpers import documents, near_components, prose, shingles

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from elastiq.llm import neardup
from elastiq.llm.neardup import Limits
from elastiq.llm.sieve import sieved


def edited(text, seed, edits):
    r, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def corpus():
    rows = []
    for k in range(25):
        base = prose(k, 20 + 12 * k)
        rows.append((10 * k, base))
        rows.append((10 * k + 1, edited(base, k, 1 + k // 6)))
        rows.append((10 * k + 2, edited(base, k + 50, 1 + k // 3)))
    rows += [(1000 + k, prose(3, 56)) for k in range(30)]  # copies
    rows += [(2000 + k, edited(prose(77, 120), k, 4)) for k in range(40)]  # a large group of near copies
    return rows + [(3000, "one"), (3001, "ONE"), (3002, ""), (3003, None), (3004, "\t"), (3005, "one two"), (3006, "One  two\n"), (3007, prose(8, 4000))]


def test_equals_all_pairs(spark):
    rows, width = corpus(), 2  # the pipeline's test has five words
    got = neardup.near_duplicates(documents(spark, rows), Limits(width=width)).collect()
    want = near_components(rows, width)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingles(t, width)) for i, t in rows}


def test_large_group_leaves_next_to_nothing_for_the_second_round(spark):
    rows = [(k, edited(prose(5, 200), k, 6)) for k in range(150)]
    limits = Limits(width=2)
    docs = documents(spark, rows)
    nodes = neardup.sketch_texts(docs, limits).selectExpr("doc_id as node", "n_shingles as n", "sketch", "signature")
    lists = neardup._labelled(neardup.retained_lists(nodes, limits), None).cache()
    links = tested = None
    for seed in range(limits.rounds):
        pairs = neardup.hub_pairs(lists, limits, seed).cache()
        assert pairs.count() <= limits.hubs * len(rows)
        found = neardup.confirmed(neardup.estimated(pairs, nodes, limits), neardup.texts_of(nodes, docs), limits)
        links = found if links is None else links.union(found)
        lists = neardup._labelled(lists.drop("component"), neardup.components(links)).cache()
    assert neardup.crossing_pairs(lists, nodes, limits).count() <= 150 * 5
    assert {r.component_id for r in neardup.near_duplicates(docs, limits).collect()} == set(near_components(rows, 2).values())


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300), st.sets(st.integers(0, 2**64 - 1), max_size=40), st.integers(0, 300))
def test_signatures_differ_in_no_more_bits_than_sets_in_values(one, more, drop):
    two = set(sorted(one)[drop:]) | more
    signatures = [neardup.parity_signature(np.array(sorted(s), np.uint64)) for s in (one, two)]
    differing = sum(int(x).bit_count() for x in (signatures[0] ^ signatures[1]).view(np.uint64))
    assert differing <= len(one ^ two)
    if len(one ^ two) <= 30:
        assert differing >= len(one ^ two) // 3  # and in hardly fewer where they are few


def test_pairs_below_the_limit_do_not_leave_the_join(spark):
    """A group of near copies of which most pairs lie between 0.6 and 0.8: few come out of the lists, and no link is lost."""
    base = prose(41, 160, 4000)
    rows = [(k, edited(base, k, 8 + k % 6)) for k in range(200)] + [(1000 + k, edited(edited(base, k, 8), 900 + k, 1)) for k in range(40)]
    limits = Limits(width=2)
    nodes = neardup.sketch_texts(documents(spark, rows), limits).selectExpr("doc_id as node", "n_shingles as n", "sketch", "signature").cache()
    lists = neardup.retained_lists(nodes, limits).cache()
    pairs = {tuple(r) for r in neardup.crossing_pairs(neardup._labelled(lists, None), nodes, limits).collect()}
    sets = {i: shingles(t, 2) for i, t in rows}
    similarity = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    middle = [p for p, j in similarity.items() if 0.6 <= j < 0.8]
    assert len(middle) > len(similarity) / 2 and len(pairs) < len(similarity) / 10
    assert {p for p, j in similarity.items() if j >= 0.8} <= pairs
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(documents(spark, rows), limits).collect()}
    assert got == near_components(rows, 2)


def test_components_of_long_chains(spark):
    chain = [(k, k + 1) for k in range(0, 60)] + [(100, 99), (99, 98), (7, 7)]
    got = neardup.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in got} == {**{k: 0 for k in range(61)}, **{k: 98 for k in (98, 99, 100)}}
    assert len(got) == 64


def test_missing_ids_repeated_rows_and_clashing_columns(spark):
    text = prose(1, 60)
    rows = [(5, text), (5, text), (None, text), (None, prose(2, 50)), (None, prose(2, 50)), (4, edited(text, 1, 1)), (6, None)]
    docs = documents(spark, rows)
    got = sorted((str(r.doc_id), str(r.component_id)) for r in neardup.near_duplicates(docs, Limits(width=2)).collect())
    assert got == sorted([("5", "4"), ("5", "4"), ("None", "4"), ("None", "None"), ("None", "None"), ("4", "4"), ("6", "6")])
    kept = neardup.one_of_each(docs, Limits(width=2))
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "6", "None"]


def test_empty_table(spark):
    docs = documents(spark, [])
    assert neardup.near_duplicates(docs).collect() == [] and neardup.one_of_each(docs).collect() == []


def test_prefix_covers_what_similar_sets_must_share():
    limits = Limits()
    assert all(1 <= limits.least_shared(k) <= k and limits.prefix(k) == k - limits.least_shared(k) + 1 for k in range(1, 65))
    assert limits.prefix(10) == 3


def test_the_sieve_lets_wanted_rows_and_few_others_through(spark):
    rows = spark.range(20000).selectExpr("if(id = 19999, null, id) as doc_id", "id % 7 as size")
    wanted = spark.range(0, 20000, 10).toDF("doc_id")
    got = [r.doc_id for r in sieved(rows, "doc_id", wanted).collect()]
    assert set(range(0, 20000, 10)) <= set(got) and len(got) == len(set(got)) and None not in got
    assert len(got) - 2000 < 18000 * 0.06
    assert sieved(rows, "doc_id", wanted.limit(0)).collect() == [] and sieved(rows.limit(0), "doc_id", wanted).collect() == []
