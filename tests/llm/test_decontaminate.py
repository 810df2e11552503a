from helpers import documents, leaks, prose

from elastiq.llm import decontaminate

ITEMS = [
    (1, prose(11, 30)), (2, "Short Item here"), (3, None), (4, "... !!"), (5, prose(11, 30)), (6, "the the the the the the the the the the the the"),
    (7, prose(12, 10)), (7, prose(12, 10)), (10, "Ünï cödé ÄB 12 x9"),
]


def test_equals_brute_force(spark):
    lines = prose(11, 30).split()
    rows = [
        (1, f"a b {' '.join(lines[3:25])} c"), (2, " ".join(lines[:9])), (3, " ".join(lines[:10])), (4, None), (5, ""),
        (6, "SHORT-item, HERE! short item hers short item here"), (7, "the " * 15), (8, "x " + "the " * 9 + "y"), (9, "..."),
        (10, prose(12, 10).upper()), (11, prose(50, 3000) + " " + prose(11, 30)), (12, "ünï cödé äb 12 x9"), (13, "Ünï cödé Äb 12 X9"),
        (14, f"{prose(12, 10)} {prose(12, 10)}"), (None, prose(11, 30)), (15, prose(12, 10)), (15, prose(12, 10)), (16, "short item"),
    ]
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = decontaminate.contamination(documents(spark, rows), bench).collect()
    items = list(dict.fromkeys(ITEMS))
    assert sorted([(r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in got], key=lambda x: (x[0] is None, x[0] or 0)) == sorted(
        [(i, *leaks(t, items)) for i, t in rows], key=lambda x: (x[0] is None, x[0] or 0)
    )


def test_many_equal_passages_and_near_windows(spark):
    passage = prose(20, 40)
    words = passage.split()
    words[5] = "other"
    rows = [(k, f"{prose(100 + k, 5)} {passage}") for k in range(60)] + [(99, " ".join(words[:10]))]
    bench = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    assert all(got[k].n_hit == 40 for k in range(60)) and got[99].n_hit == 0
    found = {r.doc_id: r.matches for r in decontaminate.find_windows(docs, bench).collect()}
    near = [x for m in found[99] or [] for x in m.near]
    exact = [x for m in found[99] or [] for x in m.exact]
    assert exact == [] and near in ([0], [])


def test_a_changed_word_is_never_lost(spark):
    words = prose(20, 40).split()
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    for place in range(0, 10, 3):
        changed = [*words[:place], "other", *words[place + 1 : 10]]
        docs = documents(spark, [(99, " ".join(changed)), (1, " ".join(words))])
        found = {r.doc_id: r.matches for r in decontaminate.find_windows(docs, bench).collect()}
        assert [x for m in found[99] for x in m.near] == [0]
    counts = {r.doc_id: (r.n_exact, r.n_near, r.near_ids) for r in decontaminate.proximity(docs, bench).collect()}
    assert counts == {99: (0, 1, ["1"]), 1: (31, 0, [])}


def test_empty_tables(spark):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(documents(spark, []), bench).collect() == []
    (row,) = decontaminate.contamination(documents(spark, [(1, "a b")]), none).collect()
    assert (row.n_words, row.n_hit, row.item_ids) == (2, 0, [])


def test_near_windows_equal_brute_force_whichever_word_changed(spark):
    passage = [f"q{chr(97 + k)}" for k in range(12)]
    # Rare and common terms: the first ones occur in few texts, the last in many.
    rows = [(k, " ".join(passage[k:])) for k in range(12)]
    rows += [(100 + k, " ".join(["pad", *passage[:k], "changed", *passage[k + 1 :]])) for k in range(12)]
    rows += [(200 + k, " ".join([*passage[:k], "one", "two", *passage[k + 2 :]])) for k in range(11)]
    rows += [(300 + k, " ".join([*passage[:k], "one", "two", "three", *passage[k + 3 :]])) for k in range(10)]
    # The third item has two words that occur nowhere in the corpus; the last is shorter than a window.
    lacking = ["nowhere1", *passage[1:9], "nowhere2"]
    bench = [(1, " ".join(passage)), (2, " ".join(passage[:10])), (3, " ".join(lacking)), (4, " ".join(passage[2:11]))]
    found = decontaminate.find_windows(documents(spark, rows), spark.createDataFrame(bench, "item_id bigint, text string"))
    got = {(r.doc_id, m.item_id, x) for r in found.collect() for m in r.matches or [] for x in m.near}
    expected = set()
    for i, text in rows:
        words = text.split()
        for item, item_text in bench:
            own = item_text.split()
            size = min(10, len(own))
            for at in range(len(own) - size + 1):
                for first in range(len(words) - size + 1):
                    same = sum(words[first + k] == own[at + k] for k in range(size))
                    if 8 <= same < size:
                        expected.add((i, str(item), first))
    assert got == expected and {k for k, _, _ in got} >= {*range(100, 112), *range(200, 211)}
