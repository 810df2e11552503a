import re
from collections import Counter

import pytest
from helpers import documents, prose, words_of

from elastiq.llm import quality, queries, sql


def counts(text):
    t = text or ""
    words, lines = words_of(t), [x for x in t.split("\n") if words_of(x)]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if seen[w] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark):
    rows = [
        (1, None), (2, ""), (3, " \n\t\n"), (4, "a b"), (5, prose(1, 60)), (6, "x y\nx y\n x y\nx y"), (7, "é🙂 #*$%&|<> " * 20),
        (8, (prose(2, 9) + "\n") * 3), (9, prose(3, 5000, 30)), (10, "one two three four five six seven eight"), (11, "la " * 40),
        (None, prose(4, 30)), (12, prose(5, 30)), (12, prose(5, 30)), (13, "\x0bq\x0cw\r\ne  \n"),
    ]
    got = quality.judge(documents(spark, rows)).collect()
    have = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got]
    by_id = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(have, key=by_id) == sorted([(i, *counts(t)) for i, t in rows], key=by_id)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed)


def test_frequent_lines_are_counted_per_host_over_distinct_texts(spark):
    line = "Terms of Use 2023"
    rows = [(k, f"{prose(k, 30)}\n{line if k % 2 else line.replace('2023', '1999').lower()}", "hot") for k in range(12)]
    rows += [(50, f"{prose(50, 3)}\n" + f"{line}\n{line}\n" * 6, "hot")]  # depleted
    rows += [(60 + k, f"{prose(60 + k, 30)}\n{line}", "cold") for k in range(5)]
    rows += [(100 + k, f"{prose(7, 30)}\nall the same", "hot") for k in range(30)]  # copies count once
    rows += [(200 + k, f"{prose(200 + k, 30)}\n{line}", None) for k in range(8)]
    got = {r.doc_id: r for r in quality.judge(documents(spark, rows), least_documents=7).collect()}
    assert {got[k].words_removed for k in range(12)} == {4} and all(got[k].kept for k in range(12))
    assert got[50].words_removed == 48 and not got[50].kept
    assert all(got[k].words_removed == 0 for k in (*range(60, 65), *range(100, 130)))
    assert all(got[k].words_removed == 4 for k in range(200, 208))
    docs = documents(spark, rows, extra=False)
    judged = quality.judge(docs, least_documents=7).select("doc_id", "removed")
    clean = {r.doc_id: r.t for r in docs.join(judged, "doc_id").select("doc_id", quality.without_lines(docs.text, judged.removed).alias("t")).collect()}
    assert clean[1] == prose(1, 30) and clean[60].endswith(line) and clean[100].endswith("same")


def test_empty_table(spark):
    assert quality.judge(documents(spark, [])).collect() == []


def test_query_equals_sql_where_lines_go_and_documents_are_depleted(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    line = "All rights reserved and so on 2023"
    rows = [(k, f"{prose(k, 30)}\n{line}", "hot") for k in range(20)]
    rows += [(200 + k, f"{prose(200 + k, 17)}\n{line}", "hot") for k in range(3)]  # too few words stay
    rows += [(300 + k, f"{prose(300 + k, 25)}\n" + f"{line}\n" * 5, "hot") for k in range(3)]
    rows += [(400 + k, prose(400 + k, 17) + (f"\n{line}" if k < 5 else " a b c d e f g"), "cold") for k in range(100)]  # at the share, not above
    rows += [(600 + k, f"{prose(600 + k, 17)}\n{line}", "small") for k in range(3)]  # at the floor, not above
    path = str(tmp_path / "documents.parquet")
    documents(spark, rows, extra=False).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = con.sql(sql.SQL["op6_line_quality"]).fetchall()
    got = queries.op6_line_quality(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {r.doc_id for r in got if not r.base_failed and not r.kept} == {200, 201, 202}


def test_more_hosts_change_no_verdict(spark):
    line = "Share this page with friends"
    rows = [(k, prose(k, 18) + (f"\n{line}" if k % 9 == 0 else " one two three"), "h") for k in range(90)]
    again = [(1000 + k, text, f"{host}{n}") for n in range(2) for k, text, host in rows]
    verdicts = lambda rs: {(r.doc_id % 1000, r.words_removed, r.kept) for r in quality.judge(documents(spark, rs)).collect()}
    assert verdicts(rows) == verdicts([*rows, *again]) and {k for k, _, kept in verdicts(rows) if not kept} == set(range(0, 90, 9))


def test_a_larger_host_with_the_same_shares_loses_the_same_lines(spark):
    line = "Share this page with friends"
    make = lambda n: [(k, prose(k, 30) + (f"\n{line}" if k % 9 == 0 else ""), "h") for k in range(n)]
    for n in (45, 90, 450):
        got = quality.judge(documents(spark, make(n))).collect()
        assert {r.doc_id for r in got if r.words_removed} == set(range(0, n, 9))
