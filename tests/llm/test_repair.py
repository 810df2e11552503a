import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from elastiq.llm import repair
from elastiq.llm.repair import Limits, block_table, chain, cheapest

TURNS = "conv_id bigint, turn bigint, role string, text string, fault string, cost int, pos int"
ROWS = st.lists(st.tuples(st.sampled_from("sua?"), st.sampled_from(repair.FAULTS)), max_size=7)


def walk(rows):
    """Cheapest (cost, audit) by trying every edit in every state until nothing gets better."""
    best, todo = {(0, 0): (0, "")}, [(0, 0)]
    while todo:
        k, q = todo.pop()
        ahead = 3 if q == 2 else 2
        steps = [(k, ahead, 2, "I")]
        if k < len(rows):
            initial, fault = rows[k]
            steps.append((k + 1, q, 3, "D"))
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                steps.append((k + 1, ahead, 2 + more, "R"))
                kept = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((initial, q))
                if kept:
                    steps.append((k + 1, kept, more, "K"))
        for at, state, more, edit in steps:
            new = (best[k, q][0] + more, best[k, q][1] + edit)
            if new[0] <= 3 * len(rows) and new < best.get((at, state), (99, "")):
                best[at, state] = new
                todo.append((at, state))
    return min(best[x] for x in ((len(rows), 0), (len(rows), 3)) if x in best)


@settings(max_examples=300, deadline=None)
@given(ROWS, st.integers(1, 3))
def test_cheapest_edits_with_the_least_audit_whole_and_in_blocks(rows, size):
    want = walk(rows)
    assert cheapest(rows) == want
    pieces = chain(block_table(rows[k : k + size]) for k in reversed(range(0, len(rows), size)))
    assert (sum(c for c, _ in pieces), "".join(a for _, a in pieces)) == want


def expected(turns):
    """The contract, row by row."""
    rows = defaultdict(list)
    for conv_id, turn, role, text in turns:
        role, text = " " if role is None else role, " " if text is None else text
        key = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
        kind = zlib.crc32(key.encode()) % 20
        text = {1: "", 2: text.translate(dict.fromkeys(map(ord, ".!?")))}.get(kind, text)
        rows[conv_id] += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv_id, group in rows.items():
        said, codes, counts, previous = set(), [], dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0), None
        group.sort()
        for _, _, role, text in group:
            shown = text.strip(" \t\n\v\f\r")
            fault = "blank" if not shown else "duplicate" if (role, text) in said else "truncated" if shown[-1] not in ".!?" else ""
            said.add((role, text))
            codes.append((role[:1], fault))
            if fault:
                counts[fault] += 1
            counts["illegal"] += previous is not None and previous + role[:1] not in ("su", "ua", "au")
            previous = role[:1]
        cost, audit = walk(codes)
        lines, at, state = [], iter(group), 0
        for edit in audit:
            role, text = next(at)[2:] if edit != "I" else ("", "")
            if edit == "D":
                continue
            state = 1 if edit == "K" and role[:1] == "s" else 3 if state == 2 else 2
            lines.append(f"{role if edit == 'K' else {2: 'user', 3: 'assistant'}[state]}:{text}")
        numbers = {t for known, t, _, _ in group if known}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv_id, gaps, *counts.values(), cost, audit, digest))
    return sorted(out, key=repr)


def conversations(seed, n):
    r, rows = random.Random(seed), []
    for c in range(n):
        for turn in range(r.randrange(1, 8)):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""])
            text = r.choice(["Yes.", "No", " \t", "", "What? ", "é!", None, "so.\n", f"{r.random()}."])
            rows.append((r.choice([c, c, c, c, None]), None if r.random() < 0.1 else turn + r.randrange(2), role, text))
    return rows


@pytest.mark.parametrize("limits", [Limits(), Limits(block_rows=3)])
def test_equals_the_contract_row_by_row(spark, limits):
    rows = conversations(5, 60)
    rows = [x for x in rows if x[0] is not None] + [x for x in rows if x[0] is None][:6]  # the plain walk is slow
    rows += [(1000, 1, "user", "x" * 300_000), (1000, 2, "assistant", "y " * 200_000 + "."), (1001, 3, "user", "same."), (1001, 3, "user", "same.")]
    docs = spark.createDataFrame([(*x, "z", 1, 2) for x in rows], TURNS).repartition(5)
    got = [tuple(x) for x in repair.repair_damaged(docs, limits).collect()]
    assert sorted(got, key=repr) == expected(rows)


def test_one_conversation_with_most_rows_is_cut_and_chained(spark):
    r = random.Random(3)
    rows = [(7, k, r.choice(["user", "assistant"]), r.choice(["a.", "b", f"{k}."])) for k in range(400)] + [(8, 0, "user", "Hi.")]
    docs = spark.createDataFrame([(*x, "z", 1, 2) for x in rows], TURNS)
    blocks = repair.blocks_of(repair.with_faults(repair.damage(docs)), Limits(block_rows=50))
    assert blocks.filter("conv_id = 7").count() >= 8
    one = repair.repair_damaged(docs, Limits(block_rows=50)).collect()
    other = repair.repair_damaged(docs, Limits(block_rows=1000)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, other))


def test_dropped_conversation_and_empty_table(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    docs = spark.createDataFrame([(gone, 0, "user", "Hi.", "", 0, 0)], TURNS)
    assert [tuple(x) for x in repair.repair_damaged(docs).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repair_damaged(docs.limit(0)).collect() == []
