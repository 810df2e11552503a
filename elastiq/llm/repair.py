"""Conversation structure repair by a bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows consumed, state of the pattern ``(s?(ua)+)?`` over role initials). Its edges are the edits:
Keep (cost 0), Rerole to user or assistant (2), Delete (3, the only edit of a blank or duplicate row), Insert of an empty
user or assistant turn (2); a truncated row that is not deleted costs 1 more. In every state but one the next role is
``user`` and in that one ``assistant``, so the initials of the edits say everything.

1. Rows get their first fault: blank, duplicate of an earlier row, truncated. Earlier rows are found from aggregates: the first
   turn of every (conversation, role and text), joined back.
2. Rows are range partitioned and sorted by (conversation, turn, role, text), so a conversation of any size spreads over tasks.
   Each task streams its rows and cuts a conversation into blocks of ``block_rows``. A conversation that lies in one block is
   repaired on the spot. Any other block gives the cheapest edits between each two states of the pattern.
3. Forward and reverse heaps run from both ends of a block until the sum of their least costs exceeds the best crossing;
   all crossings of that cost are compared and the one with the least concatenated audit wins.
4. Blocks of one conversation are chained from the last to the first (a suffix is a chain of pieces, never copied), and
   the chosen piece of each block goes back to its texts, which are digested in order. A digest has an order, so
   that last pass reads a conversation in one task; it streams, and holds per row the letters of four suffixes.

Costs are compared as integers and audits as ASCII strings, so the result does not depend on partitions or on reruns.

Defined results: null texts and roles are one space, null ids one space in the hash that chooses the damage. Rows of one turn sort by
role, then text; rows whose turn is null come first; all rows whose conv_id is null are one conversation. Rows that repeat in the input
are damaged alike, and all but the first are duplicates. Texts of any length are handled row by row; other columns are not
used. An empty table gives an empty result, and a conversation whose rows are all dropped gives zeros and an empty audit.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from elastiq.sources.staging import stage

_BLANK = r"^[\x20\x09-\x0D]*$"
_UNFINISHED = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$"

# States of the pattern: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
_KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_INITIALS = ("su", "ua", "au")
FAULTS = ("", "blank", "duplicate", "truncated")

Edge = tuple[int, int, str]  # state at the other end, cost, initial of the edit


def next_state(state: int) -> int:
    return ASSISTANT if state == USER else USER


def row_edges(initial: str, fault: str) -> list[tuple[int, int, int, str]]:
    """The edges that consume a row, as (from, to, cost, edit)."""
    edges = [(q, q, 3, "D") for q in range(4)]
    if fault not in ("blank", "duplicate"):
        more = fault == "truncated"
        for q in range(4):
            kept = _KEPT.get(initial, {}).get(q)
            if kept is not None:
                edges.append((q, kept, more, "K"))
            if kept != next_state(q):
                edges.append((q, next_state(q), 2 + more, "R"))
    return edges


INSERTS = [(q, next_state(q), 2, "I") for q in range(4)]
_EDGES = {(c, f): row_edges(c, f) for c in ("s", "u", "a", "") for f in FAULTS}
_AHEAD = {k: [[(b, c, e) for a, b, c, e in v if a == q] for q in range(4)] for k, v in _EDGES.items()}
_BACK = {k: [[(a, c, e) for a, b, c, e in v if b == q] for q in range(4)] for k, v in _EDGES.items()}
_INSERT_BACK = [[(a, c, e) for a, b, c, e in INSERTS if b == q] for q in range(4)]


class _Side:
    """One of the two searches: a heap over (cost, rows from its own end, state), and the least audit per node.

    Edges of cost 0 consume a row, so nodes of one cost are settled in the order in which their audits become final.
    """

    def __init__(self, n: int, starts: Sequence[tuple[int, int]], ahead: bool) -> None:
        self.n, self.ahead = n, ahead
        self.best = {node: (0, "") for node in starts}
        self.heap = [(0, self._rank(i), i, q) for i, q in starts]
        heapq.heapify(self.heap)
        self.settled: set[tuple[int, int]] = set()

    def _rank(self, i: int) -> int:
        return i if self.ahead else self.n - i

    def edges(self, codes: Sequence[tuple[str, str]], i: int, q: int) -> Iterator[tuple[tuple[int, int], int, str]]:
        if self.ahead:
            yield (i, next_state(q)), 2, "I"
            if i < self.n:
                for to, cost, edit in _AHEAD[codes[i]][q]:
                    yield (i + 1, to), cost, edit
        else:
            for to, cost, edit in _INSERT_BACK[q]:
                yield (i, to), cost, edit
            if i > 0:
                for to, cost, edit in _BACK[codes[i - 1]][q]:
                    yield (i - 1, to), cost, edit

    def least(self) -> int:
        """Cost of the next node; nodes met again at a higher cost are skipped."""
        while self.heap and (self.heap[0][2], self.heap[0][3]) in self.settled:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else -1

    def settle(self) -> tuple[int, int]:
        _, _, i, q = heapq.heappop(self.heap)
        self.settled.add((i, q))
        return i, q

    def relax(self, codes: Sequence[tuple[str, str]], node: tuple[int, int]) -> None:
        cost, audit = self.best[node]
        for to, more, edit in self.edges(codes, *node):
            if to in self.settled:
                continue
            new = (cost + more, audit + edit if self.ahead else edit + audit)
            old = self.best.get(to)
            if old is None or new < old:
                self.best[to] = new
                if old is None or new[0] < old[0]:
                    heapq.heappush(self.heap, (new[0], self._rank(to[0]), *to))


def cheapest(codes: Sequence[tuple[str, str]], start: int = START, ends: Sequence[int] = ENDS) -> tuple[int, str] | None:
    """Cost and audit of the cheapest edits of ``codes`` (initial, fault) that lead from ``start`` to one of ``ends``.

    When the least costs of both heaps add up to more than the best crossing, each cheapest path has an edge from a node
    settled ahead to one settled in reverse: its last node below the forward limit has all its successors below the other.
    """
    n = len(codes)
    codes = [(c if c in ("s", "u", "a") else "", f) for c, f in codes]
    ahead, back = _Side(n, [(0, start)], True), _Side(n, [(n, q) for q in ends], False)
    best = (0, "") if n == 0 and start in ends else None
    while True:
        one, two = ahead.least(), back.least()
        if one < 0 or two < 0 or (best is not None and one + two > best[0]):
            return best
        side, other = (ahead, back) if one < two else (back, ahead)
        node = side.settle()
        cost, audit = side.best[node]
        for to, more, edit in side.edges(codes, *node):
            if to in other.settled:
                far, rest = other.best[to]
                found = (cost + more + far, audit + edit + rest if side.ahead else rest + edit + audit)
                best = found if best is None else min(best, found)
        side.relax(codes, node)


def block_table(codes: Sequence[tuple[str, str]]) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit) of a block for every two states that edits can join."""
    found = ((a, b, cheapest(codes, a, (b,))) for a in range(4) for b in range(4))
    return [(a, b, *x) for a, b, x in found if x is not None]


@dataclass
class _Suffix:
    """The cheapest edits from a state to the end: a piece for one block, then the suffix after it."""

    cost: int
    piece: str = ""
    rest: _Suffix | None = None

    def audit_before(self, other: _Suffix) -> bool:
        """Whether this audit is less. Equal tails are one object, so long common tails are not walked."""
        one, two, x, y = self, other, "", ""
        while one is not two or x != y:
            if not x and one is not None:
                x, one = one.piece, one.rest
                continue
            if not y and two is not None:
                y, two = two.piece, two.rest
                continue
            k = min(len(x), len(y))
            if k == 0 or x[:k] != y[:k]:
                return x < y
            x, y = x[k:], y[k:]
        return False


def chain(tables: Iterator[Sequence[tuple[int, int, int, str]]]) -> list[tuple[int, str]]:
    """Cost and audit of each block, from the first on; ``tables`` comes from the last block to the first."""
    best: dict[int, _Suffix] = {q: _Suffix(0) for q in ENDS}
    for table in tables:
        now: dict[int, _Suffix] = {}
        for before, after, cost, audit in table:
            if after in best:
                new, old = _Suffix(cost + best[after].cost, audit, best[after]), now.get(before)
                if old is None or new.cost < old.cost or (new.cost == old.cost and new.audit_before(old)):
                    now[before] = new
        best = now
    at, pieces = best[START], []
    while at.rest is not None:
        pieces.append((at.cost - at.rest.cost, at.piece))
        at = at.rest
    return pieces


@dataclass
class Repaired:
    """The repaired conversation, written as ``role:text`` lines into a digest as edits and rows come in."""

    state: int = START
    n_rows: int = 0
    digest: hashlib._Hash = field(default_factory=hashlib.sha256)
    edits: Iterator[str] = iter("")

    def begin(self, audit: str) -> None:
        """Go on with these edits; those left of the ones before are inserts at the end."""
        self.finish()
        self.edits = iter(audit)

    def row(self, role: str, text: str) -> None:
        for edit in self.edits:
            if edit == "I":
                self._add_next("")
                continue
            if edit == "K":
                self.state = _KEPT[role[:1]][self.state]
                self._add(role, text)
            elif edit == "R":
                self._add_next(text)
            return

    def finish(self) -> str:
        for _ in self.edits:
            self._add_next("")
        return self.digest.hexdigest()

    def _add_next(self, text: str) -> None:
        self.state = next_state(self.state)
        self._add(_NAMES[self.state], text)

    def _add(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.n_rows else ''}{role}:{text}".encode())
        self.n_rows += 1


def damage(turns: DataFrame) -> DataFrame:
    """The rows after damage by crc32 of ``conv_id:turn``; dropped rows stay, with ``dropped`` true and without role and text."""
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(name[0], F.lit(":"), name[1]).cast("binary")) % 20
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    damaged = turns.select(
        F.col("conv_id").cast("bigint"),
        F.col("turn").cast("bigint"),
        kind.alias("kind"),
        F.when(kind == 4, "user").when(kind != 0, role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).when(kind != 0, text).alias("text"),
    )
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return damaged.select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("dropped"), copies.alias("copy")).drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """Add ``fault``, and ``repeats``: whether a row of the same role and text stands at an earlier turn.

    The first turn of each role and text comes from an aggregate (so a text that fills a conversation is counted before it is
    shuffled), and only texts that occur more than once are joined back.
    """
    text = F.col("text")
    fault = F.when(text.rlike(_BLANK), "blank").when(text.rlike(_UNFINISHED), "truncated").otherwise("")
    rows = rows.withColumn("fault", F.when(F.col("dropped"), "").otherwise(fault))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.withColumn("said", F.when(~F.col("dropped") & (F.col("fault") != "blank"), digest))
    first = F.min(F.struct(F.col("turn").isNotNull().alias("numbered"), "turn"))
    again = rows.filter("said is not null").groupBy("conv_id", "said").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
    again = again.filter("n > 1").select(F.col("conv_id").alias("own_conv"), F.col("said").alias("own"), F.col("first.turn").alias("first"))
    # Rows without a digest match nothing.
    same = F.col("conv_id").eqNullSafe(F.col("own_conv")) & (F.col("said") == F.col("own"))
    repeats = F.col("own").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))
    return rows.join(again, same, "left").select("conv_id", "turn", "role", "text", "dropped", "fault", repeats.alias("repeats"))


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "n_turns")
BLOCKS = (
    "conv_id bigint, part int, block bigint, whole boolean, first_turn bigint, last_turn bigint, first_initial string, last_initial string, "
    "blank bigint, duplicate bigint, truncated bigint, illegal bigint, n_turns bigint, cost bigint, audit string, sha256 string, "
    "table array<struct<before: int, after: int, cost: int, audit: string>>, rows array<struct<role: string, text: string>>"
)


class _Block:
    """A run of rows of one conversation."""

    def __init__(self, conv_id: int | None, block: int) -> None:
        self.conv_id, self.block = conv_id, block
        self.rows: list[tuple[str, str]] = []
        self.codes: list[tuple[str, str]] = []
        self.turns: list[int] = []
        self.chars = 0

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)
        self.rows.append((role, text))
        self.codes.append((role[:1], fault))
        self.chars += len(text)

    def out(self, part: int, whole: bool) -> dict:
        initials = [c for c, _ in self.codes]
        done = {name: sum(f == name for _, f in self.codes) for name in FAULTS[1:]}
        done |= dict(conv_id=self.conv_id, part=part, block=self.block, whole=whole, n_turns=len(self.turns))
        done |= dict(first_turn=self.turns[0] if self.turns else None, last_turn=self.turns[-1] if self.turns else None)
        done |= dict(first_initial=initials[0] if initials else None, last_initial=initials[-1] if initials else None)
        done["illegal"] = sum(a + b not in _INITIALS for a, b in zip(initials, initials[1:]))
        if whole:
            made = Repaired()
            done["cost"], done["audit"] = cheapest(self.codes)
            made.begin(done["audit"])
            for role, text in self.rows:
                made.row(role, text)
            done["sha256"] = made.finish()
        elif self.rows:
            done["table"] = [dict(zip(("before", "after", "cost", "audit"), x)) for x in block_table(self.codes)]
            done["rows"] = [dict(role=role, text=text) for role, text in self.rows]
        return done


def _records(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


@dataclass(frozen=True)
class Limits:
    """Rows and characters after which a conversation is cut into another block; neither changes a result."""

    block_rows: int = 256
    block_chars: int = 1 << 22


def blocks_of(rows: DataFrame, limits: Limits) -> DataFrame:
    """One row per block of a conversation, as in ``BLOCKS``. Texts go along only where a conversation is not whole."""
    schema = _arrow(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, before = TaskContext.get().partitionId(), None, None
        # The first and the last conversation of a task may go on in another one.
        first = True
        for batch in batches:
            done = []
            for conv_id, turn, role, text, dropped, fault, repeats in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.out(part, whole=now.block == 0 and not first))
                        first = False
                    now, before = _Block(conv_id, 0), None
                if dropped:
                    continue
                if len(now.rows) >= limits.block_rows or now.chars >= limits.block_chars:
                    done.append(now.out(part, whole=False))
                    now = _Block(conv_id, now.block + 1)
                if fault != "blank" and (repeats or before == (turn, role, text)):
                    fault = "duplicate"
                now.add(turn, role, text, fault)
                before = (turn, role, text)
            if done:
                yield _records(done, schema)
        if now is not None:
            yield _records([now.out(part, whole=False)], schema)

    key = ["conv_id", "turn", "role", "text"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select(*key, "dropped", "fault", "repeats").repartitionByRange(parts, *key).sortWithinPartitions(*key)
    return ordered.mapInArrow(run, BLOCKS)


_PIECES = "own_conv bigint, own_part int, own_block bigint, piece_cost bigint, piece string"
REPAIRED = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
    "repaired_sha256 string"
)


def chosen_pieces(open_blocks: DataFrame) -> DataFrame:
    """The edits of each block of the conversations that have several; blocks come in from the last to the first."""
    schema = _arrow(_PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(keys: list, tables: list) -> pa.RecordBatch:
            own = zip(reversed(keys), chain(iter(tables)))
            return _records([dict(zip(schema.names, (*key, *piece))) for key, piece in own], schema)

        keys, tables = [], []
        for batch in batches:
            for conv_id, part, block, table in zip(*(c.to_pylist() for c in batch.columns)):
                if keys and keys[-1][0] != conv_id:
                    yield close(keys, tables)
                    keys, tables = [], []
                keys.append((conv_id, part, block))
                tables.append([(q, q, 0, "") for q in range(4)] if table is None else [tuple(x.values()) for x in table])
        if keys:
            yield close(keys, tables)

    ordered = open_blocks.select("conv_id", "part", "block", "table").repartition("conv_id")
    return ordered.sortWithinPartitions("conv_id", F.desc("part"), F.desc("block")).mapInArrow(run, _PIECES)


class _Joined:
    """A conversation of several blocks."""

    def __init__(self, first: dict) -> None:
        self.conv_id, self.made, self.audit = first["conv_id"], Repaired(), []
        self.counts = dict.fromkeys((*_COUNTS, "cost"), 0)
        self.first_turn = self.last_turn = self.last_initial = None

    def begin(self, block: dict) -> None:
        for name in _COUNTS:
            self.counts[name] += block[name]
        if block["first_turn"] is not None:
            if self.first_turn is None:
                self.first_turn = block["first_turn"]
            elif self.last_turn == block["first_turn"]:
                self.counts["n_turns"] -= 1
            self.last_turn = block["last_turn"]
        if block["first_initial"] is not None:
            if self.last_initial is not None:
                self.counts["illegal"] += self.last_initial + block["first_initial"] not in _INITIALS
            self.last_initial = block["last_initial"]
        self.counts["cost"] += block["piece_cost"]
        self.audit.append(block["piece"])
        self.made.begin(block["piece"])

    def out(self) -> dict:
        n_turns = self.counts.pop("n_turns")
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - n_turns
        return dict(conv_id=self.conv_id, gaps=gaps, audit="".join(self.audit), repaired_sha256=self.made.finish(), **self.counts)


def joined(blocks: DataFrame) -> DataFrame:
    """``REPAIRED`` for conversations of several blocks, each read row by row, in order, by one task."""
    schema = _arrow(REPAIRED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Joined | None = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if now is None or now.conv_id != row["conv_id"]:
                    if now is not None:
                        done.append(now.out())
                    now = _Joined(row)
                if not row["pos"]:
                    now.begin(row)
                if row["col"] is not None:
                    now.made.row(row["col"]["role"], row["col"]["text"])
            if done:
                yield _records(done, schema)
        if now is not None:
            yield _records([now.out()], schema)

    # What belongs to a block goes with its first row alone.
    own = (*_COUNTS, "piece_cost", "piece", "first_turn", "last_turn", "first_initial", "last_initial")
    rows = blocks.select("conv_id", "part", "block", *own, F.posexplode_outer("rows"))
    ahead = [F.when(F.coalesce("pos", F.lit(0)) == 0, F.col(c)).alias(c) for c in own]
    ordered = rows.select("conv_id", "part", "block", "pos", "col", *ahead).repartition("conv_id")
    return ordered.sortWithinPartitions("conv_id", "part", "block", "pos").mapInArrow(run, REPAIRED)


def repair(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``REPAIRED`` per conversation of ``rows`` (conv_id, turn, role, text, dropped)."""
    blocks = stage(blocks_of(with_faults(rows), limits), "repair-blocks")
    gaps: Column = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0))
    whole = blocks.filter("whole").select(
        "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha256").alias("repaired_sha256")
    )
    open_blocks = blocks.filter("not whole")
    pieces = chosen_pieces(open_blocks)
    same = F.col("conv_id").eqNullSafe(F.col("own_conv")) & (F.col("part") == F.col("own_part")) & (F.col("block") == F.col("own_block"))
    return whole.unionByName(joined(open_blocks.join(pieces, same)))


def repair_damaged(turns: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Damage the rows of ``turns`` and repair what is left: one row per conversation."""
    return repair(damage(turns), limits)
