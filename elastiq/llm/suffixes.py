"""Exact removal of repeated byte strings by distributed, external induced sorting of suffixes.

A byte goes if it lies in a string of ``length`` bytes that also starts somewhere else. Induced sorting
orders a sample of the suffixes first and induces the order, and the common prefixes, of the rest from it:

1. *Sampling.* Classic induced sorting samples positions smaller than their neighbours. Here a
   position is sampled if the hash of its ``gram`` bytes is the smallest (leftmost on ties) of any window of
   ``length`` bytes. Each window belongs to one sampled position, the same in every copy, and a sampled suffix
   stands for the suffixes that start before it as far as its windows reach (its *context*).
2. *Names.* There is one level of naming and no recursion. Sampled suffixes are named by the hash of their gram; those whose name is unique have no
   equal and drop out of the sort. The rest are named again by their whole context; where all copies of a context
   agree they repeat from end to end, and one of them is enough from here on. What stays are distinct contexts
   that share a gram: edges of copied passages and near copies.
   Classic induced sorting recurses to order suffixes of any length. Here no prefix beyond ``length`` bytes matters: equal windows
   share their sampled gram, and step 3 compares up to ``length`` bytes themselves, so names need not decide an order.
3. *Sorting.* Those are dealt out by gram. Spark's external sort puts the suffixes of a partition in order, and
   neighbours are compared once to get their common prefix.
4. *Induction.* The suffixes one byte further left are sorted by that byte, stably, and the common prefix
   of two neighbours is one more than the least between them before. Level by level this gives every
   window's longest match. A bucket of up to ``in_memory`` suffixes does so in arrays. A larger one streams through queues, one
   per byte, which keep blocks of (suffix, common prefix) and move to disk when they grow; memory then depends on
   the block size alone. These are first-in first-out queues, not priority queues: each level is read in the order of the bytes and
   adds to a queue in that order already. They run only for a gram (or the core of a lane) with more than ``in_memory`` suffixes to
   sort, that is a passage in tens of thousands of different contexts; all other inputs stay in arrays. Queue files are unnamed scratch of one task, gone when it ends.
5. A gram with very many contexts is cut into lanes of levels first. All windows of a lane share a longer
   core than the gram, and the core's hash deals them out again, so a hot passage is not one task's work.

Windows are compared byte by byte in step 3; names of contexts are two 64-bit hashes with the offset.
Scratch tables go to the shared folder, so a lost executor costs its running tasks only.

Defined results: null text is empty; texts shorter than ``length`` keep all bytes; equal rows are
copies of each other; a null doc_id is an id like others; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from elastiq.sources.staging import stage

ANCHORS = "doc_id bigint, text_hash bigint, gram bigint, context bigint, p int, a int, b int"
_PIECE = 1 << 20


@dataclass(frozen=True)
class Limits:
    """Bytes of a match and of a gram; suffixes per array sort; contexts of a gram from which on it is cut into lanes."""

    length: int = 400
    gram: int = 64
    in_memory: int = 40_000
    lanes_from: int = 20_000
    lanes: int = 16


def _mixed(n: int) -> np.ndarray:
    """``n`` fixed 64-bit numbers without pattern."""
    x = (np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE, _ODD = _mixed(256), _mixed(300)[256:] | np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """The hash of ``gram`` bytes (a power of two) from every position, by doubling."""
    h, width, k = _BYTE[data], 1, 0
    while width < gram:
        h = h[:-width] * _ODD[k] + h[width:]
        width, k = 2 * width, k + 1
    h ^= h >> np.uint64(32)
    h *= _ODD[k]
    h ^= h >> np.uint64(29)
    return h


def sampled(data: np.ndarray, limits: Limits) -> list[tuple[int, int, int, int]]:
    """(position, first window, last window, gram hash) of the sampled positions; windows are cut into them without rest."""
    windows, span = len(data) - limits.length + 1, limits.length - limits.gram + 1
    out: list[tuple[int, int, int, int]] = []
    for base in range(0, windows, _PIECE):
        own = min(_PIECE, windows - base)
        h = gram_hashes(data[base : base + own + limits.length - 1], limits.gram)
        i, p = 0, int(h[:span].argmin())
        while i < own:
            coming = h[i + span : min(p, own - 1) + span] < h[p]
            k = int(coming.argmax()) if coming.size else 0
            smaller = bool(coming.size and coming[k])
            last = i + k if smaller else min(p, own - 1)
            if out and out[-1][0] == base + p:  # a piece ended within its windows
                out[-1] = (base + p, out[-1][1], base + last, int(h[p]))
            else:
                out.append((base + p, base + i, base + last, int(h[p])))
            i = last + 1
            if smaller:
                p = last + span
            elif i < own:
                p = i + int(h[i : i + span].argmin())
    return out


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _bytes(cell: pa.Scalar) -> bytes:
    buffer = cell.as_buffer()
    return buffer.to_pybytes() if buffer is not None else b""


def find_anchors(texts: DataFrame, limits: Limits) -> DataFrame:
    """The sampled positions of each text, with the hash of their gram and of their context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found, contexts = [], [], []
            for k, cell in enumerate(batch["text"]):
                data = _bytes(cell)
                if len(data) < limits.length:
                    continue
                for p, a, b, g in sampled(np.frombuffer(data, np.uint8), limits):
                    rows.append(k)
                    found.append((p, a, b, g))
                    contexts.append(xxhash.xxh3_64_intdigest(data[a : b + limits.length], p - a))
            if rows:
                p, a, b, g = zip(*found)
                place = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(place), batch["text_hash"].take(place), _signed(g), _signed(contexts),
                     pa.array(p, pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32())],
                    [x.split()[0] for x in ANCHORS.split(", ")],
                )

    return texts.mapInArrow(run, ANCHORS)


# ---- induction -----------------------------------------------------------------------------------------


def common_prefixes(strings: list[bytes], new: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of each string with the one before, 0 where a bucket begins (``new``)."""
    width = max(map(len, strings))
    rows = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)
    sizes = np.fromiter(map(len, strings), np.int32, len(strings))
    out = np.zeros(len(strings), np.int32)
    if len(strings) > 1:
        differs = rows[1:] != rows[:-1]
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        out[1:] = np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))
    out[new] = 0
    return np.minimum(out, length)


def least_between(values: np.ndarray, after: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """min(values[after + 1 : upto + 1]) for each pair, from minima over powers of two."""
    reach = np.frexp((upto - after).astype(np.float64))[1] - 1
    out, table = np.empty(len(after), values.dtype), values
    for k in range(int(reach.max(initial=0)) + 1):
        at = reach == k
        out[at] = np.minimum(table[after[at] + 1], table[upto[at] - (1 << k) + 1])
        table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def induce(bucket: np.ndarray, prefix: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, level) of the windows that start elsewhere too; one array pass per level.

    Suffixes come sorted within buckets. ``left[i, k]`` is the byte k + 1 before suffix i; it has windows at levels
    ``low[i]`` to ``high[i]``. A suffix that can't reach ``length`` any more is dropped.
    """
    order, found = np.arange(len(bucket)), []
    level = 0
    while order.size:
        best = np.maximum(prefix, np.append(prefix[1:], 0))
        hit = order[(best >= length) & (low[order] <= level) & (high[order] >= level)]
        if hit.size:
            found.append((hit, np.full(hit.size, level)))
        stay = np.flatnonzero((high[order] > level) & (best + (high[order] - level) >= length))
        if not stay.size:
            break
        items = order[stay]
        key = bucket[items].astype(np.int64) * 256 + left[items, level]
        by_key = np.argsort(key, kind="stable")
        place, key = stay[by_key], key[by_key]
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        longer = np.zeros(place.size, np.int32)
        longer[same] = least_between(prefix, place[same - 1], place[same]) + 1
        order, prefix, level = items[by_key], longer, level + 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


class ByteQueues:
    """One first-in first-out queue per byte of (suffix, common prefix) blocks, read in order of the byte.

    Blocks stay in memory until all together pass ``in_memory`` entries and go to a scratch file then.
    """

    def __init__(self, in_memory: int):
        self.in_memory, self.held, self.file = in_memory, 0, None
        self.blocks: dict[int, list] = {}

    def put(self, byte: int, items: np.ndarray, prefix: np.ndarray) -> None:
        block = np.stack([items, prefix]).astype(np.int64)
        self.held += items.size
        if self.held <= self.in_memory:
            self.blocks.setdefault(byte, []).append(block)
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        self.file.write(block.tobytes())
        self.blocks.setdefault(byte, []).append((at, items.size))

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for byte in sorted(self.blocks):
            for block in self.blocks[byte]:
                if isinstance(block, tuple):
                    self.file.seek(block[0])
                    block = np.frombuffer(self.file.read(16 * block[1]), np.int64).reshape(2, -1)
                yield block[0], block[1].astype(np.int32)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class StoredSuffixes:
    """What belongs to the suffixes of a large bucket, one record each in a scratch file."""

    def __init__(self, width: int):
        fields = [("low", "i4"), ("high", "i4"), ("start", "i4"), ("alone", "?"), ("no_id", "?"), ("doc_id", "i8"), ("text_hash", "i8")]
        self.kind = np.dtype([*fields, ("left", "u1", (width,))])
        self.file, self.count = tempfile.TemporaryFile(), 0

    def add(self, left: np.ndarray, **columns: np.ndarray) -> None:
        records = np.zeros(len(left), self.kind)
        records["left"][:, : left.shape[1]] = left
        for name, values in columns.items():
            records[name] = values
        self.file.write(records.tobytes())
        self.count += len(left)

    def open(self) -> np.memmap:
        self.file.flush()
        return np.memmap(self.file, self.kind, "r", shape=(self.count,))


def induce_on_disk(first: ByteQueues, stored: np.ndarray, length: int, in_memory: int) -> Iterator[tuple[np.ndarray, int]]:
    """As ``induce``, for one bucket of any size: (suffixes, level), the queues of a level filling those of the next."""
    queues, level = first, 0
    while True:
        after = ByteQueues(in_memory)
        # Least common prefix since the last suffix that went to each byte's queue; -1: none went there yet.
        since = np.full(256, -1, np.int64)
        last = None  # the suffix before this block, and whether its match is already known
        for items, prefix in queues:
            long = prefix >= length
            matched = long | np.append(long[1:], False)
            if last is not None and long[0] and not last[1]:
                yield from _owned(np.array([last[0]]), stored, level)
            last = (int(items[-1]), bool(matched[-1]))
            yield from _owned(items[matched], stored, level)
            stay = np.flatnonzero(stored["high"][items] > level)
            running = np.minimum.accumulate(prefix)
            earlier, since = since, np.where(since >= 0, np.minimum(since, running[-1]), -1)
            if not stay.size:
                continue
            byte = stored["left"][items[stay], level]
            by_byte = np.argsort(byte, kind="stable")
            place, byte = stay[by_byte], byte[by_byte]
            longer = np.zeros(place.size, np.int32)
            new = np.append(True, byte[1:] != byte[:-1])
            same = np.flatnonzero(~new)
            longer[same] = least_between(prefix, place[same - 1], place[same]) + 1
            onward = np.append(np.minimum.accumulate(prefix[::-1])[::-1][1:], 1 << 30)
            starts = np.flatnonzero(new)
            for s, e in zip(starts, np.append(starts[1:], place.size)):
                queue = int(byte[s])
                if earlier[queue] >= 0:
                    longer[s] = min(earlier[queue], running[place[s]]) + 1
                after.put(queue, items[place[s:e]], longer[s:e])
                since[queue] = onward[place[e - 1]]
        queues.close()
        if not after.blocks:
            return
        queues, level = after, level + 1


def _owned(items: np.ndarray, stored: np.ndarray, level: int) -> Iterator[tuple[np.ndarray, int]]:
    own = items[(stored["low"][items] <= level) & (stored["high"][items] >= level)]
    if own.size:
        yield own, level


# ---- the Spark part ------------------------------------------------------------------------------------

_SUFFIXES = "bucket bigint, suffix binary, behind binary, doc_id bigint, text_hash bigint, start int, low int, high int, alone boolean"
_RANGES = "doc_id bigint, text_hash bigint, start int, stop int"


def lane_bounds(lanes: int, levels: int) -> list[tuple[int, int]]:
    cuts = [levels * k // lanes for k in range(lanes + 1)]
    return [(x, y) for x, y in zip(cuts, cuts[1:]) if y > x]


def open_suffixes(texts: DataFrame, wanted: DataFrame, limits: Limits) -> DataFrame:
    """The suffixes to sort, with the bytes to their left: one row per context and lane."""
    levels = limits.length - limits.gram + 1
    one, many = lane_bounds(1, levels), lane_bounds(limits.lanes, levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SUFFIXES.split(", ")]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            out: list[tuple] = []
            for doc_id, text_hash, cell, places in zip(*(batch[c] for c in ("doc_id", "text_hash", "text", "places"))):
                data, doc_id, text_hash = _bytes(cell), doc_id.as_py(), text_hash.as_py()
                for x in places.as_py():
                    p, a, b = x["p"], x["a"], x["b"]
                    for start, stop in many if x["hot"] else one:
                        low, high = max(p - b, start), min(p - a, stop - 1)
                        if low > high:
                            continue
                        at = p - start
                        core = data[at : p + limits.length - stop + 1]
                        bucket = xxhash.xxh3_64_intdigest(core, start) - (1 << 63)
                        behind = data[p - high : at][::-1]
                        out.append((bucket, data[at : at + limits.length], behind, doc_id, text_hash, at, low - start, high - start, x["n"] == 1))
                if len(out) >= 5_000:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

    own = wanted.groupBy(F.col("doc_id").alias("id_w"), F.col("text_hash").alias("hash_w")).agg(
        F.collect_list(F.struct("p", "a", "b", "n", "hot")).alias("places")
    )
    same = texts["doc_id"].eqNullSafe(own["id_w"]) & (texts["text_hash"] == own["hash_w"])
    return texts.join(own, same).select("doc_id", "text_hash", "text", "places").mapInArrow(run, _SUFFIXES)


def _left_bytes(rows: pa.Table) -> np.ndarray:
    behind = [x.as_py() for x in rows["behind"]]
    width = max(1, max(map(len, behind)))
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in behind), np.uint8).reshape(len(behind), width)


class _LargeBucket:
    """A bucket that goes to disk while its sorted suffixes come in."""

    def __init__(self, key: int, length: int):
        self.key, self.length, self.last = key, length, b""
        self.queue, self.stored = ByteQueues(0), StoredSuffixes(length)

    def add(self, rows: pa.Table) -> None:
        if not rows.num_rows:
            return
        strings = [x.as_py() for x in rows["suffix"]]
        prefix = common_prefixes([self.last, *strings], np.zeros(0, int), self.length)[1:]
        self.last = strings[-1]
        self.queue.put(0, self.stored.count + np.arange(len(strings)), prefix)
        ids = rows["doc_id"]
        self.stored.add(
            _left_bytes(rows), doc_id=ids.fill_null(0).to_numpy(), no_id=ids.is_null().to_numpy(),
            **{c: rows[c].to_numpy() for c in ("low", "high", "start", "alone", "text_hash")},
        )


def repeated_ranges(suffixes: DataFrame, limits: Limits) -> DataFrame:
    """Byte ranges covered by the repeated windows of contexts that occur once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ranges(rows: pa.Table, item: np.ndarray, level: np.ndarray) -> Iterator[pa.RecordBatch]:
            item, level = item[(alone := rows["alone"].to_numpy())[item]], level[alone[item]]
            if not item.size:
                return
            order = np.lexsort((-level, item))
            item, level = item[order], level[order]
            start = rows["start"].to_numpy()[item] - level
            new = np.append(True, (item[1:] != item[:-1]) | (start[1:] != start[:-1] + 1))
            head = np.flatnonzero(new)
            tail = np.append(head[1:], item.size) - 1
            place = pa.array(item[head])
            yield pa.RecordBatch.from_arrays(
                [rows["doc_id"].combine_chunks().take(place), rows["text_hash"].combine_chunks().take(place),
                 pa.array(start[head].astype(np.int32)), pa.array((start[tail] + limits.length).astype(np.int32))],
                ["doc_id", "text_hash", "start", "stop"],
            )

        def in_arrays(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            key = rows["bucket"].to_numpy()
            new = np.append(True, key[1:] != key[:-1])
            prefix = common_prefixes([x.as_py() for x in rows["suffix"]], new, limits.length)
            low, high = rows["low"].to_numpy(), rows["high"].to_numpy()
            yield from ranges(rows, *induce(np.cumsum(new), prefix, _left_bytes(rows), low, high, limits.length))

        def stored_ranges(bucket: "_LargeBucket") -> Iterator[pa.RecordBatch]:
            stored = bucket.stored.open()
            for item, level in induce_on_disk(bucket.queue, stored, limits.length, limits.in_memory):
                rows = stored[item[stored["alone"][item]]]
                if rows.size:
                    start = rows["start"] - level
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows["doc_id"], mask=rows["no_id"]), pa.array(rows["text_hash"]),
                         pa.array(start.astype(np.int32)), pa.array((start + limits.length).astype(np.int32))],
                        ["doc_id", "text_hash", "start", "stop"],
                    )

        # Whole buckets are worked on together; one that alone passes the limit goes to disk as it comes in.
        held, count, large = [], 0, None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if large is not None:
                more = int((rows["bucket"].to_numpy() == large.key).sum())
                large.add(rows.slice(0, more))
                rows = rows.slice(more)
                if not rows.num_rows:
                    continue
                yield from stored_ranges(large)
                large = None
            held.append(rows)
            count += rows.num_rows
            if count > limits.in_memory:
                rows = pa.concat_tables(held)
                key = rows["bucket"].to_numpy()
                cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
                if cut:
                    yield from in_arrays(rows.slice(0, cut))
                held, count = [rows.slice(cut)], rows.num_rows - cut
                if count > limits.in_memory:
                    large = _LargeBucket(int(key[-1]), limits.length)
                    large.add(held.pop())
                    count = 0
        if large is not None:
            yield from stored_ranges(large)
        if count:
            yield from in_arrays(pa.concat_tables(held))

    return suffixes.repartition("bucket").sortWithinPartitions("bucket", "suffix").mapInArrow(run, _RANGES)


def repeated_spans(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, text_hash and a byte range of the text that is to go; ranges of a text may touch or overlap."""
    texts = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    anchors = stage(find_anchors(texts, limits), "suffix-anchors")
    # Counts of grams are written before they are joined: a hot gram's rows are split by adaptive execution only if both sides of a join come from a shuffle.
    shared = stage(anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"), "suffix-grams")
    anchors = stage(anchors.join(shared, "gram", "left_semi"), "suffix-shared")
    contexts = anchors.groupBy("gram", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_hash", "p", "a", "b")).alias("one")
    )
    contexts = stage(contexts, "suffix-contexts")
    stop = (F.col("b") + limits.length).alias("stop")
    whole = anchors.join(contexts.filter("n > 1").select("gram", "context"), ["gram", "context"], "left_semi")
    whole = whole.select("doc_id", "text_hash", F.col("a").alias("start"), stop)
    unclear = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("contexts"), F.min("n").alias("least"))
    unclear = unclear.filter("contexts > 1 and least = 1").select("gram", (F.col("contexts") > limits.lanes_from).alias("hot"))
    unclear = stage(unclear, "suffix-unclear")
    wanted = contexts.join(unclear, "gram").select("one.*", "n", "hot")
    parts = repeated_ranges(open_suffixes(texts, wanted, limits), limits)
    return whole.unionByName(parts)


_KEPT = "doc_id bigint, n_bytes bigint, spans array<struct<start: bigint, stop: bigint>>, kept binary"


def remove_repeats(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, the removed byte ranges (maximal, in order) and the bytes kept."""
    spans = stage(repeated_spans(docs, limits), "suffix-ranges")
    own = spans.groupBy(F.col("doc_id").alias("id_s"), F.col("text_hash").alias("hash_s")).agg(
        F.collect_set(F.struct("start", "stop")).alias("ranges")
    )
    texts = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    same = texts["doc_id"].eqNullSafe(own["id_s"]) & (texts["text_hash"] == own["hash_s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for cell, ranges in zip(batch["text"], batch["ranges"]):
                data, runs = _bytes(cell), []
                for x in sorted((r["start"], r["stop"]) for r in ranges.as_py() or []):
                    if runs and x[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x[1])
                    else:
                        runs.append(list(x))
                edges = [0, *(e for r in runs for e in r), len(data)]
                sizes.append(len(data))
                spans.append([{"start": s, "stop": e} for s, e in runs])
                kept.append(b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2])))
            span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"],
            )

    return texts.join(own, same, "left").select("doc_id", "text", "ranges").mapInArrow(run, _KEPT)
