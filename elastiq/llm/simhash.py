"""SimHash near-duplicates with Golay-code keys.

1. A text's fingerprint has 64 bits: the majority of the bits of the XXH64 values of its word shingles, repeats included. Equal
   fingerprints form one node, so copies are never compared.
2. A fingerprint is cut into three segments of at most 23 bits. The perfect Golay code of 23 bits decodes any segment to the index of
   the one codeword within three bits of it. A segment with an odd number of ones also takes the indices that it has with any
   one bit turned over (six as a rule), one with an even number only its own. So two segments that are equal, or differ in one bit,
   share an index: they are the same, or one of them is odd and reaches the index of the other.
3. Pigeonhole: three differing bits are spread over the segments so that either no segment has more than one, or one segment has at
   least two and the other two at most one between them. Keys are therefore the triples of indices, and for each two
   segments the whole of one with the indices of the other: about 50 keys of 33 to 36 bits per fingerprint, and every link shares one.
4. Fingerprints under one key are not paired off. Each is held against one of them, chosen by a hash, which joins dense groups.
   After ``rounds`` of that, fingerprints of one key are compared where they are still in different components, so no link is
   lost, and only links that join two components come out. Every pair is verified by counting the bits that differ.
5. Links become components; each gets the least doc_id that it holds.

Defined results: null and empty texts have fingerprint zero and link like any other; fewer words than ``width`` make one shingle; texts
of any length are hashed piece by piece. Rows that share a doc_id are one vertex, with as many fingerprints as it has texts. Rows
without doc_id get the component of their fingerprint, or null where no row with an id has it. Other columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from elastiq.llm.graph import components
from elastiq.sources.staging import stage

SEED = 42
_PIECE = 1 << 20
_BLANKS = b" \t\n\r\x0b\x0c"
# Lowest bit and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


@dataclass(frozen=True)
class Limits:
    """Words per shingle; bits, at most three, for which the keys are made; rounds before the comparison of what is left."""

    width: int = 3
    bits: int = 3
    rounds: int = 1


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words, lower-cased, piece by piece."""
    at = 0
    while at < len(data):
        stop = min(len(data), at + _PIECE)
        while stop < len(data) and data[stop] not in _BLANKS:
            stop += 1
        yield data[at:stop].lower().split()
        at = stop


def fingerprint(data: bytes, width: int = 3) -> int:
    """The majority of each bit over the hashes of all shingles; zero for a text without words."""
    ones, n, before = np.zeros(64, np.int64), 0, []
    for words in _pieces(data):
        words = before + words
        if len(words) < width:
            before = words
            continue
        shingles = zip(*(words[k:] for k in range(width)))
        values = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles), np.uint64, len(words) - width + 1)
        for part in np.array_split(values, max(1, values.size >> 16)):
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += values.size
        before = words[len(words) - width + 1 :]
    if n == 0:
        return xxhash.xxh64_intdigest(b" ".join(before), SEED) if before else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


class Golay:
    """The perfect binary code of 23 bits, 12 of them free, that corrects three errors."""

    GENERATOR = 0b101011100011  # fixed value: a generator polynomial of the code

    def __init__(self) -> None:
        self.syndrome_of_bit = [self._remainder(1 << k) for k in range(23)]
        self.error = np.zeros(2048, np.int64)
        for a in range(23):
            for b in range(a, 23):
                for c in range(b, 23):  # equal places stand for fewer errors
                    error = (1 << a) | (1 << b) | (1 << c)
                    self.error[self._remainder(error)] = error

    def _remainder(self, word: int) -> int:
        for k in range(22, 10, -1):
            if word >> k & 1:
                word ^= self.GENERATOR << (k - 11)
        return word

    def syndromes(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(words.shape, np.int64)
        for k, syndrome in enumerate(self.syndrome_of_bit):
            out ^= (words >> k & 1) * syndrome
        return out

    def indices(self, words: np.ndarray, bits: int) -> np.ndarray:
        """Per word its index and those with one of the lower ``bits`` turned over; for even words only the first counts."""
        own = self.syndromes(words)
        out = np.empty((words.size, bits + 1), np.int64)
        out[:, 0] = (words ^ self.error[own]) >> 11
        for k in range(bits):
            out[:, k + 1] = (words ^ (1 << k) ^ self.error[own ^ self.syndrome_of_bit[k]]) >> 11
        even = np.bitwise_count(words.astype(np.uint64)) % 2 == 0
        out[even] = out[even, :1]
        return out


@cache
def golay() -> Golay:
    return Golay()


def keys_of(fingerprints: np.ndarray) -> list[list[int]]:
    """The keys of each fingerprint (unsigned). The upper bits of a key tell which segments it is made of."""
    parts = [(fingerprints >> np.uint64(low) & np.uint64((1 << bits) - 1)).astype(np.int64) for low, bits in SEGMENTS]
    near = [golay().indices(part, bits) for part, (_, bits) in zip(parts, SEGMENTS)]
    out = []
    for k in range(fingerprints.size):
        whole, some = [int(p[k]) for p in parts], [set(n[k].tolist()) for n in near]
        keys = [a << 24 | b << 12 | c for a in some[0] for b in some[1] for c in some[2]]
        for i in range(3):
            for j in range(3):
                if i != j:
                    keys += [(1 + 3 * i + j) << 40 | whole[i] << 12 | index for index in some[j]]
        out.append(keys)
    return out


def fingerprints(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, fingerprint (the 64 bits as a bigint) per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (cell.as_buffer() for cell in batch["text"])
            own = np.fromiter((fingerprint(b.to_pybytes(), limits.width) if b is not None else 0 for b in texts), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(own.view(np.int64))], ["doc_id", "fingerprint"])

    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, fingerprint bigint")


def keyed(nodes: DataFrame) -> DataFrame:
    """key, node, own per fingerprint ``own`` of a node and each of its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch["own"].to_numpy()
            for at in range(0, own.size, 1000):
                keys = keys_of(own[at : at + 1000].view(np.uint64))
                times = [len(k) for k in keys]
                columns = [np.concatenate(keys).astype(np.int64) if keys else np.zeros(0, np.int64)]
                columns += [np.repeat(batch[c].to_numpy()[at : at + 1000], times) for c in ("node", "own")]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "own"])

    return nodes.select("node", "own").mapInArrow(run, "key bigint, node bigint, own bigint")


def _near(a: str, b: str, limits: Limits) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= limits.bits


def _open(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists with each node's component, without lists that lie in one component: those are done with."""
    at = lists.select("key", "node", "own").join(labels.withColumnRenamed("node", "labelled"), F.col("node") == F.col("labelled"), "left")
    at = at.select("key", "node", "own", F.coalesce("component", "node").alias("component"))
    mixed = at.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    return at.join(mixed.select(F.col("key").alias("mixed")), F.col("key") == F.col("mixed"), "left_semi")


def hub_links(lists: DataFrame, limits: Limits, seed: int) -> DataFrame:
    """Links of each node with one node of each of its lists, if in another component."""
    one = F.min(F.struct(F.xxhash64("node", F.lit(seed)).alias("h"), "node", "own", "component")).alias("hub")
    hubs = lists.groupBy("key").agg(one).select(F.col("key").alias("at"), "hub.node", "hub.own", "hub.component")
    hubs = hubs.toDF("at", "hub", "hub_own", "hub_component")
    test = (F.col("key") == F.col("at")) & (F.col("component") != F.col("hub_component")) & _near("own", "hub_own", limits)
    return lists.join(hubs, test).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()


def crossing_links(lists: DataFrame, limits: Limits) -> DataFrame:
    """All links between nodes of a list that lie in different components."""
    other = lists.toDF("at", "b", "other_own", "other")
    test = (F.col("key") == F.col("at")) & (F.col("component") < F.col("other")) & _near("own", "other_own", limits)
    return lists.join(other, test).select(F.col("node").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id per row of ``docs``."""
    rows = stage(fingerprints(docs, limits), "simhash-rows")
    nodes = rows.groupBy(F.col("fingerprint").alias("own")).agg(F.min("doc_id").alias("node"))
    nodes = stage(nodes.filter("node is not null"), "simhash-nodes")
    lists = keyed(nodes)
    # Most keys are one fingerprint's alone; they go before anything is joined.
    shared = lists.groupBy("key").agg(F.min("own").alias("low"), F.max("own").alias("high")).filter("low < high")
    lists = stage(lists.join(shared.select(F.col("key").alias("shared")), F.col("key") == F.col("shared"), "left_semi"), "simhash-lists")

    # Texts under one id are one vertex, whatever their fingerprints: the node of each leads to the others.
    twice = rows.groupBy("doc_id").agg(F.min("fingerprint").alias("low"), F.max("fingerprint").alias("high")).filter("low < high")
    several = rows.join(twice.select(F.col("doc_id").alias("twice")), F.col("doc_id") == F.col("twice"), "left_semi")
    links = several.join(nodes, F.col("fingerprint") == F.col("own")).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    labels = stage(components(links), "simhash-labels")
    for seed in range(limits.rounds + 1):
        lists = stage(_open(lists, labels), "simhash-open")
        found = hub_links(lists, limits, seed) if seed < limits.rounds else crossing_links(lists, limits)
        links = found.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        labels = stage(components(links), "simhash-labels")

    ids = nodes.join(labels.withColumnRenamed("node", "labelled"), F.col("node") == F.col("labelled"), "left")
    ids = ids.select("own", F.coalesce("component", "node").alias("component_id"))
    out = rows.join(ids, F.col("fingerprint") == F.col("own"), "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
