"""Ranked lexical search that groups each item's documents by the mask of terms that they hold.

1. Items (the query set) are taken in blocks of ``items_per_block``; what the driver and the tasks hold of them is one block's
   distinct terms. Items of a block are cut further where their texts exceed ``block_chars``.
2. One pass over the corpus makes an index: per document its length and the frequencies of the block's terms, written to
   the shared folder. Corpus counts (N, L and df) are aggregates over it.
3. Each task reads its documents in blocks and turns the index round: per term a bitmap of the documents that hold it, and its
   score in each. For an item the bitmaps of its terms, packed eight terms to a byte and turned by 90 degrees, give every document
   its presence mask. Documents are grouped by mask. The most that a mask can score is the sum of the highest scores of its
   terms in the block.
4. Masks are evaluated by descending maximum until the tenth score that the task has found so far is above the maximum
   of the next one. Equal maxima are evaluated, since ties are decided by doc_id. No document that could rank is skipped.
5. The best of each task are ranked by item; at most ``limit`` rows per task and item are shuffled.

Scores are 64-bit integers, so they do not depend on the order of additions.

Defined results: null and empty texts have no terms, so documents have no score and items no results. Rows that repeat are documents,
or items, of their own; items with the same item_id are ranked each for itself. Equal scores go by doc_id, null last.
Long texts count whole, with memory for one text's terms. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from elastiq.sources.staging import stage

# In UTF-8 every byte of a character beyond ASCII is above 0x7F.
_TERM = re.compile(rb"[0-9a-z\x80-\xFF]+")
_NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Limits:
    """Results per item; items, characters of items, documents and postings per block. Only the first changes a result."""

    limit: int = 10
    items_per_block: int = 2000
    block_chars: int = 1 << 26
    block_documents: int = 1 << 15
    block_postings: int = 1 << 22


def terms_of(data: bytes) -> list[bytes]:
    """The terms in order, A-Z lower-cased."""
    return _TERM.findall(data.lower())


@dataclass(frozen=True)
class Query:
    """A block of items: their distinct terms, and per item its number in the query set and the places of its terms."""

    terms: list[bytes]
    items: list[tuple[int, np.ndarray]]

    @staticmethod
    def of(texts: Sequence[tuple[int, bytes]]) -> Query:
        own = [(number, sorted(set(terms_of(data)))) for number, data in texts]
        terms = sorted({t for _, ts in own for t in ts})
        place = {t: k for k, t in enumerate(terms)}
        return Query(terms, [(number, np.array([place[t] for t in ts], np.int64)) for number, ts in own if ts])


def index(docs: DataFrame, query: Query) -> DataFrame:
    """doc_id, n_terms, terms (places in ``query.terms``), counts per document that has any term at all."""
    place = {t: k for k, t in enumerate(query.terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, cell in zip(batch["doc_id"], batch["text"]):
                buffer = cell.as_buffer()
                found = terms_of(buffer.to_pybytes()) if buffer is not None else []
                if found:
                    counts = Counter(found)
                    held = sorted(place[t] for t in counts.keys() & place.keys())
                    rows.append((doc_id.as_py(), len(found), held, [counts[query.terms[k]] for k in held]))
            columns = list(zip(*rows)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            names = ["doc_id", "n_terms", "terms", "counts"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, n_terms bigint, terms array<int>, counts array<bigint>")


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, terms of all of them, and the weight of each of the query's terms."""

    n_documents: int
    n_terms: int
    weights: np.ndarray


def corpus_counts(indexed: DataFrame, query: Query) -> Corpus:
    n, total = indexed.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    held = indexed.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # a row per query term at most
    weights = np.zeros(len(query.terms), np.int64)
    for term, df in held:
        weights[term] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
    return Corpus(n, total, weights)


class Block:
    """Some documents turned round: for each term the documents that hold it, and its score in each."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, owner: np.ndarray, terms: np.ndarray, counts: np.ndarray, corpus: Corpus) -> None:
        self.ids = ids
        # 64-bit integers as the formula has them; lengths and counts are positive.
        m = 100 - 90 + (90 * lengths * corpus.n_documents) // corpus.n_terms
        order = np.lexsort((owner, terms))
        terms, self.owner = terms[order], owner[order]
        part = (1_000_000_000 * counts[order]) // (1000 * counts[order] + 8 * m[self.owner])
        self.score = corpus.weights[terms] * part
        self.start = np.searchsorted(terms, np.arange(corpus.weights.size + 1))

    def masks(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents in order of mask, where each group of them starts, its mask (a row of bits), and the most it can score."""
        bitmaps = np.zeros((terms.size, self.ids.size), bool)
        highest = np.zeros(terms.size, np.int64)
        for k, term in enumerate(terms):
            own = slice(self.start[term], self.start[term + 1])
            bitmaps[k, self.owner[own]] = True
            highest[k] = self.score[own].max(initial=0)
        held = np.flatnonzero(bitmaps.any(axis=0))
        turned = np.packbits(bitmaps[:, held], axis=0).T
        padded = np.zeros((held.size, -(-terms.size // 64) * 8), np.uint8)
        padded[:, : turned.shape[1]] = turned
        words = padded.view(np.uint64)
        order = np.lexsort(words.T)
        words, held = words[order], held[order]
        new = np.ones(held.size, bool)
        new[1:] = (words[1:] != words[:-1]).any(axis=1)
        start = np.flatnonzero(new)
        bits = np.unpackbits(np.ascontiguousarray(words[start]).view(np.uint8), axis=1)[:, : terms.size].astype(bool)
        return held, np.append(start, held.size), bits, bits @ highest

    def score_of(self, documents: np.ndarray, bits: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Exact scores of documents of one mask."""
        total = np.zeros(documents.size, np.int64)
        for term in terms[bits]:
            low, high = self.start[term], self.start[term + 1]
            total += self.score[low + np.searchsorted(self.owner[low:high], documents)]
        return total

    def rank(self, terms: np.ndarray, best: list[tuple[int, int]], limit: int) -> int:
        """Add this block's candidates to the heap ``best`` of (score, negative id); gives the number of masks evaluated."""
        documents, start, bits, most = self.masks(terms)
        done = 0
        for group in np.argsort(-most, kind="stable"):
            if most[group] <= 0 or (len(best) == limit and most[group] < best[0][0]):
                break
            own = np.sort(documents[start[group] : start[group + 1]])
            done += 1
            for score, doc in zip(self.score_of(own, bits[group], terms).tolist(), own.tolist()):
                entry = (score, -int(self.ids[doc]))
                if score > 0 and len(best) < limit:
                    heapq.heappush(best, entry)
                elif score > 0 and entry > best[0]:
                    heapq.heapreplace(best, entry)
        return done


_FOUND = "number bigint, doc_id bigint, score bigint"


def best_of_tasks(indexed: DataFrame, query: Query, corpus: Corpus, limits: Limits) -> DataFrame:
    """number (of the item), doc_id, score: the best documents of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in query.items]

        def search(parts: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(parts)
            ids = table["doc_id"].fill_null(_NO_ID).to_numpy()
            sizes = pc.list_value_length(table["terms"]).to_numpy()
            flat = [pc.list_flatten(table[c]).to_numpy().astype(np.int64) for c in ("terms", "counts")]
            block = Block(ids, table["n_terms"].to_numpy(), np.repeat(np.arange(ids.size), sizes), *flat, corpus)
            for (_, terms), found in zip(query.items, best):
                block.rank(terms, found, limits.limit)

        parts, documents, postings = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, limits.block_documents):
                parts.append(batch.slice(at, limits.block_documents))
                documents += parts[-1].num_rows
                postings += pc.sum(pc.list_value_length(parts[-1]["terms"])).as_py() or 0
                if documents >= limits.block_documents or postings >= limits.block_postings:
                    search(parts)
                    parts, documents, postings = [], 0, 0
        if documents:
            search(parts)
        rows = [(n, None if i == -_NO_ID else -i, s) for (n, _), found in zip(query.items, best) for s, i in found]
        columns = list(zip(*rows)) or [[]] * 3
        names = ["number", "doc_id", "score"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    # Documents without any of the terms were needed for the counts only.
    return indexed.filter(F.size("terms") > 0).mapInArrow(run, _FOUND)


def query_blocks(items: DataFrame, limits: Limits) -> Iterator[Query]:
    """The query set block by block; ``items`` has number and text. The driver holds one block's texts at a time."""
    rows: list[tuple[int, bytes]] = []
    chars = 0
    for row in items.select("number", F.col("text").cast("binary").alias("text")).toLocalIterator():
        data = bytes(row["text"]) if row["text"] is not None else b""
        if rows and (len(rows) == limits.items_per_block or chars + len(data) > limits.block_chars):
            yield Query.of(rows)
            rows, chars = [], 0
        rows.append((row["number"], data))
        chars += len(data)
    if rows:
        yield Query.of(rows)


def search(docs: DataFrame, items: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """item_id, rank, doc_id, score: the highest-scoring documents of each item."""
    spark: SparkSession = docs.sparkSession
    numbered = stage(items.select("item_id", "text", F.monotonically_increasing_id().alias("number")), "ranking-items")
    found = spark.createDataFrame([], _FOUND)
    for query in query_blocks(numbered, limits):
        if query.items:
            indexed = stage(index(docs, query), "ranking-index")
            corpus = corpus_counts(indexed, query)
            if corpus.n_documents:
                found = found.unionByName(best_of_tasks(indexed, query, corpus, limits))
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limits.limit)
    named = numbered.select("item_id", F.col("number").alias("own"))
    return ranked.join(named, F.col("number") == F.col("own")).select("item_id", "rank", "doc_id", "score")
