"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum over all its
segmentations, by the forward algorithm, and a text's is the product over its words. Piece probabilities are learned by
expectation maximisation: forward and backward sums give every piece's expected count in the training words of a language.

Learning takes about ``sample`` documents per language (a documented bound; rows are chosen by a hash of their id), counts their
words, and runs a few rounds over the distinct words, all on Spark; the driver only sees one number per language and piece. Scoring
covers whole texts: words are lower-cased runs of letters, and words longer than ``LONGEST`` characters are cut there. Words are
worked out in arrays, all new words of a batch at once, and remembered in a table of bounded size.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is every text if there is nothing to learn
from; ties go to the first language by name; rows without lang or doc_id are not learned from; equal rows have equal results;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from elastiq.llm.common import held_out, may_learn
from elastiq.llm.tokens import BLANK
from elastiq.sources.staging import stage

UNKNOWN = "und"
LONGEST = 32
_REMEMBERED = 150_000
_FALLBACK = 1e-8
_SMOOTH = 0.05
_RUN = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, cut at ``LONGEST``; digits of any script alone are not words."""
    words = _RUN.findall(text.lower()) if text else []
    if any(len(w) >= LONGEST for w in words):
        words = [w[k : k + LONGEST - 1] for w in words for k in range(0, len(w), LONGEST - 1)]
    return words


def has_letter(words: list[str]) -> bool:
    return any(c.isalpha() for w in words for c in w)


class PieceModel:
    """Piece probabilities by language: ``table`` has a row per piece, one for a missing piece and one for a lone character."""

    def __init__(self, pieces: list[str], table: np.ndarray):
        self.place = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        none = np.zeros((1, table.shape[1]))
        self.table = np.concatenate([table, none, none + _FALLBACK])

    def _places(self, words: list[str], i: int, j: int) -> np.ndarray:
        missing = len(self.place) + (j - i == 1)
        return np.fromiter((self.place.get(w[i:j], missing) for w in words), np.int64, len(words))

    def _by_length(self, words: list[str]) -> Iterator[tuple[int, np.ndarray, list[str]]]:
        groups = defaultdict(list)
        for k, w in enumerate(words):
            groups[len(w) + 1].append(k)
        for length, own in groups.items():
            for at in range(0, len(own), 4096):
                part = own[at : at + 4096]
                yield length, np.array(part), [BLANK + words[k] for k in part]

    def forward(self, marked: list[str], length: int) -> tuple[np.ndarray, dict]:
        """Sums over the segmentations of every beginning, and the piece of every span that has one."""
        sums = np.zeros((length + 1, len(marked), self.table.shape[1]))
        sums[0], spans = 1.0, {}
        for j in range(1, length + 1):
            for i in range(max(0, j - self.longest), j):
                places = self._places(marked, i, j)
                if j - i == 1 or (places < len(self.place)).any():
                    spans[i, j] = places
                    sums[j] += sums[i] * self.table[places]
        return sums, spans

    def log_scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.table.shape[1]))
        for length, rows, marked in self._by_length(words):
            out[rows] = np.log(self.forward(marked, length)[0][length])
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece; ``counts`` (words x languages) says how often each word occurs."""
        total = np.zeros_like(self.table)
        for length, rows, marked in self._by_length(words):
            ahead, spans = self.forward(marked, length)
            back = np.zeros_like(ahead)
            back[length] = counts[rows] / ahead[length]
            for i in range(length - 1, -1, -1):
                for j in range(i + 1, min(length, i + self.longest) + 1):
                    if (i, j) in spans:
                        uses = self.table[spans[i, j]] * back[j]
                        back[i] += uses
                        np.add.at(total, spans[i, j], ahead[i] * uses)
        return total[: len(self.place)]


def _training_words(docs: DataFrame, sample: int) -> DataFrame:
    """word, lang, n: words of about ``sample`` documents of each language."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & may_learn(F.col("doc_id")))
    sizes = known.groupBy(F.col("lang").alias("of")).agg(F.count(F.lit(1)).alias("n_docs"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    chosen = known.join(sizes, F.col("lang") == F.col("of")).filter(place * F.col("n_docs") < sample).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter()
            for lang, text in zip(batch["lang"], batch["text"]):
                lang = lang.as_py()
                counts.update((w, lang) for w in words_of(text.as_py()))
            if counts:
                words, langs = zip(*counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words), pa.array(langs), pa.array(counts.values(), pa.int64())], ["word", "lang", "n"]
                )

    return chosen.mapInArrow(run, "word string, lang string, n bigint").groupBy("word", "lang").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, pieces: list[str], sample: int = 1000, rounds: int = 2) -> tuple[list[str], np.ndarray]:
    """The languages, by name, and their piece probabilities (pieces x languages)."""
    spark = docs.sparkSession
    words = stage(_training_words(docs, sample), "language-words")
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    table = np.full((len(pieces), len(langs)), 1 / max(1, len(pieces)))
    place = {name: k for k, name in enumerate(langs)}
    for _ in range(rounds if langs else 0):
        shared = spark.sparkContext.broadcast((pieces, table))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, total = PieceModel(*shared.value), None
            for batch in batches:
                counts = np.zeros((batch.num_rows, len(langs)))
                counts[np.arange(batch.num_rows), [place[x.as_py()] for x in batch["lang"]]] = batch["n"].to_numpy()
                own = model.expected(batch["word"].to_pylist(), counts)
                total = own if total is None else total + own
            if total is not None:
                piece, lang = np.nonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(piece.astype(np.int64)), pa.array(lang.astype(np.int64)), pa.array(total[piece, lang])], ["piece", "lang", "uses"]
                )

        uses = words.mapInArrow(run, "piece bigint, lang bigint, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses"))
        table = np.full(table.shape, _SMOOTH)
        for row in uses.toLocalIterator():
            table[row["piece"], row["lang"]] += row["uses"]
        table /= table.sum(axis=0)
    return langs, table


def identify(docs: DataFrame, pieces: list[str], sample: int = 1000) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score (the posterior under equal priors)."""
    langs, table = learn(docs, pieces, sample)
    shared = docs.sparkSession.sparkContext.broadcast((pieces, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(*shared.value)
        place: dict[str, int] = {}
        scores = np.zeros((0, len(langs)))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [words_of(x.as_py()) for x in part["text"]]
                if len(place) > _REMEMBERED:
                    place, scores = {}, scores[:0]
                new = list({w for words in texts for w in words if w not in place})
                place.update(zip(new, range(len(place), len(place) + len(new))))
                scores = np.concatenate([scores, model.log_scores(new)])
                preds, sure = [], []
                for words in texts:
                    if not langs or not has_letter(words):
                        preds.append(UNKNOWN)
                        sure.append(0.0)
                        continue
                    total = scores[[place[w] for w in words]].sum(axis=0)
                    best = int(total.argmax())
                    preds.append(langs[best])
                    sure.append(float(1 / np.exp(total - total[best]).sum()))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["held_out"], pa.array(preds, pa.string()), pa.array(sure, pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    texts = docs.select(F.col("doc_id").cast("bigint"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return texts.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
