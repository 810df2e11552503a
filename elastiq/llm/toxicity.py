"""Toxicity: a learned lexicon in a trie, met by Levenshtein automata, with context windows around each hit.

1. *Lexicon.* Words, and beginnings of words (written ``begin*``), of labelled training texts that occur much more often in
   toxic ones (by rate and by likelihood ratio) become terms. About ``toxic_sample`` toxic and ``other_sample`` other labelled rows are used, chosen by a hash of the id: the
   documented bound of the classifier's sample.
2. *Misspellings.* A word is run as a Levenshtein automaton (bit-parallel, up to one edit from five letters on, two from nine)
   down the trie of terms; branches where no state survives are left out. Of a term cut into one piece more than there may be
   edits, one piece must stand in the word; word and term must have a string in common after as many deletions as there may be
   edits. Both are looked up first, lose nothing, and spare nearly all words the walk and the others all branches but those of the terms found. Exact and misspelled hits of a term have weights of their own,
   learned from how often each occurs in toxic and other texts; exact hits that do not tell count nothing. A misspelling starts from
   the shrunk weight of its term, so one that training never saw counts too; occurrences in other texts lower it.
3. *Context.* A hit inside quotation marks, or with a word of reporting near, within ``WINDOW`` words, is taken as quotation,
   unless the reader is addressed between them; all others as abuse. The two sums of weights are the features of a
   logistic regression, fitted on counts per cell of the two features.

Scoring covers whole texts. Labels, lang, source and doc_id are used for choosing training rows only. The model (at most ``terms``
terms) is broadcast. Defined results: null and empty texts have no hits and get the score of such texts; without
labels, or with one class only, scores rest on the prior alone; rows without doc_id are not learned from; several labels of a
doc_id count as several rows; equal rows have equal scores; other columns are ignored; an empty table gives an empty result.

Bounds of the model, all at every size: terms are words of 3 to 40 letters or beginnings of 4 and 5; at most ``terms`` of them, the
strongest; a feature above 24 counts as 24. Words of any length are searched and texts are read whole.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from elastiq.llm.common import held_out, may_learn
from elastiq.sources.staging import stage

WINDOW = 8
_WORD = re.compile(r"[^\W_]+")
_PIECES = re.compile(r"([^\W_]+)")
_TO_SPACE = {c: " " for c in range(128) if not chr(c).isalnum()}
# Marks that open and close quotations, words of reporting, words that address the reader.
_MARKS = "\"“”„«»"
_REPORTING = frozenset("said says wrote writes quoted quote called calls sagte schrieb nannte zitat dit dijo escribio cita".split())
_ADDRESS = frozenset("you your youre du dich dein ihr tu toi te vous votre tu ti usted eres".split())
_REMEMBERED = 400_000
_PRIOR = np.array([-4.0, 1.0, 0.25])
_STEP, _MOST = 0.5, 24.0
# What a misspelling keeps of its term's weight, and for how many seen texts that stands.
_BACKED_OFF, _AS_SEEN = 0.8, 2.0
_HEAD = 7


def words_of(lowered: str) -> set[str]:
    """The distinct words of a text; the pattern's are runs of letters and digits, which plain text is cut into faster without it."""
    return set(lowered.translate(_TO_SPACE).split() if lowered.isascii() else _WORD.findall(lowered))


def forms(word: str) -> list[str]:
    """What a word may be listed as: itself, and its beginnings of four and five letters."""
    return [word, *(f"{word[:n]}*" for n in (4, 5) if len(word) > n)]


def shortened(word: str, deletions: int) -> set[str]:
    """The word and what is left of it after up to that many deletions."""
    out = last = {word}
    for _ in range(deletions):
        last = {w[:k] + w[k + 1 :] for w in last for k in range(len(w))}
        out = out | last
    return out


def most_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """A trie of terms, and what a word must share with them to be worth a walk."""

    def __init__(self, terms: list[str]):
        self.terms, self.trie = terms, {}
        self.exact = {t: k for k, t in enumerate(terms)}
        # By number of edits: the shortened terms with the numbers of the terms, and the lengths a word may have to be near one.
        self.shortened: dict[int, dict[str, list[int]]] = {}
        self.lengths: dict[int, set[int]] = {}
        # The same of their first characters only, which near words must share too and which are fewer to look up.
        self.heads: dict[int, set[str]] = {}
        self.known_heads: dict[str, tuple[int, ...]] = {}
        # Beginnings of the pieces of terms, with a bit for each place where one may stand in a near word, by length of the word.
        self.pieces: dict[int, dict[str, int]] = {}
        self.begins = {t[:-1] for t in terms if t.endswith("*")}
        for k, term in enumerate(terms):
            edits = most_edits(term)
            if not edits or term.endswith("*"):
                continue
            self._add(self.trie, k)
            cuts = [len(term) * i // (edits + 1) for i in range(edits + 2)]
            for start, stop in zip(cuts, cuts[1:]):
                piece, places = term[start : min(stop, start + 3)], (1 << (2 * edits + 1)) - 1
                places = places << (start - edits) if start >= edits else places >> (edits - start)
                for length in range(len(term) - edits, len(term) + edits + 1):
                    of_length = self.pieces.setdefault(length, {})
                    of_length[piece] = of_length.get(piece, 0) | places
            for left in shortened(term, edits):
                self.shortened.setdefault(edits, {}).setdefault(left, []).append(k)
            self.heads.setdefault(edits, set()).update(shortened(term[:_HEAD], edits))
            self.lengths.setdefault(edits, set()).update(range(len(term) - edits, len(term) + edits + 1))

    def _add(self, trie: dict, k: int) -> None:
        node = trie
        for c in self.terms[k]:
            node = node.setdefault(c, {})
        node[""] = (k, most_edits(self.terms[k]))

    def _has_a_piece(self, word: str) -> bool:
        """Of a term cut into one piece more than there may be edits, one piece stands untouched in a near word, hardly moved."""
        if (of_length := self.pieces.get(len(word))) is None:
            return False
        pieces = of_length.get
        for k in range(len(word) - 1):
            if (pieces(word[k : k + 3], 0) | pieces(word[k : k + 2], 0)) >> k & 1:
                return True
        return False

    def _worth(self, word: str) -> set[int]:
        """The terms that may be near: all that have a string in common with the word after their edits in deletions."""
        if not self._has_a_piece(word):
            return set()
        head = word[:_HEAD]
        if (allowed := self.known_heads.get(head)) is None:
            if len(self.known_heads) >= _REMEMBERED:
                self.known_heads.clear()
            by_most = sorted(self.heads, reverse=True)
            allowed = tuple(e for e in by_most if not self.heads[e].isdisjoint(shortened(head, e)))
            self.known_heads[head] = allowed
        found: set[int] = set()
        for edits in allowed:
            if len(word) in self.lengths[edits]:
                known = self.shortened[edits]
                for left in known.keys() & shortened(word, edits):
                    found.update(known[left])
        return found

    def near(self, word: str) -> tuple[tuple[int, bool], ...]:
        """(term, misspelled): the terms that list the word, or else the nearest within its allowance (ties: the first)."""
        listed = ()
        if word in self.exact or word[:4] in self.begins or word[:5] in self.begins:
            listed = tuple((self.exact[f], False) for f in forms(word) if f in self.exact)
        if listed or len(word) < 4 or not (worth := self._worth(word)):
            return listed
        # The branches of these terms only; most words that come here have one.
        trie: dict = {}
        for k in worth:
            self._add(trie, k)
        best = min(self.walk(word, trie=trie), key=lambda x: (x[1], x[0]), default=None)
        return ((best[0], True),) if best else ()

    def walk(self, word: str, edits: int = 2, trie: dict | None = None) -> Iterator[tuple[int, int]]:
        """The automaton of ``word`` run down the trie: bit i of state e says i characters are matched with e edits."""
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        accept, every = 1 << len(word), (2 << len(word)) - 1
        stack = [(self.trie if trie is None else trie, [(2 << e) - 1 for e in range(edits + 1)])]
        while stack:
            node, state = stack.pop()
            for c, child in node.items():
                if c == "":
                    k, allowed = child
                    hit = next((e for e in range(min(allowed, edits) + 1) if state[e] & accept), None)
                    if hit:
                        yield k, hit
                    continue
                mask = masks.get(c, 0)
                after = [(state[0] & mask) << 1]
                for e in range(1, edits + 1):
                    # match, character too many in the term, other character, character too many in the word
                    after.append(((state[e] & mask) << 1 | state[e - 1] | state[e - 1] << 1 | after[e - 1] << 1) & every)
                if any(after):
                    stack.append((child, after))


@dataclass
class Model:
    """Terms, a weight per (term, misspelled or not), and the regression's coefficients."""

    terms: list[str]
    weights: dict[tuple[int, bool], float] = field(default_factory=dict)
    fit: np.ndarray = field(default_factory=lambda: _PRIOR.copy())


class Scanner:
    """Hits and features of texts, with remembered words."""

    def __init__(self, model: Model):
        self.model, self.lexicon = model, Lexicon(model.terms)
        # Words looked up before, and those of them with hits.
        self.seen: set[str] = set()
        self.known: dict[str, tuple[tuple[int, bool], ...]] = {}

    def hits(self, text: str) -> dict[str, tuple[tuple[int, bool], ...]]:
        """The words of a text that are listed or near a term, with (term, misspelled)."""
        return self.hits_of(words_of(text.lower()))

    def hits_of(self, words: set[str]) -> dict[str, tuple[tuple[int, bool], ...]]:
        if len(self.seen) >= _REMEMBERED:
            self.seen.clear()
            self.known.clear()
        new = words - self.seen
        for word in new:
            if hits := self.lexicon.near(word):
                self.known[word] = hits
        self.seen |= new
        return {word: self.known[word] for word in words & self.known.keys()}

    def features(self, text: str | None) -> tuple[float, float]:
        """Summed weights of distinct hits: as abuse, and as quotation only."""
        lowered = (text or "").lower()
        weighed = {}
        for word, hits in self.hits_of(words_of(lowered)).items():
            telling = {h: self.model.weights[h] for h in hits if h in self.model.weights}
            if telling:
                weighed[word] = telling
        if not weighed:
            return 0.0, 0.0
        pieces = _PIECES.split(lowered)  # words at odd places, what lies between them at even ones
        words = pieces[1::2]
        ends = list(accumulate(map(len, pieces)))
        marks = [m.start() for m in re.finditer(f"[{_MARKS}]", lowered)]
        abuse: dict = {}
        quoted: dict = {}
        abusive: set[str] = set()
        for k, word in enumerate(words):
            if word in weighed and word not in abusive:
                near = range(max(0, k - WINDOW), min(len(words), k + WINDOW + 1))
                spans = [(ends[2 * j], ends[2 * j + 1], words[j]) for j in near]
                if self.is_quoted(spans, marks, ends[2 * k], ends[2 * k + 1]):
                    quoted.update(weighed[word])
                else:
                    abuse.update(weighed[word])
                    abusive.add(word)
        return sum(abuse.values()), sum(w for h, w in quoted.items() if h not in abuse)

    @staticmethod
    def is_quoted(near: list[tuple[int, int, str]], marks: list[int], start: int, stop: int) -> bool:
        words = {w for _, _, w in near}
        before = bisect_left(marks, near[0][0] - 1) < bisect_left(marks, start)
        after = bisect_left(marks, stop) < bisect_right(marks, near[-1][1])
        return (before and after or bool(words & _REPORTING)) and not words & _ADDRESS

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-float(self.model.fit @ np.array([1.0, *binned(self.features(text))]))))


def binned(features: tuple[float, float]) -> tuple[float, float]:
    """Features in cells, so that training needs one count per cell only."""
    return tuple(round(min(x, _MOST) / _STEP) * _STEP for x in features)


def _sampled(docs: DataFrame, labels: DataFrame, toxic_sample: int, other_sample: int) -> tuple[DataFrame, dict[int, float]]:
    """(toxic, text) of the training rows, and how many labelled rows each sampled row stands for, by class."""
    known = labels.select("doc_id", (F.col("toxic") == 1).cast("int").alias("toxic")).filter(F.col("toxic").isNotNull())
    known = known.filter(may_learn(F.col("doc_id")))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    stands = {y: max(1.0, sizes.get(y, 0) / most) for y, most in ((1, toxic_sample), (0, other_sample))}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    share = F.when(F.col("toxic") == 1, 1 / stands[1]).otherwise(1 / stands[0])
    chosen = stage(known.filter(place < share).select(F.col("doc_id").alias("labelled"), "toxic"), "toxic-sample")
    texts = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("labelled"))
    return stage(texts.select("toxic", F.coalesce("text", F.lit("")).alias("text")), "toxic-texts"), stands


def _document_counts(texts: DataFrame, things: callable, kind: str) -> DataFrame:
    """For each thing found in texts, in how many toxic and other ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = things()
        for batch in batches:
            counts = Counter()
            for toxic, text in zip(batch["toxic"], batch["text"]):
                toxic = toxic.as_py()
                counts.update((x, toxic) for x in find(text.as_py()))
            if counts:
                found, n = [x for x, _ in counts], list(counts.values())
                toxic = [k if y else 0 for (_, y), k in zip(counts, n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), pa.array(toxic, pa.int64()), pa.array([k - t for k, t in zip(n, toxic)], pa.int64())],
                    ["thing", "n_toxic", "n_other"],
                )

    out = texts.mapInArrow(run, f"thing {kind}, n_toxic bigint, n_other bigint")
    return out.groupBy("thing").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_other").alias("n_other"))


def learn_terms(texts: DataFrame, n: dict[int, int], terms: int, least_ratio: float = 20.0, least_evidence: float = 12.0) -> list[str]:
    """The words with the strongest evidence (likelihood ratio statistic) for the toxic class; its limit is the same at every size."""
    words = lambda: lambda text: {f for w in words_of(text.lower()) if 3 <= len(w) <= 40 for f in forms(w)}
    counts = _document_counts(texts, words, "string").filter("n_toxic > 1")
    a, b = F.col("n_toxic").cast("double"), F.col("n_other").cast("double")
    rate = (a + b) / (n[1] + n[0])

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    inside = part(a, n[1] * rate) + part(b, n[0] * rate)
    outside = part(n[1] - a, n[1] * (1 - rate)) + part(n[0] - b, n[0] * (1 - rate))
    counts = counts.withColumn("evidence", 2 * (inside + outside))
    strong = counts.filter((a / n[1] >= least_ratio * (b + 0.5) / (n[0] + 1)) & (F.col("evidence") >= least_evidence))
    best = strong.orderBy(F.desc("evidence"), "thing").limit(terms)
    return sorted(r["thing"] for r in best.select("thing").collect())


def fit_cells(cells: list[tuple[float, float, float, float]], rounds: int = 30) -> np.ndarray:
    """Logistic regression on (abuse, quotation, weight of toxic rows, weight of others), drawn towards the prior."""
    fit, pull = _PRIOR.copy(), np.array([0.01, 0.5, 2.0])
    if not cells:
        return fit
    x = np.array([[1.0, c[0], c[1]] for c in cells])
    toxic, all_rows = np.array([c[2] for c in cells]), np.array([c[2] + c[3] for c in cells])

    def loss(at: np.ndarray) -> float:
        z = x @ at
        return float((all_rows * np.logaddexp(0, z) - toxic * z).sum() + (pull * (at - _PRIOR) ** 2).sum() / 2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ fit, -30, 30)))
        slope = x.T @ (toxic - all_rows * p) - pull * (fit - _PRIOR)
        curve = (x * (all_rows * p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(curve, slope)
        while loss(fit + step) > loss(fit) and np.abs(step).max() > 1e-9:
            step = step / 2
        fit = fit + step
    return fit


def misspelled_weight(exact: float, n_toxic: int, n_other: int, n: dict[int, int]) -> float:
    """The log ratio of a term's misspellings, counted on top of ``_AS_SEEN`` texts that speak for its shrunk exact weight."""
    share, half = 1 / (1 + math.exp(-_BACKED_OFF * exact)), (n[0] + n[1]) / 2
    toxic, other = half * n_toxic / n[1] + _AS_SEEN * share, half * n_other / n[0] + _AS_SEEN * (1 - share)
    return min(6.0, math.log(toxic / other))


def learn(docs: DataFrame, labels: DataFrame, terms: int = 1000, toxic_sample: int = 4000, other_sample: int = 8000) -> Model:
    texts, stands = _sampled(docs, labels, toxic_sample, other_sample)
    n = {0: 0, 1: 0} | {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n[0] or not n[1]:
        return Model([])
    spark = docs.sparkSession
    model = Model(learn_terms(texts, n, terms))
    shared = spark.sparkContext.broadcast(model)

    def found():
        scanner = Scanner(shared.value)
        return lambda text: {2 * term + misspelled for hits in scanner.hits(text).values() for term, misspelled in hits}

    counts = {r["thing"]: (r["n_toxic"], r["n_other"]) for r in _document_counts(texts, found, "bigint").collect()}
    for k, term in enumerate(model.terms):
        n_toxic, n_other = counts.get(2 * k, (0, 0))
        tells = math.log((n_toxic + 0.5) / (n[1] + 1)) - math.log((n_other + 0.5) / (n[0] + 1))
        if n_toxic > 1 and tells >= 3:
            model.weights[k, False] = min(6.0, tells)
            weight = misspelled_weight(model.weights[k, False], *counts.get(2 * k + 1, (0, 0)), n)
            if most_edits(term) and not term.endswith("*") and weight > 0:
                model.weights[k, True] = weight
    weighed = spark.sparkContext.broadcast(model)

    def cell():
        scanner = Scanner(weighed.value)
        return lambda text: ["{} {}".format(*binned(scanner.features(text)))]

    counted = _document_counts(texts, cell, "string").collect()
    cells = [(*map(float, r["thing"].split()), r["n_toxic"] * stands[1], r["n_other"] * stands[0]) for r in counted]
    model.fit = fit_cells(sorted(cells))
    return model


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, held_out, score, and the two context features."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for batch in batches:
            scores = [scanner.score(text.as_py()) for text in batch["text"]]
            own = [batch[c] for c in ("doc_id", "text_hash", "held_out")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(scores, pa.float64())], ["doc_id", "text_hash", "held_out", "score"])

    texts = docs.select(
        F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), held_out(F.col("doc_id")).alias("held_out"), "text"
    )
    return texts.mapInArrow(run, "doc_id bigint, text_hash bigint, held_out boolean, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for batch in batches:
            clean = [scanner.score(text.as_py()) < threshold for text in batch.column(place)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
