"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists the pieces that end at each character, and dynamic programming carries two numbers per
position, the best score and its number of pieces; no path is stored. Ties are those of unigram tokenizers: starts are tried from
left to right and only a better score replaces one found, so of equal paths the one whose last piece is longest wins. A
character that no piece of its own covers may be unknown, at the least score minus ten, and counts one token per
UTF-8 byte (byte fallback).

Blanks become ``▁`` and one is put before the text, as usual. A text is cut where the vocabulary shows that no piece can lie
across: before a ``▁`` that follows another character, and around characters that occur in no longer piece. All paths meet at
such a cut, so counts add up exactly, and repeated stretches are counted once per task and looked up from then on (in a table of
bounded size).

The vocabulary is read from a file on the driver and broadcast; its size does not depend on the data. Defined results: null and
empty texts have 0 tokens; equal rows have equal counts; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
_UNKNOWN_PENALTY = 10.0
_REMEMBERED, _LONG = 200_000, 64


def read_vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Piece and score of the ordinary pieces of a sentencepiece model file (no control or byte pieces)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    plain = [i for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {model.id_to_piece(i): model.get_score(i) for i in plain}


class PieceCounter(dict):
    """Pieces of the best path by stretch of text; unknown stretches are worked out when first looked up."""

    def __init__(self, vocabulary: dict[str, float]):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(vocabulary.values(), default=0.0) - _UNKNOWN_PENALTY
        self.single = {p for p in vocabulary if len(p) == 1}
        joined = {c for p in vocabulary if len(p) > 1 for c in p}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined)
        blank_inside = any(re.search(f"[^{BLANK}]{BLANK}", p) for p in vocabulary)
        other = f"[^{alone}]" if blank_inside else f"(?:{BLANK}+[^{BLANK}{alone}]*|[^{BLANK}{alone}])"
        self.cut = re.compile(f"[{alone}]|{other}[^{alone}]*" if blank_inside else f"[{alone}]|{BLANK}+[^{BLANK}{alone}]*|[^{BLANK}{alone}]+")

    def __missing__(self, stretch: str) -> int:
        count = self.best(stretch)
        if len(stretch) <= _LONG:
            if len(self) >= _REMEMBERED:
                self.clear()
            self[stretch] = count
        return count

    def best(self, stretch: str) -> int:
        """Number of pieces of the best path."""
        scores: list[float | None] = [0.0] + [None] * len(stretch)
        counts = [0] * (len(stretch) + 1)
        found: list[list[tuple[int, float]]] = [[] for _ in stretch]
        for end, match in self.automaton.iter(stretch):
            found[end].append(match)
        for end, matches in enumerate(found):
            best, count = None, 0
            for length, score in sorted(matches, reverse=True):  # the longest, which starts first, comes first
                before = scores[end + 1 - length]
                if best is None or before + score > best:
                    best, count = before + score, counts[end + 1 - length] + 1
            if stretch[end] not in self.single:
                score = scores[end] + self.unknown
                if best is None or score > best:
                    best, count = score, counts[end] + len(stretch[end].encode())
            scores[end + 1], counts[end + 1] = best, count
        return counts[-1]

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, self.cut.findall(BLANK + text.replace(" ", BLANK))))


def count_tokens(docs: DataFrame, vocabulary: dict[str, float]) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(shared.value)
        for batch in batches:
            counts = [counter.count(text.as_py()) for text in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    texts = docs.select(F.col("doc_id").cast("bigint"), "text")
    return texts.mapInArrow(run, "doc_id bigint, n_tokens bigint")
