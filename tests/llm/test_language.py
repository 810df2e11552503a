import itertools
import math
import random
import zlib

import numpy as np
import pytest
from helpers import documents

from elastiq.llm import language
from elastiq.llm.tokens import BLANK

PIECES = [BLANK, f"{BLANK}a", "a", "b", "ab", "ba", f"{BLANK}ab", "bab", "c"]


def segmentations(word):
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, at = [], 0
        for k, cut in enumerate(cuts, 1):
            if cut:
                parts.append(word[at:k])
                at = k
        yield [*parts, word[at:]]


def weight(model, parts, lang):
    lone = len(model.place) + 1
    return math.prod(model.table[model.place.get(p, lone if len(p) == 1 else lone - 1), lang] for p in parts)


@pytest.fixture
def model():
    table = np.random.default_rng(1).random((len(PIECES), 2))
    return language.PieceModel(PIECES, table / table.sum(axis=0))


def test_forward_sums_all_segmentations(model):
    words = ["a", "ab", "abba", "babab", "cxab", "x"]
    got = model.log_scores(words)
    for k, w in enumerate(words):
        for lang in range(2):
            total = sum(weight(model, parts, lang) for parts in segmentations(BLANK + w))
            assert math.isclose(got[k, lang], math.log(total), rel_tol=1e-9)


def test_expected_uses_are_posterior_counts(model):
    words, counts = ["abab", "ba"], np.array([[2.0, 0.0], [1.0, 3.0]])
    want = np.zeros((len(PIECES), 2))
    for k, w in enumerate(words):
        for lang in range(2):
            every = [(parts, weight(model, parts, lang)) for parts in segmentations(BLANK + w)]
            total = sum(x for _, x in every)
            for parts, x in every:
                for p in parts:
                    if p in model.place:
                        want[model.place[p], lang] += counts[k, lang] * x / total
    assert np.allclose(model.expected(words, counts), want)


def invented(lang, seed):
    r = random.Random(f"{lang}{seed}")
    parts = {"xx": ["ka", "lo", "mi"], "yy": ["str", "en", "och"]}[lang]
    return " ".join("".join(r.choices(parts, k=r.randrange(1, 4))) for _ in range(30)).title()


def test_held_out_accuracy_and_edges(spark):
    rows = [(k, invented(lang, k), "s", lang) for k, lang in zip(range(120), itertools.cycle(["xx", "yy"]))]
    edges = [(1000, None), (1001, ""), (1002, "123 ²½ --"), (1003, "KA" * 50_000), (1004, invented("yy", 1) * 200), (1005, "x²"), (None, invented("xx", 9))]
    edges += [(1006, invented("xx", 5), "s", None), (1006, invented("xx", 5), "s", None)]
    pieces = sorted({c for k in "kalomistrenoch" for c in k} | {BLANK, "ka", "lo", "mi", "st", "str", "en", "och"})
    edges = [r if len(r) == 4 else (*r, "s", None) for r in edges]
    got = language.identify(documents(spark, [*rows, *edges]), pieces).collect()
    assert len(got) == len(rows) + len(edges)
    truth = {r[0]: r[3] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 20 and all(r.lang_pred == truth[r.doc_id] for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    by_id = {r.doc_id: r for r in got}
    assert all((by_id[k].lang_pred, by_id[k].score) == ("und", 0.0) for k in (1000, 1001, 1002))
    assert by_id[1003].lang_pred == "xx" and by_id[1004].lang_pred == "yy" and by_id[1005].lang_pred in ("xx", "yy")
    assert by_id[None].lang_pred == "xx" and not by_id[None].held_out and all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn_from(spark):
    rows = [(1, "ka lo", "s", None), (2, None, "s", "xx")]
    assert {r.lang_pred for r in language.identify(documents(spark, rows), PIECES).collect()} == {"und"}
    assert language.identify(documents(spark, []), PIECES).collect() == []
