import math
import random
from collections import Counter

import numpy as np
import pytest

from elastiq.llm import ranking
from elastiq.llm.ranking import Block, Corpus, Limits, Query
from helpers import EXTRA, documents, prose

ITEMS = f"item_id bigint, text string, {EXTRA.replace('component_id', 'doc_id').replace('kept_id', 'number')}"


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isascii() and c.isalnum() or ord(c) > 0x7F else " " for c in low).split(" ")


def plain(docs, items, limit=10):
    held = [(i, Counter(t for t in terms(x) if t)) for i, x in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, total, df = len(held), sum(n for _, _, n in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, counts, n in held:
            m, score = 100 - 90 + (90 * n * n_docs) // total, 0
            for t in set(terms(text)) & set(counts):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += weight * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        scores.sort(key=lambda x: x[:2] + (x[2] or 0,))
        out += [(item_id, k + 1, x[2], -x[0]) for k, x in enumerate(scores[:limit])]
    return sorted(out, key=repr)


def table(spark, items):
    return spark.createDataFrame([(*x, 1, 0.5, 7, "x", "y", 3, "z", 2) for x in items], ITEMS)


def corpus():
    docs = [(k, prose(k, 1 + k % 90, 60)) for k in range(300)]
    docs += [(1000 + k, prose(7, 40, 60)) for k in range(25)]  # copies: equal scores
    docs += [(2000, None), (2001, ""), (2002, "-- \n"), (None, prose(8, 30, 60)), (2003, "É é Äb_cd X9"), (2004, prose(3, 40_000, 300))]
    return docs + [docs[5], docs[5]]


QUESTIONS = [(k, prose(500 + k, 4 + 3 * k, 60)) for k in range(12)]
QUESTIONS += [(50, prose(9, 400, 200)), (51, ""), (52, None), (53, "é x9 CD"), (54, "nowhere"), (None, "wb wc"), (3, "wb wb WC"), (3, "wd")]


@pytest.mark.parametrize("limits", [Limits(), Limits(items_per_block=5, block_documents=17), Limits(block_chars=50, block_postings=9)])
def test_equals_scoring_every_document(spark, limits):
    docs = corpus()
    got = ranking.search(documents(spark, docs).repartition(3), table(spark, QUESTIONS), limits).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(docs, QUESTIONS)


def test_few_masks_are_evaluated_and_none_that_could_rank_is_left(spark):
    r = random.Random(2)
    n, query = 3000, Query.of([(0, b"rare seldom often usual")])
    held = [[t for t, p in ((0, 0.9), (1, 0.02), (2, 0.05), (3, 0.8)) if r.random() < p] for _ in range(n)]
    owner, flat = np.repeat(np.arange(n), [len(h) for h in held]), np.array([t for h in held for t in h])
    counts = np.array([r.randrange(1, 4) for _ in flat])
    df = np.bincount(flat, minlength=4)
    weights = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
    block = Block(np.arange(n), np.full(n, 50), owner, flat, counts, Corpus(n, 50 * n, weights))
    best = []
    evaluated = block.rank(query.items[0][1], best, 10)
    groups = block.masks(query.items[0][1])[2]
    assert evaluated < len(groups) == len({tuple(h) for h in held if h})
    total = np.zeros(n, np.int64)
    np.add.at(total, block.owner, block.score)
    want = sorted(((-s, k) for k, s in enumerate(total.tolist())))[:10]
    assert sorted(best, reverse=True) == [(-s, -k) for s, k in want]


def test_empty_tables(spark):
    docs, items = documents(spark, corpus()[:3]), table(spark, QUESTIONS)
    assert ranking.search(docs.limit(0), items).collect() == []
    assert ranking.search(docs, items.limit(0)).collect() == []
    assert ranking.search(documents(spark, [(1, None)]), items).columns == ["item_id", "rank", "doc_id", "score"]
