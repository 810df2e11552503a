import random
import zlib

import pytest
from helpers import documents, prose

from elastiq.llm import toxicity
from elastiq.llm.toxicity import Lexicon, Model, Scanner

BAD = ["stupidhead", "moronic", "scumbag", "worthless"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_automaton_finds_what_edit_distance_allows():
    r = random.Random(4)
    terms = sorted({"".join(r.choices("abc", k=r.randrange(3, 12))) for _ in range(60)})
    lexicon = Lexicon(terms)
    for _ in range(400):
        word = "".join(r.choices("abcd", k=r.randrange(1, 13)))
        near = {(k, d) for k, t in enumerate(terms) if 0 < (d := distance(word, t)) <= toxicity.most_edits(t)}
        assert {x for x in lexicon.walk(word) if x[1] > 0} == near
        if near and word not in lexicon.exact and len(word) >= 4:
            assert lexicon._worth(word) and lexicon.near(word) == ((min(near, key=lambda x: (x[1], x[0]))[0], True),)


def test_only_the_branches_of_terms_that_may_be_near_are_walked(monkeypatch):
    r = random.Random(6)
    lexicon = Lexicon(sorted({"".join(r.choices("abcdefgh", k=r.randrange(5, 12))) for _ in range(300)}))
    walked, walk = [], Lexicon.walk

    def counted(self, word, *args, trie=None, **names):
        walked.append(sum(trie is not None and c in trie for c in "abcdefgh"))
        return walk(self, word, *args, trie=trie, **names)

    monkeypatch.setattr(Lexicon, "walk", counted)
    words = [t[:2] + "x" + t[3:] for t in lexicon.terms]
    assert all(lexicon.near(w) for w in words)
    assert len(walked) == len(words) and 1 <= min(walked) and max(walked) < 4  # the full trie has eight branches


def test_words_are_those_of_the_pattern():
    plain = "".join(map(chr, range(128))).lower() + " under_score it's 3rd\x1fend"
    for text in (plain, plain + " straße", "", "été_à２³"):
        assert toxicity.words_of(text) == set(toxicity._WORD.findall(text))


def test_context_separates_quotation_from_abuse():
    model = Model(["stupidhead"], {(0, False): 5.0, (0, True): 4.0})
    scan = Scanner(model)
    assert scan.features("what a stupidhead this is") == (5.0, 0.0)
    assert scan.features("what a stuppidhead this is") == (4.0, 0.0)
    assert scan.features('he shouted "stupidhead" at noon') == (0.0, 5.0)
    assert scan.features("the word stupidhead, they said, is old") == (0.0, 5.0)
    assert scan.features('"you stupidhead" again') == (5.0, 0.0)
    assert scan.features(None) == scan.features("") == scan.features("fine day") == (0.0, 0.0)
    assert scan.score("a stupidhead") > scan.score('so "stupidhead" it was') > scan.score("a day")


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(1)
    rows, labels = [], []
    for k in range(300):
        words = prose(k, 40).split()
        toxic = k % 5 == 0
        if toxic:
            for bad in r.sample(BAD, 3):
                words.insert(r.randrange(len(words)), bad)
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    labels += [(None, 1, 1), (5000, 1, 1), (1, None, None)]
    return rows, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_rows_and_edges(spark, labelled):
    rows, labels = labelled
    edges = [(1000, None), (1001, ""), (1002, "a worthles day"), (1003, prose(9, 30_000)), (1004, prose(1, 9)), (1004, prose(1, 9)), (None, "x scumbag moronic")]
    docs = documents(spark, [*rows, *edges])
    model = toxicity.learn(docs, labels)
    assert set(BAD) <= set(model.terms)
    got = toxicity.score_texts(docs, model).collect()
    assert len(got) == len(rows) + len(edges)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert len(held) > 50 and all((r.score >= 0.7) == (r.doc_id % 5 == 0) for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    by_id = {r.doc_id: r.score for r in got}
    assert all(by_id[k] < 0.7 for k in (1000, 1001, 1003, 1004)) and by_id[None] >= 0.7
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.score < 0.7)


def test_without_labels_or_rows(spark, labelled):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = documents(spark, [(1, "a b"), (2, None)])
    assert all(0 <= r.score < 0.7 for r in toxicity.score_texts(docs, toxicity.learn(docs, none)).collect())
    empty = documents(spark, [])
    assert toxicity.score_texts(empty, toxicity.learn(empty, labelled[1])).collect() == []


def test_misspellings_that_training_never_saw(spark, labelled):
    rows, labels = labelled
    planted = {2000: "xtupidhead xoronic wxrthless", 2001: "sttupidhead mmoronic scmbag", 2002: "scumbaq wrothless stupidhhead", 2003: "wprthles sxumbag mronic"}
    seen = {w for _, text in rows for w in text.split()}
    assert not seen & {w for text in planted.values() for w in text.split()}
    clean = [(2100 + k, prose(500 + k, 40)) for k in range(20)]
    extra = [(k, f"{prose(k, 20)} {text} {prose(k + 50, 20)}") for k, text in planted.items()]
    docs = documents(spark, [*rows, *extra, *clean])
    model = toxicity.learn(docs, labels)
    open_to_edits = {k for k, t in enumerate(model.terms) if toxicity.most_edits(t) and not t.endswith("*")}
    assert {k for k, misspelled in model.weights if misspelled} == open_to_edits != set()
    got = {r.doc_id: r.score for r in toxicity.score_texts(docs, model).collect()}
    nothing = max(got[k] for k, _ in clean)
    assert all(got[k] >= 0.7 > nothing for k in planted)


def test_counts_lower_the_weight_of_a_misspelling():
    n = {0: 800, 1: 400}
    weight = lambda toxic, other: toxicity.misspelled_weight(5.0, toxic, other, n)
    assert 5.0 > weight(0, 0) > weight(0, 1) > weight(0, 5) and weight(0, 5) < 0 < weight(4, 0)
    assert weight(40, 80) == pytest.approx(0, abs=0.2)


def test_the_least_evidence_is_the_same_at_every_size(spark):
    rows = [(k % 2, prose(k, 5) + (" gutterling" if k % 2 and k < 22 else "")) for k in range(800)]
    texts = spark.createDataFrame(rows, "toxic int, text string")
    assert "gutterling" in toxicity.learn_terms(texts, {0: 400, 1: 400}, 100)
