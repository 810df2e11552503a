"""Every stage of the pipeline against plain Python on its own input, and the whole run."""

import random

import pytest
from helpers import base_secrets, by_source, documents, leaks, near_components, prose, water_filled, words_of

import corpus_pipeline as pipeline
from elastiq.llm import toxicity

BAD = ["stupidhead", "moronic", "scumbag", "worthless"]
BENCH = [(1, prose(901, 30)), (2, prose(902, 12)), (3, None), (3, "four little words here")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, rows, labels = random.Random(3), [], []
    for k in range(160):
        words = prose(k, 60).split()
        if toxic := k % 8 == 0:
            for bad in r.sample(BAD, 3):
                words.insert(r.randrange(60), bad)
        if k % 10 == 1:
            words[20:20] = BENCH[k % 2][1].split()
        if k % 10 == 2:
            words.insert(5, f"password={'%016x' % (k * 977)}")
        rows.append((k, " ".join(words), f"s{k % 5}" if k % 7 else None))
        if k < 120:
            labels.append((k, 1, int(toxic)))
    rows += [(500 + k, prose(3, 60), "s1") for k in range(5)]  # copies of a clean document
    rows += [(600 + k, " ".join([*prose(4, 60).split()[:58], f"x{k}"]), "s0") for k in range(4)]
    rows += [(700, None, "s0"), (701, "", None), (702, prose(950, 4000), "s2"), (703, "tiny", "s3"), (704, "four little words here", "s3")]
    rows += [(705, prose(951, 40), "s4")] * 2 + [(None, prose(952, 40), "s4"), (None, None, None)]
    rows += [(710 + k, f"{prose(960 + k, 30)} token=changemechangeme", f"s{k}") for k in range(4)]
    root = tmp_path_factory.mktemp("corpus")
    documents(spark, rows).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(BENCH, "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


@pytest.fixture(scope="module")
def stages(spark, folder):
    """Input and output of each stage."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for k, (name, step) in enumerate(pipeline.STAGES):
        path = f"{folder}/stage-{k}"
        step(spark, docs, folder).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = docs, after
        docs = after
    return out


def texts(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.text or "", r.source or "") for r in df.collect()))


def test_order_and_columns(stages, folder, spark):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "mixing"]
    for name, (before, after) in stages.items():
        assert after.columns[: len(before.columns)] == before.columns
        assert (len(after.columns) == len(before.columns)) == (name != "mixing")
        assert after.count() > 0


def test_toxicity(stages, folder, spark):
    before, after = stages["toxicity"]
    scan = toxicity.Scanner(toxicity.learn(before, spark.read.parquet(f"{folder}/labels.parquet")))
    want = [r for r in texts(before) if scan.score(r[2]) < 0.7]
    assert texts(after) == want
    gone = {r[1] for r in texts(before)} - {r[1] for r in want}
    assert gone == {k for k in range(1, 160) if k % 8 == 0}  # missing ids read as 0 here


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in before.collect() if r.doc_id is not None]
    component = near_components(dict(rows).items(), 5)
    kept = sorted(r.doc_id for r in after.collect() if r.doc_id is not None)
    assert kept == sorted(i for i in component if component[i] == i)
    assert sum(r.doc_id is None for r in after.collect()) == 2


def test_decontamination(stages):
    before, after = stages["decontamination"]
    assert texts(after) == [r for r in texts(before) if leaks(r[2], BENCH)[1] == 0]
    assert after.count() < before.count()


def test_secrets(stages):
    before, after = stages["secrets"]
    owners = {}
    for r in before.collect():
        for *_, secret in base_secrets(r.text):
            owners.setdefault(secret, set()).add(r.source)
    got = {(r.doc_id, r.source): r.text for r in after.collect()}
    changed = 0
    for r in before.collect():
        out, at = "", 0
        for start, _, stop, secret in base_secrets(r.text):
            if len(owners[secret]) < 3:
                if start >= at:
                    out += r.text[at:start] + "<secret>"
                    changed += 1
                at = max(at, stop)
        assert got[r.doc_id, r.source] == (None if r.text is None else out + r.text[at:])
    assert changed > 5 and after.count() == before.count()


def test_mixing(stages):
    before, after = stages["mixing"]
    sizes = by_source([(r.source, len(words_of(r.text))) for r in before.collect()])
    taken = by_source([(r.source, len(words_of(r.text))) for r in after.collect()])
    target = water_filled(sizes)
    assert all(abs(taken.get(s, 0) - target[s]) <= 1 for s in sizes)
    known = {(r.doc_id, r.source): r.text for r in before.collect()}
    for r in after.collect():
        whole = words_of(known[r.doc_id, r.source])
        assert words_of(r.text) == whole[: r.words_taken]


def test_run_and_empty_corpus(spark, folder, stages, tmp_path):
    order = lambda df: sorted(map(str, df.collect()))
    assert order(pipeline.run(spark, folder)) == order(stages["mixing"][1])
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
