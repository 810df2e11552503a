import random
import re

import pytest
from helpers import base_secrets, documents, prose

from elastiq.llm import queries, secrets

LIVE = "Zk3b9Qx7Lm2Pv8Tr5Wn4Hc6J"
EXAMPLE = "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8"
ROWS = [
    (1, 'password = "hunter2hunter2" and TOKEN:abcdefabcdef0123'), (2, "token: secret: AAAAAAAAAAAAAA"), (3, None), (4, ""),
    (5, "é🙂 AKIAABCDEFGHIJKLMN0 x AKIASHORT AKIA"), (6, "0123456789abcdef 0123456789abcde g0123456789abcdef01"),
    (7, "api_key=abc.def-ghi/jkl apikey:\"x\" API_KEY ='abcdefghijkl'"), (8, "secret=passwd=0123456789abcdefAKIAABCDEFGHIJKLMN0"),
    (9, f"key {LIVE} end", "o1"), (10, f"again {LIVE}", "o1"), (11, f"see {EXAMPLE}", "o1"), (12, f"see {EXAMPLE}", "o2"),
    (13, f"see {EXAMPLE}", "o3"), (14, prose(1, 3000) + " passwd=0123456789ab", None), (15, "no secrets"), (15, "no secrets"),
    (16, "token=aaaaaaaaaaaaaaa\ntoken=bbbbbbbbbbbbbbb"), (16, "token=aaaaaaaaaaaaaaa\ntoken=bbbbbbbbbbbbbbb"), (None, "hex 00000000000000001"),
    (17, "paſſword=0123456789abcd toKen=0123456789abcd"),
]


def test_base_spans_and_ownership(spark):
    got = secrets.with_spans(documents(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    kinds = list(secrets.KINDS)
    for i, text, *_ in ROWS:
        base = [(a, kinds[k], b) for a, k, b, _ in base_secrets(text)]
        for r in (r for r in got if r.doc_id == i):
            assert [(s.start, s.kind, s.stop) for s in r.spans if s.kind != "owned"] == base
    spans = {r.doc_id: [(s.kind, s.start, s.stop, s.verdict) for s in r.spans] for r in got}
    assert spans[9] == [("owned", 4, 4 + len(LIVE), "live")] and spans[10] == [("owned", 6, 6 + len(LIVE), "live")]
    assert spans[11] == spans[12] == spans[13] == []


def test_a_value_of_many_owners_is_an_example(spark):
    rows = [(k, "password=changemechangeme1", f"o{k % 5}") for k in range(40)] + [(99, "password=q8w7e6r5t4y3u2i1", "o1")]
    got = {r.doc_id: [s.verdict for s in r.spans] for r in secrets.with_spans(documents(spark, rows)).collect()}
    assert all(got[k] == ["example"] for k in range(40)) and got[99] == ["live"]


def test_redaction_replaces_spans_and_nothing_else(spark):
    docs = documents(spark, ROWS)
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns
    got = clean.collect()
    assert len(got) == len(ROWS)
    for r in got:
        text = next(t for i, t, *_ in ROWS if i == r.doc_id)
        spans = [(a, b) for a, _, b, _ in base_secrets(text)]
        if r.doc_id in (9, 10):
            spans = [(text.index(LIVE), text.index(LIVE) + len(LIVE))]
        out, at = "", 0
        for a, b in spans:
            if a >= at:
                out += text[at:a] + "<secret>"
            at = max(at, b)
        assert r.text == (None if text is None else out + text[at:])
        assert r.n_chars == (None if r.text is None else len(r.text))


def test_empty_table(spark):
    docs = documents(spark, [])
    assert secrets.with_spans(docs).collect() == [] and secrets.redact(docs).collect() == []


def expected(rows):
    """Spans of each row with verdict, owners and documents, from plain loops over all rows."""
    candidates = []
    for i, text, owner in rows:
        own = [(a, rank, b, value) for a, rank, b, value in base_secrets(text)]
        for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text):
            turns = sum(x.isdigit() != y.isdigit() and x.isalnum() and y.isalnum() for x, y in zip(m[0], m[0][1:]))
            if re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and turns >= 6:
                own.append((m.start(), 3, m.end(), m[0]))
        candidates.append((i, owner, own))
    places = {}
    for i, owner, own in candidates:
        for *_, value in own:
            places.setdefault(value, {}).setdefault(owner, set()).add(i)

    def verdict(value):
        sizes = [len(x) for x in places[value].values()]
        random = len(set(value)) >= 8 and re.search("[0-9]", value)
        return "example" if len(sizes) >= 3 else "live" if random and max(sizes) >= 0.75 * sum(sizes) else "shared"

    out = {}
    for i, _, own in candidates:
        base = [x for x in own if x[1] < 3]
        free = [x for x in own if x[1] == 3 and verdict(x[3]) == "live" and not any(b[0] < x[2] and x[0] < b[2] for b in base)]
        out[i] = [
            (list(secrets.KINDS)[rank], a, b, verdict(v), len(places[v]), sum(map(len, places[v].values())))
            for a, rank, b, v in sorted(base + free)
        ]
    return out


def planted(seed, owners=5):
    r = random.Random(seed)
    letters = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ"
    keys = ["".join(r.choice(letters) + str(r.randrange(10)) for _ in range(11)) + "aZ" for _ in range(12)]
    forms = ["key {}", "password={}", "see {} now", "token: {}x9", "hex 0123456789abcdef{}"]
    rows = []
    for k in range(150):
        said = [r.choice(forms).format(r.choice(keys[: 3 + k % 10])) for _ in range(r.randrange(4))]
        rows.append((k, f"{prose(k, 4)} " + " and ".join(said) + f" end {k}", f"o{min(r.randrange(owners), r.randrange(owners))}"))
    return rows


@pytest.mark.parametrize("owners", [2, 5])
def test_equals_plain_loops(spark, owners):
    rows = planted(owners, owners)
    fields = ("kind", "start", "stop", "verdict", "n_owners", "n_documents")
    read = lambda rs: {x.doc_id: [tuple(s[f] for f in fields) for s in x.spans] for x in secrets.with_spans(documents(spark, rs)).collect()}
    got = read(rows)
    assert got == expected(rows)
    assert {s[3] for spans in got.values() for s in spans} >= ({"live", "shared"} if owners == 2 else {"example"})
    # The same texts under other owners get other verdicts and spans.
    assert read([(i, t, "one") for i, t, _ in rows]) != got


def test_a_credential_of_one_owner_stays_live_whatever_its_copies(spark):
    rows = [(k, f"key {LIVE} n{k}", "hot") for k in range(1200)] + [(1500, f"key {LIVE}", "fork")]
    rows += [(2000 + k, f"key {EXAMPLE} n{k}", f"o{k % 3}") for k in range(9)]
    rows += [(3000 + k, f"password=q8w7e6r5t4y3u2i1 n{k}", f"o{k % 2}") for k in range(4)]
    got = {r.doc_id: [(s.kind, s.verdict) for s in r.spans] for r in secrets.with_spans(documents(spark, rows)).collect()}
    assert all(got[k] == [("owned", "live")] for k in (*range(1200), 1500))
    assert all(got[2000 + k] == [] for k in range(9))
    assert all(got[3000 + k] == [("assign", "shared")] for k in range(4))


def test_query_returns_verdicts_with_owners_and_documents(spark, tmp_path):
    rows = planted(2, 2)
    documents(spark, rows, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    want = expected(rows)
    got = queries.op10_secret_owners(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = want[r.doc_id]
        assert r.spans == ",".join(f"{kind}:{a}:{b}" for kind, a, b, *_ in spans)
        assert r.verdicts == ",".join(f"{verdict}:{owners}:{docs}" for *_, verdict, owners, docs in spans)
        assert [r.n_live, r.n_shared, r.n_example] == [sum(s[3] == v for s in spans) for v in ("live", "shared", "example")]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]
