"""Small tables and plain-Python counterparts for the text operators."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that operators use inside; the input may have them too.
EXTRA = "size int, score double, component_id bigint, n string, kept_id string, text_hash bigint, spans string, block int"


def documents(spark, rows, extra: bool = True):
    """``rows``: (doc_id, text) or (doc_id, text, source) or (doc_id, text, source, lang)."""
    full = []
    for r in rows:
        doc_id, text, source, lang = (*r, *["s", "en"][len(r) - 2 :]) if len(r) < 4 else r
        full.append((doc_id, text, lang, source, None if text is None else len(text)))
    if not extra:
        return spark.createDataFrame(full, SCHEMA)
    clash = (1, 0.5, 7, "x", "y", 3, "z", 2)
    return spark.createDataFrame([(*r, *clash) for r in full], f"{SCHEMA}, {EXTRA}")


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    letters = str.maketrans("0123456789", "abcdefghij")
    return " ".join(f"w{r.randrange(vocabulary)}".translate(letters) for _ in range(words))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, width):
    w = [x.encode().lower() for x in words_of(text)]
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1)))


def near_components(rows, width, percent=80):
    """doc_id -> smallest doc_id reachable over links, by comparing all pairs."""
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def repeated(rows, length):
    """Kept bytes and removed runs per row, from all windows of all rows."""
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        runs = []
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                if runs and k <= runs[-1][1]:
                    runs[-1][1] = k + length
                else:
                    runs.append([k, k + length])
        edges = [0, *(e for r in runs for e in r), len(d)]
        out.append((len(d), [tuple(r) for r in runs], b"".join(d[s:e] for s, e in zip(edges[::2], edges[1::2]))))
    return out


def benchmark_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def leaks(text, items, width=10):
    """(n_words, n_hit, sorted ids) for one text."""
    words, hit, ids = benchmark_words(text), set(), set()
    for item_id, item in items:
        own = benchmark_words(item)
        size = min(width, len(own))
        windows = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
        for k in range(len(words) - size + 1):
            if tuple(words[k : k + size]) in windows:
                hit.update(range(k, k + size))
                ids.add(item_id)
    return len(words), len(hit), sorted(map(str, ids))


SECRETS = {
    "assign": (r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    "access": (r"(AKIA[A-Z0-9]+)", 18),
    "hex": (r"([0-9a-f]+)", 16),
}


def base_secrets(text):
    """[(start, rank, end, secret)] of the base patterns."""
    out = []
    for rank, (pattern, least) in enumerate(SECRETS.values()):
        out += [(m.start(), rank, m.end(), m[1]) for m in re.finditer(pattern, text or "", re.A) if len(m[1]) >= least]
    return sorted(out)


def water_filled(sizes: dict, weights=(5, 2, 1), cap=3) -> dict:
    """Targets by sharing out, capping and sharing the excess again until nothing is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    capped: set = set()
    while True:
        left = sum(sizes.values()) - sum(cap * sizes[s] for s in capped)
        total = sum(weight[s] for s in names if s not in capped)
        target = {s: cap * sizes[s] if s in capped else left * weight[s] / total for s in names}
        more = {s for s in names if s not in capped and target[s] > cap * sizes[s] + 1e-9}
        if not more:
            return target
        capped |= more


def by_source(rows):
    out = defaultdict(int)
    for r in rows:
        out[r[0]] += r[1]
    return dict(out)
