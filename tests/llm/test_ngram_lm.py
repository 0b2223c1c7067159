import math
import re
import zlib
from collections import Counter

import numpy as np
from corpus_rows import prose

from scanweave.llm import ngram_lm as L
from scanweave.llm.elias_fano import EliasFano, from_bytes, to_bytes


def tokens(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute(rows):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    one, two, after = Counter(), Counter(), Counter()
    for d, t in rows:
        if not held(d):
            w = tokens(t)
            one.update(w)
            two.update(zip([None, *w[:-1]], w, strict=True))
    for u, _ in two:
        after[u] += 1
    n, v = sum(one.values()), len(one)
    once, twice = sum(c == 1 for c in two.values()), sum(c == 2 for c in two.values())
    cut = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
    p1 = lambda w: (one[w] + 0.5) / (n + 0.5 * (v + 1))
    out = []
    for d, t in rows:
        w, base, score = tokens(t), 0.0, 0.0
        for u, x in zip([None, *w[:-1]], w, strict=True):
            base += math.log10(p1(x))
            p = p1(x) if not one[u] else (max(two[u, x] - cut, 0) + cut * after[u] * p1(x)) / one[u]
            score += math.log10(p)
        out.append((-1 if d is None else d, held(d), len(w), sum(one[x] > 0 for x in w), n, base, score))
    return sorted(out)


def check(rows, docs):
    got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in L.score(docs).collect())
    for a, b in zip(got, brute(rows), strict=True):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9) and abs(a[6] - b[6]) <= 2e-4 * a[2] + 1e-9, (a, b)


def test_same_as_dictionaries(docs_of):
    rows = [(i, prose(i % 40, 60) + ("  End\n" if i % 3 else "")) for i in range(200)] + [(500, None), (501, "The THE the \x85 x")]
    check(rows, docs_of(rows))


def test_many_files_and_hot_contexts(docs_of, monkeypatch):
    for name, n in (("FILE_WORDS", 64), ("FILE_PAIRS", 300), ("KEPT_WORDS", 50), ("TOKENS_AT_ONCE", 200)):
        monkeypatch.setattr(L, name, n)
    rows = [(i, " ".join(f"hot {w}" for w in prose(i, 30).split())) for i in range(120)]
    check(rows, docs_of(rows))


def test_odd_rows(odd_docs, docs_of):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    check(rows, odd_docs)
    assert L.score(odd_docs.limit(0)).count() == 0
    lone = L.score(docs_of([(d, "a b") for d in range(300) if zlib.crc32(str(d).encode()) % 5 == 1])).first()
    assert lone["train_tokens"] == 0 and lone["n_known"] == 0 and lone["score"] == lone["base_score"] == 0


def test_sequences_against_search():
    draw = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 2 ** 62), (5, 3), (1000, 2000), (1000, 2 ** 45), (50_000, 2 ** 63 - 1)):
        v = np.sort(draw.integers(0, top + 1, n, dtype=np.uint64))
        e = EliasFano.within(from_bytes(to_bytes(EliasFano.of(v).arrays("x"))), "x")
        assert (e.all() == v).all()
        x = np.concatenate([v[:500], draw.integers(0, top + 1, 500, dtype=np.uint64), np.array([0, top, top + 5], np.uint64)])
        assert (e.successor(x) == np.searchsorted(v, x)).all()
        if n > 100:
            at = draw.integers(0, n, 500)
            first, last = at, np.minimum(n, at + 50)
            assert (e.get(at) == v[at]).all()
            assert (e.successor(x[:500], first, last) == np.clip(np.searchsorted(v, x[:500]), first, last)).all()
