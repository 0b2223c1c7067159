import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from corpus_rows import prose

from scanweave.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=50):
    counts = [(doc, Counter(terms(text))) for doc, text in docs]
    n_docs, length = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in counts:
            n = sum(c.values())
            score = 0
            for t in set(terms(text)) & set(c):
                m = 100 - 50 + (50 * n * n_docs) // length
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scores.append((-score, doc is not None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def _items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_same_as_brute_force(spark, docs_of, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_TERMS", 30)
    docs = [(i, prose(i % 40, 5 + i % 17) + (" The Rare É9" if i % 9 == 0 else " the")) for i in range(130)]
    items = [(i, " ".join(prose(i, 12).split()[:i + 3]) + " the; RARE.é9") for i in range(9)] + [(3, "the the unseenword"), (4, prose(4, 9))]
    got = L.search(docs_of(docs, 4), _items(spark, items))
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)
    few = L.search(docs_of(docs, 4), _items(spark, items), k=3)
    assert sorted(map(tuple, few.collect()), key=str) == brute(docs, items, 3)


def test_odd_rows(spark, odd_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    items = [(None, "one ok ü"), (1, None), (2, ""), (3, "..."), (4, "a b c x y z"), (4, "a b c x y z"), (5, prose(1, 20_000))]
    more = _items(spark, items).selectExpr("*", "1 AS score", "2 AS doc_id", "'t' AS term")
    assert sorted(map(tuple, L.search(odd_docs, more).collect()), key=str) == brute(docs, items)
    for a, b in ((odd_docs.limit(0), more), (odd_docs, more.limit(0)), (odd_docs.filter("text = ''"), more)):
        assert L.search(a, b).collect() == []


@pytest.mark.parametrize("chunk", [500, 37])
def test_accumulators_stop_and_nothing_is_lost(chunk):
    """Common terms make no accumulators once rare ones have enough; the k best are those of all scores."""
    draw = random.Random(chunk)
    names = [f"t{i}" for i in range(30)]
    docs = [[t for i, t in enumerate(names) if draw.random() < (i + 1) ** 2 / 900] for _ in range(500)]
    number = {t: i for i, t in enumerate(names)}
    df = [max(1, sum(t in d for d in docs)) for t in names]
    length = sum(map(len, docs))
    weights = np.array([math.floor(1000 * math.log(1002 / (2 * n + 1))) for n in df])
    full = {}
    for i, d in enumerate(docs):
        m = 50 + 50 * len(d) * 500 // length
        full[i] = [(10**9) // (1000 + 20 * m) if t in d else 0 for t in names]
    bounds = weights * np.array([max(full[i][t] for i in full) for t in range(30)])
    wanted = np.array([t for t in range(30)])
    best, made = L._Best(10), []
    for a in range(0, 500, chunk):
        part = docs[a:a + chunk]
        batch = pa.RecordBatch.from_arrays([
            pa.array(range(a, a + len(part)), pa.int64()), pa.array([len(d) for d in part], pa.int64()),
            pa.array(part, pa.list_(pa.string())), pa.array([[1] * len(d) for d in part], pa.list_(pa.int64()))], schema=L._FORWARD)
        made.append(L.term_at_a_time(L.Postings([batch], number, 500, length), wanted, weights, bounds, best))
    assert min(made) < 30
    scores = sorted((-int(np.dot(weights, full[i])), i) for i in full)[:10]
    assert [(-int(s), int(d)) for s, d in zip(best.score, best.doc, strict=True)] == scores
