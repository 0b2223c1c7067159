import random

import pytest

from scanweave.llm import ngram_join as J
from corpus_rows import prose


def brute(rows, threshold=0.8, k=5):
    """Links of each doc_id, and the smallest doc_id of its class, from all pairs of distinct texts."""
    def grams(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i:i + min(k, len(w))]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()

    words = {d: tuple((t or "").lower().split()) for d, t in rows}
    nodes = sorted(set(words.values()))
    sets = [grams(" ".join(n)) for n in nodes]
    link = {i: set() for i in range(len(nodes))}
    for i in range(len(nodes)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * len(sets[i] | sets[j]) - 1e-9:
                link[i].add(j)
                link[j].add(i)
    of = {}
    for i in range(len(nodes)):
        if i in of:
            continue
        reach, group = [i], {i}
        while reach:
            for x in link[reach.pop()] - group:
                group.add(x)
                reach.append(x)
        for x in group:
            of[x] = frozenset(group)
    at = {n: i for i, n in enumerate(nodes)}
    head = {}
    for d, w in words.items():
        head[of[at[w]]] = min(d, head.get(of[at[w]], d))
    return {d: (len(link[at[w]]), head[of[at[w]]]) for d, w in words.items()}


def near(seed, base, edits):
    draw, words = random.Random(seed), base.split()
    for _ in range(edits):
        words[draw.randrange(len(words))] = "changed%d" % draw.randrange(10 ** 6)
    return " ".join(words)


def test_same_as_all_pairs(docs_of):
    base = [prose(s, 120) for s in range(6)]
    rows = [(i, near(i, base[i % 6], i % 5)) for i in range(150)] + [(200 + i, prose(900 + i, 3 + i)) for i in range(40)]
    rows += [(400, base[0]), (401, base[0].upper()), (402, None), (403, "")]
    got = {r["doc_id"]: (r["links"], r["class_id"]) for r in J.near_duplicates(docs_of(rows)).collect()}
    assert got == brute(rows)


def test_blocks_give_the_same(docs_of, monkeypatch):
    base = prose(7, 100)
    rows = [(i, near(i, base, 1 + i % 4)) for i in range(120)]
    want = {r["doc_id"]: (r["links"], r["class_id"]) for r in J.near_duplicates(docs_of(rows)).collect()}
    monkeypatch.setattr(J, "BLOCK_NODES", 16)
    assert {r["doc_id"]: (r["links"], r["class_id"]) for r in J.near_duplicates(docs_of(rows)).collect()} == want == brute(rows)


def test_one_of_each_class_stays(docs_of):
    base = prose(3, 80)
    rows = [(5, base), (6, base + " more"), (7, prose(4, 80)), (5, base)]
    docs = docs_of(rows)
    assert sorted(r["doc_id"] for r in J.keep_one(docs).collect()) == [5, 7]
    assert sum(r["kept"] for r in J.near_duplicates(docs).collect()) == 2
    assert J.keep_one(docs).columns == docs.columns


@pytest.mark.parametrize("threshold,recall", [(0.8, 0.9999), (0.8, 0.9), (0.5, 0.95)])
def test_bands_reach_the_recall(threshold, recall):
    bands, rows = J.bands_for(threshold, recall, 96)
    assert 1 - (1 - threshold ** rows) ** bands >= recall and bands * rows <= 96


def test_odd_rows(odd_docs):
    rows = J.near_duplicates(odd_docs).collect()
    assert len(rows) == 13
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[5][0]["class_id"] == by[6][0]["class_id"] == 5
    assert {r["class_id"] for d in (1, 2, 3) for r in by[d]} == {None} and by[2][0]["copies"] == 4
    assert sum(r["kept"] for d in (7, 8) for r in by[d]) == 1
    assert J.near_duplicates(odd_docs.limit(0)).count() == 0
    assert J.keep_one(odd_docs).columns == odd_docs.columns
