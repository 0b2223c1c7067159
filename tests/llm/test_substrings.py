import hashlib
import random
from collections import Counter

from corpus_rows import prose

from scanweave.llm import substrings as S


def brute(rows):
    """doc_id, n_words, n_removed, text that is left, from all windows at once."""
    texts = [[w for w in _split(t or "")] for _, t in rows]
    seen = Counter(tuple(ws[i:i + 35]) for ws in texts for i in range(len(ws) - 34))
    out = []
    for (doc, _), ws in zip(rows, texts, strict=True):
        gone = {i + k for i in range(len(ws) - 34) if seen[tuple(ws[i:i + 35])] > 1 for k in range(35)}
        out.append((doc, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return sorted(out, key=str)


def _split(text):
    return [w.decode() for w in text.encode().split()]


def _check(docs, rows):
    got = S.dedup_substrings(docs)
    assert got.columns == ["doc_id", "n_words", "n_removed", "text"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_passages_and_copies(docs_of):
    common = [prose(100 + i, n) for i, n in enumerate((34, 35, 36, 60, 300))]
    rows = [(i, f"{prose(i, 5 + i)} {common[i % 5]}  {prose(500 + i, 20)}\n{common[(i * 3) % 5]}") for i in range(30)]
    rows += [(40, common[4]), (41, common[4]), (42, " ".join(["again"] * 90)), (43, " ".join(["only", "two"] * 18)), (44, prose(7, 34))]
    _check(docs_of(rows), rows)


def test_pieces_and_shards_of_any_size(docs_of, monkeypatch):
    monkeypatch.setattr(S, "SHARD_WORDS", 100)
    monkeypatch.setattr(S, "STREAM_WORDS", 60)
    long = prose(3, 9000)
    words = long.split()
    rows = [(0, long), (1, " ".join(words[1000:6000])), (2, " ".join(words[4000:4100] + words[50:130])), (3, long + " end")]
    rows += [(9, prose(77, 80) + f" {i} " + prose(78, 50)) for i in range(25)]
    _check(docs_of(rows), rows)


def test_odd_rows(odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    _check(odd_docs, rows)
    report = S.substring_report(odd_docs).collect()
    assert {r["kept_sha256"] for r in report} == {hashlib.sha256(r[3].encode()).hexdigest() for r in brute(rows)}
    empty = S.substring_report(odd_docs.limit(0))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]


def test_no_text_long_enough(docs_of):
    rows = [(i, "a few words") for i in range(4)]
    _check(docs_of(rows), rows)


def test_automaton_against_all_substrings():
    draw = random.Random(5)
    for _ in range(60):
        passages = [[draw.choice([b"a", b"b", b"c"]) for _ in range(draw.randrange(1, 12))] for _ in range(draw.randrange(1, 5))]
        automaton = S.SuffixAutomaton.from_bytes(S.SuffixAutomaton.of(passages).to_bytes())
        inside = {tuple(p[i:j]) for p in passages for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
        text = [draw.choice([b"a", b"b", b"c", b"d"]) for _ in range(40)]
        for least in (1, 2, 3, 5):
            covered = {k for i in range(40) for j in range(i + least, 41) if tuple(text[i:j]) in inside for k in range(i, j)}
            spans = automaton.spans(text, least)
            assert {k for a, b in spans for k in range(a, b)} == covered
            assert all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))
