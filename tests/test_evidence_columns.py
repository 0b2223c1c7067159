"""Evidence rows are made by column, not out of a dictionary for every line of a snapshot."""

from __future__ import annotations

import hashlib

import pyarrow as pa

from scanweave.operators import fixes as fx

STEP = pa.struct([("line", pa.int32()), *[(c, pa.string()) for c in ("finding_id", "fix_type", "title", "reference", "after")]])


def _batch():
    steps = [[{"line": 4, "finding_id": "c", "fix_type": "t", "title": "T", "reference": None, "after": "D\nd"},
              {"line": 1, "finding_id": "a", "fix_type": "t", "title": "T", "reference": "R", "after": "A"},
              {"line": 1, "finding_id": "b", "fix_type": "t", "title": "T", "reference": "R", "after": "AA"}]] * 3
    texts = ["a\nb\nc\nd", "x\né\n\nd", "a\nb\nc\nd\ne\nf"]
    columns = [pa.array(["p"] * 3), pa.array(["f", "g", "h"]), pa.array(texts), pa.array(steps, pa.list_(STEP))]
    return pa.RecordBatch.from_arrays(columns, names=["project", "file", "content", "steps"]), texts


def test_no_rows_of_dictionaries(monkeypatch):
    class Table:
        from_arrays = pa.RecordBatch.from_arrays

    batch, _ = _batch()
    monkeypatch.setattr(fx.pa, "RecordBatch", Table)  # it has no from_pylist
    assert sum(b.num_rows for b in fx._evidence_rows(1)(iter([batch]))) == 9


def test_steps_of_a_part_of_a_batch():
    batch, texts = _batch()
    rows = [r for b in fx._evidence_rows(1)(iter([batch.slice(1, 2)])) for r in b.to_pylist()]
    assert [(r["file"], r["step"], r["line"], r["finding_id"]) for r in rows] == [
        (f, n, line, i) for f in "gh" for n, (line, i) in enumerate([(4, "c"), (1, "a"), (1, "b")])]
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in (
        "x\né\n\nD\nd", "A\né\n\nD\nd", "AA\né\n\nD\nd", "a\nb\nc\nD\nd\ne\nf", "A\nb\nc\nD\nd\ne\nf", "AA\nb\nc\nD\nd\ne\nf")]
    assert [r["hash_after"] for r in rows] == sha
    assert [r["hash_before"] for r in rows[::3]] == [hashlib.sha256(t.encode()).hexdigest() for t in texts[1:]]
    shown = [[[(x["line_number"], x["content"], x["is_match"]) for x in r[c]] for c in ("before", "after")] for r in rows[3:5]]
    assert shown[0] == [[(3, "c", False), (4, "d", True), (5, "e", False)], [(3, "c", False), (4, "D\nd", True), (5, "e", False)]]
    assert shown[1] == [[(1, "a", True), (2, "b", False)], [(1, "A", True), (2, "b", False)]]
