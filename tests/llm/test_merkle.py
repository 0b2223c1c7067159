"""The manifest against a plain build of the same trees, over odd rows and small fans of copies."""

import hashlib
import zlib

import pytest

from scanweave.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, node_id string, place int"


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row, text):
    parts = (row[0], row[1], row[2], row[3], text)
    return _h("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))


def _runs(level):
    return [level[a:a + 8] for a in range(0, len(level), 8)]


def _proofs(leaves):
    """Root, and for every leaf the runs on its way as (digests of the run, place in it)."""
    level, ways, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for way, i in zip(ways, range(len(at)), strict=True):
            way.append((level[at[i] // 8 * 8:at[i] // 8 * 8 + 8], at[i] % 8))
            at[i] //= 8
        level = [_h("".join(run)) for run in _runs(level)]
    return level[0], ways


def brute(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for r in rows:
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
        groups.setdefault(r[2], []).append((r[0], _leaf(r, r[4]), _leaf(r, r[4].translate(lower) if changed else r[4])))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = _proofs([x[1] for x in groups[lang]])
    root, tops = _proofs([trees[lang][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        subroot, ways = trees[lang]
        for (doc, leaf, given), way in zip(groups[lang], ways, strict=True):
            proof, fold = "", given
            for run, at in way + tops[k]:
                proof += "".join(run[:at] + run[at + 1:])
                fold = _h("".join(run[:at] + [fold] + run[at + 1:]))
            out.append((doc, leaf, subroot, root, _h(proof), fold, fold == root))
    return sorted(out, key=str)


def _check(spark, rows, parts=3):
    docs = spark.createDataFrame([r + ("x", 1) for r in rows], SCHEMA).repartition(parts)
    got = merkle.merkle_report(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_uneven_groups(spark):
    rows = [(i, f"s{i % 3}", f"l{i % 13 if i % 2 else 0}", i * 7, f"Text {i} " * (i % 5)) for i in range(150)]
    _check(spark, rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (3, "a", None, 1, ""), (3, "a", None, 1, "É UP"),
            (3, "a", "", 1, "UP"), (7, "b", "ä", None, "X" * 50_000), (-5, "b", "z", 2, "lower"), (9, "b", "ä", 2, None)]
    _check(spark, rows + [(12, "c", "same", 4, "Copy")] * 20)


@pytest.mark.parametrize("n", [1, 9, 65])
def test_one_group(spark, n):
    _check(spark, [(i, "s", "en", 1, f"Doc {i}") for i in range(n)])


def test_copies_of_high_nodes(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SPREAD", 2)
    _check(spark, [(i, "s", "en" if i % 9 else f"l{i}", 1, f"Doc {i}") for i in range(200)])


def test_empty(spark):
    got = merkle.merkle_report(spark.createDataFrame([], SCHEMA))
    assert got.collect() == [] and "proof_sha256" in got.columns
