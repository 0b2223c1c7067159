import random

import duckdb
from corpus_rows import prose

from scanweave.llm import components as C
from scanweave.llm import exact_dedup as E
from scanweave.llm import line_dedup as L


def sql(query, docs):
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    return con.execute(query).fetchall()


def test_cuckoo_index_against_a_set():
    draw, index, live = random.Random(1), E.CuckooIndex(2), {}
    keys = [draw.randbytes(16) for _ in range(3000)] + [bytes(2) + draw.randbytes(14) for _ in range(500)]
    for step in range(12_000):
        key = draw.choice(keys)
        if key in live:
            assert index.find(key) == live[key]
            if step % 3 == 0:
                assert index.delete(key)
                del live[key]
        else:
            assert index.find(key) == -1 and not index.delete(key)
            live[key] = index.insert(key)
    assert index.live == len(live) and all(index.find(k) == n for k, n in live.items())


def test_many_keys_in_the_same_buckets():
    index, same = E.CuckooIndex(1), [b"\x00\x07" + i.to_bytes(8, "big") + bytes(6) for i in range(400)]
    numbers = [index.insert(k) for k in same]
    assert [index.find(k) for k in same] == numbers


def test_exact_dedup_same_as_sql(docs_of):
    rows = [(i, prose(i % 12, 8).upper() if i % 2 else prose(i % 12, 8)) for i in range(60)] + [(100, None), (101, ""), (102, "É"), (103, "é")]
    docs = docs_of(rows)
    got = sorted(map(tuple, E.exact_dedup(docs).collect()))
    assert got == sorted(sql(E.SQL, docs))
    assert sorted(r["doc_id"] for r in E.keep_one(docs).collect()) == sorted(r[0] for r in got if r[3])


def test_the_same_row_stays_over_any_partitions(docs_of):
    from scanweave.llm import ngram_join as J

    body = " " + prose(5, 40)
    rows = [(1, "ABC d" + body), (1, "abc D" + body), (1, "Abc d" + body), (2, "other")]
    for keep in (E.keep_one, J.keep_one):
        kept = [sorted(map(tuple, keep(docs_of(rows, n)).collect())) for n in (1, 2, 5)]
        assert kept[0] == kept[1] == kept[2]


def test_exact_dedup_odd_rows(odd_docs):
    rows = E.exact_dedup(odd_docs).collect()
    assert len(rows) == 13 and len({r["text_sha256"] for r in rows}) == sum(r["kept"] for r in rows) == E.keep_one(odd_docs).count()
    assert {r["keep_id"] for r in rows if r["group_size"] == 3} == {2, 8}
    assert E.exact_dedup(odd_docs.limit(0)).count() == 0


def test_live_digests_after_removals(spark):
    rows = [("aa" * 16, 1, 0, 1), ("aa" * 16, 2, 1, 1), ("bb" * 16, 3, 2, 1), ("bb" * 16, 3, 3, -1), ("cc" * 16, None, 4, 1)]
    live = E.live_digests(spark.createDataFrame(rows, "digest string, doc_id long, row_no long, n int").repartition(3))
    assert sorted((r["digest"][:2], r["keep_id"], r["group_size"]) for r in live.collect()) == [("aa", 2, 2), ("cc", None, 1)]


def test_removing_the_largest_of_several(spark):
    rows = [("aa" * 16, i, i, 1) for i in range(5)] + [("aa" * 16, 4, 4, -1), ("aa" * 16, 3, 77, -1)]
    rows += [("bb" * 16, 7, 10, 1), ("bb" * 16, 7, 11, 1), ("bb" * 16, 7, 11, -1), ("bb" * 16, 9, 12, -1)]
    rows += [("cc" * 16, None, 13, 1), ("cc" * 16, 5, 14, 1), ("cc" * 16, 5, 14, -1), ("dd" * 16, 6, 15, 1), ("dd" * 16, 6, 15, -1)]
    live = E.live_digests(spark.createDataFrame(rows, "digest string, doc_id long, row_no long, n int").repartition(4))
    got = sorted((r["digest"][:2], r["keep_id"], r["keep_row"], r["group_size"]) for r in live.collect())
    assert got == [("aa", 2, 2, 3), ("bb", 7, 10, 1), ("cc", None, 13, 1)]


def test_lines_same_as_sql(docs_of):
    draw, lines = random.Random(5), [prose(i, 4) for i in range(9)] + ["", "  "]
    rows = [(i, "\n".join(draw.choice(lines) for _ in range(draw.randrange(1, 14)))) for i in range(80)]
    rows += [(200, "a\nb\nc\na\nb\nc"), (201, "x\nx\nx\nx\nx"), (202, None), (203, "\n\n\n\n")]
    docs = docs_of(rows)
    assert sorted(map(tuple, L.line_report(docs).collect())) == sorted(sql(L.SQL, docs))


def test_lines_by_hand(docs_of):
    docs = docs_of([(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd\ny"), (3, "c\nb\na")])
    assert {r["doc_id"]: r["text"] for r in L.dedup_lines(docs).collect()} == {1: "a\nb\nc\nd", 2: "x\ny", 3: "c\nb\na"}


def test_lines_odd_rows(odd_docs):
    rows = L.dedup_lines(odd_docs).collect()
    assert len(rows) == 13 and {r["n_removed"] for r in rows if r["doc_id"] == 9} == {3}
    assert {r["n_lines"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert L.dedup_lines(odd_docs.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)] + [("s", f"t{i}") for i in range(30)] + [("z", "z")]
    roots = {r["node"]: r["root"] for r in C.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert {r for n, r in roots.items() if n[0] == "c"} == {"c000"} and {r for n, r in roots.items() if n[0] == "t"} == {"s"}
    assert len(roots) == 70
