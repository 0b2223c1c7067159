"""Projects with equal paths, clean projects, and files that are no clean UTF-8."""

import pytest
from pyspark.sql import functions as F

from scanweave.operators import aggregate as a
from scanweave.operators import files as fl
from scanweave.operators import fixes as fx
from scanweave.operators import history as h
from scanweave.operators import lifecycle as lc
from scanweave.plans.scan import scan
from scanweave.sources import corpus as src

FILES = "project string, file string, content string"


@pytest.fixture(scope="module")
def everything(spark):
    line = "const password = 'hunter2hunter2';\nfetch('http://records.clinic.org/patients');"
    rows = [("p1", "src/a.ts", line), ("p2", "src/a.ts", line), ("p3", "src/clean.ts", "const x = 1;")]
    return scan(spark.createDataFrame(rows, FILES))


@pytest.fixture(scope="module")
def found(everything):
    """What lines give; no project has a scanner's configuration, which is a finding of each."""
    return everything.filter("rule_id <> 'HIPAA-PENTEST-001'")


def test_every_project_is_asked_for_a_scanner(everything):
    rows = everything.filter("rule_id = 'HIPAA-PENTEST-001'").select("project", "file", "line").collect()
    assert sorted(map(tuple, rows)) == [(p, "project-level", None) for p in ("p1", "p2", "p3")]


def test_category_scores_list_all_five(spark, found):
    units = spark.createDataFrame([("p1",), ("p3",)], "project string")
    got = {}
    for r in a.category_scores(found, units=units).collect():
        got.setdefault(r["project"], {})[r["category"]] = (r["findings"], r["score"], r["grade"])
    assert set(got["p1"]) == {*a.CATEGORY_LABELS.values(), "overall"} and got["p1"]["overall"][0] > 0
    assert got["p3"] == {label: (0, 100, None) for label in a.CATEGORY_LABELS.values()} | {"overall": (0, 100, "A+")}


def test_roots_are_what_paths_share(spark):
    rows = [("a", "/r/a/src/x.ts", "x"), ("a", "/r/a/src/y/z.ts", "x"), ("b", "/r/b/one.ts", "x"), ("c", "top.ts", "x"), ("c", "src/x.ts", "x"),
            ("d", "/r/d/.snyk", "x"), ("d", "/r/d/src/x.ts", "x"), ("e", "/r/e/sub/.snyk", "x"), ("e", "/r/e/a.ts", "x")]
    c = spark.createDataFrame(rows, FILES)
    assert {r["project"]: r["root"] for r in fl.project_roots(c).collect()} == {
        "a": "/r/a/src", "b": "/r/b", "c": "", "d": "/r/d", "e": "/r/e"}
    assert sorted(r["project"] for r in fl.missing_vulnerability_scan(c).collect()) == ["a", "b", "c", "e"]


def test_scan_keeps_findings_of_both_projects(found):
    counts = {r["project"]: r["count"] for r in found.groupBy("project").count().collect()}
    assert counts["p1"] == counts["p2"] > 0 and "p3" not in counts


def test_a_baseline_silences_its_own_project_only(found):
    old = lc.baseline_of(found.filter("project = 'p1'"))
    left = {r["project"] for r in lc.new_findings(found, old).select("project").distinct().collect()}
    assert left == {"p2"}
    flags = lc.apply_baseline(found.drop("is_baseline"), old).groupBy("project").agg(F.bool_and("is_baseline").alias("b"))
    assert {r["project"]: r["b"] for r in flags.collect()} == {"p1": True, "p2": False}


def test_places_and_verdicts_are_of_one_project(found):
    places = a.group_by_location(found)
    assert places.filter("project = 'p1'").count() == places.filter("project = 'p2'").count() > 0
    verdicts = found.filter("project = 'p1'").select(
        "project", "file", "line", "finding_id", F.lit("false_positive").alias("classification"), F.lit(0.9).alias("ai_confidence"))
    assert {r["project"] for r in lc.merge_verdicts(found, verdicts.distinct()).collect()} == {"p2"}


def test_clean_projects_score_full(spark, found):
    units = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "project string")
    scores = {r["project"]: r for r in a.recommendations(a.compliance_score(found, units=units)).collect()}
    assert scores["p3"]["score"] == 100 and scores["p3"]["grade"] == "A" and scores["p3"]["total"] == 0
    assert scores["p3"]["recommendations"][0].startswith("Excellent!") and scores["p1"]["score"] < 100
    assert {r["project"]: r["status"] for r in a.executive_status(found, units=units).collect()}["p3"] == "compliant"
    gate = {r["project"]: r for r in a.gates(found, units=units).collect()}["p3"]
    assert not gate["scan_fails"] and not gate["score_fails"] and gate["skill_verdict"] == "safe"
    assert {r["project"]: r["total"] for r in a.report_summary(found, units=units).collect()}["p3"] == 0


def test_clean_scans_have_an_entry_and_resolve_rules(spark, found):
    scans = spark.sql("SELECT * FROM VALUES ('p1', 1L, TIMESTAMP'2024-01-01', 7L), ('p1', 2L, TIMESTAMP'2024-01-02', 8L) "
                      "AS t(project, scan_id, scan_ts, files)")
    first = found.filter("project = 'p1'").withColumns({"scan_id": F.lit(1).cast("long"), "scan_ts": F.lit("2024-01-01").cast("timestamp")})
    entries = h.history_entries(first, scans=scans)
    got = {r["scan_id"]: r for r in entries.collect()}
    assert got[2]["score"] == 100 and got[2]["files"] == 8 and got[2]["failed_rules"] == [] and got[1]["failed_rules"]
    last = {r["scan_id"]: r for r in h.compare_with_previous(entries).collect()}[2]
    assert sorted(last["resolved_rules"]) == got[1]["failed_rules"]


def test_fixes_stay_in_their_project(spark):
    corpus = spark.createDataFrame([("p1", "a.ts", "one\ntwo\nthree"), ("p2", "a.ts", "x\ny")], FILES)
    steps = spark.createDataFrame(
        [("p1", "a.ts", 2, 0, "f", "t", "n", "r", "two", "2", True), ("p1", "a.ts", 2, 1, "f", "t", "n", "r", "2", "zwei", True),
         ("p1", "a.ts", 3, 0, "f", "t", "n", "r", "three", "drei", True)],
        "project string, file string, line int, k int, finding_id string, fix_type string, title string, reference string, "
        "before string, after string, fixed boolean")
    assert [(r["project"], r["fixed_content"]) for r in fx.apply_fixes(corpus, steps).collect()] == [("p1", "one\nzwei\ndrei")]
    rows = fx.evidence(corpus, steps).orderBy("step").collect()
    assert [r["project"] for r in rows] == ["p1"] * 3
    assert [[x["content"] for x in r["after"]][1:] for r in rows] == [["two", "drei"], ["2", "drei"], ["zwei", "drei"]]


def test_fixes_of_a_long_file_are_linear(spark):
    n = 20_000
    corpus = spark.createDataFrame([("p", "long.ts", "\n".join(f"l{i}" for i in range(1, n + 1)))], FILES)
    steps = spark.range(1, n + 1, 2).selectExpr(
        "'p' AS project", "'long.ts' AS file", "CAST(id AS INT) AS line", "0 AS k", "'f' AS finding_id", "'t' AS fix_type",
        "'n' AS title", "'r' AS reference", "concat('l', id) AS before", "concat('f', id) AS after", "true AS fixed")
    text = fx.apply_fixes(corpus, steps).first()["fixed_content"].split("\n")
    assert text == [f"{'f' if i % 2 else 'l'}{i}" for i in range(1, n + 1)]


def test_no_file_is_lost(spark, tmp_path):
    (tmp_path / "alpha").mkdir()
    (tmp_path / "alpha" / "latin.ts").write_bytes("caf\xe9\npassword".encode("latin-1"))
    (tmp_path / "alpha" / "binary.dat").write_bytes(bytes(range(256)))
    (tmp_path / "alpha" / "big.ts").write_text("x" * 1_300_000)
    project = F.regexp_extract("file", r"/([^/]+)/[^/]+$", 1)
    rows = {r["file"].split("/")[-1]: r for r in src.read_files(spark, str(tmp_path), project).collect()}
    assert set(rows) == {"latin.ts", "binary.dat", "big.ts"} and {r["project"] for r in rows.values()} == {"alpha"}
    assert rows["latin.ts"]["content"] == "caf�\npassword" and len(rows["big.ts"]["content"]) == 1_300_000
    some = src.read_files(spark, str(tmp_path), project, max_bytes=1_000_000, keep_skipped=True)
    assert src.size_report(some, 1_000_000).first().asDict() == {"project": "alpha", "scanned": 2, "skipped": 1}


def test_report_without_acknowledgements(found):
    assert found.schema["acknowledgment"].dataType.typeName() == "struct"
    assert a.report_summary(found).filter("acknowledged = 0").count() == 2
