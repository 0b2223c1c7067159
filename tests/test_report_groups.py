"""Reports group findings that lie in buckets of their groups, so that no finding moves."""

from __future__ import annotations

import json

from scanweave.operators import aggregate as a
from scanweave.sources import tables as tb

SCHEMA = ("project string, file string, line int, rank int, pack_no int, rule_no int, severity string, title string, category string, "
          "reference string, finding_id string, is_baseline boolean, suppressed boolean, acknowledged boolean")


def _findings(spark):
    rows = [(f"p{i % 3}", f"/r/{i % 7}.ts", i, i % 2, 0, i % 2, ("critical", "high")[i % 2], ("Open  port", "open port ")[i % 4 // 2],
             "encryption", None, f"f-{i}", False, False, i % 5 == 0) for i in range(60)]
    return spark.createDataFrame(rows + rows[:6], SCHEMA).repartition(5)


def test_grouping_moves_no_finding(spark):
    f, by = a.by_group(_findings(spark), ["project"]), ["project"]
    for made in (a.group_findings(f, by), a.group_examples(f, by)):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    plain = _findings(spark)
    for op in (a.group_findings, a.group_examples):
        assert sorted(map(str, op(f, by).collect())) == sorted(map(str, op(plain, by).collect()))
    assert a.headline(f, by).orderBy("project").collect() == a.headline(plain, by).orderBy("project").collect()


def test_documents_have_all_groups_and_clean_projects(spark):
    units = spark.createDataFrame([("p0",), ("p1",), ("p2",), ("p9",)], "project string")
    got = {r["project"]: json.loads(r["document"]) for r in tb.report_documents(_findings(spark), units=units).collect()}
    assert got.keys() == {"p0", "p1", "p2", "p9"} and got["p9"]["summary"] == [] and got["p9"]["score"] == 100
    assert [g["title_key"] for g in got["p0"]["summary"]] == ["open port", "open port"]
    assert sum(g["occurrence_count"] for p in got.values() for g in p["summary"]) == 66
    assert all(len(g["examples"]) == min(5, g["file_count"]) for p in got.values() for g in p["summary"])
