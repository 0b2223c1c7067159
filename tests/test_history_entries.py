"""Scans and their findings meet once."""

from __future__ import annotations

from scanweave.operators import history as h


def test_entries_take_files_and_counts_in_one_join(spark):
    findings = spark.createDataFrame(
        [("p", 1, "2024-01-01", "f", "r1", "high"), ("p", 1, "2024-01-01", "g", "r2", "low"), ("p", None, "2024-01-01", "f", "r1", "low")],
        "project string, scan_id bigint, scan_ts string, file string, rule_id string, severity string").selectExpr(
        "*", "false AS is_baseline", "false AS suppressed", "false AS acknowledged")
    scans = spark.createDataFrame(
        [("p", 1, "2024-01-01", 7), ("p", 2, "2024-01-02", 3), ("p", 2, "2024-01-02", 4), ("p", None, "2024-01-01", 9), (None, 3, "2024-01-01", 9)],
        "project string, scan_id bigint, scan_ts string, files bigint")
    e = h.history_entries(findings, scans=scans)
    assert e.columns == ["project", "scan_id", "scan_ts", "score", *h.SEVERITY_NAMES, "failed_rules", "files"]
    assert sorted(map(tuple, e.collect())) == [
        ("p", 1, "2024-01-01", 94, 0, 1, 0, 1, ["r1", "r2"], 7), ("p", 2, "2024-01-02", 100, 0, 0, 0, 0, [], 3),
        ("p", 2, "2024-01-02", 100, 0, 0, 0, 0, [], 4)]
    plan = e._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join " in line for line in plan.split("\n")) == 1, plan
    without = h.history_entries(findings, scans=scans.drop("files")).collect()
    assert sorted((r["scan_id"] or 0, r["files"]) for r in without if r["project"]) == [(0, 0), (1, 2), (2, 0)]
