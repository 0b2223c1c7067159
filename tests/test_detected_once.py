"""Queries that read findings more than once detect them once."""

from __future__ import annotations

import pytest

from checks import lifecycle, texts
from checks.catalog import QUERIES
from scanweave.operators import detect as d


@pytest.mark.parametrize("name", ["f07_manual_reviews", "t08_issue_difference"])
def test_result_reads_written_findings(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "parquet" in plan


def test_persisted_scans_and_their_findings_come_from_one_detection(spark, sf, monkeypatch):
    calls, plain = [], d.detect
    monkeypatch.setattr(d, "detect", lambda *a, **k: calls.append(1) or plain(*a, **k))
    QUERIES["s12_persist_scan"](spark, sf)
    assert len(calls) == 1 and lifecycle.d is d


def test_a_trail_writes_no_snapshots(spark, sf, monkeypatch):
    written, plain = [], texts.stored
    monkeypatch.setattr(texts, "stored", lambda df, name: written.append(df.columns) or plain(df, name))
    QUERIES["f06_project_trail"](spark, sf)
    assert written == [["project", "file", "step", "finding_id", "hash_before", "hash_after", "at"]]
