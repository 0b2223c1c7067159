"""Rules are tried on rows that hold a line and those around it."""

from __future__ import annotations

import pytest

from scanweave.operators import detect as d


@pytest.mark.parametrize("prefilter", [True, False])
def test_a_row_carries_the_lines_around_and_not_the_file(spark, prefilter):
    """The rules are tried on rows without the file's text, in a filter of its own."""
    text = "\n".join(["x"] * 400 + ["const ssn = '123-45-6789';"] + ["y"] * 400)
    c = spark.createDataFrame([("p", "/p/src/a.ts", text), ("p", "/p/src/b.ts", None)], "project string, file string, content string")
    f = d.detect(c, ["phi"], prefilter)
    got = f.filter("rule_id = 'ssn-hardcoded'").select("line", "code", "prev", "ctx_from", "ctx").collect()
    assert [tuple(r) for r in got] == [(401, "const ssn = '123-45-6789';", "x", 398, ["x", "x", "const ssn = '123-45-6789';", "y", "y"])]
    plan = f._jdf.queryExecution().optimizedPlan().toString()
    tried = next(line for line in plan.split("\n") if "Filter" in line and "l#" in line)
    assert "content" not in tried and "ls__" not in tried


def test_no_rules_no_findings(spark):
    c = spark.createDataFrame([("p", "/p/a.ts", "x")], "project string, file string, content string")
    assert d.detect_rules(c, []).columns == d.FINDING_COLUMNS and not d.detect_rules(c, []).collect()
