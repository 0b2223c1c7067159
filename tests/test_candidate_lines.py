"""Which lines a rule tries, and which files it looks into."""

from __future__ import annotations

from scanweave.functions import keywords
from scanweave.functions.regex import alternatives, found_in_text
from scanweave.operators import detect as d
from scanweave.rules.catalog import rule


def test_a_line_is_tried_where_it_has_all_words_of_an_alternative(spark):
    words = {-9: ["patient"], -8: ["phone", "mobile"], -7: ["cell"], 4: ["ssn"]}
    text = "patient\nPhone of patient\n\nmobile\nssn cell\ncell PATIENT ssn"
    rows = spark.createDataFrame([(text,), (None,), ("phone",)], "t string")
    got = [r["m"] for r in rows.select(keywords.lines_with(words, {0: [[-9, -8], [-9, -7]], 1: [[-8]]})("t").alias("m")).collect()]
    assert got == [{0: [1, 5], 1: [1, 3], 4: [4, 5]}, {}, {1: [0]}]


def test_words_of_alternatives():
    assert alternatives("(?i)patient.*email|debug.*patient") == [
        frozenset([frozenset(["patient"]), frozenset(["email"])]), frozenset([frozenset(["patient"]), frozenset(["debug"])])]
    assert alternatives(r"abc|\d+") is None and alternatives("(?:ab)?.*cd") == [frozenset([frozenset(["cd"])])]
    assert found_in_text(r"\b\d{3}-\d{2}\b") and not found_in_text(r"^\d") and not found_in_text(r"\d(?!x)")


def test_a_rule_without_words_looks_at_the_text_first(spark):
    """Its pattern is tried on lines only of files that have it somewhere, whole or in pieces."""
    p = next(p for p, r in d.line_rules(["phi"]) if r.id == "ssn-hardcoded")
    rules = [(p, rule("ssn-hardcoded"))]
    c = spark.createDataFrame([("p", "/p/src/a.ts", "x\n123-45-6789\ny"), ("p", "/p/src/b.ts", "1-2\n3"), ("p", "/p/src/c.ts", None)],
                              "project string, file string, content string")
    f = d.detect_rules(c, rules)
    assert [tuple(r) for r in f.select("file", "line").collect()] == [("/p/src/a.ts", 2)]
    plan = f._jdf.queryExecution().optimizedPlan().toString()
    assert any("content" in line and "RLIKE" in line and "Generate" in line for line in plan.split("\n")), plan
    assert d.detect_rules(c, rules, prefilter=False).select("file", "line").collect() == f.select("file", "line").collect()
