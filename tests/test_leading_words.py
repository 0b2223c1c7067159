"""The words that start a pattern's matches, and the folded text of a finding's context."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from scanweave.functions.regex import _MOST_STARTS, alternatives, leading_keywords
from scanweave.functions.sql import js_trim, lit
from scanweave.functions.regex import to_java
from scanweave.operators.detect import line_words
from scanweave.operators.lifecycle import snippet
from scanweave.rules.catalog import rule


def test_starts_go_on_into_branches():
    assert leading_keywords(r"(?:pg|postgres)\.(?:connect|Pool).*") == {"pg.connect", "pg.pool", "postgres.connect", "postgres.pool"}
    assert leading_keywords(r"\bapi[-_]?key\s*=") == {"api-key", "api_key", "apikey"}
    assert leading_keywords(r"ab?c+d") == {"abc", "ac"} and leading_keywords(r"x(?:y|\d)z") == {"x"}
    assert leading_keywords(r"a?\d") is None and leading_keywords(r"(?:ab){2}c") == {"ab"}
    assert alternatives(r"(?i)API[-_]?key.*end") == [frozenset([frozenset(["api-key", "api_key", "apikey"]), frozenset(["end"])])]


def test_many_starts_are_cut_and_not_dropped():
    words = leading_keywords("(?:" + "|".join(f"{a}{b}{c}q" for a in "abcde" for b in "fghij" for c in "klmno") + ")")
    assert words and len(words) <= _MOST_STARTS and all(any(w.startswith(s) for s in words) for w in ("afkq", "ejoq"))


def test_a_span_rule_asks_for_whole_words():
    words = {w for some in line_words(rule("HIPAA-ENC-REST-001")) for one in some for w in one}
    assert "pg.connect" in words and all(len(w) > 1 for w in words)


def test_folded_lines_are_those_folded_one_by_one(spark):
    lines = [["  A \t b ", "", None, " X﻿"], [], [" ", " "], None, ["ΑΣ", "y\r"]]
    rows = spark.createDataFrame([(x,) for x in lines], "ctx array<string>")
    folded = f"regexp_replace(lower({js_trim('c')}), {lit(to_java(chr(92) + 's+'))}, ' ')"
    one_by_one = F.expr(f"array_join(transform(ctx, c -> {folded}), '\\n')")
    assert [r[0] for r in rows.select(snippet()).collect()] == [r[0] for r in rows.select(one_by_one).collect()]
    assert not re.search("transform|lambda", rows.select(snippet())._jdf.queryExecution().optimizedPlan().toString())
