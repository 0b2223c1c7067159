"""Small builders of Spark SQL expression text."""

from __future__ import annotations

from scanweave.functions.regex import to_java


def lit(text: str) -> str:
    """A string literal; ``${`` is spelled out because Spark would substitute a variable there."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("${", "\\u0024{") + "'"


def like(column: str, pattern: str) -> str:
    return f"{column} RLIKE {lit(to_java(pattern))}"


def has_any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {lit(w)})" for w in words) + ")"


def js_trim(column: str) -> str:
    return f"regexp_replace({column}, {lit(to_java(chr(94) + chr(92) + 's+|' + chr(92) + 's+$'))}, '')"
