"""Numbered placeholders for personal data in texts, and their way back.

Each kind runs over the text the kinds before it left; the parts between hits are joined again with the placeholder of
the hit's number. All of it is one expression per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.functions.regex import to_java
from scanweave.functions.sql import lit

# Kinds in order with their patterns.
KINDS = [
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("PHONE", r"\b(?:\+?1[-.]?)?\(?\d{3}\)?[-.]?\d{3}[-.]?\d{4}\b"),
    ("DOB", r"\b(?:0[1-9]|1[0-2])[-/](?:0[1-9]|[12]\d|3[01])[-/](?:19|20)\d{2}\b"),
    ("MRN", r"(?i)\bMRN[-:\s]*\d{6,10}\b"),
    ("IP", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
]


def scrub(texts: DataFrame, column: str = "text") -> DataFrame:
    """Adds ``clean`` text, ``found`` total, ``counts`` per kind and ``replaced`` placeholder-original pairs.

    A kind runs only if the original text matches it, even where earlier placeholders changed the text since.
    """
    steps = (f"array(named_struct('clean', {column}, 'replaced', "
             "CAST(array() AS array<struct<placeholder:string,original:string>>)))")
    for kind, pattern in KINDS:
        p = lit(to_java(pattern))
        name = f"concat('[PHI_{kind}_', k, ']')"
        joined = (f"array_join(transform(split(s.clean, {p}, -1), (x, k) -> CASE WHEN k = 0 THEN x "
                  f"ELSE concat({name}, x) END), '')")
        pairs = (f"transform(regexp_extract_all(s.clean, {p}, 0), (x, j) -> named_struct('placeholder', "
                 f"concat('[PHI_{kind}_', j + 1, ']'), 'original', x))")
        needed = f"contains({column}, '@') AND " if kind == "EMAIL" else ""
        steps = (f"transform({steps}, s -> CASE WHEN {needed}{column} RLIKE {p} THEN named_struct('clean', {joined}, 'replaced', "
                 f"concat(s.replaced, {pairs})) ELSE s END)")
    counts = ", ".join(
        f"'{kind}', size(filter(replaced, r -> startswith(r.placeholder, '[PHI_{kind}_')))" for kind, _ in KINDS)
    return (
        texts.withColumn("_s", F.explode(F.expr(steps)))
        .withColumns({"clean": F.col("_s.clean"), "replaced": F.col("_s.replaced")}).drop("_s")
        .withColumn("found", F.size("replaced")).withColumn("counts", F.expr(f"map({counts})"))
    )


def restore(scrubbed: DataFrame) -> DataFrame:
    """Puts originals back, last replaced first."""
    return scrubbed.withColumn("restored", F.expr(
        "aggregate(reverse(replaced), clean, (acc, r) -> replace(acc, r.placeholder, r.original))"))
