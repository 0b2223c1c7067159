"""Custom rules as rows: loading, overriding and validation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanweave.functions.regex import to_java
from scanweave.rules.catalog import CATEGORY_PACKS, packs
from scanweave.rules.model import CATEGORIES, LINE, SEVERITY_RANK, Condition, Pack, Rule

RULE_ROWS = (
    "id string, name string, description string, category string, severity string, pattern string, flags string, "
    "include array<string>, exclude array<string>, recommendation string, reference string, must_not_contain string, "
    "confidence string, adjust_confidence boolean, load_order bigint"
)
# Accepted flags and the default.
KNOWN_FLAGS = "gimsuy"
DEFAULT_FLAGS = "gi"


def load_rules(rows: DataFrame) -> DataFrame:
    """The last loaded row of each id; unknown flags are dropped, missing ones get the default."""
    last = rows.groupBy("id").agg(F.max_by(F.struct(*rows.columns), "load_order").alias("r")).select("r.*")
    flags = F.coalesce(F.nullif("flags", F.lit("")), F.lit(DEFAULT_FLAGS))
    return last.withColumn("flags", F.regexp_replace(flags, f"[^{KNOWN_FLAGS}]", ""))


def read_rules(spark: SparkSession, *paths: str) -> DataFrame:
    """Rules of JSON files and folders of such files; the paths must exist."""
    return load_rules(spark.read.schema(RULE_ROWS).json(list(paths)))


@F.pandas_udf(T.StringType())
def _java(patterns: pd.Series) -> pd.Series:
    return patterns.map(to_java)


def compiles(pattern: Column) -> Column:
    """Whether the engine that runs rules accepts the pattern, as it would be given to it."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), _java(pattern)).isNotNull()


def rule_errors(rows: DataFrame) -> DataFrame:
    """One row per violated condition of a rule row; each distinct pattern is compiled once."""
    patterns = rows.select(F.col("pattern").alias("p")).union(rows.select("must_not_contain")).distinct().filter(
        "p IS NOT NULL").withColumn("ok", compiles(F.col("p")))
    broken = patterns.filter("NOT ok").select("p", F.lit(True).alias("bad"))
    r = rows.join(broken.withColumnRenamed("bad", "_bad_p"), F.col("pattern") == F.col("p"), "left").drop("p")
    r = r.join(broken.withColumnRenamed("bad", "_bad_n"), F.col("must_not_contain") == F.col("p"), "left").drop("p")

    def empty(col):
        return F.when(F.coalesce(F.col(col), F.lit("")) == "", F.lit(f"{col} is required"))

    errors = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("id"), F.lit("")).rlike("^[a-z0-9-]+$"), F.lit("id must be lowercase alphanumeric with hyphens")),
        empty("name"), empty("description"), empty("pattern"), empty("recommendation"),
        F.when(~F.coalesce(F.col("category"), F.lit("")).isin(*CATEGORIES), F.lit("unknown category")),
        F.when(~F.coalesce(F.col("severity"), F.lit("")).isin(*SEVERITY_RANK), F.lit("unknown severity")),
        F.when(F.col("_bad_p"), F.lit("pattern does not compile")),
        F.when(F.col("_bad_n"), F.lit("must_not_contain does not compile"))))
    return r.select("load_order", "id", F.explode(errors).alias("error"))


_DOLLAR = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]|\$", re.S)


def _flagged(pattern: str, flags: str) -> str:
    """The pattern under its flags: ``i`` ignores case, ``m`` lets ``^`` and ``$`` match at line ends, ``s`` lets ``.`` match
    them, ``y`` ties the match to the start; ``g`` and ``u`` change nothing about whether a line matches."""
    if "m" in flags:
        ends = _DOLLAR.sub(lambda t: r"(?=[\r\n\u2028\u2029]|$)" if t[0] == "$" else t[0], pattern)
        pattern = f"(?m:{ends})"
    if "s" in flags:
        pattern = f"(?s:{pattern})"
    if "y" in flags:
        pattern = f"\\A(?:{pattern})"
    if "i" in flags:
        pattern = "(?i)" + (pattern if pattern.isascii() else f"(?u:{pattern})")
    return pattern


def compile_rules(rows, first_no: int = 10_000):
    """Rule rows (plain mappings) to ``(pack, rule)`` pairs for detection, under their flags.

    Detection compiles every rule into the plan, so the caller passes a checked rule file, not a data table.
    """
    pack = Pack("custom", 90, ".", "custom-{id}-{file}-{i}", 2, "")
    out = []
    for k, row in enumerate(rows):
        flags = row.get("flags") or DEFAULT_FLAGS
        never = row.get("must_not_contain")
        out.append((pack, Rule(
            no=first_no + k, pack="custom", id=row["id"], category=row["category"], severity=row["severity"],
            title=row["name"], reference=row.get("reference") or "", patterns=(_flagged(row["pattern"], flags),),
            forbid=(Condition(LINE, (_flagged(never, flags),)),) if never else (), include=tuple(row.get("include") or ()),
            exclude=tuple(row.get("exclude") or ()), confidence=row.get("confidence"),
            adjust_confidence=row.get("adjust_confidence") is not False, advice=row.get("recommendation"))))
    return out


def checked_rules(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rule rows without a fault, errors): one bad rule of a file doesn't keep the others from running."""
    errors = rule_errors(rows)
    return rows.join(errors.select("load_order").distinct(), "load_order", "left_anti").select(rows.columns), errors


# Rules of the model-backed pack and of the audit pack, catalog rows only; the owning category of a pack.
AI_RULES = [
    ("HIPAA-PHI-003", "phi-exposure"), ("HIPAA-SEC-001", "encryption"), ("HIPAA-ACCESS-001", "access-control"),
    ("HIPAA-AUDIT-001", "audit-logging"), ("HIPAA-RETENTION-001", "data-retention"), ("HIPAA-AUTH-001", "access-control"),
]
AUDIT_RULES = [("audit-no-framework", "high"), ("audit-unlogged-action", "medium")]
OWNER = {
    "phi": "phi-exposure", "encryption": "encryption", "credentials": "encryption", "configuration": "audit-logging",
    "errors": "audit-logging", "operational": "data-retention", "retention": "data-retention",
}


def catalog_table(spark: SparkSession) -> DataFrame:
    """All built-in rules: id, category of the owning pack, severity, pack, source."""
    rows = [(r.id, OWNER.get(p.name, "access-control"), r.severity, p.name, "pattern")
            for p in packs().values() for r in p.rules]
    rows += [(i, "audit-logging", s, "audit", "pattern") for i, s in AUDIT_RULES]
    rows += [(i, c, "info", "ai", "ai") for i, c in AI_RULES]
    return spark.createDataFrame(rows, "id string, category string, severity string, pack string, source string")


def packs_of(categories) -> list[str]:
    return sorted({p for c in categories for p in CATEGORY_PACKS[c]})
