"""Whole scans: category choice, detection, lifecycle and score in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.operators import lifecycle as lc
from scanweave.operators.detect import detect, detect_rules
from scanweave.operators.files import audit_rules, file_findings
from scanweave.rules.catalog import CATEGORY_PACKS, PACK_NAMES, line_rules
from scanweave.sources.rules import compile_rules


def pack_bridge(spark, categories) -> DataFrame:
    """Which pack runs for which category; a pack may serve several, its findings then appear once per category."""
    rows = [(c, p) for c in categories for p in CATEGORY_PACKS[c]]
    return spark.createDataFrame(rows, "run_category string, pack string")


def detect_categories(corpus: DataFrame, categories, keep=()) -> DataFrame:
    """Findings of the packs of the chosen categories; every pack is evaluated once."""
    bridge = pack_bridge(corpus.sparkSession, categories)
    names = [p for p in PACK_NAMES if any(p in CATEGORY_PACKS[c] for c in categories)]
    return detect(corpus, names, keep=keep).join(F.broadcast(bridge), "pack")


def scan(corpus: DataFrame, categories=None, acks=(), as_of: str | None = None, baseline: DataFrame | None = None,
         min_confidence: str | None = None, keep=(), custom=()) -> DataFrame:
    """A whole scan: detection, acknowledgement, suppression, confidence, baseline, demotion, duplicates.

    Line rules, the audit rules and ``custom`` rules (checked rule rows) share one pass over the files; file, project and
    skill checks are added. ``run_category`` is the category that ran a finding's pack, or a custom rule's own.
    """
    chosen = list(categories or CATEGORY_PACKS)
    names = {p for c in chosen for p in CATEGORY_PACKS[c]}
    files = corpus.filter("content IS NOT NULL")
    rules = [*line_rules([p for p in PACK_NAMES if p in names]), *(audit_rules() if "audit" in names else ()), *compile_rules(custom)]
    found = detect_rules(files, rules, keep=keep).unionByName(file_findings(files, names, keep))
    found = found.join(F.broadcast(pack_bridge(corpus.sparkSession, chosen)), "pack", "left").withColumn(
        "run_category", F.coalesce("run_category", "category"))
    found = lc.classify_confidence(lc.suppress(lc.acknowledge(found, acks, as_of)))
    found = lc.apply_baseline(found, baseline) if baseline is not None else found.withColumn("is_baseline", F.lit(False))
    if min_confidence:
        found = lc.demote_below(found, min_confidence)
    return lc.dedupe(found)
