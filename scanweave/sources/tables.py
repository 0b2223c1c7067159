"""Stored results: baseline, history, scans, reports and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanweave.operators.aggregate import by_group, compliance_score, group_examples, group_findings, headline
from scanweave.sources.folders import stored, work_folder

__all__ = [
    "HISTORY_SCHEMA", "append_history", "export_groups", "persist_scan", "project_state", "read_baseline", "read_history",
    "report_documents", "stored", "stored_scans", "work_folder", "write_baseline", "write_documents",
]

HISTORY_SCHEMA = (
    "project string, scan_id bigint, scan_ts timestamp, score bigint, critical bigint, high bigint, medium bigint, "
    "low bigint, failed_rules array<string>, files bigint"
)


def write_baseline(baseline: DataFrame, path: str) -> None:
    baseline.write.mode("overwrite").parquet(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_history(entries: DataFrame, path: str, batch: str = "0") -> None:
    """Writes scan entries as JSON lines, in one folder per batch and month. A batch that is written again replaces itself."""
    entries.withColumn("month", F.date_format("scan_ts", "yyyy-MM")).write.mode("overwrite").partitionBy("month").json(
        f"{path}/batch={batch}")


def read_history(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """All entries, newest first; lines that are no JSON are dropped. ``since`` skips whole months. Of a scan that several batches
    hold the entry of the largest batch label counts."""
    h = spark.read.schema(HISTORY_SCHEMA + ", batch string, month string").option("mode", "DROPMALFORMED").json(path)
    if since:
        h = h.filter(F.col("month") >= since[:7])
    h = _latest(h.filter(F.col("project").isNotNull()))
    return h.drop("month", "batch").orderBy(F.desc("scan_ts"), F.desc("scan_id"))


def _latest(scans: DataFrame) -> DataFrame:
    """One row of each scan: that of the largest batch label."""
    other = [c for c in scans.columns if c not in ("project", "scan_id")]
    last = scans.groupBy("project", "scan_id").agg(F.max_by(F.struct(*other), "batch").alias("s"))
    return last.select("project", "scan_id", "s.*").select(scans.columns)


def persist_scan(findings: DataFrame, scans: DataFrame, path: str, batch: str = "0") -> None:
    """Findings and scan rows by batch and month of the scan; the project's state is the view of its latest scan.

    ``batch`` names the write, for instance a run's id: a retry replaces what it wrote before, so nothing is stored twice.
    Scan rows are written after the findings; a batch without scan rows isn't complete and isn't read.
    """
    for name, rows in (("findings", findings), ("scans", scans)):
        rows.withColumn("month", F.date_format("scan_ts", "yyyy-MM")).write.mode("overwrite").partitionBy("month").parquet(
            f"{path}/{name}/batch={batch}")


def stored_scans(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(findings, scans) as stored. Of a scan that several batches hold the largest batch label counts, in both."""
    def read(name):
        t = spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
        return t.withColumn("batch", F.col("batch").cast("string"))

    scans = _latest(read("scans"))
    findings = read("findings")
    held = scans.select("project", "scan_id", "batch")
    findings = findings.join(held, ["project", "scan_id", "batch"], "left_semi")
    return findings.drop("batch", "month"), scans.drop("batch", "month")


def project_state(scans: DataFrame) -> DataFrame:
    key = F.struct("scan_ts", "scan_id")
    return scans.groupBy("project").agg(
        F.max("scan_ts").alias("last_scan_at"), F.max_by("score", key).alias("score"), F.count("*").alias("scans"))


def report_documents(findings: DataFrame, by=("project",), units: DataFrame | None = None) -> DataFrame:
    """One JSON text per report: score, grade, headline and the groups with examples.

    ``units`` holds all projects or scans: those without findings have a report with an empty summary. Groups are bounded by the rule table; the full list of findings is written by :func:`persist_scan`.
    Findings are read once and written in buckets of their groups, which all parts of the reports read.
    """
    keys = [*by, "severity", "title_key"]
    findings = by_group(findings, by)
    ex = group_examples(findings, by).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("n", "file", "line"))).alias("examples"))
    groups = group_findings(findings, by).join(ex, keys)
    entry = F.struct("rank", "title_key", "group_id", "title", "severity", "category", "reference", "occurrence_count",
                     "file_count", "examples")
    listed = groups.groupBy(*by).agg(F.sort_array(F.collect_list(entry)).alias("summary"))
    top = compliance_score(findings, by, units=units).join(headline(findings, by, units), list(by)).join(listed, list(by), "left")
    top = top.withColumn("summary", F.coalesce("summary", F.array().cast(listed.schema["summary"].dataType)))
    stats = F.struct("total", "critical", "high", "medium", "low", "acknowledged")
    return top.select(*by, F.to_json(F.struct(
        "score", "grade", "status", "headline", stats.alias("stats"), "summary")).alias("document"))


def write_documents(documents: DataFrame, path: str) -> None:
    """Documents as lines of compressed text: they say much the same and take a tenth of the disk."""
    documents.select("document").write.mode("overwrite").option("compression", "gzip").text(path)


def export_groups(groups: DataFrame, path: str, limit: int = 50) -> None:
    """The first groups by severity as CSV."""
    groups.orderBy("rank", F.desc("occurrence_count"), "title_key").limit(limit).write.mode("overwrite").option(
        "header", "true").csv(path)
