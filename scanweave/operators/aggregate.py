"""Groups, counts and scores of findings.

Aggregates combine on the map side, so a rule or project that holds most findings does not gather in one task.
Examples use a row limit per group that Spark applies before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanweave.functions.sql import js_trim, like, lit
from scanweave.functions.regex import to_java
from scanweave.operators.lifecycle import SEQ, scope
from scanweave.rules.model import CATEGORIES, SEVERITY_RANK
from scanweave.sources.folders import bucketed, stored

# Penalties, thresholds and labels.
PENALTY = {"critical": 10, "high": 5, "medium": 2, "low": 1}
ACKNOWLEDGED_FACTOR = 0.25
CATEGORY_PENALTY = {"critical": 15, "high": 8, "medium": 3, "low": 1}
CATEGORY_LABELS = {
    "phi-exposure": "PHI Protection", "encryption": "Encryption", "audit-logging": "Audit & Logging",
    "access-control": "Access Control", "data-retention": "Data Retention",
}
ANNOTATION_LEVEL = {"critical": "failure", "high": "warning", "medium": "warning", "low": "notice", "info": "notice"}
NPRM = r"(?i)\bNPRM\b"
SEVERITIES = list(SEVERITY_RANK)


def flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def severity_counts(condition: Column | None = None, names=SEVERITIES) -> list[Column]:
    keep = F.lit(True) if condition is None else condition
    return [count_where(keep & (F.col("severity") == s)).alias(s) for s in names]


def active() -> Column:
    return ~flag("is_baseline") & ~flag("suppressed") & ~flag("acknowledged")


def group_key(findings: DataFrame) -> DataFrame:
    """Adds the normalized title, unless the findings have it already."""
    if "title_key" in findings.columns:
        return findings
    title = f"regexp_replace(lower({js_trim('title')}), {lit(to_java(chr(92) + 's+'))}, ' ')"
    return findings.withColumn("title_key", F.expr(title))


def group_findings(findings: DataFrame, by=()) -> DataFrame:
    """One row per severity and normalized title; attributes of the first member, counts over all.

    Files are counted by grouping per file first, which reads the findings once. Members stay in the findings table
    under the same key: a rule's whole list of places is never gathered.
    """
    keys = [*by, "severity", "title_key"]
    first = F.struct(*SEQ)
    attrs = F.struct("finding_id", "category", "title", "reference")
    per_file = group_key(findings).groupBy(*keys, "file").agg(
        F.count("*").alias("n"), F.min_by(attrs, first).alias("m"), F.min(first).alias("first"))
    g = per_file.groupBy(*keys).agg(
        F.sum("n").alias("occurrence_count"), F.count("*").alias("file_count"), F.min_by("m", "first").alias("m"),
        F.min("first").alias("first"))
    clean = F.expr("CASE WHEN m.finding_id RLIKE '^[a-z]' THEN regexp_replace(m.finding_id, '-[0-9]+$', '') "
                   "ELSE m.finding_id END")
    return g.select(
        *by, clean.alias("group_id"), "severity", "title_key", "m.category", "m.title", "m.reference",
        "occurrence_count", "file_count", F.col("first.rank").alias("rank"))


def group_examples(findings: DataFrame, by=(), limit: int = 5) -> DataFrame:
    """Up to five places per group, each in another file, in report order."""
    keys = [*by, "severity", "title_key"]
    per_file = group_key(findings).groupBy(*keys, "file").agg(F.min(F.struct(*SEQ)).alias("first"))
    w = Window.partitionBy(*keys).orderBy("first")
    return per_file.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit).select(
        *keys, "n", "file", F.col("first.line").alias("line"))


def by_group(findings: DataFrame, by=()) -> DataFrame:
    """What reports read of findings, as a written table in buckets of their groups: grouping them moves no row, however often."""
    needed = [*by, "severity", "title_key", "title", "category", "reference", "finding_id", *SEQ, "is_baseline", "suppressed", "acknowledged"]
    return bucketed(group_key(findings).select(*dict.fromkeys(needed)), "findings_by_group", [*by, "severity", "title_key"])


def is_proposed() -> Column:
    return F.expr(like("coalesce(reference, '')", NPRM))


def group_by_location(findings: DataFrame) -> DataFrame:
    """Findings of one project and scan on the same file, line and category; proposed ones do not raise the headline
    severity."""
    keys = [*scope(findings), "file", "line", "category"]
    member = F.struct("rank", "title", "severity", "finding_id")
    g = findings.groupBy(*keys).agg(
        F.min(F.when(~is_proposed(), F.col("rank"))).alias("current_rank"), F.min("rank").alias("any_rank"),
        F.sort_array(F.collect_list(member)).alias("members"))
    rank = F.coalesce("current_rank", "any_rank")
    names = F.array(*[F.lit(s) for s in SEVERITIES])
    return g.select(*keys, F.get(names, rank).alias("severity"), rank.alias("rank"), "members")


def partition_proposed(findings: DataFrame):
    """(current, proposed) of findings that are written once; proposed ones are listed by file, line and title."""
    findings = stored(findings, "findings")
    return findings.filter(~is_proposed()), findings.filter(is_proposed()).orderBy("file", "line", "title")


def with_clean(counted: DataFrame, units: DataFrame | None, by, keep=()) -> DataFrame:
    """Adds the rows of ``units`` (all projects or scans) that have no findings: counts 0, flags false, lists empty.

    With ``keep``, columns of ``units`` to carry along, each row of ``units`` whose keys are known gives one.
    """
    if units is None:
        return counted
    rows = units.select(*by, *keep).dropna(subset=list(by)) if keep else units.select(*by).distinct()
    out = rows.join(counted, list(by), "left")
    zero = {"boolean": F.lit(False), "bigint": F.lit(0), "int": F.lit(0), "double": F.lit(0.0)}
    return out.withColumns({
        c: F.coalesce(c, zero.get(t, F.array()).cast(t)) for c, t in counted.dtypes
        if c not in by and (t in zero or t.startswith("array"))})


def report_summary(findings: DataFrame, raw_count: str = "raw_count", by=("project",), units: DataFrame | None = None) -> DataFrame:
    """Counters of a report in one pass; ``raw_count`` is taken before duplicates are dropped. ``units``: see
    ``with_clean``."""
    new = active()
    expired = F.coalesce(F.col("acknowledgment.expired"), F.lit(False))
    return with_clean(findings.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_distinct(F.concat_ws("::", "severity", "title")).alias("unique_findings"),
        count_where(flag("acknowledged") & ~expired).alias("acknowledged"),
        count_where(flag("suppressed")).alias("suppressed"), count_where(flag("is_baseline")).alias("baseline"),
        count_where(new).alias("unacknowledged"), *severity_counts(new)), units, by)


def vulnerability_counts(vulnerabilities: DataFrame, by=("project",)) -> DataFrame:
    names = ["critical", "high", "moderate", "low"]
    return vulnerabilities.groupBy(*by).agg(F.count("*").alias("total"), *severity_counts(names=names))


def js_round(x: Column) -> Column:
    return F.floor(x + 0.5)


def step(value: Column, steps, last: str) -> Column:
    """The label of the first threshold that the value reaches."""
    out = F.lit(last)
    for limit, label in reversed(steps):
        out = F.when(value >= limit, label).otherwise(out)
    return out


def compliance_score(findings: DataFrame, by=("project",), extra=(), units: DataFrame | None = None, keep=()) -> DataFrame:
    """Score, grade and status; baseline and suppressed findings are left out, acknowledged ones weigh a quarter.

    ``extra`` aggregates run in the same pass. ``units`` holds all projects or scans, so that clean ones score 100; ``keep``: see
    ``with_clean``.
    """
    counted = ~flag("is_baseline") & ~flag("suppressed")
    weight = F.when(flag("acknowledged"), ACKNOWLEDGED_FACTOR).otherwise(1.0)
    penalties = [
        F.sum(F.when(counted & (F.col("severity") == s), weight * p).otherwise(0.0)).alias(f"penalty_{s}")
        for s, p in PENALTY.items()
    ]
    g = findings.groupBy(*by).agg(
        count_where(counted).alias("total"), *severity_counts(counted, list(PENALTY)),
        count_where(counted & flag("acknowledged")).alias("acknowledged"), *penalties, *extra)
    g = with_clean(g, units, by, keep)
    total = sum((F.col(f"penalty_{s}") for s in PENALTY), F.lit(0.0))
    g = g.withColumn("penalty_total", total).withColumn(
        "score", js_round(F.greatest(F.lit(0.0), 100 - F.col("penalty_total"))))
    score = F.col("score")
    return g.withColumns({
        "grade": step(score, [(90, "A"), (80, "B"), (70, "C"), (60, "D")], "F"),
        "status": step(score, [(90, "excellent"), (80, "good"), (70, "fair"), (60, "poor")], "critical"),
    })


def recommendations(scores: DataFrame) -> DataFrame:
    """Ordered advice built from the counts and the score of each row."""
    def when(cond, *parts):
        return F.when(cond, F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))

    c, h, m, a, s, t = (F.col(x) for x in ("critical", "high", "medium", "acknowledged", "score", "total"))
    # Report wording.
    items = F.array_compact(F.array(
        when(c > 0, "Address ", c, " critical issue(s) immediately - these pose severe HIPAA compliance risks"),
        when(h > 0, "Resolve ", h, " high severity issue(s) as soon as possible"),
        when(m > 10, "Review and remediate ", m, " medium severity findings to improve compliance posture"),
        when(a > 0, a, " finding(s) are acknowledged but should still be addressed when possible"),
        when(s < 70, "Your compliance score is below acceptable levels. Consider a comprehensive security audit"),
        when((s >= 90) & (t == 0), "Excellent! No active compliance issues found. Maintain regular scanning."),
        when((s >= 90) & (t > 0), "Great compliance posture! Continue monitoring and maintaining best practices."),
    ))
    default = F.array(F.lit("Continue regular scanning to maintain HIPAA compliance"))
    return scores.withColumn("recommendations", F.when(F.size(items) == 0, default).otherwise(items))


def category_scores(findings: DataFrame, by=("project",), units: DataFrame | None = None) -> DataFrame:
    """Score of each of the five categories and overall, six rows for every project or scan: 100 where nothing was found.

    One aggregate counts all of them side by side. ``units`` holds all projects or scans, so that clean ones come too.
    """
    penalty = F.lit(0)
    for name, p in CATEGORY_PENALTY.items():
        penalty = F.when(F.col("severity") == name, p).otherwise(penalty)
    kinds = {"overall": F.lit(True)} | {label: F.col("category") == c for c, label in CATEGORY_LABELS.items()}
    aggregates = [x for k, cond in enumerate(kinds.values()) for x in (
        count_where(cond).alias(f"n{k}"), F.coalesce(F.sum(F.when(cond, penalty)), F.lit(0)).cast("bigint").alias(f"d{k}"))]
    g = with_clean(findings.groupBy(*by).agg(*aggregates), units, by)
    rows = F.explode(F.array(*[F.struct(
        F.lit(label).alias("category"), F.col(f"n{k}").alias("findings"), F.greatest(F.lit(0), 100 - F.col(f"d{k}")).alias("score"))
        for k, label in enumerate(kinds)]))
    steps = [(95, "A+"), (80, "A"), (60, "B"), (40, "C"), (20, "D")]
    return g.select(*by, rows.alias("x")).select(
        *by, "x.*", F.when(F.col("x.category") == "overall", step(F.col("x.score"), steps, "F")).alias("grade"))


def executive_status(findings: DataFrame, by=("project",), units: DataFrame | None = None) -> DataFrame:
    """Overall status and risk level from the counts of new critical and high findings."""
    g = with_clean(findings.groupBy(*by).agg(*severity_counts(active(), ["critical", "high"])), units, by)
    c, h = F.col("critical"), F.col("high")
    return g.withColumns({
        "status": F.when((c == 0) & (h == 0), "compliant").when((c == 0) & (h <= 3), "needs-attention")
        .otherwise("non-compliant"),
        "risk": F.when(c > 5, "Critical").when((c > 0) | (h > 10), "High").when(h > 0, "Medium").otherwise("Low"),
    })


def top_findings(findings: DataFrame, limit: int, by=("project",), severities=("critical", "high")) -> DataFrame:
    """The first findings of the wanted severities per group, numbered."""
    w = Window.partitionBy(*by).orderBy(*SEQ)
    return findings.filter(F.col("severity").isin(*severities)).withColumn("n", F.row_number().over(w)).filter(
        F.col("n") <= limit)


def top_categories(findings: DataFrame, limit: int = 3, by=("project",)) -> DataFrame:
    counts = findings.groupBy(*by, "category").agg(F.count("*").alias("hits"))
    w = Window.partitionBy(*by).orderBy(F.desc("hits"), "category")
    return counts.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit)


def project_status(score: Column) -> Column:
    return F.when(score >= 90, "compliant").when(score >= 70, "at_risk").otherwise("critical")


def gates(findings: DataFrame, by=("project",), units: DataFrame | None = None) -> DataFrame:
    """Exit decisions: scan fails on any critical, score fails below 60, enforced review fails on new criticals."""
    urgent = F.col("severity") == "critical"
    g = compliance_score(findings, by, [
        F.bool_or(urgent).alias("any_critical"), F.bool_or(urgent & active()).alias("new_critical"),
        F.max(F.lit(4) - F.col("rank")).alias("worst")], units)
    return g.select(
        *by, F.col("any_critical").alias("scan_fails"), (F.col("score") < 60).alias("score_fails"),
        F.col("new_critical").alias("review_fails"),
        F.when(F.col("worst") >= 3, "reject").when(F.col("worst") == 2, "review").otherwise("safe").alias("skill_verdict"))


def headline(findings: DataFrame, by=("project",), units: DataFrame | None = None) -> DataFrame:
    g = with_clean(group_key(findings).groupBy(*by).agg(
        F.count_distinct("severity", "title_key").alias("types"), F.count("*").alias("locations"),
        F.count_distinct("file").alias("files")), units, by)
    return g.withColumn("headline", F.format_string(
        "Found %d types of HIPAA violations across %d locations in %d files", "types", "locations", "files"))


def issue_types(findings: DataFrame) -> DataFrame:
    """Counts by the second dash-separated part of the rule id."""
    part = F.coalesce(F.get(F.split("rule_id", "-"), F.lit(1)), F.lit("other"))
    return findings.groupBy(part.alias("issue_type")).agg(F.count("*").alias("hits"))


def per_file_issues(findings: DataFrame) -> DataFrame:
    """Editor view: counts per file and its findings by line; a file's list is bounded by the file's own size."""
    entry = F.struct("line", "rank", "finding_id")
    return findings.groupBy(*scope(findings), "file").agg(
        F.count("*").alias("findings"), count_where(F.col("rank") <= 1).alias("urgent"),
        F.sort_array(F.collect_list(entry)).alias("entries"))


def annotations(findings: DataFrame, limit: int = 50, by=("project",)) -> DataFrame:
    """The first findings of each review as annotations."""
    from scanweave.functions.text import clean_path

    levels = F.create_map(*[F.lit(x) for kv in ANNOTATION_LEVEL.items() for x in kv])
    w = Window.partitionBy(*by).orderBy(*SEQ)
    located = findings.filter(F.col("line").isNotNull() & (F.col("file") != ""))
    return located.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit).select(
        *by, "n", clean_path("file").alias("path"), "line",
        F.coalesce(levels[F.col("severity")], F.lit("notice")).alias("level"),
        F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "title").alias("title"))


def audit_summary(reviews: DataFrame, as_of, by=("project",)) -> DataFrame:
    late = (F.col("deadline") < F.lit(as_of).cast("timestamp")) & (F.col("status") == "pending_review")
    statuses = ["pending_review", "in_progress", "resolved", "accepted_risk"]
    return reviews.groupBy(*by).agg(
        F.count("*").alias("reviews"), *[count_where(F.col("status") == s).alias(s) for s in statuses],
        *severity_counts(), count_where(late).alias("overdue"))


def catalog_counts(rules: DataFrame) -> DataFrame:
    """Rules per category, zero where none."""
    dim = rules.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    counts = rules.groupBy("category").agg(F.count("*").alias("n"))
    return F.broadcast(dim).join(counts, "category", "left").select(
        "category", F.coalesce("n", F.lit(0)).alias("rules"))


def catalog_problems(rules: DataFrame) -> DataFrame:
    """Duplicate ids and categories outside the closed list."""
    dup = rules.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(
        F.lit("duplicate id").alias("problem"), F.col("id").alias("subject"))
    bad = rules.filter(~F.col("category").isin(*CATEGORIES)).select(
        F.lit("unknown category").alias("problem"), F.concat_ws(" -> ", "id", "category").alias("subject"))
    return dup.unionByName(bad)


def normalize_severity(column: str) -> Column:
    low = F.lower(column)
    return F.when(low.isin(*SEVERITIES), low).otherwise("info")


def portfolio_stats(projects: DataFrame) -> DataFrame:
    """Average score of scanned projects, urgent and total findings."""
    return projects.agg(
        js_round(F.avg("score")).alias("avg_score"),
        F.sum(F.coalesce("critical", F.lit(0)) + F.coalesce("high", F.lit(0))).alias("urgent"),
        F.sum(F.coalesce("total", F.lit(0))).alias("total"))
