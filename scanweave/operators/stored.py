"""Reads over the stored tables: projects, scans, findings and the rule registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanweave.rules.model import SEVERITY_RANK

# Weights of the registry ranking, featured threshold.
DOWNLOAD_WEIGHT, REVIEW_WEIGHT = 0.7, 0.3
FEATURED_RATING = 4.0


def recent_scans(scans: DataFrame, projects: DataFrame, limit: int = 10) -> DataFrame:
    newest = scans.orderBy(F.desc("scan_ts"), F.desc("scan_id")).limit(limit)
    return newest.join(projects.select("project", "name"), "project", "left")


def urgent_findings(findings: DataFrame, projects: DataFrame, limit: int = 20) -> DataFrame:
    """Newest critical and high findings with their project's name; the cut comes before the join."""
    newest = findings.filter(F.col("severity").isin("critical", "high")).orderBy(
        F.desc("scan_ts"), "file", "line", "rule_no").limit(limit)
    return newest.join(projects.select("project", "name"), "project", "left")


def projects_by_update(projects: DataFrame) -> DataFrame:
    return projects.orderBy(F.desc("updated_at"), "project")


def of_project(rows: DataFrame, project: str, scan_id=None) -> DataFrame:
    rows = rows.filter(F.col("project") == project)
    return rows if scan_id is None else rows.filter(F.col("scan_id") == scan_id)


def by_severity(findings: DataFrame, limits=None, by: str = "scan_id") -> DataFrame:
    """Findings by severity; ``limits`` such as {"critical": 20} keep the first rows of a severity per scan."""
    rank = F.coalesce(*[F.when(F.col("severity") == s, r) for s, r in SEVERITY_RANK.items()])
    f = findings.withColumn("rank", rank)
    if limits:
        w = Window.partitionBy(by, "severity").orderBy("file", "line", "rule_no")
        cap = F.coalesce(*[F.when(F.col("severity") == s, n) for s, n in limits.items()])
        f = f.filter(F.col("severity").isin(*limits)).withColumn("n", F.row_number().over(w)).filter(
            F.col("n") <= max(limits.values())).filter(F.col("n") <= cap)
    return f


def search_registry(registry: DataFrame, text: str = "", equals=None, tech=None, min_rating=None, tags=None,
                    page: int = 1, page_size: int = 20, after=None) -> DataFrame:
    """One page of matching rules, best ranked first, with their place ``n`` and the number of all matches.

    ``after``: relevance and id of the last rule of the page before. Then only a page of rules is ranked however far down it lies,
    and places are counted from there; ``page`` is for the first few pages.
    """
    r = registry
    if text:
        needle = F.lit(text.lower())
        r = r.filter(
            F.contains(F.lower("name"), needle) | F.contains(F.lower("description"), needle)
            | F.exists("tags", lambda t: F.contains(F.lower(t), needle)))
    for column, value in (equals or {}).items():
        r = r.filter(F.col(column) == value)
    if tech:
        r = r.filter(F.array_contains("tech_stack", tech))
    if min_rating:
        r = r.filter(F.col("rating") >= min_rating)
    if tags:
        r = r.filter(F.forall(F.array(*[F.lit(t) for t in tags]), lambda t: F.array_contains("tags", t)))
    score = F.col("downloads") * DOWNLOAD_WEIGHT + F.col("rating") * F.col("reviews") * REVIEW_WEIGHT
    r = r.withColumn("relevance", score)
    matches = r
    if after:
        relevance, last = F.lit(after[0]), F.lit(after[1])
        r = r.filter((F.col("relevance") < relevance) | ((F.col("relevance") == relevance) & (F.col("id") > last)))
        page = 1
    best = r.orderBy(F.desc("relevance"), "id").limit(page * page_size)
    # The limit leaves one partition, which the window takes as it is; the number of matches is a scalar, not a join.
    shown = best.withColumn("n", F.row_number().over(Window.orderBy(F.desc("relevance"), "id"))).filter(F.col("n") > (page - 1) * page_size)
    return shown.sparkSession.sql("SELECT *, (SELECT count(*) FROM {m}) AS total FROM {s}", m=matches, s=shown)


def featured(registry: DataFrame, limit: int = 10) -> DataFrame:
    """Verified, well rated rules, newest first with the rating as a small bonus in milliseconds."""
    order = F.unix_millis("updated_at") + F.col("rating") * 1000
    return registry.filter(F.col("verified") & (F.col("rating") >= FEATURED_RATING)).withColumn(
        "order_key", order).orderBy(F.desc("order_key"), "id").limit(limit)


def registry_counts(registry: DataFrame) -> DataFrame:
    """Rules per category and per framework in one pass."""
    return registry.sparkSession.sql(
        "SELECT CASE WHEN grouping(framework) = 1 THEN 'category' ELSE 'framework' END AS kind, "
        "coalesce(category, framework) AS name, count(*) AS rules FROM {r} "
        "GROUP BY GROUPING SETS ((category), (framework))", r=registry)


def top_contributors(registry: DataFrame, limit: int = 10) -> DataFrame:
    return registry.groupBy("author").agg(
        F.count("*").alias("rules"), F.sum("downloads").alias("downloads")).orderBy(
        F.desc("downloads"), "author").limit(limit)


def updates_available(installed: DataFrame, registry: DataFrame) -> DataFrame:
    """Installed rules whose registry version differs, or that the registry no longer has."""
    latest = registry.select("id", F.col("version").alias("latest"))
    return installed.join(latest, "id", "left").withColumn(
        "state",
        F.when(F.col("latest").isNull(), "missing").when(F.col("latest") != F.col("version"), "changed")
        .otherwise("current"))


def expand_packages(packages: DataFrame, registry: DataFrame) -> DataFrame:
    rules = packages.select("package_id", F.explode("rules").alias("id"))
    return rules.join(registry.select("id", "version"), "id", "left")


def issue_difference(current: DataFrame, previous: DataFrame, keys) -> DataFrame:
    """New issues are in the current set only, resolved ones in the previous set only."""
    a, b = current.select(*keys).distinct(), previous.select(*keys).distinct()
    new = a.join(b, list(keys), "left_anti").withColumn("change", F.lit("new"))
    return new.unionByName(b.join(a, list(keys), "left_anti").withColumn("change", F.lit("resolved")))


def without_samples(rows: DataFrame, owner: str) -> DataFrame:
    """What a rewrite keeps after an owner's sample rows are removed."""
    sample = F.coalesce(F.col("is_sample"), F.lit(False)) & (F.col("owner") == owner)
    return rows.filter(~F.coalesce(sample, F.lit(False)))
