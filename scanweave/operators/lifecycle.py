"""What happens to findings after detection: acknowledgement, suppression, confidence, baseline, duplicates.

Most steps are projections: a finding carries its line, the line above and its context, so they need no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanweave.functions.regex import SPACE, glob_to_regex, star_to_regex, to_java
from scanweave.functions.sql import js_trim, like, lit
from scanweave.rules.model import CONFIDENCE_RANK
from scanweave.sources.folders import bucketed, stored

# Order in which a scan reports its findings; "first" below means first in this order.
SEQ = ["rank", "pack_no", "file", "line", "rule_no"]

# File kinds and comment marks of the confidence step; scan-wide files; artifact rule ids.
TEST_PATH = r"\.test\.(?:ts|tsx|js|jsx)$|\.spec\.(?:ts|tsx|js|jsx)$|/__tests__/|/tests?/"
SCRIPT_PATH = r"\.(?:ts|tsx|js|jsx)$"
COMMENT_START = r"^\s*(?://|/\*|\*)"
TRAILING_COMMENT = r"\s//\s"
QUOTE = "['\"`]"
VIRTUAL_FILES = ["project-level", "ASSET-INVENTORY", "PHI-FLOW-MAP"]
ARTIFACT_IDS = ["HIPAA-ASSET-001", "HIPAA-FLOW-001"]


@dataclass(frozen=True)
class Ack:
    pattern: str
    reason: str
    by: str
    at: str
    id: str | None = None
    category: str | None = None
    severity: str | None = None
    expires_at: str | None = None
    ticket: str | None = None


#: What keeps findings of one scan apart from those of others; an operator uses the columns that its input has.
SCOPE = ("project", "scan_id")
ACKNOWLEDGMENT = "struct<reason:string,by:string,at:string,ticket:string,expired:boolean>"


def scope(*tables: DataFrame, of=SCOPE) -> list[str]:
    """The columns of ``of`` that all tables have."""
    return [c for c in of if all(c in t.columns for t in tables)]


def acknowledge(findings: DataFrame, acks, as_of: str | None = None) -> DataFrame:
    """The first acknowledgement, in list order, whose path glob and optional id, category and severity fit.

    The list is configuration, so it becomes one CASE expression instead of a join. ``as_of`` decides what has expired;
    without it, the time of the run does.
    """
    def text(value):
        return "CAST(NULL AS STRING)" if value is None else lit(value)

    cases, now = [], f"CAST({lit(as_of)} AS TIMESTAMP)" if as_of else "current_timestamp()"
    for a in acks:
        terms = [like("file", glob_to_regex(a.pattern))]
        if a.id:
            terms.append(f"finding_id RLIKE {lit(to_java(star_to_regex(a.id)))}")
        if a.category:
            terms.append(f"category = {lit(a.category)}")
        if a.severity:
            terms.append(f"severity = {lit(a.severity)}")
        expired = f"CAST({lit(a.expires_at)} AS TIMESTAMP) < {now}" if a.expires_at else "false"
        cases.append(
            f"WHEN {' AND '.join(terms)} THEN named_struct('reason', {lit(a.reason)}, 'by', {lit(a.by)}, "
            f"'at', {lit(a.at)}, 'ticket', {text(a.ticket)}, 'expired', {expired})")
    if not cases:
        return findings.withColumns({"acknowledged": F.lit(False), "acknowledgment": F.lit(None).cast(ACKNOWLEDGMENT)})
    return findings.withColumn("acknowledgment", F.expr(f"CASE {' '.join(cases)} END")).withColumn(
        "acknowledged", F.col("acknowledgment").isNotNull())


def ack_errors(acks: DataFrame) -> DataFrame:
    """Messages for acknowledgement rows that lack a required field or carry a date that does not parse."""
    def missing(col):
        return F.when(F.coalesce(F.col(col), F.lit("")) == "", F.concat(F.lit(f"'{col}' is required")))

    def bad_date(col):
        given = F.coalesce(F.col(col), F.lit("")) != ""
        return F.when(given & F.expr(f"try_to_timestamp({col})").isNull(), F.lit(f"'{col}' must be a valid ISO 8601 date"))

    errors = F.array_compact(F.array(
        missing("pattern"), missing("reason"), missing("acknowledged_by"), missing("acknowledged_at"),
        bad_date("acknowledged_at"), bad_date("expires_at")))
    return acks.select("ordinal", F.explode(errors).alias("error"))


def suppress(findings: DataFrame, marker: str = "scan-ignore") -> DataFrame:
    """Marker comments on the line above, else on the line itself; a marker without a reason does not count.

    A marker above that fits the finding ends the search even when it has no reason.
    """
    with_reason = to_java(rf"//\s*{marker}\s+([a-zA-Z0-9\-*]+)\s+--\s+(.+)")
    bare = to_java(rf"//\s*{marker}\s+([a-zA-Z0-9\-*]+)\s*$")

    def mark(column):
        rule = f"regexp_extract({column}, {lit(with_reason)}, 1)"
        plain = f"regexp_extract({column}, {lit(bare)}, 1)"
        raw = f"regexp_extract({column}, {lit(with_reason)}, 2)"
        return (f"CASE WHEN contains({column}, {lit(marker)}) THEN named_struct("
                f"'rule', CASE WHEN {rule} <> '' THEN {rule} ELSE {plain} END, 'reason', {js_trim(raw)}) END")

    def fits(m):
        return f"coalesce({m}.rule <> '' AND finding_id LIKE replace({m}.rule, '*', '%'), false)"

    f = findings.withColumns({"_above": F.expr(mark("prev")), "_same": F.expr(mark("code"))})
    chosen = f"CASE WHEN {fits('_above')} THEN _above WHEN {fits('_same')} THEN _same END"
    f = f.withColumn("_mark", F.expr(chosen))
    return f.withColumn(
        "suppression",
        F.expr("CASE WHEN _mark.reason <> '' THEN named_struct('reason', _mark.reason, 'comment', "
               f"concat('// {marker} ', _mark.rule, ' -- ', _mark.reason)) END"),
    ).withColumn("suppressed", F.col("suppression").isNotNull()).drop("_above", "_same", "_mark")


def classify_confidence(findings: DataFrame) -> DataFrame:
    """Comment low, other than script files medium, test files low, else high; a rule may keep its own value."""
    context = (
        f"CASE WHEN NOT ({like('file', SCRIPT_PATH)}) THEN 'medium' "
        f"WHEN {like('code', COMMENT_START)} OR in_block OR {like('code', TRAILING_COMMENT)} THEN 'low' "
        f"WHEN {like('file', TEST_PATH)} THEN 'low' ELSE 'high' END")
    keep = F.col("confidence").isNotNull() & ~F.coalesce(F.col("adjust_confidence"), F.lit(True))
    return findings.withColumn("confidence", F.when(keep, F.col("confidence")).otherwise(F.expr(context)))


def line_context(findings: DataFrame) -> DataFrame:
    """The plain-text guess used where a file cannot be parsed."""
    return findings.withColumns({
        "context_kind": F.expr(
            f"CASE WHEN {like('code', COMMENT_START)} THEN 'comment' WHEN {like('code', QUOTE)} THEN 'string' "
            "ELSE 'code' END"),
        "context_confidence": F.expr(
            f"CASE WHEN {like('code', COMMENT_START)} OR {like('code', QUOTE)} OR {like('file', TEST_PATH)} "
            "THEN 'low' ELSE 'medium' END"),
    })


def confidence_rank(column: str = "confidence") -> Column:
    expr = F.lit(CONFIDENCE_RANK["high"])
    for name in ("medium", "low"):
        expr = F.when(F.col(column) == name, CONFIDENCE_RANK[name]).otherwise(expr)
    return expr


def demote_below(findings: DataFrame, min_confidence: str) -> DataFrame:
    """Findings below the wanted confidence become baseline; they are not dropped."""
    known = F.coalesce(F.col("is_baseline"), F.lit(False)) if "is_baseline" in findings.columns else F.lit(False)
    return findings.withColumn("is_baseline", known | (confidence_rank() < CONFIDENCE_RANK[min_confidence]))


def finding_hash(findings: DataFrame) -> DataFrame:
    key = F.concat_ws(":", "file", F.coalesce(F.col("line"), F.lit(0)).cast("string"), "finding_id", "title")
    return findings.withColumn("hash", F.substring(F.sha2(key, 256), 1, 16))


def baseline_of(findings: DataFrame) -> DataFrame:
    """Known findings by project; a baseline outlives its scan, so it holds no scan."""
    project = scope(findings, of=("project",))
    return finding_hash(findings).select(
        *project, "hash", "finding_id", "file", "line", "title", "severity", "category").distinct()


def baseline_stats(findings: DataFrame, by=()) -> DataFrame:
    """total, baseline and new findings of ``apply_baseline``, counted in the pass that flags them."""
    known = F.col("is_baseline")
    return findings.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(known).alias("baseline"), F.count_if(~known).alias("new"))


def apply_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Flags findings whose project and hash are in the baseline; the hash spreads evenly."""
    keys = ["hash", *scope(findings, baseline, of=("project",))]
    known = baseline.select(*keys).distinct().withColumn("_known", F.lit(True))
    return finding_hash(findings).join(known, keys, "left").withColumn(
        "is_baseline", F.col("_known").isNotNull()).drop("_known")


def new_findings(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    keys = ["hash", *scope(findings, baseline, of=("project",))]
    return finding_hash(findings).join(baseline.select(*keys), keys, "left_anti")


def snippet() -> Column:
    """Context lines trimmed, lowercased, whitespace folded: all lines at once, since none holds a line feed."""
    folded = f"regexp_replace(lower(array_join(ctx, '\\n')), {lit(f'[{SPACE}&&[^' + chr(92) + 'n]]+')}, ' ')"
    return F.expr(f"trim(regexp_replace({folded}, ' ?\\n ?', '\\n'))")


def dedupe(findings: DataFrame, order=SEQ) -> DataFrame:
    """One finding per project, scan, id, file, line and snippet: the first."""
    keyed = findings.withColumn("_snippet", F.unhex(F.sha2(snippet(), 256)))
    w = Window.partitionBy(*scope(findings), "finding_id", "file", "line", "_snippet").orderBy(*order)
    return keyed.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_snippet")


def dedupe_virtual(findings: DataFrame) -> DataFrame:
    """Scan-wide findings keep one row per project, scan and id; findings on real files pass. Findings are written once; only the
    scan-wide ones move."""
    findings = stored(findings, "findings")
    virtual = F.col("file").isin(VIRTUAL_FILES)
    return findings.filter(~virtual).unionByName(
        findings.filter(virtual).dropDuplicates([*scope(findings), "finding_id"]))


def split_artifacts(findings: DataFrame):
    """(findings, informational artifacts)."""
    artifact = F.col("rule_id").isin(ARTIFACT_IDS)
    return findings.filter(~artifact), findings.filter(artifact)


def sort_by_severity(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*SEQ)


def triage_candidates(findings: DataFrame, cap: int = 50) -> DataFrame:
    """Per project, the first ``cap`` findings with content go to triage; the rest keep a reason and a default.

    Findings are written once and read twice. Numbering happens only among each project's first ``cap`` rows with content, so a
    large project is cut before it reaches one task.
    """
    findings = stored(findings, "to-triage")
    w = Window.partitionBy("project").orderBy(*SEQ)
    first = (findings.filter("has_content").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap)
             .groupBy("project").agg(F.count("*").alias("_kept"), F.max(F.struct(*SEQ)).alias("_last")))
    f = findings.join(first, "project", "left")
    full = F.coalesce(F.col("_kept") >= cap, F.lit(False)) & (F.struct(*SEQ) > F.col("_last"))
    return f.withColumn(
        "triage",
        F.when(full, F.lit("cap reached")).when(~F.col("has_content"), F.lit("no content")).otherwise(F.lit("scheduled")),
    ).drop("_kept", "_last")


def merge_verdicts(findings: DataFrame, verdicts: DataFrame, drop_false: bool = True) -> DataFrame:
    """Adds triage verdicts; findings without one count as likely at 0.5; false positives go unless kept."""
    f = findings.join(verdicts, [*scope(findings, verdicts), "file", "line", "finding_id"], "left").withColumns({
        "classification": F.coalesce("classification", F.lit("likely")),
        "ai_confidence": F.coalesce("ai_confidence", F.lit(0.5)),
    })
    return f.filter("classification <> 'false_positive'") if drop_false else f


def normalize_model_findings(responses: DataFrame) -> DataFrame:
    """Explodes JSON responses of a model rule into findings with a named confidence."""
    schema = ("struct<findings:array<struct<line:int,severity:string,message:string,suggestion:string,"
              "confidence:double>>>")
    return (
        responses.select("rule_id", "rule_name", "file", F.posexplode(F.from_json("body", schema)["findings"]).alias("k", "x"))
        .selectExpr(
            "concat(rule_id, '-', file, '-', x.line, '-', k) AS finding_id", "file", "x.line AS line",
            "x.severity AS severity", "concat(rule_name, ': ', x.message) AS title", "x.suggestion AS recommendation",
            "CASE WHEN x.confidence >= 0.8D THEN 'high' WHEN x.confidence >= 0.5D THEN 'medium' ELSE 'low' END AS confidence")
    )


def reuse_cached(corpus: DataFrame, rule_ids, cache: DataFrame, as_of, ttl_hours: int = 24):
    """(pairs to run, cached results): results keyed by content hash and rule, younger than the limit.

    Pairs to run have the columns of ``corpus`` with the content, ``content_hash`` and ``rule_id``; cached results have those of
    the corpus without the content and those of ``cache``, its latest fresh row of a hash and rule.

    No text moves between tasks. Files are numbered and written where they are, in buckets of their number. What is shuffled
    are hashes: one row for each file, with the number, meets one row for each cached hash, which holds its results by rule (as many
    as there are rules). A file's list of rules to run then meets its text in the bucket of its number, which no two files share,
    so copies of one text stay spread.
    """
    wanted = F.array(*[F.lit(r) for r in rule_ids])
    numbered = corpus.withColumns({"content_hash": F.sha2("content", 256), "file_no": F.monotonically_increasing_id()})
    files = bucketed(numbered, "files_by_number", "file_no")
    fresh = cache.filter(F.col("cached_at") > F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {ttl_hours} HOURS"))
    fresh = fresh.filter(F.col("rule_id").isin(list(rule_ids)))
    other = [c for c in cache.columns if c not in ("content_hash", "rule_id")]
    results = fresh.groupBy("content_hash", "rule_id").agg(F.max_by(F.struct(*other), "cached_at").alias("result"))
    results = results.groupBy("content_hash").agg(F.collect_list(F.struct("rule_id", "result")).alias("results"))
    own = [c for c in corpus.columns if c != "content"]
    known = files.select("file_no", "content_hash").join(results, "content_hash", "left")
    known = stored(known.select("file_no", "results", F.array_except(wanted, F.coalesce("results.rule_id", F.array().cast(
        "array<string>"))).alias("to_run")), "known-results")
    run = files.join(known.filter(F.size("to_run") > 0).select("file_no", "to_run"), "file_no").withColumn("rule_id", F.explode("to_run"))
    hit = files.select("file_no", *own, "content_hash").join(known.filter("results IS NOT NULL").select("file_no", "results"), "file_no")
    hit = hit.withColumn("x", F.explode("results")).select(*own, "content_hash", "x.rule_id", "x.result.*")
    return run.drop("file_no", "to_run"), hit


def visible_to(rows: DataFrame, projects: DataFrame, owner: str, key: str = "project") -> DataFrame:
    """Rows of projects that the owner owns."""
    return rows.join(projects.filter(F.col("owner") == owner).select(key), key, "left_semi")
