"""Lifecycle, aggregate and history queries over the findings of the line packs on the code corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import oracle as o
from checks.corpus import _q, code_corpus, corpus, read
from checks.registry import query
from scanweave.operators import aggregate as a
from scanweave.operators import history as h
from scanweave.operators import lifecycle as lc
from scanweave.operators import detect as d
from scanweave.plans.scan import detect_categories
from scanweave.rules.catalog import LINE_PACKS
from scanweave.sources.tables import stored

AS_OF = "1999-01-01"
BASELINE_UNTIL = "1996-06-01"
ACKS = [
    lc.Ack("**/node_modules/**", "vendored", "ops", "1998-01-01"),
    lc.Ack("**/src/**/*.ts", "old review", "amy", "1997-01-01", id="phi-*", expires_at="1998-01-01"),
    lc.Ack("**/src/**", "accepted", "bob", "1998-05-01", category="encryption", ticket="T-1"),
    lc.Ack("/repos/**/services/*.py", "accepted", "bob", "1998-06-01", severity="medium"),
    lc.Ack("**/{db,deploy}/*", "reviewed", "eve", "1998-07-01", id="security-*-uri-*"),
    lc.Ack("**/.github/**", "reviewed", "eve", "1998-07-01", expires_at="2001-01-01"),
]
# The same list written by hand for the checking engine: condition, reason, expired.
ACK_CASES = [
    (r"regexp_matches(file, '^(.*/)?node_modules/.*$')", "vendored", "false"),
    (r"regexp_matches(file, '^(.*/)?src/(.*/)?[^/]*\.ts$') AND regexp_matches(finding_id, 'phi-.*')", "old review", "true"),
    (r"regexp_matches(file, '^(.*/)?src/.*$') AND category = 'encryption'", "accepted", "false"),
    (r"regexp_matches(file, '^/repos/(.*/)?services/[^/]*\.py$') AND severity = 'medium'", "accepted", "false"),
    (r"regexp_matches(file, '^(.*/)?(db|deploy)/[^/]*$') AND regexp_matches(finding_id, 'security-.*-uri-.*')", "reviewed",
     "false"),
    (r"regexp_matches(file, '^(.*/)?\.github/.*$')", "reviewed", "false"),
]


def found(spark, sf):
    return d.detect(code_corpus(spark, sf), LINE_PACKS, keep=("scan_id", "scan_ts"))


def units(spark, sf, *by):
    """All projects or scans of the code corpus, clean ones too."""
    scans = read(spark, sf, "orders").selectExpr(
        "concat('cust-', o_custkey) AS project", "o_orderkey AS scan_id", "o_orderdate AS scan_ts", "1L AS files")
    return scans.select(*by).distinct()


def judged(spark, sf):
    """Findings after the lifecycle steps that look at one finding alone.

    Their lines and contexts, which the steps have looked at and no report reads, aren't written.
    """
    f = lc.classify_confidence(lc.suppress(lc.acknowledge(found(spark, sf), ACKS, AS_OF)))
    return stored(f.drop("code", "prev", "in_block", "col", "ctx_from", "ctx"), "findings")


def processed(spark, sf, f=None):
    """Findings after every lifecycle step, those of ``judged`` where ``f`` doesn't give them; the baseline holds findings of scans
    before a date."""
    f = judged(spark, sf) if f is None else f
    old = lc.baseline_of(f.filter(F.col("scan_ts") < F.lit(BASELINE_UNTIL).cast("timestamp")))
    return lc.apply_baseline(f, old)


_MARK = r"//\s*scan-ignore\s+([a-zA-Z0-9\-*]+)\s+--\s+(.+)"
_BARE = r"//\s*scan-ignore\s+([a-zA-Z0-9\-*]+)\s*$"


def _rule_of(col):
    return (f"coalesce(nullif(regexp_extract(coalesce({col}, ''), {_q(_MARK)}, 1), ''), "
            f"regexp_extract(coalesce({col}, ''), {_q(_BARE)}, 1))")


def _fits(col):
    r = _rule_of(col)
    return f"({r} <> '' AND finding_id LIKE replace({r}, '*', '%'))"


FOUND = o.pack_findings(LINE_PACKS)
_SCRIPT = r"regexp_matches(file, '\.(ts|tsx|js|jsx)$')"
_TEST = r"regexp_matches(file, '\.(test|spec)\.(ts|tsx|js|jsx)$|/__tests__/|/tests?/')"
_COMMENT = r"(regexp_matches(code, '^\s*(//|/\*|\*)') OR in_block OR regexp_matches(code, '\s//\s'))"
_HASH = "substr(sha256(file || ':' || line || ':' || finding_id || ':' || title), 1, 16)"
LIFE = (
    f"{FOUND}, life AS MATERIALIZED (SELECT *, "
    f"CASE {' '.join(f'WHEN {c} THEN {_q(r)}' for c, r, _ in ACK_CASES)} END AS ack_reason, "
    f"CASE {' '.join(f'WHEN {c} THEN {e}' for c, _, e in ACK_CASES)} ELSE false END AS ack_expired, "
    f"CASE WHEN {_fits('prev')} THEN regexp_extract(prev, {_q(_MARK)}, 2) "
    f"WHEN {_fits('code')} THEN regexp_extract(code, {_q(_MARK)}, 2) ELSE '' END AS why, "
    f"CASE WHEN NOT {_SCRIPT} THEN 'medium' WHEN {_COMMENT} THEN 'low' WHEN {_TEST} THEN 'low' ELSE 'high' END AS conf, "
    f"{_HASH} AS hash FROM findings), "
    "p AS MATERIALIZED (SELECT *, ack_reason IS NOT NULL AS acknowledged, trim(why) <> '' AS suppressed, "
    f"hash IN (SELECT hash FROM life WHERE scan_ts < TIMESTAMP '{BASELINE_UNTIL}') AS is_baseline FROM life)"
)
ACTIVE = "(NOT acknowledged AND NOT suppressed AND NOT is_baseline)"
SEQ = "rank, pack_no, file, line, rule_no"


@query("l01_acknowledge", f"{LIFE} SELECT finding_id, file, ack_reason, ack_expired FROM p WHERE acknowledged")
def acknowledged(spark, sf):
    f = lc.acknowledge(found(spark, sf), ACKS, AS_OF).filter("acknowledged")
    return f.select("finding_id", "file", F.col("acknowledgment.reason").alias("ack_reason"),
                    F.col("acknowledgment.expired").alias("ack_expired"))


def ack_rows(spark, sf):
    return read(spark, sf, "customer").selectExpr(
        "c_custkey AS ordinal", "CASE WHEN c_custkey % 5 <> 0 THEN concat('**/', c_name) END AS pattern",
        "CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment ELSE '' END AS reason",
        "CASE WHEN c_custkey % 11 <> 0 THEN 'amy' END AS acknowledged_by",
        "CASE c_custkey % 4 WHEN 0 THEN '2024-01-01' WHEN 1 THEN 'soon' WHEN 2 THEN '2024-02-03T04:05:06' END "
        "AS acknowledged_at",
        "CASE c_custkey % 3 WHEN 0 THEN 'never' WHEN 1 THEN '2025-06-30' END AS expires_at")


_ACK_ROWS = (
    "SELECT c_custkey AS ordinal, CASE WHEN c_custkey % 5 <> 0 THEN '**/' || c_name END AS pattern, "
    "CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment ELSE '' END AS reason, "
    "CASE WHEN c_custkey % 11 <> 0 THEN 'amy' END AS acknowledged_by, "
    "CASE c_custkey % 4 WHEN 0 THEN '2024-01-01' WHEN 1 THEN 'soon' WHEN 2 THEN '2024-02-03T04:05:06' END "
    "AS acknowledged_at, CASE c_custkey % 3 WHEN 0 THEN 'never' WHEN 1 THEN '2025-06-30' END AS expires_at FROM customer")


@query("l02_ack_validation", f"WITH a AS ({_ACK_ROWS}) " + " UNION ALL ".join(
    [f"SELECT ordinal, '''{c}'' is required' AS error FROM a WHERE coalesce({c}, '') = ''"
     for c in ("pattern", "reason", "acknowledged_by", "acknowledged_at")]
    + [f"SELECT ordinal, '''{c}'' must be a valid ISO 8601 date' FROM a WHERE coalesce({c}, '') <> '' AND "
       f"try_cast({c} AS TIMESTAMP) IS NULL" for c in ("acknowledged_at", "expires_at")]))
def ack_validation(spark, sf):
    return lc.ack_errors(ack_rows(spark, sf))


@query("l03_inline_suppression", f"{LIFE} SELECT finding_id, file, line, trim(why) AS reason FROM p WHERE suppressed")
def suppressed(spark, sf):
    f = lc.suppress(found(spark, sf)).filter("suppressed")
    return f.select("finding_id", "file", "line", F.col("suppression.reason").alias("reason"))


@query("l04_confidence", f"{LIFE} SELECT finding_id, file, line, conf AS confidence FROM p")
def confidence(spark, sf):
    return lc.classify_confidence(found(spark, sf)).select("finding_id", "file", "line", "confidence")


@query("l05_line_context", f"{FOUND} SELECT finding_id, file, line, CASE WHEN {_COMMENT.split(' OR')[0][1:]} THEN "
       "'comment' WHEN regexp_matches(code, '[''\"`]') THEN 'string' ELSE 'code' END AS context_kind, "
       f"CASE WHEN {_COMMENT.split(' OR')[0][1:]} OR regexp_matches(code, '[''\"`]') OR {_TEST} THEN 'low' "
       "ELSE 'medium' END AS context_confidence FROM findings")
def line_context(spark, sf):
    return lc.line_context(found(spark, sf)).select(
        "finding_id", "file", "line", "context_kind", "context_confidence")


@query("l06_min_confidence", f"{LIFE} SELECT conf = 'low' AS is_baseline, count(*) AS n FROM p GROUP BY 1")
def min_confidence(spark, sf):
    f = lc.demote_below(lc.classify_confidence(found(spark, sf)), "medium")
    return f.groupBy("is_baseline").agg(F.count("*").alias("n"))


@query("l07_finding_hash", f"{LIFE} SELECT finding_id, file, hash FROM p")
def hashes(spark, sf):
    return lc.finding_hash(found(spark, sf)).select("finding_id", "file", "hash")


def _old(spark, sf):
    f = found(spark, sf)
    return f, lc.baseline_of(f.filter(F.col("scan_ts") < F.lit(BASELINE_UNTIL).cast("timestamp")))


@query("l08_new_against_baseline", f"{LIFE} SELECT finding_id, file, line FROM p WHERE NOT is_baseline")
def new_only(spark, sf):
    return lc.new_findings(*_old(spark, sf)).select("finding_id", "file", "line")


@query("l09_baseline_stats", f"{LIFE} SELECT count(*) AS total, count(*) FILTER (WHERE is_baseline) AS baseline, "
       "count(*) FILTER (WHERE NOT is_baseline) AS new FROM p")
def baseline_stats(spark, sf):
    return lc.baseline_stats(lc.apply_baseline(*_old(spark, sf)))


_TWICE = o.pack_findings(["phi", "errors", "configuration"])


@query("l10_dedupe", f"{_TWICE} SELECT finding_id, file, line, array_to_string(list_transform(ctx, lambda c: "
       "regexp_replace(lower(regexp_replace(c, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g')), ' | ') AS snippet "
       "FROM findings GROUP BY ALL")
def deduped(spark, sf):
    f = detect_categories(code_corpus(spark, sf), ["phi-exposure", "audit-logging"])
    return lc.dedupe(f).select("finding_id", "file", "line", F.replace(lc.snippet(), F.lit("\n"), F.lit(" | ")).alias("snippet"))


@query("l12_severity_sort", f"{FOUND} SELECT severity, rank, count(*) AS n, min(file) AS first_file FROM findings "
       "GROUP BY severity, rank")
def sorted_by_severity(spark, sf):
    f = lc.sort_by_severity(found(spark, sf))
    return f.groupBy("severity", "rank").agg(F.count("*").alias("n"), F.min("file").alias("first_file"))


@query("l13_triage_candidates", f"{FOUND}, t AS (SELECT *, code NOT LIKE '//%' AS has_content FROM findings), "
       f"s AS (SELECT *, sum(CASE WHEN has_content THEN 1 ELSE 0 END) OVER (PARTITION BY project ORDER BY {SEQ} "
       "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used FROM t) SELECT finding_id, file, line, "
       "CASE WHEN coalesce(used, 0) >= 10 THEN 'cap reached' WHEN NOT has_content THEN 'no content' ELSE 'scheduled' END "
       "AS triage FROM s")
def triage(spark, sf):
    f = found(spark, sf).withColumn("has_content", ~F.col("code").startswith("//"))
    return lc.triage_candidates(f, cap=10).select("finding_id", "file", "line", "triage")


@query("l14_verdict_merge", f"{LIFE}, v AS (SELECT *, substr(hash, 1, 1) AS x FROM p) SELECT finding_id, file, line, "
       "CASE WHEN x < '3' THEN 'confirmed' ELSE 'likely' END AS classification, "
       "CASE WHEN x < '3' THEN 0.9 ELSE 0.5 END::DOUBLE AS ai_confidence FROM v WHERE NOT (x >= '3' AND x < '6')")
def verdicts(spark, sf):
    f = found(spark, sf)
    x = F.substring("hash", 1, 1)
    v = lc.finding_hash(f).filter(x < "6").select(
        "file", "line", "finding_id", F.when(x < "3", "confirmed").otherwise("false_positive").alias("classification"),
        F.lit(0.9).alias("ai_confidence")).dropDuplicates(["file", "line", "finding_id"])
    return lc.merge_verdicts(f, v).select("finding_id", "file", "line", "classification", "ai_confidence")


_BODY = ("'{\"findings\":[{\"line\":' || l_linenumber || ',\"severity\":\"high\",\"message\":\"part ' || l_partkey || "
         "'\",\"suggestion\":\"check\",\"confidence\":' || l_discount || '},{\"line\":' || (l_linenumber + 7) || "
         "',\"severity\":\"low\",\"message\":\"supplier ' || l_suppkey || '\",\"suggestion\":\"none\",\"confidence\":0.' || "
         "(l_suppkey % 10) || '}]}'")


@query("l15_model_result_normalize", "WITH x AS (SELECT 'r-' || l_suppkey AS rule_id, 'f/' || l_orderkey AS file, "
       "l_linenumber, l_partkey, l_suppkey, l_discount FROM lineitem) SELECT rule_id || '-' || file || '-' || "
       "l_linenumber || '-0' AS finding_id, l_linenumber AS line, 'Check: part ' || l_partkey AS title, "
       "CASE WHEN l_discount >= 0.8 THEN 'high' WHEN l_discount >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM x "
       "UNION ALL SELECT rule_id || '-' || file || '-' || (l_linenumber + 7) || '-1', l_linenumber + 7, "
       "'Check: supplier ' || l_suppkey, CASE WHEN l_suppkey % 10 >= 8 THEN 'high' WHEN l_suppkey % 10 >= 5 THEN 'medium' "
       "ELSE 'low' END FROM x")
def model_results(spark, sf):
    body = F.expr(_BODY)
    r = read(spark, sf, "lineitem").select(
        F.expr("'r-' || l_suppkey").alias("rule_id"), F.lit("Check").alias("rule_name"),
        F.expr("'f/' || l_orderkey").alias("file"), body.alias("body"))
    return lc.normalize_model_findings(r).select("finding_id", "line", "title", "confidence")


_RULE_IDS = ["HIPAA-PHI-003", "HIPAA-SEC-001", "HIPAA-ACCESS-001"]


@query("l16_content_hash_cache", "WITH c AS (SELECT doc_id, sha256(text) AS content_hash FROM documents), "
       f"r AS (SELECT unnest({_RULE_IDS}) AS rule_id), k AS (SELECT DISTINCT content_hash, rule_id, "
       "CASE WHEN substr(content_hash, 1, 1) < '8' THEN 3 ELSE 30 END AS age FROM c, r WHERE "
       "substr(content_hash, 2, 1) < 'a' AND rule_id <> 'HIPAA-ACCESS-001'), m AS (SELECT c.*, r.rule_id, k.age FROM c, r "
       "LEFT JOIN k ON k.content_hash = c.content_hash AND k.rule_id = r.rule_id) SELECT doc_id, rule_id, "
       "CASE WHEN age < 24 THEN 'cached' ELSE 'run' END AS step FROM m")
def cached_results(spark, sf):
    docs = read(spark, sf, "documents").selectExpr("doc_id", "text AS content")
    as_of = "2024-01-10 00:00:00"
    known = F.array(*[F.lit(r) for r in _RULE_IDS if r != "HIPAA-ACCESS-001"])
    cache = docs.select(F.sha2("content", 256).alias("content_hash")).distinct().filter(
        F.substring("content_hash", 2, 1) < "a").withColumns({
            "rule_id": F.explode(known), "cached_at": F.expr(
                f"timestamp '{as_of}' - make_interval(0, 0, 0, 0, CASE WHEN content_hash < '8' THEN 3 ELSE 30 END)")})
    run, hit = lc.reuse_cached(docs, _RULE_IDS, cache, as_of)
    cols = ["doc_id", "rule_id"]
    return run.select(*cols, F.lit("run").alias("step")).unionByName(hit.select(*cols, F.lit("cached").alias("step")))


@query("l17_owner_visibility", f"{FOUND} SELECT finding_id, file, line FROM findings WHERE project IN "
       "(SELECT 'cust-' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def visible(spark, sf):
    projects = read(spark, sf, "customer").selectExpr("concat('cust-', c_custkey) AS project", "c_mktsegment AS owner")
    return lc.visible_to(found(spark, sf), projects, "BUILDING").select("finding_id", "file", "line")


# Aggregates

_KEY = "regexp_replace(lower(trim(title)), '\\s+', ' ', 'g')"
_ARG = f"(rank, pack_no, file, line, rule_no)"


@query("a01_group_findings", f"{FOUND}, g AS (SELECT *, {_KEY} AS title_key, row_number() OVER (PARTITION BY severity, "
       f"{_KEY} ORDER BY {SEQ}) AS n FROM findings) SELECT severity, title_key, "
       "max(CASE WHEN n = 1 THEN regexp_replace(finding_id, '^([a-z].*)-\\d+$', '\\1') END) AS group_id, "
       "max(CASE WHEN n = 1 THEN category END) AS category, count(*) AS occurrence_count, "
       "count(DISTINCT file) AS file_count FROM g GROUP BY severity, title_key")
def grouped(spark, sf):
    return a.group_findings(found(spark, sf)).select(
        "severity", "title_key", "group_id", "category", "occurrence_count", "file_count")


@query("a02_group_examples", f"{FOUND}, g AS (SELECT *, {_KEY} AS title_key, row_number() OVER (PARTITION BY severity, "
       f"{_KEY}, file ORDER BY {SEQ}) AS k FROM findings), e AS (SELECT *, row_number() OVER (PARTITION BY severity, "
       f"title_key ORDER BY {SEQ}) AS n FROM g WHERE k = 1) SELECT severity, title_key, n, file, line FROM e WHERE n <= 5")
def examples(spark, sf):
    return a.group_examples(found(spark, sf))


# NPRM citations come from rules in their own tables; here every fourth rule counts as proposed.
_PROPOSED = "CASE WHEN rule_no % 4 = 0 THEN 'NPRM ' || reference ELSE reference END"


def proposed(spark, sf):
    return found(spark, sf).withColumn(
        "reference", F.expr("CASE WHEN rule_no % 4 = 0 THEN concat('NPRM ', reference) ELSE reference END"))


@query("a03_group_by_location", f"{FOUND} SELECT file, line, category, coalesce(min(CASE WHEN rule_no % 4 <> 0 THEN rank "
       "END), min(rank)) AS rank, string_agg(finding_id, ',' ORDER BY rank, title, severity, finding_id) AS members "
       "FROM findings GROUP BY file, line, category")
def by_location(spark, sf):
    g = a.group_by_location(proposed(spark, sf))
    return g.select("file", "line", "category", "rank", F.array_join("members.finding_id", ",").alias("members"))


@query("a04_partition_proposed", f"{FOUND} SELECT rule_no % 4 = 0 AS proposed, count(*) AS n, count(DISTINCT file) AS "
       "files FROM findings GROUP BY 1")
def split_proposed(spark, sf):
    current, later = a.partition_proposed(proposed(spark, sf))
    both = current.withColumn("proposed", F.lit(False)).unionByName(later.withColumn("proposed", F.lit(True)))
    return both.groupBy("proposed").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


_SEV = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in a.SEVERITIES)


@query("a05_count_by_severity", f"{FOUND}, g AS (SELECT severity FROM findings GROUP BY severity, {_KEY}) "
       f"SELECT 'findings' AS what, {_SEV} FROM findings UNION ALL SELECT 'groups', {_SEV} FROM g")
def severity_table(spark, sf):
    f = found(spark, sf)
    n = f.agg(*a.severity_counts()).select(F.lit("findings").alias("what"), "*")
    return n.unionByName(a.group_findings(f).agg(*a.severity_counts()).select(F.lit("groups").alias("what"), "*"))


_NEW = ", ".join(f"count(*) FILTER (WHERE {ACTIVE} AND severity = '{s}') AS {s}" for s in a.SEVERITIES)


@query("a06_report_summary", f"{LIFE} SELECT project, count(*) AS total, count(DISTINCT severity || title) AS "
       "unique_findings, count(*) FILTER (WHERE acknowledged AND NOT ack_expired) AS acknowledged, "
       "count(*) FILTER (WHERE suppressed) AS suppressed, count(*) FILTER (WHERE is_baseline) AS baseline, "
       f"count(*) FILTER (WHERE {ACTIVE}) AS unacknowledged, {_NEW} FROM p GROUP BY project")
def summary(spark, sf):
    return a.report_summary(processed(spark, sf))


_PEN = " + ".join(f"CASE WHEN severity = '{s}' THEN {p} ELSE 0 END" for s, p in a.PENALTY.items())


def score_sql(by: str) -> str:
    on = "NOT is_baseline AND NOT suppressed"
    counts = ", ".join(f"count(*) FILTER (WHERE {on} AND severity = '{s}') AS {s}" for s in a.PENALTY)
    return (
        f"SELECT unit AS {by}, count(*) FILTER (WHERE {on}) AS total, {counts}, "
        f"count(*) FILTER (WHERE {on} AND p.acknowledged) AS acknowledged, "
        f"coalesce(sum(({_PEN}) * CASE WHEN p.acknowledged THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END) FILTER (WHERE {on}), 0) "
        f"AS penalty_total, "
        f"CAST(floor(greatest(0, 100 - penalty_total) + 0.5) AS BIGINT) AS score "
        f"FROM (SELECT DISTINCT {by} AS unit FROM corpus) LEFT JOIN p ON p.{by} = unit GROUP BY unit"
    )


_GRADE = ("CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' "
          "ELSE 'F' END")
_STATUS = ("CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 80 THEN 'good' WHEN score >= 70 THEN 'fair' "
           "WHEN score >= 60 THEN 'poor' ELSE 'critical' END")


@query("a07_compliance_score", f"{LIFE}, s AS ({score_sql('project')}) SELECT project, total, critical, high, medium, "
       f"low, acknowledged, penalty_total, score, {_GRADE} AS grade, {_STATUS} AS status FROM s")
def scores(spark, sf):
    return a.compliance_score(processed(spark, sf), units=units(spark, sf, "project")).select(
        "project", "total", "critical", "high", "medium", "low", "acknowledged", "penalty_total", "score", "grade", "status")


@query("a07_scan_score", f"{LIFE}, s AS ({score_sql('scan_id')}) SELECT scan_id, total, score, {_GRADE} AS grade FROM s")
def scan_scores(spark, sf):
    return a.compliance_score(processed(spark, sf), ("scan_id",), units=units(spark, sf, "scan_id")).select(
        "scan_id", "total", "score", "grade")


@query("a08_recommendations", f"{LIFE}, s AS ({score_sql('scan_id')}) SELECT scan_id, concat_ws(' | ', "
       "CASE WHEN critical > 0 THEN 'Address ' || critical || ' critical issue(s) immediately - these pose severe HIPAA "
       "compliance risks' END, CASE WHEN high > 0 THEN 'Resolve ' || high || ' high severity issue(s) as soon as possible' "
       "END, CASE WHEN medium > 10 THEN 'Review and remediate ' || medium || ' medium severity findings to improve "
       "compliance posture' END, CASE WHEN acknowledged > 0 THEN acknowledged || ' finding(s) are acknowledged but should "
       "still be addressed when possible' END, CASE WHEN score < 70 THEN 'Your compliance score is below acceptable levels. "
       "Consider a comprehensive security audit' END, CASE WHEN score >= 90 AND total = 0 THEN 'Excellent! No active compliance "
       "issues found. Maintain regular scanning.' WHEN score >= 90 THEN 'Great compliance posture! Continue "
       "monitoring and maintaining best practices.' END, CASE WHEN critical = 0 AND high = 0 AND medium <= 10 AND "
       "acknowledged = 0 AND score >= 70 AND score < 90 THEN 'Continue regular scanning to maintain HIPAA compliance' END) "
       "AS advice FROM s")
def advice(spark, sf):
    s = a.recommendations(a.compliance_score(processed(spark, sf), ("scan_id",), units=units(spark, sf, "scan_id")))
    return s.select("scan_id", F.array_join("recommendations", " | ").alias("advice"))


_DEDUCT = " + ".join(f"{p} * count(*) FILTER (WHERE severity = '{s}')" for s, p in a.CATEGORY_PENALTY.items())
_LABEL = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in a.CATEGORY_LABELS.items()) + " END"


_ALL_KINDS = ", ".join([f"({_q(k)}, {_q(v)})" for k, v in a.CATEGORY_LABELS.items()] + ["(NULL, 'overall')"])


@query("a09_category_score", f"{FOUND}, u AS (SELECT DISTINCT project FROM corpus), s AS (SELECT u.project, k.label AS category, "
       f"count(f.severity) AS findings, greatest(0, 100 - ({_DEDUCT})) AS score FROM u CROSS JOIN (VALUES {_ALL_KINDS}) AS k(name, "
       "label) LEFT JOIN findings f ON f.project = u.project AND (k.name IS NULL OR f.category = k.name) GROUP BY ALL) SELECT *, "
       "CASE WHEN category = 'overall' THEN CASE WHEN score >= 95 THEN 'A+' WHEN score >= 80 THEN 'A' WHEN score >= 60 THEN 'B' WHEN "
       "score >= 40 THEN 'C' WHEN score >= 20 THEN 'D' ELSE 'F' END END AS grade FROM s")
def category_score(spark, sf):
    return a.category_scores(found(spark, sf), units=units(spark, sf, "project"))


@query("a10_executive_status", f"{LIFE}, s AS (SELECT unit AS project, count(*) FILTER (WHERE {ACTIVE} AND severity = 'critical') "
       f"AS critical, count(*) FILTER (WHERE {ACTIVE} AND severity = 'high') AS high FROM (SELECT DISTINCT project AS unit FROM corpus) "
       "LEFT JOIN p ON p.project = unit GROUP BY unit) SELECT *, "
       "CASE WHEN critical = 0 AND high = 0 THEN 'compliant' WHEN critical = 0 AND high <= 3 THEN 'needs-attention' ELSE "
       "'non-compliant' END AS status, CASE WHEN critical > 5 THEN 'Critical' WHEN critical > 0 OR high > 10 THEN 'High' "
       "WHEN high > 0 THEN 'Medium' ELSE 'Low' END AS risk FROM s")
def executive(spark, sf):
    return a.executive_status(processed(spark, sf), units=units(spark, sf, "project"))


@query("a10_top_findings", f"{FOUND}, s AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY {SEQ}) AS n FROM "
       "findings WHERE severity IN ('critical', 'high')) SELECT project, n, finding_id, file, line FROM s WHERE n <= 5")
def priority(spark, sf):
    return a.top_findings(found(spark, sf), 5).select("project", "n", "finding_id", "file", "line")


@query("a10_top_categories", f"{FOUND}, c AS (SELECT project, category, count(*) AS hits FROM findings GROUP BY ALL), "
       "s AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY hits DESC, category) AS n FROM c) "
       "SELECT project, category, hits, n FROM s WHERE n <= 3")
def top_categories(spark, sf):
    return a.top_categories(found(spark, sf))


@query("a11_project_status", f"{LIFE}, s AS ({score_sql('project')}) SELECT project, score, CASE WHEN score >= 90 THEN "
       "'compliant' WHEN score >= 70 THEN 'at_risk' ELSE 'critical' END AS status FROM s")
def project_status(spark, sf):
    s = a.compliance_score(processed(spark, sf), units=units(spark, sf, "project"))
    return s.select("project", "score", a.project_status(F.col("score")).alias("status"))


@query("a12_gates", f"{LIFE}, s AS (SELECT scan_id, score FROM ({score_sql('scan_id')})) SELECT s.scan_id, coalesce(bool_or(severity = 'critical'), "
       f"false) AS scan_fails, min(s.score) < 60 AS score_fails, coalesce(bool_or(severity = 'critical' AND {ACTIVE}), false) AS "
       "review_fails, CASE min(rank) WHEN 0 THEN 'reject' WHEN 1 THEN 'reject' WHEN 2 THEN 'review' ELSE 'safe' END AS skill_verdict "
       "FROM s LEFT JOIN p ON s.scan_id = p.scan_id GROUP BY s.scan_id")
def gates(spark, sf):
    return a.gates(processed(spark, sf), ("scan_id",), units(spark, sf, "scan_id"))


_REVIEWS = (
    "SELECT project, severity, scan_ts, CASE line % 4 WHEN 0 THEN 'pending_review' WHEN 1 THEN 'in_progress' WHEN 2 THEN "
    "'resolved' ELSE 'pending_review' END AS status, CAST(CAST(scan_ts AS DATE) + CASE severity WHEN 'critical' THEN 7 "
    "WHEN 'high' THEN 14 WHEN 'medium' THEN 30 ELSE 60 END AS TIMESTAMP) AS deadline FROM findings WHERE fix_type IS NULL")


@query("a13_audit_summary", f"{FOUND}, r AS ({_REVIEWS}) SELECT project, count(*) AS reviews, "
       + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in
                   ("pending_review", "in_progress", "resolved", "accepted_risk"))
       + f", {_SEV}, count(*) FILTER (WHERE deadline < TIMESTAMP '{AS_OF}' AND status = 'pending_review') AS overdue "
       "FROM r GROUP BY project")
def audit(spark, sf):
    r = found(spark, sf).filter("fix_type IS NULL").withColumns({
        "status": F.expr("CASE line % 4 WHEN 1 THEN 'in_progress' WHEN 2 THEN 'resolved' ELSE 'pending_review' END"),
        "deadline": h.review_deadline("scan_ts").cast("timestamp")})
    return a.audit_summary(r, AS_OF)


@query("a16_portfolio_stats", f"{LIFE}, s AS ({score_sql('project')}) SELECT CAST(floor(avg(score) + 0.5) AS BIGINT) AS "
       "avg_score, CAST(sum(critical + high) AS BIGINT) AS urgent, CAST(sum(total) AS BIGINT) AS total FROM s")
def portfolio(spark, sf):
    return a.portfolio_stats(a.compliance_score(processed(spark, sf), units=units(spark, sf, "project")))


@query("a17_skill_issue_types", f"{o.pack_findings(['skills'], 'all')} SELECT split_part(rule_id, '-', 2) AS issue_type, "
       "count(*) AS hits FROM findings GROUP BY 1")
def skill_types(spark, sf):
    return a.issue_types(d.detect(corpus(spark, sf), ["skills"]))


@query("a19_per_file_issues", f"{FOUND} SELECT file, count(*) AS findings, count(*) FILTER (WHERE rank <= 1) AS urgent, "
       "string_agg(finding_id, ',' ORDER BY line, rank, finding_id) AS entries FROM findings GROUP BY file")
def per_file(spark, sf):
    f = a.per_file_issues(found(spark, sf))
    return f.select("file", "findings", "urgent", F.array_join("entries.finding_id", ",").alias("entries"))


@query("a20_annotations", f"{FOUND}, s AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY {SEQ}) AS n FROM "
       "findings) SELECT project, n, file AS path, line, CASE severity WHEN 'critical' THEN 'failure' WHEN 'high' THEN "
       "'warning' WHEN 'medium' THEN 'warning' ELSE 'notice' END AS level, '[' || upper(severity) || '] ' || title AS title "
       "FROM s WHERE n <= 50")
def annotations(spark, sf):
    return a.annotations(found(spark, sf))


@query("a21_headline", f"{FOUND} SELECT project, count(DISTINCT severity || '::' || {_KEY}) AS types, count(*) AS "
       "locations, count(DISTINCT file) AS files, 'Found ' || types || ' types of HIPAA violations across ' || locations || "
       "' locations in ' || files || ' files' AS headline FROM findings GROUP BY project")
def headline(spark, sf):
    return a.headline(found(spark, sf))


# History: one scan per order, so a project's scans follow its order dates.

_HIST = (
    f"{LIFE}, s AS (SELECT scan_id, score FROM ({score_sql('scan_id')})), hist AS MATERIALIZED (SELECT c.project, c.scan_id, c.scan_ts, "
    "min(s.score) AS score, " + ", ".join(f"count(*) FILTER (WHERE {ACTIVE} AND severity = '{x}') AS {x}" for x in h.SEVERITY_NAMES)
    + f", coalesce(list_sort(list(DISTINCT rule_id) FILTER (WHERE {ACTIVE})), []) AS failed_rules, 1 AS files FROM corpus c JOIN s ON "
    "s.scan_id = c.scan_id LEFT JOIN p ON p.scan_id = c.scan_id GROUP BY c.project, c.scan_id, c.scan_ts)"
)
_W = "PARTITION BY project ORDER BY scan_ts, scan_id"
_WD = "PARTITION BY project ORDER BY scan_ts DESC, scan_id DESC"


def history(spark, sf, f=None):
    """The history table, of clean scans too; the queries on it read it more than once, so it is written first, as in use."""
    scans = units(spark, sf, "project", "scan_id", "scan_ts", "files")
    return stored(h.history_entries(processed(spark, sf, f), scans=scans), "history")


@query("w01_latest_scan", f"{_HIST}, x AS (SELECT *, row_number() OVER ({_WD}) AS n FROM hist) SELECT project, scan_id, "
       "score FROM x WHERE n = 1")
def latest(spark, sf):
    return h.latest_scan(history(spark, sf)).select("project", "scan_id", "score")


_CH = ", ".join(f"CASE WHEN n = 1 THEN 0 ELSE {c} - p_{c} END AS {c}_change" for c in ["score", *h.SEVERITY_NAMES])
_LAGS = ", ".join(f"lag({c}) OVER ({_W}) AS p_{c}" for c in ["score", *h.SEVERITY_NAMES, "failed_rules"])


@query("w02_compare_with_previous", f"{_HIST}, x AS (SELECT *, row_number() OVER ({_W}) AS n, {_LAGS} FROM hist) SELECT "
       f"scan_id, {_CH}, CASE WHEN n = 1 THEN '' ELSE array_to_string(list_filter(failed_rules, lambda r: NOT "
       "list_contains(p_failed_rules, r)), ',') END AS new_rules, CASE WHEN n = 1 THEN '' ELSE array_to_string(list_filter("
       "p_failed_rules, lambda r: NOT list_contains(failed_rules, r)), ',') END AS resolved_rules FROM x")
def compared(spark, sf):
    c = h.compare_with_previous(history(spark, sf))
    return c.select("scan_id", *[f"{x}_change" for x in ["score", *h.SEVERITY_NAMES]],
                    F.array_join("new_rules", ",").alias("new_rules"),
                    F.array_join("resolved_rules", ",").alias("resolved_rules"))


@query("w03_history_view", f"{_HIST}, x AS (SELECT *, coalesce(score - lag(score) OVER ({_W}), 0) AS change, row_number() "
       f"OVER ({_WD}) AS n, score = max(score) OVER (PARTITION BY project) AS best, score = min(score) OVER (PARTITION BY "
       "project) AS lowest FROM hist) SELECT scan_id, n, change, CASE WHEN change > 0 THEN 'up' WHEN change < 0 THEN 'down' "
       "ELSE 'flat' END AS arrow, best, lowest FROM x WHERE n <= 10")
def view(spark, sf):
    return h.history_view(history(spark, sf)).select("scan_id", "n", "change", "arrow", "best", "lowest")


@query("w04_history_stats", f"{_HIST} SELECT project, count(*) AS scans, CAST(floor(avg(score) + 0.5) AS BIGINT) AS "
       "avg_score, max(score) AS best, min(score) AS lowest, arg_max(score, (scan_ts, scan_id)) - arg_min(score, (scan_ts, "
       "scan_id)) AS trend FROM hist GROUP BY project")
def stats(spark, sf):
    return h.history_stats(history(spark, sf))


@query("w05_score_direction", f"{_HIST}, x AS (SELECT *, score - lag(score) OVER ({_W}) AS change FROM hist) SELECT scan_id, "
       "CASE WHEN change IS NULL THEN NULL WHEN abs(change) < 1 THEN 'same' WHEN change > 0 THEN 'up' ELSE 'down' END AS "
       "direction FROM x")
def direction(spark, sf):
    return h.score_direction(history(spark, sf)).select("scan_id", "direction")


@query("w06_history_entries", f"{_HIST} SELECT project, scan_id, score, critical, high, medium, low, "
       "array_to_string(failed_rules, ',') AS failed_rules, files FROM hist")
def entries(spark, sf):
    return history(spark, sf).select(
        "project", "scan_id", "score", *h.SEVERITY_NAMES, F.array_join("failed_rules", ",").alias("failed_rules"), "files")


@query("w07_chart_series", f"{_HIST}, x AS (SELECT *, row_number() OVER ({_WD}) AS n FROM hist), y AS (SELECT *, "
       f"row_number() OVER ({_W}) AS point FROM x WHERE n <= 10) SELECT project, point, score FROM y")
def chart(spark, sf):
    return h.chart_series(history(spark, sf)).select("project", "point", "score")


@query("w08_review_deadline", f"{FOUND} SELECT finding_id, file, strftime(CAST(scan_ts AS DATE) + CASE severity WHEN "
       "'critical' THEN 7 WHEN 'high' THEN 14 WHEN 'medium' THEN 30 ELSE 60 END, '%Y-%m-%d') AS deadline FROM findings "
       "WHERE fix_type IS NULL")
def deadlines(spark, sf):
    f = found(spark, sf).filter("fix_type IS NULL")
    return f.select("finding_id", "file", h.review_deadline("scan_ts").cast("string").alias("deadline"))


@query("w09_call_limit", "WITH e AS (SELECT event_id, event_type || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS scan, {'us': "
       "epoch_us(ts), 'id': event_id} AS c FROM events), l AS (SELECT scan, list(c ORDER BY c.us, c.id) AS l FROM e GROUP BY scan), "
       "k AS (SELECT scan, list_reduce(list_transform(l, lambda v: [v]), lambda acc, x: CASE WHEN len(acc) < 50 AND "
       "len(list_filter(acc, lambda a: a.us > x[1].us - 60000000)) < 20 THEN list_concat(acc, x) ELSE acc END) AS kept FROM l) "
       "SELECT event_id, len(list_filter(kept, lambda a: a.us > c.us - 60000000 AND (a.us < c.us OR (a.us = c.us AND a.id < c.id)))) "
       "AS in_minute, len(list_filter(kept, lambda a: a.us < c.us OR (a.us = c.us AND a.id < c.id))) AS in_scan, "
       "len(list_filter(kept, lambda a: a.id = c.id)) > 0 AS allowed FROM e JOIN k USING (scan)")
def call_limit(spark, sf):
    e = read(spark, sf, "events").withColumn("scan", F.concat_ws("/", "event_type", F.to_date("ts")))
    return h.rate_limited(e, "scan", "ts").select("event_id", "in_minute", "in_scan", "allowed")


@query("w10_budget_cutoff", "WITH c AS (SELECT event_id, coalesce(sum(CAST(floor(value * 100) AS BIGINT) * 3 + CAST(floor("
       "value * 10) AS BIGINT) * 15) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 "
       "PRECEDING), 0) AS t FROM events) SELECT event_id, CAST(t AS DOUBLE) * 100 / 1000000 AS cents_before, "
       "CAST(t AS DOUBLE) * 100 / 1000000 < 25 AS runs FROM c")
def budget(spark, sf):
    e = read(spark, sf, "events").selectExpr(
        "event_id", "user_id", "ts", "CAST(floor(value * 100) AS BIGINT) AS input_tokens",
        "CAST(floor(value * 10) AS BIGINT) AS output_tokens")
    return h.budget_cutoff(e, "user_id", "ts", 25).select("event_id", "cents_before", "runs")


