"""Redaction, fixes and report text."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import oracle as o
from checks.corpus import _q, code_corpus, code_corpus_sql, corpus, corpus_sql, read, text_corpus, text_corpus_sql
from checks.lifecycle import FOUND, found
from checks.registry import query
from scanweave.functions import text as tx
from scanweave.operators import aggregate as a
from scanweave.operators import detect as d
from scanweave.operators import fixes as fx
from scanweave.operators import redact as rd
from scanweave.sources.folders import stored


def _scrub_sql(source: str) -> str:
    """One CTE per kind: hits become a control character, the parts between are numbered again."""
    ctes, prev = [f"t0 AS (SELECT file, content, content AS clean, 0 AS found FROM ({source}))"], "t0"
    for n, (kind, p) in enumerate(rd.KINDS, 1):
        q = _q(o.re2(p))
        parts = f"string_split(regexp_replace(clean, {q}, chr(1), 'g'), chr(1))"
        joined = (f"array_to_string(list_transform(range(1, len(parts) + 1), lambda k: CASE WHEN k = 1 THEN parts[k] ELSE "
                  f"'[PHI_{kind}_' || (k - 1) || ']' || parts[k] END), '')")
        ctes.append(f"s{n} AS (SELECT *, {parts} AS parts, regexp_matches(content, {q}) AS hit FROM {prev})")
        ctes.append(f"t{n} AS (SELECT file, content, CASE WHEN hit THEN {joined} ELSE clean END AS clean, found + CASE WHEN hit "
                    f"THEN len(parts) - 1 ELSE 0 END AS found, {', '.join(f'n{j}' for j in range(1, n))}"
                    f"{', ' if n > 1 else ''}CASE WHEN hit THEN len(parts) - 1 ELSE 0 END AS n{n} FROM s{n})")
        prev = f"t{n}"
    return "WITH " + ", ".join(ctes)


@query("f01_scrub", f"{_scrub_sql(corpus_sql())} SELECT file, sha256(clean) AS clean_hash, found, n1 AS ssn, n2 AS email, n3 AS "
       "phone, n4 AS dob, n5 AS mrn, n6 AS ip FROM t6")
def scrub(spark, sf):
    s = rd.scrub(corpus(spark, sf), "content")
    return s.select("file", F.sha2("clean", 256).alias("clean_hash"), "found",
                    *[F.col("counts")[k].alias(k.lower()) for k, _ in rd.KINDS])


@query("f02_restore", f"SELECT file, sha256(content) AS restored_hash FROM ({text_corpus_sql()})")
def restore(spark, sf):
    r = rd.restore(rd.scrub(text_corpus(spark, sf), "content"))
    return r.select("file", F.sha2("restored", 256).alias("restored_hash"))


# Fixes whose rules hit the corpora; the checking engine has its own wording of each.
def _fix_sql(t: str, kind: str) -> str:
    quotes = ["\"[^'\"`]+\"", "'[^'\"`]+'", "`[^'\"`]+`"]

    def assigned(word):
        return f"(?i)({word})\\s*[:=]\\s*(?:{'|'.join(quotes)})"

    name = (f"coalesce(nullif(regexp_extract({t}, '(?:const|let|var)\\s+(\\w+)|(\\w+)\\s*[:=]', 1), ''), "
            f"nullif(regexp_extract({t}, '(?:const|let|var)\\s+(\\w+)|(\\w+)\\s*[:=]', 2), ''))")
    env = f"upper(regexp_replace(regexp_replace({name}, '([a-z])([A-Z])', '\\1_\\2', 'g'), '[-\\s]+', '_', 'g'))"

    def secret(word, lead):
        p = _q(assigned(word))
        keep = f"regexp_extract({t}, {p}, 1)" if lead is None else _q(lead)
        return (f"CASE WHEN regexp_matches({t}, {p}) THEN regexp_replace({t}, {p}, {keep} || ' = process.env.' || {env}) END")

    indent, line = f"regexp_extract({t}, '^(\\s*)', 1)", f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"
    cookie = r"cookie\s*:\s*\{([^}]*)\}"
    call = r"(res\.cookie\s*\(\s*['\"`][^'\"`]+['\"`]\s*,\s*\w+)\s*\)"
    tpl = r"(\w+)\s*\(\s*`([^`]*)\$\{([^}]+)\}([^`]*)`\s*\)"
    cat = r"""(\w+)\s*\(\s*"([^"]+)"\s*\+\s*(\w+)\s*\+\s*"([^"]*)"\s*\)"""

    def g(p, n):
        return f"regexp_extract({t}, {_q(p)}, {n})"

    return {
        "http-url": (f"CASE WHEN contains({t}, 'http://') AND NOT contains({t}, 'http://localhost') AND NOT contains({t}, "
                     f"'http://127.0.0.1') THEN replace({t}, 'http://', 'https://') END"),
        "hardcoded-password": secret("password|pwd", None), "hardcoded-secret": secret("secret", "secret"),
        "api-key-exposed": secret("api[_-]?key|apikey", None),
        "innerhtml-unsanitized": (f"CASE WHEN regexp_matches({t}, '\\.innerHTML\\s*=') THEN regexp_replace({t}, "
                                  "'\\.innerHTML\\s*=', '.textContent =') END"),
        "phi-console-log": (f"CASE WHEN regexp_matches({t}, '^\\s*console\\.(log|info|debug|warn|error)\\s*\\(') THEN {indent} || "
                            f"'// [REVIEW] PHI logging removed - review needed: ' || {line} END"),
        "phi-localstorage": (f"CASE WHEN regexp_matches({t}, '^\\s*localStorage\\.(setItem|getItem)\\s*\\(') THEN {indent} || "
                             "'// [REVIEW] PHI in localStorage removed - use server-side session storage instead' || chr(10) || "
                             f"{indent} || '// TODO: Replace with: await sessionApi.store(key, encryptedData)' || chr(10) || "
                             f"{indent} || '// Original: ' || {line} END"),
        "phi-url-param": (f"CASE WHEN regexp_matches({t}, '^\\s*(fetch|axios\\.get|http\\.get)\\s*\\(\\s*[`''\"]') THEN {indent} "
                          "|| '// [REVIEW] PHI in URL params - use POST with encrypted body instead' || chr(10) || "
                          f"{indent} || '// TODO: Replace with: ' || CASE WHEN regexp_matches({t}, '^\\s*fetch') THEN 'fetch(url, {{ "
                          "method: ''POST'', body: JSON.stringify({{ patientId }}) }})' ELSE 'axios.post(url, {{ patientId }})' END "
                          "|| chr(10) || ".replace("{{", "{").replace("}}", "}") + f"{indent} || '// Original: ' || {line} END"),
        "cookie-insecure": (f"CASE WHEN contains({t}, 'httpOnly') THEN NULL WHEN regexp_matches({t}, {_q(cookie)}) THEN "
                            f"regexp_replace({t}, {_q(cookie)}, 'cookie: {{ ' || CASE WHEN trim({g(cookie, 1)}) <> '' THEN "
                            f"trim({g(cookie, 1)}) || ', ' ELSE '' END || 'httpOnly: true, secure: true }}') WHEN "
                            f"regexp_matches({t}, {_q(call)}) THEN regexp_replace({t}, {_q(call)}, '\\1, {{ httpOnly: true, "
                            "secure: true })') END".replace("}}", "}")).replace("{{", "{").replace("}}", "}"),
        "phi-log-unredacted": (f"CASE WHEN regexp_matches({t}, {_q(fx.LOG_CALL)}) THEN regexp_replace({t}, "
                               + _q(fx.LOG_CALL.replace(r",\s*(\w+)", r",\s*)(\w+)").replace("logger", "(logger", 1))
                               + ", '\\1redactPHI(\\2)') END"),
        "sql-injection-template": (f"CASE WHEN regexp_matches({t}, {_q(tpl)}) THEN regexp_replace({t}, '\\w+\\s*\\(\\s*`[^`]*`"
                                   f"\\s*\\)', {g(tpl, 1)} || '(''' || {g(tpl, 2)} || '?' || {g(tpl, 4)} || ''', [' || "
                                   f"trim({g(tpl, 3)}) || '])') END"),
        "sql-injection-concat": (f"CASE WHEN regexp_matches({t}, {_q(cat)}) THEN regexp_replace({t}, {_q(cat)}, {g(cat, 1)} || "
                                 f"'(''' || regexp_replace({g(cat, 2)}, '''?\\s*$', '') || '?' || regexp_replace({g(cat, 4)}, "
                                 f"'^\\s*''?', '') || ''', [' || {g(cat, 3)} || '])') END"),
        "backup-unencrypted": (f"CASE WHEN regexp_matches({t}, {_q(fx.BACKUP_WRITE)}) THEN {indent} || '// [REVIEW] Unencrypted "
                               f"backup - encrypt before writing' || chr(10) || {indent} || '// TODO: const encrypted = await "
                               f"crypto.encrypt(data, process.env.BACKUP_KEY);' || chr(10) || {indent} || '// Then write encrypted "
                               f"data to ' || {g(fx.BACKUP_WRITE, 1)} || '.enc' || chr(10) || {indent} || '// Original: ' || {line} "
                               f"WHEN regexp_matches({t}, {_q(fx.BACKUP_NAME)}) AND NOT contains({t}, 'encrypt') AND NOT "
                               f"contains({t}, 'gpg') THEN {indent} || '// [REVIEW] Use encrypted backup format (.gpg, .enc) or "
                               f"enable encryption' || chr(10) || {indent} || {line} END"),
    }[kind]


KINDS = ["http-url", "hardcoded-password", "hardcoded-secret", "api-key-exposed", "innerhtml-unsanitized", "phi-console-log",
         "phi-localstorage", "phi-url-param", "cookie-insecure", "phi-log-unredacted", "sql-injection-template",
         "sql-injection-concat", "backup-unencrypted"]


@query("f03_fix_strategies", f"{o.base('all')}, u AS (" + " UNION ALL ".join(
    f"SELECT file, i + 1 AS line, '{k}' AS fix_type, {_fix_sql('text', k)} AS fixed FROM lines" for k in KINDS)
    + ") SELECT fix_type, file, line, sha256(fixed) AS fixed_hash FROM u WHERE fixed IS NOT NULL")
def strategies(spark, sf):
    lines = fx.possible_fixes(d.explode_lines(corpus(spark, sf)), KINDS)
    return fx.fix_cases(lines).filter("fixed IS NOT NULL").select(
        "fix_type", "file", "line", F.sha2("fixed", 256).alias("fixed_hash"))


# One CTE per round: the first remaining fix of every line, applied to what the rounds before left.
_ROUNDS = 4
_FIXED = (
    f"{FOUND}, todo AS MATERIALIZED (SELECT project, file, line, code, finding_id, fix_type, row_number() OVER (PARTITION BY file, "
    "line ORDER BY rank, pack_no, file, line, rule_no) AS n FROM findings WHERE fix_type IS NOT NULL), "
    "r0 AS (SELECT DISTINCT file, line, code AS text FROM todo)"
    + "".join(
        f", q{n} AS (SELECT r.file, r.line, r.text AS before, t.finding_id, t.fix_type, coalesce(CASE t.fix_type "
        + " ".join(f"WHEN '{k}' THEN {_fix_sql('r.text', k)}" for k in KINDS)
        + f" END, r.text) AS text FROM r{n - 1} r LEFT JOIN todo t ON t.file = r.file AND t.line = r.line AND t.n = {n}), "
        f"r{n} AS MATERIALIZED (SELECT file, line, text FROM q{n})" for n in range(1, _ROUNDS + 1))
)
_STEPS = " UNION ALL ".join(
    f"SELECT file, line, {n - 1} AS k, finding_id, before, text AS after, before <> text AS fixed FROM q{n} WHERE finding_id IS NOT "
    "NULL" for n in range(1, _ROUNDS + 1))


@query("f04_fix_steps", f"{_FIXED} SELECT file, line, k, finding_id, sha256(after) AS after_hash, fixed FROM ({_STEPS})")
def steps(spark, sf):
    return fx.fix_steps(found(spark, sf)).select(
        "file", "line", "k", "finding_id", F.sha2("after", 256).alias("after_hash"), "fixed")


_NEWTEXT = ("array_to_string(list_transform(range(1, len(f.ls) + 1), lambda i: coalesce(m.new[i], f.ls[i])), chr(10))")


@query("f04_apply_fixes", f"{_FIXED}, m AS (SELECT file, map_from_entries(list((line, text))) AS new FROM r{_ROUNDS} GROUP BY "
       "file), c AS (SELECT DISTINCT file FROM (" + _STEPS + ") WHERE fixed) SELECT f.file, sha256(" + _NEWTEXT + ") AS new_hash "
       "FROM files f JOIN m ON m.file = f.file JOIN c ON c.file = f.file")
def applied(spark, sf):
    out = fx.apply_fixes(code_corpus(spark, sf), fx.fix_steps(found(spark, sf)))
    return out.select("file", F.sha2("fixed_content", 256).alias("new_hash"))


_EVIDENCE = (
    f"{_FIXED}, m AS (SELECT file, map_from_entries(list((line, text))) AS new FROM r{_ROUNDS} GROUP BY file), "
    f"st AS (SELECT * FROM ({_STEPS}) WHERE fixed), e AS (SELECT s.file, s.line, s.finding_id, row_number() OVER (PARTITION BY "
    "s.file ORDER BY s.line DESC, s.k) - 1 AS step, sha256(f.content) AS hash_before, sha256(array_to_string(list_transform(range(1, "
    "len(f.ls) + 1), lambda i: CASE WHEN i > s.line THEN coalesce(m.new[i], f.ls[i]) WHEN i = s.line THEN s.after ELSE f.ls[i] END), "
    "chr(10))) AS hash_after, array_to_string(f.ls[greatest(s.line - 3, 1) : s.line + 3], ' / ') AS before_lines FROM st s JOIN "
    "files f ON f.file = s.file JOIN m ON m.file = s.file)"
)


@query("f05_evidence", f"{_EVIDENCE} SELECT * FROM e")
def evidence(spark, sf):
    e = fx.evidence(code_corpus(spark, sf), fx.fix_steps(found(spark, sf)))
    return e.select("file", "line", "finding_id", "step", "hash_before", "hash_after",
                    F.array_join("before.content", " / ").alias("before_lines"))


@query("f06_trail_hash", f"{_EVIDENCE} SELECT file, sha256(string_agg(finding_id || '|' || hash_before || '|' || hash_after || "
       "'|1998-01-01', chr(10) ORDER BY step)) AS trail_hash FROM e GROUP BY file")
def trail(spark, sf):
    e = fx.evidence(code_corpus(spark, sf), fx.fix_steps(found(spark, sf))).withColumn("at", F.lit("1998-01-01"))
    return fx.trail_hash(e, ["file"], "at")


@query("f06_project_trail", f"{_EVIDENCE} SELECT f.project, sha256(string_agg(e.finding_id || '|' || e.hash_before || '|' || "
       "e.hash_after || '|1998-01-01', chr(10) ORDER BY e.file, e.step)) AS trail_hash, count(*) AS steps, count(DISTINCT e.file) AS "
       f"files FROM e JOIN (SELECT DISTINCT project, file FROM ({code_corpus_sql()})) f ON f.file = e.file GROUP BY f.project")
def project_trail(spark, sf):
    """A trail over all files of a project."""
    e = fx.evidence(code_corpus(spark, sf), fx.fix_steps(found(spark, sf))).withColumn("at", F.lit("1998-01-01"))
    e = stored(e.drop("line", "fix_type", "title", "reference", "before", "after"), "evidence")
    counts = e.groupBy("project").agg(F.count("*").alias("steps"), F.count_distinct("file").alias("files"))
    return fx.trail_hash(e, ["project"], "at").join(counts, "project")


@query("a18_fix_report", f"{_FIXED} SELECT file, count(*) FILTER (WHERE fixed) AS fixed, count(*) FILTER (WHERE NOT fixed) AS "
       f"skipped FROM ({_STEPS}) GROUP BY file")
def fix_report(spark, sf):
    return fx.fix_report(fx.fix_steps(found(spark, sf))).select("file", "fixed", "skipped")


@query("f07_manual_reviews", f"{FOUND} SELECT file, line, finding_id, CASE line % 5 WHEN 0 THEN 'resolved' WHEN 1 THEN "
       "'in_progress' ELSE 'pending_review' END AS status, strftime(CAST(scan_ts AS DATE) + CASE severity WHEN 'critical' THEN 7 WHEN "
       "'high' THEN 14 WHEN 'medium' THEN 30 ELSE 60 END, '%Y-%m-%d') AS deadline FROM findings WHERE fix_type IS NULL")
def reviews(spark, sf):
    r = stored(fx.manual_reviews(found(spark, sf)), "reviews")
    keys = ["file", "line", "finding_id"]
    first = r.filter("line % 5 < 2").select(*keys, F.lit("in_progress").alias("status"), F.expr(
        "CAST(updated_at AS TIMESTAMP) + INTERVAL 1 DAY").alias("updated_at"))
    second = r.filter("line % 5 = 0").select(*keys, F.lit("resolved").alias("status"), F.expr(
        "CAST(updated_at AS TIMESTAMP) + INTERVAL 2 DAYS").alias("updated_at"))
    r = r.withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    out = fx.update_reviews(r, first.unionByName(second))
    return out.select(*keys, "status", F.col("deadline").cast("string").alias("deadline"))


_PATHS = ("CASE o_orderkey % 5 WHEN 0 THEN '/home/runner/work/app/app/src/f' || o_orderkey || '.ts' WHEN 1 THEN '/tmp/scan-x1/repo/lib/f' "
          "|| o_orderkey || '.js' WHEN 2 THEN './lib/f' || o_orderkey WHEN 3 THEN '/repos/a/src/f' || o_orderkey ELSE 'src/f' || "
          "o_orderkey END")


@query("f08_path_cleanup", f"WITH x AS (SELECT {_PATHS} AS p FROM orders) SELECT p, regexp_replace(regexp_replace(regexp_replace(p, "
       "'^/home/runner/work/[^/]+/[^/]+/', ''), '^/tmp/scan-[^/]+/[^/]+/', ''), '^\\./', '') AS clean, CASE WHEN p NOT LIKE '/%' THEN p "
       "WHEN p LIKE '/repos/a/%' THEN substr(p, 10) ELSE regexp_extract(p, '([^/]*)$', 1) END AS rel FROM x")
def paths(spark, sf):
    x = read(spark, sf, "orders").select(F.expr(_PATHS).alias("p"), F.lit("/repos/a").alias("root"))
    return x.select("p", tx.clean_path("p").alias("clean"), tx.relative_path("p", "root").alias("rel"))


_REFS = ["§164.502, §164.514", "45 CFR §164.312(c) - Integrity Controls", "NPRM §164.312(d) - Person or Entity Authentication",
         "§164.312(a)(2)(iv), §164.312(e)(2)(ii)", "§164.312(e)(1)", "", "-", "internal policy", "§164.308(a)(8)"]
_WANT = [
    "45 CFR §164.502 — Uses and Disclosures of PHI: General Rules; 45 CFR §164.514 — De-identification and Minimum Necessary",
    "45 CFR §164.312(c) — Integrity Controls",
    "45 CFR §164.312(d) — Person or Entity Authentication (NPRM — proposed rule)",
    "45 CFR §164.312(a)(2)(iv) — Encryption and Decryption; 45 CFR §164.312(e)(2)(ii)",
    "45 CFR §164.312(e)(1) — Transmission Security", "—", "—", "internal policy", "45 CFR §164.308(a)(8) — Evaluation",
]


@query("f09_reference_normalize", "SELECT p_partkey, ([" + ", ".join(_q(w) for w in _WANT) + "])[p_partkey % 9 + 1] AS reference "
       "FROM part")
def references(spark, sf):
    from scanweave.functions.sql import lit

    raw = f"element_at(array({', '.join(lit(r) for r in _REFS)}), CAST(p_partkey % 9 AS INT) + 1) AS raw"
    return read(spark, sf, "part").selectExpr("p_partkey", raw).select(
        "p_partkey", tx.format_reference("raw").alias("reference"))


@query("f10_report_text", f"{o.pack_findings(['phi', 'security', 'errors'], 'all')} SELECT file, line, finding_id, replace(replace("
       "replace(replace(code, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS safe, CASE category WHEN 'phi-exposure' THEN "
       "'Phi Exposure' WHEN 'access-control' THEN 'Access Control' ELSE 'Audit Logging' END AS category_title, CASE category WHEN "
       "'phi-exposure' THEN 'Unauthorized PHI Disclosure' WHEN 'access-control' THEN 'Unauthorized Access / Privilege Escalation' ELSE "
       "'Lack of Accountability / Forensics' END AS threat, upper(severity) AS risk, CASE WHEN fix_type IS NULL THEN 'Open' ELSE "
       "'Remediation Available (Auto-fix)' END AS mitigation FROM findings")
def report_text(spark, sf):
    f = d.detect(corpus(spark, sf), ["phi", "security", "errors"])
    return f.select("file", "line", "finding_id", tx.escape_html("code").alias("safe"), tx.title_category("category").alias(
        "category_title"), tx.threat("category").alias("threat"), tx.risk_level("severity").alias("risk"),
        tx.mitigation("fix_type").alias("mitigation"))


_VULNS = "SELECT p_brand AS project, (['critical', 'high', 'moderate', 'low'])[p_partkey % 4 + 1] AS severity FROM part"


@query("a06_vulnerability_counts", f"WITH v AS ({_VULNS}) SELECT project, count(*) AS total, " + ", ".join(
    f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in ("critical", "high", "moderate", "low")) + " FROM v GROUP BY project")
def vulnerability_counts(spark, sf):
    v = read(spark, sf, "part").selectExpr(
        "p_brand AS project", "element_at(array('critical', 'high', 'moderate', 'low'), CAST(p_partkey % 4 AS INT) + 1) AS severity")
    return a.vulnerability_counts(v)
