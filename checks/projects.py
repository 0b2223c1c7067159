"""File and project checks, inventories, sources, registry and stored-table reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import oracle as o
from checks.corpus import _array, _q, code_corpus, code_corpus_sql, corpus, corpus_sql, read, text_corpus
from checks.lifecycle import FOUND, LIFE, _HIST, _KEY, found, history, judged, processed, score_sql, units
from checks.registry import ORACLE, query
from scanweave.functions.sql import lit
from scanweave.operators import aggregate as a
from scanweave.operators import files as fl
from scanweave.operators import inventory as inv
from scanweave.operators import stored as st
from scanweave.rules.catalog import IMPORT_LINE, line_rules, packs, rule
from scanweave.sources import corpus as src
from scanweave.sources import rules as rl
from scanweave.sources import tables as tb

# Package names that customers' manifests draw from; 53 of them, so that steps of 11 do not repeat.
DEPS = """
next react react-dom vue nuxt express fastify hono koa @angular/core @nestjs/core next-auth next-intl @auth0/nextjs-auth0
@clerk/nextjs @supabase/supabase-js @supabase/ssr @supabase/auth-helpers @prisma/client prisma mongoose mongodb pg pg-promise
mysql2 redis drizzle-orm bcrypt jsonwebtoken passport passport-jwt lucia stripe @stripe/stripe-js twilio resend nodemailer
firebase firebase-admin @aws-sdk/client-s3 @google-cloud/storage winston pino morgan snyk left-pad lodash zod typescript
eslint-config-x @types/node vitest axios
""".split()
EXTRAS = [
    ("next.config.js", "module.exports = {};"), ("auth.ts", "export const auth = 1;"),
    (".github/dependabot.yml", "version: 2"), (".snyk", "ignore: {}"), ("nuxt.config.ts", "export default {};"),
    (".github/workflows/codeql.yml", "on: push"), ("src/env.ts", "const u = process.env.SUPABASE_URL;"),
    (".github/workflows/ci.yml", "run: npm audit"), ("README.md", "notes"), ("src/conn.ts", "read(DATABASE_URL)"),
]
N = len(DEPS)


def manifests(spark, sf):
    """One package manifest per customer."""
    pick = f"element_at(array({_array(DEPS, lit)}), CAST((c_custkey * 7 + k * 11) % {N} AS INT) + 1)"
    entry = f"concat('\"', {pick}, '\":\"^', c_custkey % 5, '.', k, '.0\"')"
    return read(spark, sf, "customer").selectExpr(
        "concat('cust-', c_custkey) AS project",
        "concat('{\"name\":\"c\",\"dependencies\":{', array_join(transform(sequence(0, CAST(1 + c_custkey % 6 AS INT)), k -> "
        f"{entry}), ','), '}},\"devDependencies\":{{', array_join(transform(sequence(CAST(2 + c_custkey % 6 AS INT), "
        f"CAST(3 + c_custkey % 6 AS INT)), k -> {entry}), ','), '}}}}') AS body")


DEPS_SQL = (
    "deps AS (SELECT 'cust-' || c_custkey AS project, c_custkey, k, "
    f"([{_array(DEPS, _q)}])[CAST((c_custkey * 7 + k * 11) % {N} AS INT) + 1] AS name, c_custkey % 5 || '.' || k || '.0' AS "
    "version FROM customer, unnest(range(0, 4 + c_custkey % 6)) AS u(k))"
)
_BODY = ("SELECT project, '{' || string_agg('\"' || name || '\":\"^' || version || '\"', ',' ORDER BY k) || '}' AS body "
         "FROM deps GROUP BY project")


def project_corpus(spark, sf):
    """Code files plus each customer's manifest and one extra file, with the project's root folder."""
    code = code_corpus(spark, sf).select("project", "file", "content")
    m = manifests(spark, sf).selectExpr("project", "concat('/repos/', project, '/package.json') AS file", "body AS content")
    kind = f"CAST(c_custkey % {len(EXTRAS)} AS INT) + 1"
    x = read(spark, sf, "customer").selectExpr(
        "concat('cust-', c_custkey) AS project",
        f"concat('/repos/cust-', c_custkey, '/', element_at(array({_array([e for e, _ in EXTRAS], lit)}), {kind})) AS file",
        f"element_at(array({_array([t for _, t in EXTRAS], lit)}), {kind}) AS content")
    return code.unionByName(m).unionByName(x).withColumn("root", F.concat(F.lit("/repos/"), "project"))


_KIND = f"CAST(c_custkey % {len(EXTRAS)} AS INT) + 1"
PROJECTS = (
    f"WITH {DEPS_SQL}, corpus AS MATERIALIZED (SELECT project, file, content FROM ({code_corpus_sql()}) UNION ALL "
    f"SELECT project, '/repos/' || project || '/package.json', body FROM ({_BODY}) UNION ALL "
    f"SELECT 'cust-' || c_custkey, '/repos/cust-' || c_custkey || '/' || ([{_array([e for e, _ in EXTRAS], _q)}])[{_KIND}], "
    f"([{_array([t for _, t in EXTRAS], _q)}])[{_KIND}] FROM customer), "
    "files AS MATERIALIZED (SELECT *, string_split(content, chr(10)) AS ls, substr(file, length('/repos/' || project) + 2) "
    "AS rel FROM corpus), lines AS MATERIALIZED (SELECT project, file, unnest(range(len(ls))) AS i, unnest(ls) AS text "
    "FROM files)"
)
_IMPORT = o.any_match("regexp_replace(text, '^\\s+|\\s+$', '', 'g')", IMPORT_LINE)


def _acts():
    return " ".join(f"WHEN {o.rx('text', p)} THEN '{n}'" for n, p in fl.AUDITED_ACTIONS)


@query("d16_unlogged_actions", f"{o.base('code')}, a AS (SELECT l.file, l.i, CASE {_acts()} END AS action FROM lines l JOIN "
       f"files f ON f.file = l.file WHERE {o.rx('l.file', fl.AUDITED_CODE)} AND NOT {o.rx('l.file', 'test|spec')} AND "
       f"{o.rx('f.content', fl.HEALTH_WORDS)} AND NOT {o.rx('f.content', fl.LOGGING_CALL)}) SELECT file, i + 1 AS line, action, "
       "'audit-unlogged-' || action || '-' || i AS finding_id FROM a WHERE action IS NOT NULL")
def unlogged(spark, sf):
    return fl.unlogged_actions(code_corpus(spark, sf)).select("file", "line", "action", "finding_id")


_MFA = rule("MFA-001")


@query("d17_file_level_absence", f"{o.base('all')} SELECT l.file, min(l.i) + 1 AS line FROM lines l JOIN files f ON f.file = "
       f"l.file WHERE {o.rx('l.file', fl.WEB_CONFIG)} AND {o.any_match('f.content', _MFA.patterns)} AND NOT "
       f"{o.any_match('f.content', _MFA.negatives)} AND {o.any_match('l.text', _MFA.patterns)} AND NOT "
       f"{_IMPORT.replace('(text,', '(l.text,')} GROUP BY l.file")
def no_mfa(spark, sf):
    return fl.missing_mfa(corpus(spark, sf)).select("file", "line")


@query("d18_client_or_server_file", f"{o.base('all')}, c AS (SELECT l.file, {o.client_file()} AS is_client FROM files l JOIN "
       "files f ON f.file = l.file) SELECT file, is_client FROM c")
def client_files(spark, sf):
    return fl.classify_files(corpus(spark, sf)).select("file", "is_client")


_BK = rule("BACKUP-001")


@query("d19_project_backup_absence", f"{PROJECTS}, u AS (SELECT project, file, i, {_IMPORT} AS imp FROM lines WHERE "
       f"{o.rx('file', fl.WEB_MODULES_DATA)} AND {o.any_match('text', _BK.patterns)}), b AS (SELECT project FROM files WHERE "
       f"{o.rx('file', fl.WEB_MODULES_DATA)} AND {o.any_match('content', _BK.negatives)}), r AS (SELECT *, row_number() OVER "
       "(PARTITION BY project ORDER BY imp, file, i) AS n FROM u WHERE project NOT IN (SELECT project FROM b)) SELECT project, "
       "file, i + 1 AS line FROM r WHERE n = 1")
def no_backup(spark, sf):
    return fl.missing_backup(project_corpus(spark, sf)).select("project", "file", "line")


@query("d20_project_log_framework_absence", f"{PROJECTS} SELECT project, min(file) AS file FROM files WHERE file LIKE "
       "'%package.json' GROUP BY project HAVING NOT bool_or(" + " OR ".join(f"contains(content, '{w}')" for w in
                                                                         fl.LOGGING_FRAMEWORKS) + ")")
def no_log_framework(spark, sf):
    return fl.missing_log_framework(project_corpus(spark, sf)).select("project", "file")


@query("d21_project_vulnerability_scan_absence", f"{PROJECTS} SELECT project FROM files GROUP BY project HAVING NOT bool_or("
       f"rel IN ({_array(fl.SCAN_CONFIG_FILES, _q)}) OR (rel LIKE '.github/workflows/%' AND strpos(substr(rel, 19), '/') = 0 AND "
       f"({o.rx('substr(rel, 19)', fl.WORKFLOW_NAME)} OR {o.rx('content', fl.WORKFLOW_STEP)})) OR (rel = 'package.json' AND "
       f"{o.rx('content', fl.MANIFEST_WORD)}))")
def no_vuln_scan(spark, sf):
    return fl.missing_vulnerability_scan(project_corpus(spark, sf)).select("project")


@query("d21_root_from_paths", ORACLE["d21_project_vulnerability_scan_absence"])
def no_vuln_scan_no_root(spark, sf):
    return fl.missing_vulnerability_scan(project_corpus(spark, sf).drop("root")).select("project")


def _skill_fields():
    out = []
    for k, p in fl.SKILL_FIELDS.items():
        m, v = o.rx("text", p), f"trim(regexp_extract(text, {_q(o.re2(p))}, 1))"
        out.append(f"arg_max({v}, i) FILTER (WHERE {m}) AS {k}")
    out.append(f"arg_min(trim(regexp_extract(text, {_q(o.re2(fl.SKILL_NAME))}, 1)), i) FILTER (WHERE "
               f"{o.rx('text', fl.SKILL_NAME)}) AS name")
    out.append(f"max(i) FILTER (WHERE {o.rx('text', fl.SKILL_FIELDS['permissions'])}) + 1 AS permissions_line")
    out.append(f"min(i) FILTER (WHERE {o.rx('text', fl.SYSTEM_CHANGE)}) + 1 AS system_line")
    return ", ".join(out)


_META = f"{o.base('all')}, m AS (SELECT file, {_skill_fields()} FROM lines WHERE {o.rx('file', fl.SKILL_FILES)} GROUP BY file)"


@query("d23_skill_metadata", f"{_META} SELECT * FROM m")
def skill_meta(spark, sf):
    return fl.skill_metadata(corpus(spark, sf)).drop("project")


@query("d23_skill_findings", f"{_META} SELECT file, 'skill-excessive-permissions' AS rule_id, permissions_line AS line FROM m "
       "WHERE len(list_filter(string_split(permissions, ','), lambda p: trim(p) IN ('*', 'all'))) > 0 UNION ALL SELECT file, "
       "'skill-unknown-author', 1 FROM m WHERE coalesce(author, '') = '' AND coalesce(source, '') = '' UNION ALL SELECT file, "
       "'skill-system-modification', system_line FROM m WHERE system_line IS NOT NULL")
def skill_extra(spark, sf):
    return fl.skill_findings(fl.skill_metadata(corpus(spark, sf))).select("file", "rule_id", "line")


def _whole_scan_sql():
    """Line hits of all packs beside the file, project and skill checks, each written out over the project corpus."""
    line = " UNION ALL ".join(o.rule_sql(p, r) for p, r in line_rules(None))
    skill = (f"m AS (SELECT project, file, {_skill_fields()} FROM lines WHERE {o.rx('file', fl.SKILL_FILES)} GROUP BY ALL)")
    parts = [
        "SELECT h.project, r.rule_id FROM hits h JOIN " + o.rules_values(line_rules(None)) + " ON r.rule_no = h.rule_no",
        f"SELECT l.project, 'audit-unlogged-action' FROM lines l JOIN files f ON f.file = l.file WHERE {o.rx('l.file', fl.AUDITED_CODE)} "
        f"AND NOT {o.rx('l.file', 'test|spec')} AND {o.rx('f.content', fl.HEALTH_WORDS)} AND NOT "
        f"{o.rx('f.content', fl.LOGGING_CALL)} AND ({' OR '.join(o.rx('l.text', p) for _, p in fl.AUDITED_ACTIONS)})",
        f"SELECT DISTINCT ON (l.file) l.project, 'MFA-001' FROM lines l JOIN files f ON f.file = l.file WHERE "
        f"{o.rx('l.file', fl.WEB_CONFIG)} AND {o.any_match('f.content', _MFA.patterns)} AND NOT "
        f"{o.any_match('f.content', _MFA.negatives)} AND {o.any_match('l.text', _MFA.patterns)} AND NOT "
        f"{_IMPORT.replace('(text,', '(l.text,')}",
        f"SELECT project, 'BACKUP-001' FROM ({ORACLE['d19_project_backup_absence']})",
        f"SELECT project, 'audit-no-framework' FROM ({ORACLE['d20_project_log_framework_absence']})",
        f"SELECT project, 'HIPAA-PENTEST-001' FROM ({ORACLE['d21_project_vulnerability_scan_absence']})",
        "SELECT project, 'skill-excessive-permissions' FROM m WHERE len(list_filter(string_split(permissions, ','), lambda p: "
        "trim(p) IN ('*', 'all'))) > 0",
        "SELECT project, 'skill-unknown-author' FROM m WHERE coalesce(author, '') = '' AND coalesce(source, '') = ''",
        "SELECT project, 'skill-system-modification' FROM m WHERE system_line IS NOT NULL"]
    return (f"{PROJECTS}, hits AS MATERIALIZED ({line}), {skill} SELECT project, rule_id, count(*) AS findings FROM ("
            + " UNION ALL ".join(f"({p})" for p in parts) + ") AS x(project, rule_id) GROUP BY project, rule_id")


@query("t12_whole_scan", _whole_scan_sql())
def whole_scan(spark, sf):
    """Line, audit, file, project and skill findings of a scan of all packs."""
    from scanweave.plans.scan import scan

    return scan(project_corpus(spark, sf)).groupBy("project", "rule_id").agg(F.count("*").alias("findings"))



@query("t09_scan_artifacts", f"{o.base('all')}, a AS (" + " UNION ALL ".join(
    [f"SELECT project, 'HIPAA-ASSET-001' AS finding_id, '{k}' AS kind, file, i, text FROM lines WHERE {o.rx('file', fl.CODE_CS)} AND "
     f"{o.rx('text', p)}" for k, p, _ in fl.ASSETS]
    + [f"SELECT project, 'HIPAA-FLOW-001', '{k}', file, i, text FROM lines WHERE {o.rx('file', fl.CODE_CS)} AND {o.rx('text', p)}"
       for k, p in fl.FLOW_STAGES])
    + "), n AS (SELECT *, row_number() OVER (PARTITION BY project, finding_id, kind ORDER BY file, i) AS k FROM a) SELECT project, "
    "finding_id, CASE finding_id WHEN 'HIPAA-ASSET-001' THEN 'ASSET-INVENTORY' ELSE 'PHI-FLOW-MAP' END AS file, count(*) AS entries, "
    "string_agg(kind || ':' || k || ':' || file || ':' || (i + 1), ',' ORDER BY kind, k) FILTER (WHERE k <= 5) AS content FROM n GROUP BY ALL")
def scan_artifacts(spark, sf):
    content = F.array_join(F.transform("content", lambda x: F.concat_ws(":", x["kind"], x["n"], x["file"], x["line"])), ",")
    return fl.artifacts(corpus(spark, sf)).select("project", "finding_id", "file", "entries", content.alias("content"))


@query("d24_asset_inventory", f"{o.base('all')}, a AS (" + " UNION ALL ".join(
    f"SELECT l.file, l.i, l.text, '{k}' AS type, {o.rx('f.content', w)} AS processes_phi FROM lines l JOIN files f ON f.file = "
    f"l.file WHERE {o.rx('l.file', fl.CODE_CS)} AND {o.rx('l.text', p)}" for k, p, w in fl.ASSETS)
    + f") SELECT file, i + 1 AS line, type, processes_phi, coalesce(nullif(regexp_extract(text, {_q(fl.QUOTED)}, 1), ''), type "
    "|| '-' || substr(sha256(text), 1, 7)) AS name FROM a")
def assets(spark, sf):
    return fl.asset_inventory(corpus(spark, sf)).drop("project")


_FLOW = f"{o.base('all')}, f2 AS (" + " UNION ALL ".join(
    f"SELECT project, file, i + 1 AS line, text, '{k}' AS stage FROM lines WHERE {o.rx('file', fl.CODE_CS)} AND "
    f"{o.rx('text', p)}" for k, p in fl.FLOW_STAGES) + ")"


@query("d25_flow_map", f"{_FLOW}, r AS (SELECT *, row_number() OVER (PARTITION BY project, stage ORDER BY file, line) AS n, "
       "count(*) OVER (PARTITION BY project, stage) AS points FROM f2) SELECT project, stage, points, n, file, line, trim(text) "
       "AS context FROM r WHERE n <= 5")
def flow(spark, sf):
    return fl.flow_map(fl.flow_points(corpus(spark, sf)))


_PK = ", ".join(f"({n}, {_q(k)}, {_q(c)}, {_q(p)})" for n, (k, c, p) in enumerate(inv.PACKAGES))
_KEPT = ("name NOT IN ('typescript', 'eslint', 'prettier', 'vitest', 'jest') AND name NOT LIKE '@types/%' AND name NOT LIKE "
         "'eslint-%' AND name NOT LIKE '@testing-library/%'")


@query("d29_dependency_inventory", f"WITH {DEPS_SQL}, t(n, key, category, provider) AS (VALUES {_PK}), d AS (SELECT *, "
       f"row_number() OVER (PARTITION BY project ORDER BY k) AS num FROM deps WHERE {_KEPT}), j AS (SELECT d.*, t.category, "
       "t.provider, row_number() OVER (PARTITION BY d.project, d.name ORDER BY t.key <> d.name, t.n) AS best FROM d LEFT JOIN t "
       "ON starts_with(d.name, t.key)) SELECT project, 'TECH-' || lpad(CAST(num AS VARCHAR), 3, '0') AS id, name, version, "
       "coalesce(category, 'other') AS category, coalesce(provider, name) AS provider FROM j WHERE best = 1")
def dependencies(spark, sf):
    return inv.dependency_inventory(manifests(spark, sf))


_FL = (
    f"{PROJECTS}, found AS ({FOUND} SELECT project, file, category, title FROM findings), g AS (SELECT project, "
    "bool_or(category IN ('encryption', 'data-retention')) AS store_issue, bool_or(category IN ('access-control', "
    "'audit-logging')) AS auth_issue, bool_or(category = 'encryption' OR contains(lower(title), 'api') OR "
    "contains(lower(title), 'external')) AS external_issue, bool_or(category IN ('access-control', 'phi-exposure')) AS "
    "entry_issue, bool_or(contains(file, '/api/')) AS api_file, string_agg(DISTINCT lower(file), ' ') AS names FROM found GROUP "
    "BY project), routes AS (SELECT project, count(*) AS n FROM files WHERE (" + " OR ".join(
        f"starts_with(rel, '{x}/')" for x in inv.API_FOLDERS) + ") AND regexp_matches(file, '\\.(ts|js)$') GROUP BY project)"
)


def _comp(kind, rows, on, issue):
    vals = ", ".join(f"({_q(p)}, {_q(n)}, {_q(i)})" for p, n, i in rows)
    return (f"SELECT DISTINCT d.project, '{kind}' AS type, t.id, t.label AS name, coalesce({issue}, false) AS has_issues FROM "
            f"(VALUES {vals}) t(p, label, id) JOIN deps d ON {on} LEFT JOIN g ON g.project = d.project")


@query("d30_data_flow_components", f"{_FL} " + " UNION ALL ".join([
    _comp("data-store", inv.DATA_STORES, "d.name = t.p", "store_issue OR contains(names, t.id)"),
    _comp("auth-provider", inv.AUTH_PROVIDERS, "d.name = t.p", "auth_issue")])
    + " UNION ALL (WITH e AS (" + _comp("external-service", inv.EXTERNAL_SERVICES, "contains(d.name, t.p)", "external_issue")
    .replace("SELECT DISTINCT", "SELECT DISTINCT t.p AS p,") + ") SELECT project, type, id, name, has_issues FROM e) "
    "UNION ALL SELECT r.project, 'entry-point', 'api-routes', 'API Routes (' || r.n || ' detected)', coalesce(api_file OR "
    "entry_issue, false) FROM routes r LEFT JOIN g ON g.project = r.project UNION ALL SELECT DISTINCT d.project, 'entry-point', "
    "'api-endpoints', 'API Endpoints', coalesce(entry_issue, false) FROM deps d LEFT JOIN g ON g.project = d.project WHERE d.name "
    "IN ('express', 'fastify', 'next') AND d.project NOT IN (SELECT project FROM routes)")
def components(spark, sf):
    return inv.data_flow_components(manifests(spark, sf), found(spark, sf), project_corpus(spark, sf))


def _tech(table, base, kind):
    vals, k = [], 0
    for n, (name, pkgs, p) in enumerate(table):
        vals += [f"({n}, {_q(name)}, {_q(x)}, {_q(pkgs[0])})" for x in pkgs]
    ev = " OR ".join(f"(t.name = {_q(n)} AND {kind(p)})" for n, _, p in table if p) or "false"
    return (f"(SELECT project, arg_min(t.name, t.n) AS name, min(t.n) AS n FROM deps d JOIN (VALUES {', '.join(vals)}) "
            "t(n, name, pkg, first) ON d.name = t.pkg OR starts_with(d.name, t.pkg || '/') GROUP BY project)", ev, base)


def _stack_sql():
    parts = {}
    for label, table, base, kind in (
            ("f", inv.FRAMEWORKS, 0.7, lambda p: o.rx("f.file", p)),
            ("d", inv.DATABASES, 0.8, lambda p: f"({o.rx('f.file', inv.ENV_FILES)} AND {o.rx('f.content', p)})"),
            ("a", inv.AUTHS, 0.8, lambda p: o.rx("f.file", p))):
        q, ev, base = _tech(table, base, kind)
        first = " ".join(f"WHEN '{n}' THEN {_q(p[0])}" for n, p, _ in table)
        parts[label] = (
            f"{label} AS (SELECT t.project, t.name, CASE WHEN EXISTS (SELECT 1 FROM files f WHERE f.project = t.project AND "
            f"({ev})) THEN 0.95 ELSE {base} END AS conf, (SELECT '^' || version FROM deps x WHERE x.project = t.project AND "
            f"x.name = CASE t.name {first} END) AS version FROM {q} t)")
    return ", ".join(parts.values())


@query("d31_stack_detection", f"{PROJECTS}, {_stack_sql()}, z AS (SELECT project, bool_or(contains(name, 'supabase')) AS sb, "
       "bool_or(contains(name, 'firebase')) AS fb FROM deps GROUP BY project) SELECT z.project, coalesce(f.name, 'unknown') AS "
       "framework, coalesce(f.conf, 0)::DOUBLE AS framework_confidence, f.version AS framework_version, coalesce(d.name, "
       "'unknown') AS database, coalesce(d.conf, 0)::DOUBLE AS database_confidence, d.version AS database_version, "
       "coalesce(a.name, CASE WHEN sb THEN 'supabase-auth' WHEN fb THEN 'firebase-auth' ELSE 'unknown' END) AS auth, "
       "coalesce(a.conf, CASE WHEN sb OR fb THEN 0.6 ELSE 0 END)::DOUBLE AS auth_confidence, a.version AS auth_version FROM z "
       "LEFT JOIN f ON f.project = z.project LEFT JOIN d ON d.project = z.project LEFT JOIN a ON a.project = z.project")
def stack(spark, sf):
    return inv.detect_stack(manifests(spark, sf), project_corpus(spark, sf))


_GUIDE = " ".join("WHEN " + " OR ".join(f"contains(lower(title), {_q(t.lower())}) OR contains(lower(finding_id), {_q(t.lower())})"
                                       for t in ts) + f" THEN '{g}'" for g, ts in inv.GUIDES)


@query("d32_remediation_guide", f"{FOUND} SELECT CASE {_GUIDE} END AS guide, count(*) AS n FROM findings GROUP BY 1")
def guides(spark, sf):
    return inv.remediation_guide(found(spark, sf)).groupBy("guide").agg(F.count("*").alias("n"))


# Sources

@query("s01_read_corpus", f"SELECT project, count(*) AS files, sum(strlen(content))::BIGINT AS bytes FROM ({corpus_sql()}) "
       "GROUP BY project")
def read_corpus(spark, sf):
    c = corpus(spark, sf)
    t = src.from_table(c, F.col("project"), F.col("file"), F.col("content"))
    return t.groupBy("project").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("s02_exclude_globs", f"SELECT file FROM ({code_corpus_sql()}) WHERE NOT regexp_matches(file, "
       "'/(node_modules|dist|build|\\.git|coverage|\\.scanweave|samples)/|/(package-lock\\.json|pnpm-lock\\.yaml|yarn\\.lock)$') "
       "AND NOT regexp_matches(file, '/db/[^/]*\\.sql$')")
def excluded(spark, sf):
    return src.exclude_globs(code_corpus(spark, sf), ["**/db/*.sql"]).select("file")


@query("s04_ignore_paths", f"SELECT file FROM ({code_corpus_sql()}) WHERE NOT regexp_matches(file, 'src/.*test') AND NOT "
       "contains(file, '/web/') AND NOT regexp_matches(file, 'order_1.*\\.py')")
def ignored(spark, sf):
    return src.ignore_paths(code_corpus(spark, sf), ["src/*test", "/web/", "order_1*\\.py"]).select("file")


@query("s05_size_filter", f"SELECT project, count(*) FILTER (WHERE strlen(content) <= 2000) AS scanned, count(*) FILTER (WHERE "
       f"strlen(content) > 2000) AS skipped FROM ({corpus_sql()}) GROUP BY project")
def sizes(spark, sf):
    c = corpus(spark, sf).withColumn("size", F.octet_length("content"))
    return src.size_report(c, 2000)


@query("s06_extension_masks", f"SELECT file, concat_ws(',', " + ", ".join(
    f"CASE WHEN {o.rx('file', p.path)} THEN '{n}' END" for n, p in packs().items()) + f") AS packs FROM ({corpus_sql()})")
def masks(spark, sf):
    return src.pack_mask(corpus(spark, sf)).select("file", F.array_join("packs", ",").alias("packs"))


@query("s07_explode_lines", f"{o.base('text')} SELECT file, i + 1 AS line, sha256(text) AS hash FROM lines")
def lines(spark, sf):
    from scanweave.operators.detect import explode_lines

    return explode_lines(text_corpus(spark, sf)).select("file", "line", F.sha2("text", 256).alias("hash"))


@query("s16_source_subset", f"SELECT project, file, n FROM (SELECT project, file, row_number() OVER (PARTITION BY project ORDER "
       f"BY file) AS n FROM ({corpus_sql()}) WHERE {o.rx('file', src.SOURCE_FILES)}) WHERE n <= 20")
def subset(spark, sf):
    return src.source_subset(corpus(spark, sf)).select("project", "file", "n")


_CATS = "['phi-exposure', 'encryption', 'audit-logging', 'access-control', 'data-retention', 'other']"
_SEVS = "['critical', 'high', 'medium', 'low', 'info', 'urgent']"
_PATS = ["token\\d+", "(", "[a", "*x", "user.?name", "\\bkey\\b"]
_RULE_ROWS = (
    "SELECT p_partkey AS load_order, CASE WHEN p_partkey % 13 = 0 THEN p_brand ELSE lower(replace(p_brand, '#', '-')) || '-' || "
    "p_size END AS id, CASE WHEN p_partkey % 11 <> 0 THEN p_name END AS name, p_type AS description, {cat} AS category, {sev} AS "
    "severity, {pat} AS pattern, CASE p_partkey % 3 WHEN 0 THEN 'gxi' WHEN 1 THEN '' END AS flags, CASE WHEN p_partkey % 17 <> 0 "
    "THEN 'check' ELSE '' END AS recommendation, CASE WHEN p_partkey % 10 = 0 THEN '(' END AS must_not_contain FROM part"
)
_RULE_SQL = _RULE_ROWS.format(cat=f"({_CATS})[p_partkey % 6 + 1]", sev=f"({_SEVS})[p_partkey * 5 % 6 + 1]",
                              pat=f"([{_array(_PATS, _q)}])[p_partkey % 6 + 1]")


def rule_rows(spark, sf):
    def pick(values, k):
        return f"element_at(array({_array(values, lit)}), CAST({k} AS INT) + 1)"

    cats = ["phi-exposure", "encryption", "audit-logging", "access-control", "data-retention", "other"]
    sevs = ["critical", "high", "medium", "low", "info", "urgent"]
    read(spark, sf, "part").createOrReplaceTempView("scanweave_part")
    sql = _RULE_ROWS.format(cat=pick(cats, "p_partkey % 6"), sev=pick(sevs, "p_partkey * 5 % 6"), pat=pick(_PATS, "p_partkey % 6"))
    return spark.sql(sql.replace("FROM part", "FROM scanweave_part"))


@query("s08_load_rules", f"WITH r AS ({_RULE_SQL}), x AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY load_order "
       "DESC) AS n FROM r) SELECT id, load_order, pattern, regexp_replace(coalesce(nullif(flags, ''), 'gi'), '[^gimsuy]', '', 'g') "
       "AS flags FROM x WHERE n = 1")
def loaded(spark, sf):
    return rl.load_rules(rule_rows(spark, sf)).select("id", "load_order", "pattern", "flags")


_REQ = " UNION ALL ".join(f"SELECT load_order, '{c} is required' AS error FROM r WHERE coalesce({c}, '') = ''"
                          for c in ("name", "description", "pattern", "recommendation"))


@query("s09_validate_rules", f"WITH r AS ({_RULE_SQL}) {_REQ} UNION ALL SELECT load_order, 'id must be lowercase alphanumeric "
       "with hyphens' FROM r WHERE NOT regexp_matches(id, '^[a-z0-9-]+$') UNION ALL SELECT load_order, 'unknown category' FROM r "
       "WHERE category = 'other' UNION ALL SELECT load_order, 'unknown severity' FROM r WHERE severity = 'urgent' UNION ALL SELECT "
       "load_order, 'pattern does not compile' FROM r WHERE pattern IN ('(', '[a', '*x') UNION ALL SELECT load_order, "
       "'must_not_contain does not compile' FROM r WHERE must_not_contain = '('")
def validated(spark, sf):
    return rl.rule_errors(rule_rows(spark, sf)).select("load_order", "error")


@query("s10_baseline_round_trip", f"{LIFE} SELECT DISTINCT hash, finding_id, line, severity FROM p")
def baseline_round_trip(spark, sf):
    from scanweave.operators.lifecycle import baseline_of

    path = tb.work_folder(spark, "baseline")
    tb.write_baseline(baseline_of(found(spark, sf)), path)
    return tb.read_baseline(spark, path).select("hash", "finding_id", "line", "severity")


@query("s11_history_round_trip", f"{_HIST} SELECT project, scan_id, score, critical, array_to_string(failed_rules, ',') AS "
       "failed_rules FROM hist WHERE scan_ts >= TIMESTAMP '1996-01-01'")
def history_round_trip(spark, sf):
    path = tb.work_folder(spark, "history")
    entries = history(spark, sf)
    tb.append_history(entries.filter("scan_id % 2 = 0"), path, "a")
    for _ in range(2):  # the second write is a retry
        tb.append_history(entries.filter("scan_id % 3 = 0 OR scan_id % 2 = 1"), path, "b")
    broken = spark.createDataFrame([("{\"project\": \"cust-1\", \"scan",), ("no json",)], "value string")
    broken.withColumn("month", F.lit("1997-01")).write.mode("append").partitionBy("month").text(f"{path}/batch=b")
    back = tb.read_history(spark, path, since="1996-01-01")
    return back.select("project", "scan_id", "score", "critical", F.array_join("failed_rules", ",").alias("failed_rules"))


@query("s12_persist_scan", f"{_HIST} SELECT project, count(*) AS scans, arg_max(score, (scan_ts, scan_id)) AS score, "
       "(SELECT count(*) FROM p WHERE p.project = hist.project) AS findings FROM hist GROUP BY project")
def persisted(spark, sf):
    """Two batches share a third of the scans, and one of them is written again: every scan is there once."""
    path = tb.work_folder(spark, "store")
    f = judged(spark, sf)
    scans = history(spark, sf, f)
    f = f.select("project", "scan_id", "scan_ts", "finding_id", "file", "line")
    for batch, some in (("a", "scan_id % 3 < 2"), ("b", "scan_id % 3 > 0"), ("a", "scan_id % 3 < 2")):
        tb.persist_scan(f.filter(some), scans.filter(some), path, batch)
    kept, all_scans = tb.stored_scans(spark, path)
    n = kept.groupBy("project").agg(F.count("*").alias("findings"))
    return tb.project_state(all_scans).join(n, "project", "left").select(
        "project", "scans", "score", F.coalesce("findings", F.lit(0)).alias("findings"))


@query("s13_report_documents", f"{LIFE}, s AS ({score_sql('project')}) SELECT s.project, min(s.score) AS score, count(DISTINCT "
       f"severity || {_KEY}) AS groups, count(p.severity) AS locations FROM (SELECT project, score FROM s) s LEFT JOIN p ON s.project = "
       "p.project GROUP BY s.project")
def documents(spark, sf):
    path = tb.work_folder(spark, "report")
    tb.write_documents(tb.report_documents(processed(spark, sf), units=units(spark, sf, "project")).select(
        F.concat(F.lit("["), F.to_json(F.struct("project")), F.lit(","), "document", F.lit("]")).alias("document")), path)
    d = spark.read.text(path).select(
        F.get_json_object("value", "$[0].project").alias("project"), F.get_json_object("value", "$[1].score").cast("long").alias("score"),
        F.from_json(F.get_json_object("value", "$[1].summary"), "array<struct<occurrence_count:bigint>>").alias("g"))
    return d.select("project", "score", F.size("g").cast("long").alias("groups"),
                    F.expr("aggregate(g, 0L, (acc, x) -> acc + x.occurrence_count)").alias("locations"))


_VUL = ("SELECT 'part-' || p_partkey AS project, p_partkey, p_name, p_size, p_type FROM part")


@query("s14_dependency_report", "WITH r AS (SELECT 'part-' || p_partkey AS project, p_partkey % 4 AS s, p_name, p_size FROM "
       "part) SELECT project, 'a' AS name, (['critical', 'high', 'moderate', 'low'])[s + 1] AS severity, 'flaw in ' || p_name AS "
       "via, '<' || p_size AS range, true AS fix_available, 'https://x.test/' || p_size AS url FROM r UNION ALL SELECT project, "
       "'b', 'moderate', 'a', '*', false, NULL FROM r UNION ALL SELECT project, 'c', 'low', 'direct', '>=1', true, NULL FROM r")
def dependency_reports(spark, sf):
    body = ("concat('{\"vulnerabilities\":{\"a\":{\"severity\":\"', element_at(array('critical', 'high', 'moderate', 'low'), "
            "CAST(p_partkey % 4 AS INT) + 1), '\",\"via\":[{\"title\":\"flaw in ', p_name, '\",\"url\":\"https://x.test/', p_size, "
            "'\"},\"more\"],\"range\":\"<', p_size, '\",\"fixAvailable\":{\"name\":\"a\"}},\"b\":{\"severity\":\"moderate\",\"via\":"
            "[\"a\"],\"range\":\"*\",\"fixAvailable\":false},\"c\":{\"severity\":\"low\",\"via\":\"direct\",\"range\":\">=1\","
            "\"fixAvailable\":true}}}')")
    r = read(spark, sf, "part").selectExpr("concat('part-', p_partkey) AS project", f"{body} AS body")
    return inv.vulnerabilities(r)


@query("s15_group_export", f"{FOUND}, g AS (SELECT severity, rank, {_KEY} AS title_key, count(*) AS occurrence_count FROM "
       "findings GROUP BY ALL) SELECT severity, title_key, occurrence_count FROM g ORDER BY rank, occurrence_count DESC, title_key "
       "LIMIT 50")
def export(spark, sf):
    path = tb.work_folder(spark, "export")
    tb.export_groups(a.group_findings(found(spark, sf)), path)
    back = spark.read.option("header", "true").schema(
        "group_id string, severity string, title_key string, category string, title string, reference string, "
        "occurrence_count bigint, file_count bigint, rank int").csv(path)
    return back.select("severity", "title_key", "occurrence_count")


# Catalog and registry

@query("a14_catalog_counts", "WITH r AS (" + _RULE_SQL + ") SELECT c AS category, (SELECT count(*) FROM r WHERE r.category = c) "
       "AS rules FROM (SELECT unnest(['phi-exposure', 'encryption', 'audit-logging', 'access-control', 'data-retention']) AS c)")
def catalog_counts(spark, sf):
    return a.catalog_counts(rule_rows(spark, sf))


@query("a14_catalog_problems", "WITH r AS (" + _RULE_SQL + ") SELECT 'duplicate id' AS problem, id AS subject FROM r GROUP BY id "
       "HAVING count(*) > 1 UNION ALL SELECT 'unknown category', id || ' -> ' || category FROM r WHERE category = 'other'")
def catalog_problems(spark, sf):
    return a.catalog_problems(rule_rows(spark, sf))


@query("a14_severity_normalize", "WITH r AS (" + _RULE_SQL + ") SELECT CASE WHEN severity = 'urgent' THEN 'info' ELSE severity "
       "END AS severity, count(*) AS n FROM r GROUP BY 1")
def severities(spark, sf):
    r = rule_rows(spark, sf).select(F.upper("severity").alias("s"))
    return r.groupBy(a.normalize_severity("s").alias("severity")).agg(F.count("*").alias("n"))


_REG = (
    "SELECT 'rule-' || p_partkey AS id, p_name AS name, p_type || ' ' || p_brand AS description, {array}(lower(p_type), "
    "'size-' || p_size % 5) AS tags, {array}({tech}) AS tech_stack, {fw} AS framework, {cat} AS category, p_brand AS author, '1.' "
    "|| p_size || '.0' AS version, p_partkey * 37 % 5000 AS downloads, (p_size % 11) / 2.0{d} AS rating, p_partkey % 97 AS "
    "reviews, p_partkey % 3 = 0 AS verified, {ts} AS updated_at FROM {part}"
)
_REG_SQL = _REG.format(
    array="list_value", tech="(['node', 'python', 'java'])[p_partkey % 3 + 1]",
    fw="(['HIPAA', 'SOC2', 'GDPR', 'PCI'])[p_partkey % 4 + 1]", cat=f"({_CATS})[p_partkey % 5 + 1]", d="::DOUBLE",
    ts="TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (p_partkey % 1000)", part="part")


def registry(spark, sf):
    read(spark, sf, "part").createOrReplaceTempView("scanweave_part")
    cats = ["phi-exposure", "encryption", "audit-logging", "access-control", "data-retention"]
    return spark.sql(_REG.format(
        array="array", tech="element_at(array('node', 'python', 'java'), CAST(p_partkey % 3 AS INT) + 1)",
        fw="element_at(array('HIPAA', 'SOC2', 'GDPR', 'PCI'), CAST(p_partkey % 4 AS INT) + 1)",
        cat=f"element_at(array({_array(cats, lit)}), CAST(p_partkey % 5 AS INT) + 1)", d="D",
        ts="TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(p_partkey % 1000 AS INT))",
        part="scanweave_part"))


@query("a15_registry_counts", f"WITH r AS ({_REG_SQL}) SELECT 'category' AS kind, category AS name, count(*) AS rules FROM r "
       "GROUP BY category UNION ALL SELECT 'framework', framework, count(*) FROM r GROUP BY framework")
def registry_counts(spark, sf):
    return st.registry_counts(registry(spark, sf))


@query("a15_top_contributors", f"WITH r AS ({_REG_SQL}) SELECT author, count(*) AS rules, sum(downloads)::BIGINT AS downloads "
       "FROM r GROUP BY author ORDER BY downloads DESC, author LIMIT 10")
def contributors(spark, sf):
    return st.top_contributors(registry(spark, sf))


@query("t05_registry_search", f"WITH r AS ({_REG_SQL}), m AS (SELECT *, downloads * 0.7::DOUBLE + rating * reviews * 0.3::DOUBLE "
       "AS relevance FROM r WHERE (contains(lower(name), 'ring') OR contains(lower(description), 'ring')) AND framework = 'HIPAA' "
       "AND list_contains(tech_stack, 'node') AND rating >= 1), n AS (SELECT *, row_number() OVER (ORDER BY relevance DESC, id) AS "
       "n, count(*) OVER () AS total FROM m) SELECT id, n, total FROM n WHERE n > 5 AND n <= 10")
def search(spark, sf):
    r = st.search_registry(registry(spark, sf), "RING", {"framework": "HIPAA"}, tech="node", min_rating=1, page=2, page_size=5)
    return r.select("id", "n", "total")


@query("t06_registry_featured", f"WITH r AS ({_REG_SQL}) SELECT id, epoch_ms(updated_at) + rating * 1000 AS order_key FROM r "
       "WHERE verified AND rating >= 4 ORDER BY order_key DESC, id LIMIT 10")
def featured(spark, sf):
    return st.featured(registry(spark, sf)).select("id", "order_key")


@query("t07_updates_available", f"WITH r AS ({_REG_SQL}), i AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN 'gone-' ELSE 'rule-' END "
       "|| p_partkey AS id, '1.' || (p_size + p_partkey % 2) || '.0' AS version FROM part) SELECT i.id, CASE WHEN r.id IS NULL THEN "
       "'missing' WHEN r.version <> i.version THEN 'changed' ELSE 'current' END AS state FROM i LEFT JOIN r ON r.id = i.id")
def updates(spark, sf):
    i = read(spark, sf, "part").selectExpr(
        "concat(CASE WHEN p_partkey % 9 = 0 THEN 'gone-' ELSE 'rule-' END, p_partkey) AS id",
        "concat('1.', p_size + p_partkey % 2, '.0') AS version")
    return st.updates_available(i, registry(spark, sf)).select("id", "state")


@query("t07_package_expansion", f"WITH r AS ({_REG_SQL}), k AS (SELECT 'pack-' || l_orderkey AS package_id, 'rule-' || l_partkey "
       "AS id FROM lineitem) SELECT k.package_id, k.id, r.version FROM k LEFT JOIN r ON r.id = k.id")
def expanded(spark, sf):
    p = read(spark, sf, "lineitem").selectExpr(
        "concat('pack-', l_orderkey) AS package_id", "array(concat('rule-', l_partkey)) AS rules")
    return st.expand_packages(p, registry(spark, sf))


# Stored tables

def projects(spark, sf):
    return read(spark, sf, "customer").selectExpr(
        "concat('cust-', c_custkey) AS project", "c_name AS name", "c_mktsegment AS owner",
        "timestamp '1998-01-01 00:00:00' + make_interval(0, 0, 0, CAST(c_custkey % 500 AS INT)) AS updated_at")


_PROJ = ("SELECT 'cust-' || c_custkey AS project, c_name AS name, c_mktsegment AS owner, TIMESTAMP '1998-01-01' + INTERVAL 1 DAY "
         "* (c_custkey % 500) AS updated_at FROM customer")


@query("t01_recent_scans", f"WITH s AS (SELECT 'cust-' || o_custkey AS project, o_orderkey AS scan_id, o_orderdate AS scan_ts "
       f"FROM orders ORDER BY scan_ts DESC, scan_id DESC LIMIT 10) SELECT s.scan_id, p.name FROM s LEFT JOIN ({_PROJ}) p ON "
       "p.project = s.project")
def recent(spark, sf):
    s = read(spark, sf, "orders").selectExpr(
        "concat('cust-', o_custkey) AS project", "o_orderkey AS scan_id", "o_orderdate AS scan_ts")
    return st.recent_scans(s, projects(spark, sf)).select("scan_id", "name")


@query("t02_urgent_findings", f"{FOUND}, t AS (SELECT * FROM findings WHERE severity IN ('critical', 'high') ORDER BY scan_ts "
       f"DESC, file, line, rule_no LIMIT 20) SELECT t.finding_id, t.file, p.name FROM t LEFT JOIN ({_PROJ}) p ON p.project = "
       "t.project")
def urgent(spark, sf):
    return st.urgent_findings(found(spark, sf), projects(spark, sf)).select("finding_id", "file", "name")


@query("t03_project_findings", f"{FOUND} SELECT finding_id, file, line FROM findings WHERE project = 'cust-7'")
def project_findings(spark, sf):
    return st.of_project(found(spark, sf), "cust-7").select("finding_id", "file", "line")


@query("t03_projects_by_update", f"SELECT project, name, strftime(updated_at, '%Y-%m-%d') AS day FROM ({_PROJ})")
def by_update(spark, sf):
    p = st.projects_by_update(projects(spark, sf))
    return p.select("project", "name", F.date_format("updated_at", "yyyy-MM-dd").alias("day"))


@query("t04_findings_by_severity", f"{FOUND}, t AS (SELECT *, row_number() OVER (PARTITION BY project, severity ORDER BY file, "
       "line, rule_no) AS n FROM findings) SELECT project, severity, n, finding_id FROM t WHERE (severity = 'critical' AND n <= 20) "
       "OR (severity = 'high' AND n <= 10)")
def severity_list(spark, sf):
    f = st.by_severity(found(spark, sf), {"critical": 20, "high": 10}, "project")
    return f.select("project", "severity", "n", "finding_id")


@query("t08_issue_difference", f"{FOUND}, c AS (SELECT DISTINCT project, rule_id FROM findings WHERE scan_ts >= TIMESTAMP "
       "'1996-01-01'), o AS (SELECT DISTINCT project, rule_id FROM findings WHERE scan_ts < TIMESTAMP '1996-01-01') SELECT 'new' AS "
       "change, * FROM (SELECT * FROM c EXCEPT SELECT * FROM o) UNION ALL SELECT 'resolved', * FROM (SELECT * FROM o EXCEPT SELECT "
       "* FROM c)")
def difference(spark, sf):
    f, cut = tb.stored(found(spark, sf).select("project", "rule_id", "scan_ts"), "findings"), F.lit("1996-01-01").cast("timestamp")
    return st.issue_difference(f.filter(F.col("scan_ts") >= cut), f.filter(F.col("scan_ts") < cut), ["project", "rule_id"])


@query("t10_delete_samples", "SELECT o_orderkey AS scan_id FROM orders WHERE NOT (o_orderpriority = '5-LOW' AND o_orderstatus = "
       "'F')")
def samples(spark, sf):
    r = read(spark, sf, "orders").selectExpr(
        "o_orderkey AS scan_id", "o_orderpriority = '5-LOW' AS is_sample", "o_orderstatus AS owner")
    return st.without_samples(r, "F").select("scan_id")


