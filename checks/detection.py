"""Detection queries: one per pack and per line operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import oracle as o
from checks.corpus import _q, code_corpus, corpus, text_corpus, write_files, written_path
from checks.registry import query
from scanweave.operators import detect as d
from scanweave.rules import catalog as cat
from scanweave.rules.model import LINE, Condition, Pack, Rule, window
from scanweave.sources.corpus import read_files
from scanweave.sources.long_files import pieces, read_lines
from scanweave.sources.tables import work_folder

COLS = ["rule_id", "finding_id", "project", "file", "line", "severity", "category"]
SELECT = f"SELECT {', '.join(COLS)} FROM findings"


def _pack_query(name, label):
    @query(f"{label}_{name}_rules", f"{o.pack_findings([name], 'all')} {SELECT}")
    def run(spark, sf, name=name):
        return d.detect(corpus(spark, sf), [name]).select(*COLS)


# Fixed numbering: the operator each pack mainly exercises.
for _name, _label in [
    ("phi", "d01_line_match"), ("encryption", "d03_safe_domain"), ("access", "d01_line_match"),
    ("security", "d05_test_file"), ("retention", "d02_numeric_check"), ("skills", "d22_skill_files"),
    ("hipaa2026", "d11_span_match"), ("authentication", "d11_span_match"), ("rbac", "d10_window_negative"),
    ("credentials", "d13_required_context"), ("errors", "d12_split_negatives"),
    ("sanitization", "d10_window_negative"), ("revocation", "d10_window_negative"),
    ("configuration", "d10_window_negative"), ("api_security", "d15_flat_context"),
    ("operational", "d10_window_negative"),
]:
    _pack_query(_name, _label)


def _only(rule_id):
    return [(p, r) for p, r in cat.line_rules() if r.id == rule_id]


@query("d04_path_and_comment_exemption", f"{o.findings(_only('enc-http-url'), 'all')} "
       "SELECT project, count(*) AS links, count(DISTINCT file) AS files FROM findings GROUP BY project")
def http_links(spark, sf):
    f = d.detect_rules(corpus(spark, sf), _only("enc-http-url"))
    return f.groupBy("project").agg(F.count("*").alias("links"), F.countDistinct("file").alias("files"))


_COMMENT = o.rx("text", cat.COMMENT_OR_HASH)
_IMPORT = o.any_match("regexp_replace(text, '^\\s+|\\s+$', '', 'g')", cat.IMPORT_LINE)


@query("d06_comment_and_d07_import_lines", f"{o.base('all')} SELECT project, count(*) AS lines, "
       f"count(*) FILTER (WHERE {_COMMENT}) AS comment_lines, count(*) FILTER (WHERE {_IMPORT}) AS import_lines "
       "FROM lines GROUP BY project")
def line_kinds(spark, sf):
    lines = d.explode_lines(corpus(spark, sf))
    return lines.groupBy("project").agg(
        F.count("*").alias("lines"),
        F.expr(f"count_if({d.like('text', cat.COMMENT_OR_HASH)})").alias("comment_lines"),
        F.expr(f"count_if({d.is_import_line('text')})").alias("import_lines"))


CUSTOM_PACK = Pack("custom", 90, ".", "custom-{id}-{file}-{i}", 2, "Follow the team's own rule.")
CUSTOM_RULES = [
    Rule(no=901, pack="custom", id="console-use", category="audit-logging", severity="low", title="Console output",
         reference="", patterns=(r"(?i)console\.\w+",), forbid=(Condition(LINE, (r"(?i)redact|masked",)),),
         include=("**/src/**", "**/app/**/*.jsx"), exclude=("**/*.test.ts", "**/node_modules/**"),
         confidence="medium", adjust_confidence=False),
    Rule(no=902, pack="custom", id="mail-address", category="phi-exposure", severity="medium", title="Mail address",
         reference="", patterns=(r"(?i)[a-z0-9._-]{2,}@[a-z0-9.-]+\.[a-z]{2,}",),
         forbid=(Condition(LINE, (r"(?i)noreply|example\.org",)),)),
    Rule(no=903, pack="custom", id="query-use", category="access-control", severity="info", title="Query use",
         reference="", patterns=(r"(?i)\.(?:query|execute)\(",), include=("**/*.{ts,js,go}",)),
]


def _glob_sql(rules):
    """Path conditions of the custom rules, written as plain regular expressions."""
    paths = {901: (r"^(?:.*/)?src/.*$|^(?:.*/)?app/(?:.*/)?[^/]*\.jsx$", r"^(?:.*/)?[^/]*\.test\.ts$|^(?:.*/)?node_modules/.*$"),
             902: (".", None), 903: (r"^(?:.*/)?[^/]*\.(?:ts|js|go)$", None)}
    hits = " UNION ALL ".join(
        o.rule_sql(CUSTOM_PACK, r) + f" AND {o.rx('l.file', paths[r.no][0])}"
        + (f" AND NOT {o.rx('l.file', paths[r.no][1])}" if paths[r.no][1] else "") for r in rules)
    return (f"{o.base('all')}, hits AS ({hits}) SELECT h.rule_no, 'custom-' || CASE h.rule_no WHEN 901 THEN "
            "'console-use' WHEN 902 THEN 'mail-address' ELSE 'query-use' END || '-' || h.file || '-' || h.i "
            "AS finding_id, h.file, h.i + 1 AS line FROM hits h")


@query("d08_must_not_contain_d09_rule_globs", _glob_sql(CUSTOM_RULES))
def custom_rules(spark, sf):
    f = d.detect_rules(corpus(spark, sf), [(CUSTOM_PACK, r) for r in CUSTOM_RULES])
    return f.select("rule_no", "finding_id", "file", "line")


@query("d14_value_guard", f"{o.findings(_only('CRED-002'), 'all')} SELECT file, line, code FROM findings")
def literal_values(spark, sf):
    return d.detect_rules(corpus(spark, sf), _only("CRED-002")).select("file", "line", "code")


WINDOW_RULE = Rule(no=950, pack="custom", id="name-without-unit", category="audit-logging", severity="info",
                   title="Passage without a nearby mark", reference="", patterns=(r"(?i)\bdes\b",),
                   forbid=(Condition(window(5, 5), (r"(?i)\bque\b",)),))


@query("d10_window_negative_on_prose", f"{o.findings([(CUSTOM_PACK, WINDOW_RULE)], 'text')} "
       "SELECT file, line FROM findings")
def prose_window(spark, sf):
    return d.detect_rules(text_corpus(spark, sf), [(CUSTOM_PACK, WINDOW_RULE)]).select("file", "line")


@query("d26_context_snippet", f"{o.pack_findings(['phi', 'skills'], 'all')} SELECT finding_id, file, line, "
       "k.unnest AS line_number, ctx[k.unnest - ctx_from] AS content, k.unnest = line AS is_match "
       "FROM findings, unnest(range(ctx_from + 1, ctx_from + len(ctx) + 1)) AS k")
def snippets(spark, sf):
    f = d.context_snippet(d.detect(corpus(spark, sf), ["phi", "skills"]))
    return f.select("finding_id", "file", "line", F.explode("context").alias("c")).select(
        "finding_id", "file", "line", "c.*")


@query("d27_column", f"{o.pack_findings(['api_security', 'operational'], 'all')} SELECT rule_id, file, line, "
       "strpos(code, regexp_replace(code, '^\\s+|\\s+$', '', 'g')) AS col FROM findings")
def columns(spark, sf):
    return d.detect(corpus(spark, sf), ["api_security", "operational"]).select("rule_id", "file", "line", "col")


_BRIDGE = " UNION ALL ".join(
    f"SELECT {_q(c)} AS run_category, {_q(p)} AS pack" for c, ps in cat.CATEGORY_PACKS.items() for p in ps
    if p != "audit" and c in ("phi-exposure", "audit-logging"))


@query("d28_category_select", f"{o.pack_findings(['phi', 'errors', 'configuration'])} SELECT run_category, rule_id, "
       f"count(*) AS hits FROM findings JOIN ({_BRIDGE}) USING (pack) GROUP BY run_category, rule_id")
def category_select(spark, sf):
    from scanweave.plans.scan import detect_categories

    f = detect_categories(code_corpus(spark, sf), ["phi-exposure", "audit-logging"])
    return f.groupBy("run_category", "rule_id").agg(F.count("*").alias("hits"))


@query("t09_union_of_packs", f"{o.pack_findings(None, 'all')} SELECT pack, severity, count(*) AS hits, "
       "count(DISTINCT file) AS files FROM findings GROUP BY pack, severity")
def all_packs(spark, sf):
    f = d.detect(corpus(spark, sf))
    return f.groupBy("pack", "severity").agg(F.count("*").alias("hits"), F.countDistinct("file").alias("files"))


# Files written to disk and read back, whole and by byte ranges in pieces of 64 lines: the same findings.
_ON_DISK = ["phi", "security", "hipaa2026", "rbac", "errors", "revocation", "configuration", "api_security"]
_DISK_COLS = [*COLS, "code", "in_block", "ctx_from"]
_DISK_SQL = f"{o.pack_findings(_ON_DISK, 'written')} SELECT {', '.join(_DISK_COLS)} FROM findings"


def _written(spark, sf) -> str:
    folder = work_folder(spark, "files")
    write_files(spark, sf, folder)
    return folder


@query("s01_read_files", _DISK_SQL)
def whole_files(spark, sf):
    files = read_files(spark, _written(spark, sf), "disk").withColumn("file", written_path("file"))
    return d.detect(files, _ON_DISK).select(_DISK_COLS)


@query("s07_long_files", _DISK_SQL)
def files_in_pieces(spark, sf):
    rules = list(cat.line_rules(_ON_DISK))
    lines = read_lines(spark, _written(spark, sf), "disk", named=written_path)
    return d.detect_rules(pieces(lines, rules, 64), rules).select(_DISK_COLS)
