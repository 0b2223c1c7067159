"""Checks over a whole file or project: absences, classification, skill metadata, asset and flow maps."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanweave.functions.regex import any_of, to_java
from scanweave.functions.sql import has_any, like, lit
from scanweave.operators.detect import (
    FINDING_COLUMNS, LINE_TEXT, is_client_file, is_import_line, js_trim_left, line_hits, per_file, rule_table,
)
from scanweave.rules.catalog import AUDITED_CODE, CODE_CS, SKILL_FILES, WEB_CONFIG, WEB_MODULES_DATA, packs, rule
from scanweave.rules.model import CONTENT, LINE, Condition, Pack, Rule
from scanweave.sources.folders import stored

# Words, actions and file names of the file and project checks.
HEALTH_WORDS = r"(?i)patient|health|medical|diagnosis|treatment"
LOGGING_CALL = r"(?i)\.(?:log|info|warn|error|audit)\s*\(|logger\."
AUDITED_ACTIONS = [
    ("create", r"(?i)\.(?:create|insert|save|add)\s*\("),
    ("update", r"(?i)\.(?:update|modify|patch|put)\s*\("),
    ("delete", r"(?i)\.(?:delete|remove|destroy)\s*\("),
    ("read", r"(?i)\.(?:read|get|find|fetch|select)\s*\("),
    ("auth", r"(?i)\.(?:login|authenticate|authorize)\s*\("),
]
LOGGING_FRAMEWORKS = ["winston", "bunyan", "pino", "log4js", "morgan", "logging", "logger", "structlog", "loguru"]
SCAN_CONFIG_FILES = [
    ".github/dependabot.yml", ".github/dependabot.yaml", ".github/workflows/security.yml",
    ".github/workflows/security.yaml", ".snyk", ".semgrep.yml", ".semgrep.yaml", "snyk.json", ".trivyignore", "trivy.yaml",
]
WORKFLOW_NAME = r"(?i)security|codeql|snyk|trivy|semgrep|dependabot|vulnerability|sast|dast"
WORKFLOW_STEP = r"(?i)snyk|trivy|semgrep|codeql|npm audit|security.scan|vulnerability"
MANIFEST_WORD = r"snyk|audit|security"
ASSETS = [
    ("database", r"(?i)(?:mongoose|sequelize|prisma|typeorm)\.(?:connect|model)", r"(?i)patient|phi|medical|health"),
    ("storage", r"(?i)(?:s3|azure\.storage|gcs)\.", r"(?i)patient|phi|medical"),
    ("third-party", r"(?i)(?:stripe|twilio|sendgrid|mailgun)\.(?:api|client)", r"(?i)patient|phi|medical"),
    ("api", r"(?i)(?:axios|fetch|got|request)\.", r"(?i)patient|phi|medical"),
]
FLOW_STAGES = [
    ("input", r"(?i)(?:req\.body|req\.params|req\.query).*?(?:patient|phi|medical)"),
    ("processing", r"(?i)(?:process|transform|validate).*?(?:patient|phi)"),
    ("storage", r"(?i)(?:save|insert|update|create).*?(?:patient|phi)"),
    ("output", r"(?i)(?:res\.(?:send|json)|return).*?(?:patient|phi)"),
]
SKILL_FIELDS = {
    "author": r"(?i)(?:author|by|created.by):\s*(.+)",
    "source": r"(?i)(?:source|repository|url):\s*(.+)",
    "permissions": r"(?i)(?:permissions?|requires?):\s*(.+)",
    "version": r"(?i)(?:version):\s*(.+)",
}
SKILL_NAME = r"^#\s+(.+)"
# Pack, id, category, severity, title, section and confidence of checks outside the rule tables.
OTHER_CHECKS = [
    ("audit", "audit-no-framework", "audit-logging", "high", "No audit logging framework detected", "§164.312(b)", None),
    ("skills", "skill-excessive-permissions", "access-control", "high", "Skill requests excessive permissions",
     "§164.308(a)(4) - Access Controls", "high"),
    ("skills", "skill-unknown-author", "access-control", "medium", "Skill from unknown/unverified source", "", "medium"),
    ("skills", "skill-system-modification", "access-control", "critical", "Skill attempts to modify system files", "", "high"),
]
AUDIT_SECTION = "§164.312(b)"
SYSTEM_CHANGE = r"(?:rm|mv|chmod|chown)\s+-rf?\s+/"
QUOTED = r"""['"`]([^'"`]+)['"`]"""


def unlogged_actions(corpus: DataFrame) -> DataFrame:
    """In files with health words and no logging call: each line's first audited action."""
    gate = (f"NOT ({like('file', 'test|spec')}) AND {like('content', HEALTH_WORDS)} "
            f"AND NOT ({like('content', LOGGING_CALL)})")
    first = " ".join(f"WHEN {like('text', p)} THEN {lit(name)}" for name, p in AUDITED_ACTIONS)
    any_action = like(LINE_TEXT, any_of([p for _, p in AUDITED_ACTIONS]))
    hits = line_hits(corpus, AUDITED_CODE, [("action", any_action)], gate)
    return hits.withColumn("action", F.expr(f"CASE {first} END")).select(
        "project", "file", "line", "action",
        F.concat(F.lit("audit-unlogged-"), "action", F.lit("-"), F.col("line") - 1).alias("finding_id"))


def audit_rules():
    """The same as ``(pack, rule)`` pairs, so that a scan finds them in its one pass over the lines."""
    earlier: tuple = ()
    for k, (name, pattern) in enumerate(AUDITED_ACTIONS):
        yield _audit_pack(f"audit-unlogged-{name}-{{i}}", AUDITED_CODE), Rule(
            no=9_000 + k, pack="audit", id="audit-unlogged-action", category="audit-logging", severity="medium",
            title=f"PHI {name} operation may lack audit logging", reference=AUDIT_SECTION, patterns=(pattern,),
            skip_path="test|spec", require=(Condition(CONTENT, (HEALTH_WORDS,)),),
            forbid=(Condition(CONTENT, (LOGGING_CALL,)), Condition(LINE, earlier)))
        earlier = (*earlier, pattern)


def _audit_pack(finding_id: str, path: str = ".") -> Pack:
    return Pack("audit", 16, path, finding_id, 2, "Write an audit record for every use of personal health data.")


def _first_line(condition: str) -> str:
    """The first line ``l`` of file ``f`` that fits, with its text and the one above; null if none does."""
    return (f"get(transform(slice(filter(f.lines, l -> {condition}), 1, 1), "
            "l -> named_struct('i', l.i, 'code', l.x, 'prev', get(f.ls, l.i - 1))), 0)")


def missing_mfa(corpus: DataFrame, keep=()) -> DataFrame:
    """Auth configuration in a file without any second-factor word: its first line that is not an import."""
    r = rule("MFA-001")
    gate = f"{like('content', any_of(r.patterns))} AND NOT ({like('content', any_of(r.negatives))})"
    cond = f"{like(LINE_TEXT, any_of(r.patterns))} AND NOT ({is_import_line(LINE_TEXT)})"
    found = F.expr(per_file(f"array({_first_line(cond)})")).alias("x")
    files = corpus.filter(F.expr(f"{like('file', WEB_CONFIG)} AND {gate}"))
    return files.select("project", *keep, "file", F.explode(found).alias("x")).filter("x IS NOT NULL").select(
        "project", *keep, "file", (F.col("x.i") + 1).alias("line"), F.lit(r.id).alias("rule_id"), "x.code", "x.prev")


def classify_files(corpus: DataFrame) -> DataFrame:
    return corpus.withColumn("is_client", F.expr(is_client_file()))


def missing_backup(corpus: DataFrame, keep=()) -> DataFrame:
    """Projects that use a database and nowhere mention backups; anchored at the first use, else the first import."""
    r = rule("BACKUP-001")
    use, imports = like(LINE_TEXT, any_of(r.patterns)), is_import_line(LINE_TEXT)
    parts = (f"array(named_struct('use', {_first_line(f'{use} AND NOT ({imports})')}, "
             f"'imp', {_first_line(f'{use} AND {imports}')}))")
    files = corpus.filter(F.expr(like("file", WEB_MODULES_DATA))).select(
        "project", *keep, "file", F.expr(like("content", any_of(r.negatives))).alias("has_backup"),
        F.expr(f"{per_file(parts)}[0]").alias("a"))
    first = files.groupBy("project", *keep).agg(
        F.min(F.when(F.col("a.use").isNotNull(), F.struct("file", F.col("a.use").alias("at")))).alias("use"),
        F.min(F.when(F.col("a.imp").isNotNull(), F.struct("file", F.col("a.imp").alias("at")))).alias("imp"),
        F.bool_or("has_backup").alias("has_backup"))
    anchor = F.coalesce("use", "imp")
    return first.filter(~F.col("has_backup") & anchor.isNotNull()).select(
        "project", *keep, anchor["file"].alias("file"), (anchor["at"]["i"] + 1).alias("line"), F.lit(r.id).alias("rule_id"),
        anchor["at"]["code"].alias("code"), anchor["at"]["prev"].alias("prev"))


def missing_log_framework(corpus: DataFrame, keep=()) -> DataFrame:
    """Projects whose package manifests name no logging framework; reported on the first manifest."""
    manifests = corpus.filter(F.col("file").endswith("package.json"))
    g = manifests.groupBy("project", *keep).agg(
        F.bool_or(F.expr(has_any("content", LOGGING_FRAMEWORKS))).alias("has"), F.min("file").alias("file"))
    return g.filter("NOT has").select("project", *keep, "file", F.lit("audit-no-framework").alias("rule_id"))


def project_roots(corpus: DataFrame, keep=()) -> DataFrame:
    """The folder that all files of a project share: what its smallest and its largest path have in common."""
    g = corpus.groupBy("project", *keep).agg(F.split(F.min("file"), "/").alias("a"), F.split(F.max("file"), "/").alias("b"))
    differ = F.array_position(F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y)), False)
    shared = F.when(differ > 0, differ - 1).otherwise(F.least(F.size("a"), F.size("b")))
    folders = F.least(shared, F.size("a") - 1).cast("int")
    return g.select("project", *keep, F.array_join(F.slice("a", F.lit(1), folders), "/").alias("root"))


def missing_vulnerability_scan(corpus: DataFrame, root: str = "root", keep=()) -> DataFrame:
    """Projects without a scanner configuration, a scanning workflow or a scan word in the root manifest.

    A corpus without the column ``root`` has the folder that all files of a project share for it. Contents are tested before any
    row moves, and only of the few files whose place can matter.
    """
    ends = "|".join(re.escape(f) for f in SCAN_CONFIG_FILES)
    likely = corpus.filter(F.col("file").rlike(rf"(?:^|/)(?:{ends}|package\.json|\.github/workflows/[^/]+)$")).select(
        "project", *keep, "file", F.col("content").rlike(WORKFLOW_STEP).alias("step"), F.col("content").rlike(MANIFEST_WORD).alias("word"))
    if root in corpus.columns:
        roots = corpus.groupBy("project", *keep).agg(F.first(root).alias("root"))
    else:
        roots = project_roots(corpus, keep)
    both = likely.join(roots, ["project", *keep]).withColumn("rel", F.expr("substring(file, if(root = '', 1, length(root) + 2))"))
    workflow = F.col("rel").rlike(r"^\.github/workflows/[^/]+$")
    name = F.element_at(F.split("rel", "/"), -1)
    ok = F.col("rel").isin(SCAN_CONFIG_FILES) | (workflow & (name.rlike(WORKFLOW_NAME) | F.col("step"))) | (
        (F.col("rel") == "package.json") & F.col("word"))
    return roots.join(both.filter(ok).select("project", *keep).distinct(), ["project", *keep], "left_anti").select(
        "project", *keep, F.lit("HIPAA-PENTEST-001").alias("rule_id"), F.lit("project-level").alias("file"))


def skill_metadata(corpus: DataFrame, keep=()) -> DataFrame:
    """Author, source, permissions and version (last mention wins) and name (first heading) of each skill file."""
    def matches(p, group=1):
        return (f"transform(filter(f.lines, l -> {like(LINE_TEXT, p)}), l -> named_struct('i', l.i, 'v', "
                f"trim(regexp_extract({LINE_TEXT}, {lit(to_java(p))}, {group}))))")

    fields = ", ".join(f"'{k}', get(reverse({matches(p)}), 0)" for k, p in SKILL_FIELDS.items())
    system = f"get(filter(f.lines, l -> {like(LINE_TEXT, SYSTEM_CHANGE)}), 0).i"
    parts = f"array(named_struct({fields}, 'name', get({matches(SKILL_NAME)}, 0), 'system', {system}))"
    skills = corpus.filter(F.expr(like("file", SKILL_FILES)))
    m = skills.select("project", *keep, "file", F.expr(f"{per_file(parts)}[0]").alias("m"))
    return m.select(
        "project", *keep, "file", *[F.col(f"m.{k}.v").alias(k) for k in [*SKILL_FIELDS, "name"]],
        (F.col("m.permissions.i") + 1).alias("permissions_line"), (F.col("m.system") + 1).alias("system_line"))


def skill_findings(metadata: DataFrame, keep=()) -> DataFrame:
    """Wildcard permissions, no attribution, system modification."""
    wide = F.expr("exists(split(permissions, ','), p -> trim(p) IN ('*', 'all'))")
    found = F.array_compact(F.array(
        F.when(wide, F.struct(F.lit("skill-excessive-permissions").alias("rule_id"), F.lit("high").alias("severity"),
                              F.col("permissions_line").alias("line"))),
        F.when(F.coalesce("author", F.lit("")).eqNullSafe("") & F.coalesce("source", F.lit("")).eqNullSafe(""),
               F.struct(F.lit("skill-unknown-author").alias("rule_id"), F.lit("medium").alias("severity"),
                        F.lit(1).alias("line"))),
        F.when(F.col("system_line").isNotNull(),
               F.struct(F.lit("skill-system-modification").alias("rule_id"), F.lit("critical").alias("severity"),
                        F.col("system_line").alias("line")))))
    return metadata.select("project", *keep, "file", F.explode(found).alias("x")).select("project", *keep, "file", "x.*")


def file_findings(corpus: DataFrame, names, keep=()) -> DataFrame:
    """Findings of the file, project and skill checks of the packs ``names``, with the columns of ``detect``.

    Project checks look at all files of a project, and of a scan if ``keep`` names it. Findings on no single line have a null
    line and an empty ``code``. A project's root folder is the corpus' column ``root``, or else what its files have in common.
    """
    found = []
    if "authentication" in names:
        found.append(missing_mfa(corpus, keep))
    if "operational" in names:
        found.append(missing_backup(corpus, keep))
    if "audit" in names:
        found.append(missing_log_framework(corpus, keep))
    if "hipaa2026" in names:
        found.append(missing_vulnerability_scan(corpus, keep=keep))
    if "skills" in names:
        found.append(skill_findings(skill_metadata(corpus, keep), keep).drop("severity"))
    all_packs = packs() | {"audit": _audit_pack("{id}")}
    listed = [(all_packs[r.pack], r) for r in map(rule, ("MFA-001", "BACKUP-001", "HIPAA-PENTEST-001"))]
    for k, (pack, rid, category, severity, title, section, confidence) in enumerate(OTHER_CHECKS):
        listed.append((all_packs[pack], Rule(
            no=9_100 + k, pack=pack, id=rid, category=category, severity=severity, title=title, reference=section, patterns=(),
            confidence=confidence)))
    table = rule_table(corpus.sparkSession, listed)
    none = {"line": F.lit(None).cast("int"), "code": F.lit(""), "prev": F.lit(None).cast("string")}
    columns = ["project", *keep, "file", "rule_id", *none]
    out = corpus.select("project", *keep, "file", F.lit("").alias("rule_id")).withColumns(none).select(columns).limit(0)
    for f in found:
        f = f.withColumns({c: v for c, v in none.items() if c not in f.columns})
        out = out.unionByName(f.select(columns))
    return out.join(F.broadcast(table), "rule_id").withColumns({
        "finding_id": F.col("rule_id"), "in_block": F.lit(False),
        "col": F.expr(f"length(code) - length({js_trim_left('code')}) + 1"),
        "ctx_from": F.lit(None).cast("int"), "ctx": F.array().cast("array<string>")}).select(*FINDING_COLUMNS, *keep)


def asset_inventory(corpus: DataFrame) -> DataFrame:
    """Databases, storage, third parties and interfaces named in code; unnamed ones get a name from the line's hash."""
    hits = line_hits(corpus.withColumn("_phi", F.array(*[F.expr(like("content", w)) for _, _, w in ASSETS])), CODE_CS,
                     [(kind, like(LINE_TEXT, p)) for kind, p, _ in ASSETS], keep=("_phi",))
    named = F.regexp_extract("text", to_java(QUOTED), 1)
    fallback = F.concat("label", F.lit("-"), F.substring(F.sha2("text", 256), 1, 7))
    order = F.array(*[F.lit(k) for k, _, _ in ASSETS])
    return hits.select(
        "project", "file", "line", F.col("label").alias("type"), F.when(named != "", named).otherwise(fallback).alias("name"),
        F.element_at("_phi", F.array_position(order, F.col("label")).cast("int")).alias("processes_phi"))


def flow_points(corpus: DataFrame) -> DataFrame:
    hits = line_hits(corpus, CODE_CS, [(stage, like(LINE_TEXT, p)) for stage, p in FLOW_STAGES])
    return hits.select("project", "file", "line", F.col("label").alias("stage"), F.trim("text").alias("context"))


def flow_map(points: DataFrame, shown: int = 5) -> DataFrame:
    """Points per project and stage with the first few. The points are written once; the count comes from an aggregate of them and
    the first from a limit that Spark applies before rows move."""
    points = stored(points.select("project", "stage", "file", "line", "context"), "flow-points")
    counts = points.groupBy("project", "stage").agg(F.count("*").alias("points"))
    w = Window.partitionBy("project", "stage").orderBy("file", "line")
    first = points.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= shown)
    return first.join(counts, ["project", "stage"]).select("project", "stage", "points", "n", "file", "line", "context")


def artifacts(corpus: DataFrame, keep=(), shown: int = 5) -> DataFrame:
    """The generated documents of a scan: per project the asset inventory and the flow map, where they have entries.

    project, finding_id, file, title, reference, entries (how many), and the first ``shown`` of each kind as ``content``: kind, n,
    file, line and text. They are informational, so they never count as findings. Assets and flow points are found in one pass.
    """
    labels = [(f"HIPAA-ASSET-001:{kind}", like(LINE_TEXT, p)) for kind, p, _ in ASSETS]
    labels += [(f"HIPAA-FLOW-001:{stage}", like(LINE_TEXT, p)) for stage, p in FLOW_STAGES]
    hits = line_hits(corpus, CODE_CS, labels, keep=keep)
    part = F.split("label", ":")
    hits = stored(hits.select("project", *keep, part[0].alias("rule_id"), part[1].alias("kind"), "file", "line",
                              F.trim("text").alias("text")), "artifacts")
    key = ["project", *keep, "rule_id"]
    order = Window.partitionBy(*key, "kind").orderBy("file", "line")
    first = hits.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= shown)
    content = first.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("kind", "n", "file", "line", "text"))).alias("content"))
    counts = hits.groupBy(*key).agg(F.count("*").alias("entries"))
    names = {"HIPAA-ASSET-001": "ASSET-INVENTORY", "HIPAA-FLOW-001": "PHI-FLOW-MAP"}
    of = lambda values: F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("rule_id")]
    return counts.join(content, key).select(
        "project", *keep, F.col("rule_id").alias("finding_id"), of(names).alias("file"), of({r: rule(r).title for r in names}).alias("title"),
        of({r: rule(r).reference for r in names}).alias("reference"), "entries", "content")
