"""Line fixes with evidence: strategies, application from the last line up, hashes and manual reviews."""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanweave.functions.regex import to_java
from scanweave.functions.sql import has_any, js_trim, like, lit
from scanweave.operators.history import review_deadline
from scanweave.operators.lifecycle import SEQ

MARK = "REVIEW"
# Patterns and wording of the fixes.
QUOTE = "['\"`]"
TEMPLATE_CALL = r"(\w+)\s*\(\s*`([^`]*)\$\{([^}]+)\}([^`]*)`\s*\)"
TEMPLATE_REGION = r"\w+\s*\(\s*`[^`]*`\s*\)"
CONCAT_CALL = r"""(\w+)\s*\(\s*"([^"]+)"\s*\+\s*(\w+)\s*\+\s*"([^"]*)"\s*\)"""
VARIABLE = r"(?:const|let|var)\s+(\w+)|(\w+)\s*[:=]"
ASSIGNED = r"\s*[:=]\s*(['\"`])[^'\"`]+"
LOG_CALL = r"""logger\.(?:log|info|debug|warn|error)\s*\(\s*['"`][^'"`]*['"`]\s*,\s*(\w+)"""
LOG_PATIENT = r"(?i)logger\.(?:log|info|debug|warn|error)\s*\((\w*patient\w*)\s*\)"
LOG_PATIENT_SPACED = r"(?i)logger\.(?:log|info|debug|warn|error)\s*\(\s*(\w*patient\w*)\s*\)"
COOKIE_OBJECT = r"cookie\s*:\s*\{([^}]*)\}"
COOKIE_CALL = r"""(res\.cookie\s*\(\s*['"`][^'"`]+['"`]\s*,\s*\w+)\s*\)"""
BACKUP_WRITE = r"""(?i)^\s*(?:fs\.)?writeFile\s*\(\s*(['"`][^'"`]*backup[^'"`]*['"`])"""
BACKUP_NAME = r"(?i)^\s*.*backup.*=.*\.(?:sql|csv|json|txt)"


# What every line has that a fix type can change, in lower case: one of each group.
MARKS = {
    "sql-injection-template": [["("], ["`"], ["${"]], "sql-injection-concat": [["("], ['"'], ["+"]],
    "hardcoded-password": [["password", "pwd"]], "hardcoded-secret": [["secret"]], "api-key-exposed": [["api"], ["key"]],
    "phi-console-log": [["console."]], "http-url": [["http://"]], "innerhtml-unsanitized": [[".innerhtml"]],
    "phi-localstorage": [["localstorage."]], "phi-url-param": [["fetch", "axios.get", "http.get"]],
    "phi-log-unredacted": [["logger."]], "cookie-insecure": [["cookie"]], "backup-unencrypted": [["backup"]],
}


def _get(text: str, pattern: str, group: int) -> str:
    return f"regexp_extract({text}, {lit(to_java(pattern))}, {group})"


def _swap(text: str, pattern: str, replacement: str) -> str:
    """Replaces the first match of the pattern by an expression."""
    hit = _get(text, pattern, 0)
    return (f"concat(substring_index({text}, {hit}, 1), {replacement}, "
            f"substring({text}, length(substring_index({text}, {hit}, 1)) + length({hit}) + 1))")


def _env(text: str, default: str) -> str:
    name = f"coalesce(nullif({_get(text, VARIABLE, 1)}, ''), nullif({_get(text, VARIABLE, 2)}, ''))"
    split = f"regexp_replace({name}, '([a-z])([A-Z])', '$1_$2')"
    return f"coalesce(upper(regexp_replace({split}, {lit(to_java(chr(91) + '-' + chr(92) + 's]+'))}, '_')), '{default}')"


def has_all(text: str, *parts: str) -> str:
    """Whether all of ``parts``, of which every match has some, are in the text: tried before patterns that may start at any word."""
    return " AND ".join(f"contains({text}, {lit(p)})" for p in parts)


def _indent(text: str) -> str:
    return _get(text, r"^(\s*)", 1)


def strategies(t: str) -> dict:
    """Fix type to the SQL of the fixed line, null where the line does not fit."""
    sql0 = f"concat({_get(t, TEMPLATE_CALL, 2)}, '?', {_get(t, TEMPLATE_CALL, 4)})"
    more = f"transform(regexp_extract_all({sql0}, '\\\\$\\\\{{([^}}]+)\\\\}}', 1), v -> trim(v))"
    template_vars = f"array_join(concat(array(trim({_get(t, TEMPLATE_CALL, 3)})), {more}), ', ')"
    template_sql = f"regexp_replace({sql0}, '\\\\$\\\\{{[^}}]+\\\\}}', '?')"
    before = f"regexp_replace({_get(t, CONCAT_CALL, 2)}, {lit(to_java(chr(39) + '?' + chr(92) + 's*$'))}, '')"
    after = f"regexp_replace({_get(t, CONCAT_CALL, 4)}, {lit(to_java('^' + chr(92) + 's*' + chr(39) + '?'))}, '')"

    def named(word):
        p = rf"(?i)({word}){ASSIGNED}\2"
        return p

    def secret(word, default):
        p = named(word)
        return (f"CASE WHEN {like(t, p)} THEN "
                + _swap(t, p, f"concat({_get(t, p, 1)}, ' = process.env.', {_env(t, default)})") + " END")

    plain_secret = named("secret")
    options = f"trim({_get(t, COOKIE_OBJECT, 1)})"
    flags = "'httpOnly: true, secure: true'"
    url_call = r"""^\s*(fetch|axios\.get|http\.get)\s*\(\s*[`'"]"""
    post = (f"CASE WHEN {_get(t, url_call, 1)} = 'fetch' THEN "
            "'fetch(url, { method: \\'POST\\', body: JSON.stringify({ patientId }) })' "
            "ELSE 'axios.post(url, { patientId })' END")
    variable = _get(t, LOG_CALL, 1)
    call = _get(t, LOG_CALL, 0)
    patient = _get(t, LOG_PATIENT, 0)
    name = _get(t, LOG_PATIENT, 1)
    line = js_trim(t)
    ind = _indent(t)
    return {
        "sql-injection-template": (
            f"CASE WHEN {has_all(t, '(', '`', '${')} AND {like(t, TEMPLATE_CALL)} THEN "
            + _swap(t, TEMPLATE_REGION, f"concat({_get(t, TEMPLATE_CALL, 1)}, '(\\'', {template_sql}, '\\', [', "
                    f"{template_vars}, '])')") + " END"),
        "sql-injection-concat": (
            f"CASE WHEN {has_all(t, '(', chr(34), '+')} AND {like(t, CONCAT_CALL)} THEN "
            + _swap(t, CONCAT_CALL, f"concat({_get(t, CONCAT_CALL, 1)}, '(\\'', {before}, '?', {after}, '\\', [', "
                    f"{_get(t, CONCAT_CALL, 3)}, '])')") + " END"),
        "hardcoded-password": secret("password|pwd", "PASSWORD"),
        "hardcoded-secret": (
            f"CASE WHEN {like(t, plain_secret)} THEN "
            + _swap(t, plain_secret, f"concat('secret = process.env.', {_env(t, 'SECRET')})") + " END"),
        "api-key-exposed": secret("api[_-]?key|apikey", "API_KEY"),
        "phi-console-log": (
            rf"CASE WHEN {like(t, r'^\s*console\.(?:log|info|debug|warn|error)\s*\(')} THEN "
            f"concat({ind}, '// [{MARK}] PHI logging removed - review needed: ', {line}) END"),
        "http-url": (
            f"CASE WHEN contains({t}, 'http://') AND NOT contains({t}, 'http://localhost') AND "
            f"NOT contains({t}, 'http://127.0.0.1') THEN replace({t}, 'http://', 'https://') END"),
        "innerhtml-unsanitized": (
            rf"CASE WHEN {like(t, r'\.innerHTML\s*=')} THEN " + _swap(t, r"\.innerHTML\s*=", "'.textContent ='") + " END"),
        "phi-localstorage": (
            rf"CASE WHEN {like(t, r'^\s*localStorage\.(?:setItem|getItem)\s*\(')} THEN concat({ind}, "
            f"'// [{MARK}] PHI in localStorage removed - use server-side session storage instead\\n', {ind}, "
            f"'// TODO: Replace with: await sessionApi.store(key, encryptedData)\\n', {ind}, '// Original: ', {line}) END"),
        "phi-url-param": (
            f"CASE WHEN {like(t, url_call)} THEN concat({ind}, "
            f"'// [{MARK}] PHI in URL params - use POST with encrypted body instead\\n', {ind}, "
            f"'// TODO: Replace with: ', {post}, '\\n', {ind}, '// Original: ', {line}) END"),
        "phi-log-unredacted": (
            f"CASE WHEN {like(t, LOG_CALL)} THEN "
            + _swap(t, LOG_CALL, f"concat(substring({call}, 1, length({call}) - length({variable})), 'redactPHI(', "
                    f"{variable}, ')')")
            + f" WHEN {like(t, LOG_PATIENT)} THEN " + _swap(t, LOG_PATIENT, f"replace({patient}, concat('(', {name}), "
                                                           f"concat('(redactPHI(', {name}, ')'))")
            + f" WHEN {like(t, LOG_PATIENT_SPACED)} THEN {t} END"),
        "cookie-insecure": (
            f"CASE WHEN contains({t}, 'httpOnly') THEN NULL WHEN {like(t, COOKIE_OBJECT)} THEN "
            + _swap(t, COOKIE_OBJECT, f"concat('cookie: {{ ', CASE WHEN {options} <> '' THEN concat({options}, ', ') "
                    f"ELSE '' END, {flags}, ' }}')")
            + f" WHEN {like(t, COOKIE_CALL)} THEN "
            + _swap(t, COOKIE_CALL, f"concat({_get(t, COOKIE_CALL, 1)}, ', {{ httpOnly: true, secure: true }})')") + " END"),
        "backup-unencrypted": (
            f"CASE WHEN {like(t, BACKUP_WRITE)} THEN concat({ind}, "
            f"'// [{MARK}] Unencrypted backup - encrypt before writing\\n', {ind}, "
            f"'// TODO: const encrypted = await crypto.encrypt(data, process.env.BACKUP_KEY);\\n', {ind}, "
            f"'// Then write encrypted data to ', {_get(t, BACKUP_WRITE, 1)}, '.enc\\n', {ind}, '// Original: ', {line}) "
            f"WHEN {like(t, BACKUP_NAME)} AND NOT contains({t}, 'encrypt') AND NOT contains({t}, 'gpg') THEN "
            f"concat({ind}, '// [{MARK}] Use encrypted backup format (.gpg, .enc) or enable encryption\\n', {ind}, {line}) "
            "END"),
    }


def fix_line(text: str, fix_type: str) -> str:
    cases = " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in strategies(text).items())
    return f"CASE {fix_type} {cases} END"


def possible_fixes(lines: DataFrame, kinds) -> DataFrame:
    """Rows of ``text`` once for each fix type of ``kinds`` whose marks it has, as ``fix_type``; other types can't change it."""
    having = ", ".join(
        f"CASE WHEN {' AND '.join(has_any('low__', some) for some in MARKS.get(k, [])) or 'true'} THEN {lit(k)} END" for k in kinds)
    low = lines.withColumn("low__", F.lower("text"))
    return low.select(*lines.columns, F.explode(F.expr(f"array_compact(array({having}))")).alias("fix_type"))


def fix_cases(cases: DataFrame) -> DataFrame:
    """``fixed`` for rows of ``text, fix_type``; null where the strategy does not apply."""
    return cases.withColumn("fixed", F.expr(fix_line("text", "fix_type")))


def fix_steps(findings: DataFrame) -> DataFrame:
    """Every fixable finding with the line before and after its fix.

    Several findings on one line apply one after the other, in report order; the list is bounded by the rule table.
    """
    entry = F.struct(*SEQ, "finding_id", "fix_type", "title", "reference")
    lines = findings.filter(F.col("fix_type").isNotNull() & F.col("line").isNotNull()).groupBy(
        "project", "file", "line", "code").agg(F.sort_array(F.collect_list(entry)).alias("todo"))
    step = ("named_struct('finding_id', t.finding_id, 'fix_type', t.fix_type, 'title', t.title, 'reference', t.reference, "
            "'before', acc.text, 'after', x, 'fixed', x <> acc.text)")
    empty = ("CAST(array() AS array<struct<finding_id:string,fix_type:string,title:string,reference:string,before:string,"
             "after:string,fixed:boolean>>)")
    fixed = f"coalesce({fix_line('acc.text', 't.fix_type')}, acc.text)"
    fold = (f"aggregate(todo, named_struct('text', code, 'steps', {empty}), (acc, t) -> transform(array({fixed}), x -> "
            f"named_struct('text', x, 'steps', concat(acc.steps, array({step}))))[0]).steps")
    return lines.select("project", "file", "line", F.posexplode(F.expr(fold)).alias("k", "s")).select(
        "project", "file", "line", "k", "s.*")


def _finals(applied: DataFrame) -> DataFrame:
    """For each changed file its changed lines in order, with their last text; bounded by the file's size."""
    lines = applied.groupBy("project", "file", "line").agg(F.max_by("after", "k").alias("after"))
    return lines.groupBy("project", "file").agg(F.sort_array(F.collect_list(F.struct("line", "after"))).alias("_finals"))


def _fixed_lines(lines: str, finals: str) -> str:
    """The lines with the changed ones in place: unchanged stretches are cut out once, so the cost is the file's length."""
    before = f"coalesce(get({finals}, i - 1).line, 0)"
    last = f"element_at({finals}, -1).line"
    return (f"flatten(concat(transform({finals}, (s, i) -> concat(slice({lines}, {before} + 1, s.line - 1 - {before}), array(s.after))), "
            f"array(slice({lines}, {last} + 1, size({lines}) - {last}))))")


def apply_fixes(corpus: DataFrame, steps: DataFrame) -> DataFrame:
    """Corpus rows of changed files with their new content; files are told apart by project and path."""
    f = corpus.join(_finals(steps.filter("fixed")), ["project", "file"])
    bound = "array(named_struct('ls', split(content, '\\n', -1), 'fs', _finals))"
    new = f"array_join(transform({bound}, b -> {_fixed_lines('b.ls', 'b.fs')})[0], '\\n')"
    return f.withColumn("fixed_content", F.expr(new)).drop("_finals")


_SNAPSHOT = "array<struct<line_number:int,content:string,is_match:boolean>>"
_EVIDENCE = (
    "project string, file string, step int, line int, finding_id string, fix_type string, title string, reference string, "
    f"hash_before string, hash_after string, before {_SNAPSHOT}, after {_SNAPSHOT}")
_LINES = pa.list_(pa.struct([("line_number", pa.int32()), ("content", pa.string()), ("is_match", pa.bool_())]))
_ARROW = pa.schema(
    [("project", pa.string()), ("file", pa.string()), ("step", pa.int32()), ("line", pa.int32())]
    + [(c, pa.string()) for c in ("finding_id", "fix_type", "title", "reference", "hash_before", "hash_after")]
    + [("before", _LINES), ("after", _LINES)])


class _Snapshots:
    """A column of snapshots, kept as flat lists that Arrow takes without a look at every line."""

    def __init__(self):
        self.ends, self.numbers, self.contents, self.matches = [0], [], [], []

    def add(self, above, own: str, below, at: int, around: int) -> None:
        """The line numbered ``at`` from 0, its text ``own``, and lines around it, out of all lines ``above`` and ``below``."""
        first, last = max(at - around, 0), min(at + around + 1, len(below))
        self.numbers += range(first + 1, last + 1)
        self.contents += [*above[first:at], own, *below[at + 1:last]]
        self.matches += [i == at for i in range(first, last)]
        self.ends.append(len(self.numbers))

    def array(self) -> pa.Array:
        flat = [pa.array(x, f.type) for x, f in zip((self.numbers, self.contents, self.matches), _LINES.value_type, strict=True)]
        rows = pa.StructArray.from_arrays(flat, fields=list(_LINES.value_type))
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), rows, type=_LINES)


_STEP = ("line", "finding_id", "fix_type", "title", "reference", "after")


def _evidence_rows(around: int):
    """Rows (project, file, content, steps from the last line up) to one row for each step.

    The original text is hashed once, up to its end, and the state at each line with a step is kept; a step's hash goes on from there
    with its line and the fixed text below, which lies as bytes in one place. So a step costs what follows it. Rows are made by column,
    and a batch has about a thousand of them.
    """
    def of_file(content, steps):
        """For each step its hashes, the original lines and the fixed ones; steps are (line, text after)."""
        lines = content.split("\n")
        fixed = list(lines)
        for line, after in steps:  # from the last line up, a line's own fixes in their order
            fixed[line - 1] = after
        below = "\n".join(fixed).encode()
        ends = list(itertools.accumulate((len(x.encode()) + 1 for x in fixed), initial=0))  # where line i begins
        states, state, at = {}, hashlib.sha256(), 0
        for line in sorted({line for line, _ in steps}):
            state.update("\n".join([*lines[at:line - 1], ""]).encode())
            at = line - 1
            states[line] = state.copy()
        whole = hashlib.sha256(content.encode()).hexdigest()
        view = memoryview(below)
        for line, after in steps:
            state = states[line].copy()
            state.update(after.encode())
            if line < len(lines):
                state.update(b"\n")
                state.update(view[ends[line]:])
            yield whole, state.hexdigest(), lines, fixed

    def batch_of(rows, before, after):
        flat = [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ARROW, strict=False)]
        return pa.RecordBatch.from_arrays([*flat, before.array(), after.array()], schema=_ARROW)

    def run(batches):
        for batch in batches:
            rows, before, after = [], _Snapshots(), _Snapshots()
            listed = batch.column(3)
            # Offsets count from the beginning of the values, also where the batch is a part of a larger one.
            steps = list(zip(*(listed.values.field(c).to_pylist() for c in _STEP), strict=True))
            ends = listed.offsets.to_pylist()
            for i, (project, file, content) in enumerate(zip(*(batch.column(k) for k in range(3)), strict=True)):
                project, file, own = project.as_py(), file.as_py(), steps[ends[i]:ends[i + 1]]
                states = of_file(content.as_py(), [(s[0], s[-1]) for s in own])
                for n, (s, (was, now, lines, fixed)) in enumerate(zip(own, states, strict=True)):
                    rows.append((project, file, n, *s[:-1], was, now))
                    at = s[0] - 1
                    before.add(lines, lines[at], lines, at, around)
                    after.add(lines, s[-1], fixed, at, around)  # lines above it are still original
                    if len(rows) == 1000:
                        yield batch_of(rows, before, after)
                        rows, before, after = [], _Snapshots(), _Snapshots()
            if rows:
                yield batch_of(rows, before, after)

    return run


def evidence(corpus: DataFrame, steps: DataFrame, around: int = 3) -> DataFrame:
    """One row per applied step: hashes of the file before and after it and both snapshots.

    After a step, lines below it carry all their fixes and lines above it are still original.
    """
    order = F.struct((-F.col("line")).alias("up"), "k", "line", "finding_id", "fix_type", "title", "reference", "after")
    by_file = steps.filter("fixed").groupBy("project", "file").agg(F.sort_array(F.collect_list(order)).alias("steps"))
    f = corpus.select("project", "file", "content").join(by_file, ["project", "file"]).select("project", "file", "content", "steps")
    return f.mapInArrow(_evidence_rows(around), _EVIDENCE)


def _trail(keys: int):
    """Rows (keys, file, step, text) in order to one row a trail; a digest's state goes on over rows and batches."""
    def ended(rows, like):
        fields = [like.field(i) for i in range(keys)] + [pa.field("trail_hash", pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields, strict=True)], schema=pa.schema(fields))

    def run(batches):
        last, state, like = None, None, None
        for batch in batches:
            out, like = [], batch.schema
            for *key, text in zip(*(batch.column(i).to_pylist() for i in (*range(keys), keys + 2)), strict=True):
                if state is not None and key == last:
                    state.update(b"\n")
                else:
                    if state is not None:
                        out.append((*last, state.hexdigest()))
                    last, state = key, hashlib.sha256()
                state.update(text.encode())
            if out:
                yield ended(out, like)
        if state is not None:
            yield ended([(*last, state.hexdigest())], like)

    return run


def trail_hash(evidence_rows: DataFrame, by, ts: str) -> DataFrame:
    """One hash per trail over its evidence lines, ordered by file and step.

    A trail's lines are sorted and go through one digest as they come; no list of them is built, so a trail of any length takes the
    memory of a batch.
    """
    line = F.concat_ws("|", "finding_id", "hash_before", "hash_after", F.col(ts).cast("string")).alias("row")
    rows = evidence_rows.select(*by, F.col("file").alias("file__"), F.col("step").alias("step__"), line)
    out = T.StructType([*rows.select(*by).schema.fields, T.StructField("trail_hash", T.StringType())])
    dealt = rows.repartition(*by).sortWithinPartitions(*by, "file__", "step__")
    return dealt.mapInArrow(_trail(len(by)), out)


def fix_report(steps: DataFrame) -> DataFrame:
    """Per file: its applied fixes by line and the number skipped."""
    entry = F.when(F.col("fixed"), F.struct("line", "k", "fix_type"))
    return steps.groupBy("project", "file").agg(
        F.count_if("fixed").alias("fixed"), F.count_if(~F.col("fixed")).alias("skipped"),
        F.sort_array(F.collect_list(entry)).alias("fixes"))


def manual_reviews(findings: DataFrame, created: str = "scan_ts") -> DataFrame:
    """Findings without a fix become reviews with a deadline by severity."""
    return findings.filter(F.col("fix_type").isNull()).select(
        "project", "file", "line", "finding_id", "severity", F.lit("pending_review").alias("status"),
        review_deadline(created).alias("deadline"), F.col(created).alias("updated_at"))


def update_reviews(reviews: DataFrame, updates: DataFrame, keys=("project", "file", "line", "finding_id")) -> DataFrame:
    """The latest status of each review; an update of an unknown review is ignored. Keys that a table lacks don't count."""
    keys = [k for k in keys if k in reviews.columns and k in updates.columns]
    last = updates.groupBy(*keys).agg(
        F.max_by("status", "updated_at").alias("_status"), F.max("updated_at").alias("_at"))
    return reviews.join(last, list(keys), "left").withColumns({
        "status": F.coalesce("_status", "status"), "updated_at": F.coalesce("_at", "updated_at")}).drop("_status", "_at")
