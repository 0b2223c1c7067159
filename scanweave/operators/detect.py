"""Line rules over a corpus.

One row per file goes in: ``project, file, content``. One pass over the content finds the lines that hold a keyword of each
rule. Every such line becomes a row for the rule, with the lines around it that the rule looks at, and the rule's condition is a
compiled filter on that row; no shuffle is needed. A rule costs nothing for a file that lacks its keywords; windows are joined
only for lines whose own pattern already matched.

A long file may come as several rows, its pieces (``sources.long_files``): lines of its own and a margin on both sides, for which
``detect_rules`` gives the findings that the whole file has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanweave.functions.keywords import lines_with
from scanweave.functions.regex import all_keywords, alternatives, any_of, found_in_text, glob_to_regex, leading_keywords, to_java
from scanweave.functions.sql import js_trim, like, lit
from scanweave.rules.catalog import COMMENT, IMPORT_LINE, line_rules
from scanweave.rules.model import SEVERITY_RANK, Rule, Scope

# A file's parts are bound as f, one of its lines as l: l.i its 0-based number, l.x its text. Where rules are tried, l also has the
# lines around, l.ls, and the line's place among them, l.w.
LINE_TEXT = "l.x"

# Client and server hints in paths and contents.
SERVER_HINTS = [r"(?i)/api/", r"(?i)\.server\.", r"(?i)getServerSideProps", r"(?i)getStaticProps", r"(?i)use server"]
CLIENT_HINTS = [
    r"(?i)/(?:components?|pages?|app)/", r"(?i)\.client\.", r"(?i)use client", r"(?i)useState|useEffect|useContext",
    r"(?i)window\.", r"(?i)document\.",
]
WEB_FOLDERS = r"(?i)/(?:src|components?|pages?|app|views?)/"
# Short retention is under six years of days; values that are not secrets.
RETENTION_DAYS = 2190
PLACEHOLDER = r"(?i)^(?:your|my|the|a|an|test|example|demo|sample|placeholder|xxx|changeme|replace|todo)"
GENERIC_VALUE = r"(?i)^(?:12345|qwerty|password|admin|test)"
ASSIGNED_VALUE = r"""[:=]\s*['"`]([^'"`]+)['"`]"""

# Fixed value: rules in a group, so that finding a rule's condition takes few comparisons.
GROUP = 12


class WholeText:
    """Tests on a file's whole text. On a piece of a long file they are lookups among the ``facts`` that its row carries: the
    numbers of the patterns that match anywhere in the file.

    With a number ``first_key``, patterns are tried only on texts that hold one of their keywords, which are found under the keys
    from there on.
    """

    def __init__(self, in_pieces: bool = False, first_key: int | None = None):
        self.in_pieces, self.first_key, self.patterns = in_pieces, first_key, []

    def like(self, pattern: str) -> str:
        if not self.in_pieces and self.first_key is None:
            return like("content", pattern)
        if pattern not in self.patterns:
            self.patterns.append(pattern)
        k = self.patterns.index(pattern)
        return f"array_contains(facts, {k})" if self.in_pieces else f"({self.where_found(k, 'f.words')})"

    def words(self) -> dict[int, list[str]]:
        """The patterns' keywords by key, of those that have some."""
        if self.first_key is None:
            return {}
        found = {self.first_key + k: all_keywords([p]) for k, p in enumerate(self.patterns)}
        return {key: some for key, some in found.items() if some}

    def where_found(self, k: int, words: str) -> str:
        """Test of the text by pattern ``k``; ``words`` is the map of the keys found."""
        test, key = like("content", self.patterns[k]), None if self.first_key is None else self.first_key + k
        return f"{words}[{key}] IS NOT NULL AND {test}" if key in self.words() else test


def is_client_file(whole: WholeText | None = None) -> str:
    """Server hints win, then client hints, then common web folders."""
    server, client, whole = any_of(SERVER_HINTS), any_of(CLIENT_HINTS), whole or WholeText()
    return (
        f"CASE WHEN {like('file', server)} OR {whole.like(server)} THEN false "
        f"WHEN {like('file', client)} OR {whole.like(client)} THEN true "
        f"ELSE {like('file', WEB_FOLDERS)} END"
    )


def line_hits(corpus: DataFrame, path: str, labelled, gate: str = "true", keep=()) -> DataFrame:
    """One row per (label, line) where the label's condition on line ``l`` holds, for files on ``path``."""
    parts = ", ".join(
        f"transform(filter(f.lines, l -> {cond}), l -> named_struct('label', {lit(label)}, 'i', l.i, 'text', l.x))"
        for label, cond in labelled)
    hits = per_file(
        f"CASE WHEN {like('file', path)} AND {gate} THEN flatten(array({parts})) ELSE "
        "CAST(array() AS array<struct<label:string,i:int,text:string>>) END")
    return corpus.select("project", "file", *keep, F.explode(F.expr(hits)).alias("h")).select(
        "project", "file", *keep, "h.label", (F.col("h.i") + 1).alias("line"), "h.text")


def is_import_line(text: str) -> str:
    return like(js_trim(text), any_of(IMPORT_LINE))


def window_lines(before: int, after: int) -> str:
    """Lines i-before .. i+after of the file, cut at its ends."""
    start = f"greatest(l.w - {before}, 0)" if before else "l.w"
    return f"slice(l.ls, {start} + 1, least(l.w + {after}, size(l.ls) - 1) - {start} + 1)"


def scope_text(scope: Scope) -> str:
    if scope.kind == "line":
        return LINE_TEXT
    if scope.kind == "path":
        return "file"
    if scope.kind == "content":
        return "content"
    lines = window_lines(scope.before, scope.after)
    if scope.code_only:
        lines = f"filter({lines}, t -> NOT ({like('t', COMMENT)}))"
    if scope.kind == "flat":
        return f"regexp_replace(array_join({lines}, ' '), '\\\\s+', ' ')"
    return f"array_join({lines}, '\\n')"


def _anchored(patterns) -> str:
    """Patterns whose match must start on the first line and may run over the following ones."""
    return r"(?s)\A[^\n]*?(?:" + any_of(patterns) + ")"


def _guard(name: str) -> str:
    if name == "short_retention":
        parts = r"(?i)deleteAfter\s*[:=]\s*(\d+)\s*(day|hour|minute)"
        number = f"regexp_extract({LINE_TEXT}, {lit(to_java(parts))}, 1)"
        unit = f"lower(regexp_extract({LINE_TEXT}, {lit(to_java(parts))}, 2))"
        return f"({unit} <> 'day' OR CAST({number} AS DOUBLE) < {RETENTION_DAYS})"
    if name == "literal_value":
        value = f"regexp_extract({LINE_TEXT}, {lit(to_java(ASSIGNED_VALUE))}, 1)"
        weak = f"{like(value, PLACEHOLDER)} OR length({value}) < 8 OR {like(value, GENERIC_VALUE)}"
        return f"NOT ({value} <> '' AND ({weak}))"
    raise ValueError(name)


def _matches(scope: Scope, patterns, whole: WholeText) -> str:
    """True where any pattern matches the text of the scope."""
    if scope.kind == "content":
        return f"({whole.like(any_of(patterns))})"
    return f"({like(scope_text(scope), _anchored(patterns) if scope.kind == 'span' else any_of(patterns))})"


def line_condition(rule: Rule, whole: WholeText | None = None) -> str:
    """Spark SQL condition on line ``l``."""
    terms, whole = [], whole or WholeText()
    for c in rule.require:
        if c.scope.kind == "line":
            terms.append(_matches(c.scope, c.patterns, whole))
    if rule.on.kind != "content":
        terms.append(_matches(rule.on, rule.patterns, whole))
    for p in rule.skip:
        terms.append(f"NOT ({like(LINE_TEXT, p)})")
    if rule.skip_imports:
        terms.append(f"NOT ({is_import_line(LINE_TEXT)})")
    if rule.guard:
        terms.append(_guard(rule.guard))
    for c in rule.require:
        if c.scope.kind not in ("line", "content"):
            terms.append(_matches(c.scope, c.patterns, whole))
    for c in rule.forbid:
        if c.patterns and c.scope.kind in ("line", "window"):
            terms.append(f"NOT {_matches(c.scope, c.patterns, whole)}")
    return " AND ".join(terms) or "true"


def file_condition(rule: Rule, whole: WholeText | None = None) -> str:
    """Condition on the file row that must hold before any line is looked at."""
    terms, whole = [], whole or WholeText()
    if rule.skip_path:
        terms.append(f"NOT ({like('file', rule.skip_path)})")
    if rule.include:
        terms.append("(" + " OR ".join(like("file", glob_to_regex(g)) for g in rule.include) + ")")
    for g in rule.exclude:
        terms.append(f"NOT ({like('file', glob_to_regex(g))})")
    if rule.client_only:
        terms.append(f"({is_client_file(whole)})")
    if rule.on.kind == "content":
        terms.append(_matches(rule.on, rule.patterns, whole))
    for c in rule.require:
        if c.scope.kind == "content":
            terms.append(_matches(c.scope, c.patterns, whole))
    for c in rule.forbid:
        if c.patterns and c.scope.kind in ("path", "content"):
            terms.append(f"NOT {_matches(c.scope, c.patterns, whole)}")
    return " AND ".join(terms) or "true"


def line_words(rule: Rule) -> list[frozenset]:
    """Alternatives that cover every hit of the rule, each a set of sets of words: its line has one of each. Empty where there are none."""
    covering = [frozenset()]
    if rule.on.kind == "line":
        found = [alternatives(p) for p in rule.patterns]
        covering = [a for some in found for a in some] if found and all(found) else covering
    elif rule.on.kind == "span":
        words = all_keywords(rule.patterns, leading_keywords)
        covering = [frozenset([frozenset(words)])] if words else covering
    asked = [all_keywords(c.patterns) for c in rule.require if c.scope.kind == "line"]
    more = frozenset(frozenset(words) for words in asked if words)
    covering = list(dict.fromkeys(a | more for a in covering))
    return covering if all(covering) else []


def _pattern_in_text(rule: Rule) -> str | None:
    """A test that the text of every line with a hit passes, of a rule on lines without words."""
    if rule.on.kind == "line" and all(map(found_in_text, rule.patterns)):
        return like("content", any_of(rule.patterns))
    return None


def _margin(rules) -> tuple[int, int]:
    """Lines above and below a line that some rule or its context looks at."""
    scopes = [s for _, r in rules for s in (r.on, *[c.scope for c in (*r.require, *r.forbid)])]
    around = max([p.context or 0 for p, _ in rules], default=0)
    return max([around, 1, *[s.before for s in scopes]]), max([around, *[s.after for s in scopes]])


def _ints(values) -> str:
    return f"array({', '.join(map(str, values))})"


def _lines_to_try(files: DataFrame, rules, asking, whole: WholeText, columns, shift: str) -> DataFrame:
    """Every line that a rule must try, as ``l``: the rule's place ``l.k`` among ``rules``, the line and those around it.

    Where the file's map ``f.words`` has lines under a rule's place, these; all lines for the rules of ``asking``, of files that pass
    their test there. A row carries the lines around its own, never the file.
    """
    found = ["map_entries(f.words)"] if len(asking) < len(rules) else []
    if asking:
        keys = ", ".join(f"CASE WHEN {test} THEN {k} END" if test else str(k) for k, test in asking.items())
        found.append(f"transform(array_compact(array({keys})), k -> named_struct('key', k, 'value', CAST(NULL AS array<int>)))")
    by_path = list(dict.fromkeys(p.path for p, _ in rules))
    read = f"get(paths__, get({_ints(by_path.index(p.path) for p, _ in rules)}, found__.key))"
    more = [(k, c) for k, c in ((k, file_condition(r, whole)) for k, (_, r) in enumerate(rules)) if c != "true"]
    if more:
        read += f" AND CASE found__.key {' '.join(f'WHEN {k} THEN {c}' for k, c in more)} ELSE true END"
    asked = files.withColumn("found__", F.explode(F.expr(f"concat({', '.join(found)})"))).filter(F.expr(read))
    lines = asked.withColumn("at__", F.explode(F.expr("coalesce(found__.value, sequence(0, size(ls__) - 1))")))
    if "core_from" in files.columns:
        lines = lines.filter("at__ BETWEEN core_from AND core_to")
    margins = [_margin([pr]) for pr in rules]
    above = f"least(at__, get({_ints(up for up, _ in margins)}, found__.key))"
    around = f"slice(ls__, at__ - {above} + 1, {above} + 1 + get({_ints(down for _, down in margins)}, found__.key))"
    in_block = (f"marked__ IS NOT NULL AND (contains(get(ls__, at__), '/*') OR length(get(marked__, at__ - {shift})) > length(get(ls__, at__)))")
    line = f"named_struct('k', found__.key, 'i', at__, 'w', {above}, 'x', get(ls__, at__), 'in_block', {in_block}, 'ls', {around})"
    return lines.select(*columns, F.explode(F.expr(f"array({line})")).alias("l"))


def _rule_holds(conditions: list[str]) -> str:
    """The condition of the rule ``l.k`` on line ``l``.

    The lambda is always true. It keeps Spark from fusing this filter with the steps around it: fused, all rules would be one method,
    too long for the JVM to compile, while on its own Spark cuts the test into small ones.
    """
    groups = [range(k, min(k + GROUP, len(conditions))) for k in range(0, len(conditions), GROUP)]
    cases = [f"WHEN l.k < {g.stop} THEN CASE l.k {' '.join(f'WHEN {k} THEN {conditions[k]}' for k in g)} END" for g in groups]
    return f"CASE {' '.join(cases)} END AND exists(l.ls, x -> x IS NOT NULL)"


# A line is in a block comment if it has an opener or begins inside one; the latter get a mark: from an opener, or the end of the
# last match, up to the line's end without a closer. A quoted "/*" counts as an opener, since files are not parsed.
_OPEN_LINES = r"(?:\G(?!\A)|/\*)(?:(?!\*/)[^\n])*+\n"
_MARKED = (
    f"CASE WHEN contains({{0}}, '/*') THEN split(regexp_replace({{0}}, {lit(_OPEN_LINES)}, {lit('$0' + chr(1))}), '\\n', -1) END")
SPLIT = "split(content, '\\n', -1)"


def per_file(expression: str) -> str:
    """Evaluates ``expression`` over the file's parts ``f``, which are made once per row: ``f.ls`` and ``f.lines``.

    Binding them as a lambda variable keeps the optimizer from copying the split into every use.
    """
    parts = f"named_struct('ls', {SPLIT}, 'lines', transform({SPLIT}, (x, i) -> named_struct('i', i, 'x', x)))"
    return f"flatten(transform(array({parts}), f -> {expression}))"


def explode_lines(corpus: DataFrame) -> DataFrame:
    """One row per line, numbered from 1."""
    lines = F.posexplode(F.split("content", "\n", -1)).alias("i", "text")
    return corpus.select("project", "file", lines).withColumn("line", F.col("i") + 1).drop("i")


def rule_table(spark, rules) -> DataFrame:
    """The attributes of ``(pack, rule)`` pairs as a table; a few hundred rows at most."""
    rows = [
        (r.no, p.name, p.no, r.id, p.finding_id, p.context if p.context is not None else -1, r.category, r.severity,
         SEVERITY_RANK[r.severity], r.title, r.reference, r.fix_type, r.confidence, r.adjust_confidence, r.advice or p.advice)
        for p, r in rules
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


RULE_SCHEMA = (
    "rule_no int, pack string, pack_no int, rule_id string, id_form string, context_lines int, category string, "
    "severity string, rank int, title string, reference string, fix_type string, confidence string, "
    "adjust_confidence boolean, recommendation string"
)

FINDING_COLUMNS = [
    "project", "file", "line", "rule_no", "pack", "pack_no", "rule_id", "finding_id", "category", "severity", "rank",
    "title", "reference", "recommendation", "fix_type", "confidence", "adjust_confidence", "code", "prev", "in_block", "col", "ctx_from",
    "ctx",
]


def detect_rules(corpus: DataFrame, rules, prefilter: bool = True, keep=()) -> DataFrame:
    """Findings of ``(pack, rule)`` pairs: map-only over files, then one small broadcast of rule attributes.

    ``keep`` names further corpus columns to carry along, such as a scan id. Without ``prefilter`` every rule tries every line.
    Rows that are pieces of long files (they have the column ``first_line``) give the findings on their own lines, with the file's
    line numbers; what rules ask of a whole file is then collected from all its pieces first.
    """
    rules = list(rules)
    pieces = "first_line" in corpus.columns
    whole = WholeText(pieces, len(rules) if prefilter else None)
    found: dict[int, list[str]] = {}
    needs: dict[int, list[list[int]]] = {}
    asking: dict[int, str | None] = {}
    sets: dict[frozenset, int] = {}
    for k, (_, r) in enumerate(rules):
        words = line_words(r) if prefilter else []
        file_words = all_keywords(r.patterns) if prefilter and not words and not pieces else None
        if words:
            # Keys of single sets of words lie below those of files.
            needs[k] = [[sets.setdefault(some, -1 - len(rules) - len(sets)) for some in together] for together in words]
        elif file_words:
            asking[k], found[-1 - k] = f"f.words[{-1 - k}] IS NOT NULL", file_words
        else:
            asking[k] = _pattern_in_text(r) if prefilter else None
    found |= {key: sorted(some) for some, key in sets.items()}
    if not rules:
        none = corpus.filter("false").selectExpr(
            "project", "file", *keep, "0 AS rule_no", "0 AS i", "'' AS code", "'' AS prev", "false AS in_block", "0 AS ctx_from",
            "CAST(array() AS array<string>) AS ctx")
        return _describe(none, rule_table(corpus.sparkSession, rules), keep)
    conditions = [line_condition(r, whole) for _, r in rules]
    for _, r in rules:
        file_condition(r, whole)  # names the patterns that look at whole files
    paths = list(dict.fromkeys(p.path for p, _ in rules))
    files = corpus.filter(F.expr(" OR ".join(f"({like('file', p)})" for p in sorted(paths))))
    if pieces:
        files = _with_facts(files, whole)
    else:
        found |= whole.words()
    words = lines_with(found, needs)("content") if found else F.lit(None).cast("map<int,array<int>>")
    files = files.withColumns({
        "f": F.struct(words.alias("words")), "ls__": F.expr(SPLIT), "marked__": F.expr(_MARKED.format("core_text" if pieces else "content")),
        "paths__": F.expr(f"array({', '.join(like('file', p) for p in paths)})")})
    columns = ["project", "file", *keep, *(["first_line"] if pieces else [])]
    hits = _lines_to_try(files, rules, asking, whole, columns, "core_from" if pieces else "0").filter(F.expr(_rule_holds(conditions)))
    first = F.col("first_line") if pieces else F.lit(0)
    hits = hits.select(
        "project", "file", *keep, F.expr(f"get({_ints(r.no for _, r in rules)}, l.k)").alias("rule_no"),
        (F.col("l.i") + first).alias("i"), F.col("l.x").alias("code"), F.expr("get(l.ls, l.w - 1)").alias("prev"), "l.in_block",
        (F.expr("l.i - l.w") + first).alias("ctx_from"), F.col("l.ls").alias("ctx"))
    return _describe(hits, rule_table(corpus.sparkSession, rules), keep)


def _with_facts(pieces: DataFrame, whole: WholeText) -> DataFrame:
    """``facts``: the numbers of the patterns that match somewhere in the file, from one row per piece."""
    if not whole.patterns:
        return pieces.withColumn("facts", F.array().cast("array<int>"))
    numbers, words = range(len(whole.patterns)), whole.words()
    texts = pieces.select("project", "file", *["piece"][:"piece" in pieces.columns], "content")
    if words:
        texts = texts.withColumn("words", lines_with(words)("content"))
    if "piece" in pieces.columns:
        # Facts go to each piece by its own key, by which the pieces lie already: texts don't move.
        keys, of_file = ["project", "file", "piece"], Window.partitionBy("project", "file")
        flags = texts.select(*keys, *[F.expr(whole.where_found(k, "words")).alias(f"f{k}") for k in numbers])
        flags = flags.select(*keys, *[F.bool_or(f"f{k}").over(of_file).alias(f"f{k}") for k in numbers])
        return pieces.join(flags.select(*keys, _found_facts(numbers)), keys)
    flags = texts.groupBy("project", "file").agg(*[F.bool_or(F.expr(whole.where_found(k, "words"))).alias(f"f{k}") for k in numbers])
    return pieces.join(flags.select("project", "file", _found_facts(numbers)), ["project", "file"])


def _found_facts(numbers):
    return F.array_compact(F.array(*[F.when(F.col(f"f{k}"), F.lit(k)) for k in numbers])).alias("facts")


def _describe(hits: DataFrame, table: DataFrame, keep) -> DataFrame:
    """Joins rule attributes to hits and cuts the context to what the pack keeps."""
    f = hits.join(F.broadcast(table), "rule_no")
    first = F.expr("greatest(i - context_lines, 0)")
    f = f.withColumns({
        "line": F.col("i") + 1,
        "finding_id": F.expr("replace(replace(replace(id_form, '{id}', rule_id), '{i}', CAST(i AS STRING)), '{file}', file)"),
        "col": F.expr(f"length(code) - length({js_trim_left('code')}) + 1"),
        "ctx": F.expr(
            f"CASE WHEN context_lines < 0 THEN CAST(array() AS array<string>) ELSE "
            f"slice(ctx, greatest(i - context_lines, 0) - ctx_from + 1, "
            f"i + context_lines - greatest(i - context_lines, 0) + 1) END"),
        "ctx_from": F.when(F.col("context_lines") < 0, F.lit(None)).otherwise(first),
    })
    return f.select(*FINDING_COLUMNS, *keep)


def js_trim_left(column: str) -> str:
    return f"regexp_replace({column}, {lit(to_java('^' + chr(92) + 's+'))}, '')"


def detect(corpus: DataFrame, pack_names=None, prefilter: bool = True, keep=()) -> DataFrame:
    """Findings of the built-in line rules of the named packs (all packs by default)."""
    return detect_rules(corpus, line_rules(pack_names), prefilter, keep)


def context_snippet(findings: DataFrame) -> DataFrame:
    """Context as numbered lines, the matching one flagged."""
    return findings.withColumn(
        "context",
        F.expr(
            "transform(ctx, (x, k) -> named_struct('line_number', ctx_from + k + 1, 'content', x, "
            "'is_match', ctx_from + k + 1 = line))"),
    )
