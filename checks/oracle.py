"""SQL text for the checking engine: rules over exploded lines, without lookaround and without keyword filters.

Each rule is one SELECT over a lines table; windows come from the file's line list by join. This is written apart from
the Spark operators, so that both sides can disagree.
"""

from __future__ import annotations

import re

from checks.corpus import _q, code_corpus_sql, corpus_sql, text_corpus_sql, written_sql
from scanweave.rules.catalog import IMPORT_LINE, line_rules
from scanweave.rules.model import SEVERITY_RANK

WS = r"\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


def re2(p: str) -> str:
    out, cls, i = "", False, 0
    while i < len(p):
        c = p[i]
        if c == "\\":
            e = p[i + 1]
            out += (WS if cls else f"[{WS}]") if e == "s" else (f"[^{WS}]" if e == "S" and not cls else c + e)
            i += 2
            continue
        if cls and c == "]":
            cls = False
        elif not cls and c == "[":
            cls = True
        out += c
        i += 1
    return out


def rx(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {_q(re2(pattern))})"


def arms(p: str) -> list[str]:
    out, depth, cls, cur, i = [], 0, False, "", 0
    while i < len(p):
        c = p[i]
        if c == "\\":
            cur += p[i:i + 2]
            i += 2
            continue
        if cls:
            cls = c != "]"
        elif c == "[":
            cls = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and not depth:
            out.append(cur)
            cur, i = "", i + 1
            continue
        cur += c
        i += 1
    return out + [cur]


def _trailing_lookahead(p: str):
    """(body, ahead) of ``body(?!ahead)``, or None."""
    at = p.rfind("(?!")
    if at < 0 or not p.endswith(")"):
        return None
    depth = 0
    for i in range(at, len(p)):
        if p[i] == "\\":
            continue
        if p[i] == "(" and p[i - 1] != "\\":
            depth += 1
        if p[i] == ")" and p[i - 1] != "\\":
            depth -= 1
            if depth == 0:
                return (p[:at], p[at + 3:i]) if i == len(p) - 1 else None
    return None


def matches(text: str, pattern: str, span: bool = False) -> str:
    """Boolean SQL: the pattern matches the text; in span mode the match starts on the first line."""
    ci = "(?i)" if pattern.startswith("(?i)") else ""
    body = pattern[4:] if ci else pattern
    if "(?!" not in body and "(?<!" not in body:
        if span:
            flags = "(?is)" if ci else "(?s)"
            return rx(text, rf"{flags}\A[^\n]*?(?:{body})")
        return rx(text, pattern)
    return "(" + " OR ".join(_arm(text, a, ci, span) for a in arms(body)) + ")"


def _gone(text: str, pattern: str) -> str:
    return f"regexp_replace({text}, {_q(re2(pattern))}, '~', 'g')"


def _arm(text: str, p: str, ci: str, span: bool) -> str:
    if "(?<!local)(?<!session)" in p:
        text, p = _gone(text, "(?i)(?:local|session)storage"), p.replace("(?<!local)(?<!session)", "")
    if r"(?!\{\{)" in p:
        p = p.replace(r"(?!\{\{)", "")
    if p.startswith("curl") and "(?!localhost" in p:
        ahead = re.search(r"\(\?!(localhost.*?\.com)\)", p).group(1)
        text, p = _gone(text, rf"curl\s+(?:{ahead})"), p.replace(f"(?!{ahead})", "")
    if "http://(?!localhost" in p:
        ahead = r"localhost|127\.0\.0\.1"
        text, p = _gone(text, f"(?i)http://(?:{ahead})"), p.replace(f"(?!{ahead})", "")
    if p.startswith("mysqldump(?!.*--ssl)"):
        text = f"regexp_replace({text}, '(?i)^.*--ssl', '')"
        p = p.replace("(?!.*--ssl)", "")
    cut = _trailing_lookahead(p)
    if cut and cut[0].endswith(".*?"):
        p, cut = cut[0], None
    if not cut:
        return matches(text, ci + p, span)
    greedy = cut[0].replace(".*?", ".*")
    flags = "(?is)" if ci and span else "(?s)" if span else ci
    lead = r"\A[^\n]*" if span else "^.*"
    tail = f"regexp_replace({text}, {_q(re2(f'{flags}{lead}(?:{greedy})'))}, '')"
    return f"({matches(text, ci + cut[0], span)} AND NOT {rx(tail, f'{flags}^(?:{cut[1]})')})"


def any_match(text: str, patterns, span: bool = False) -> str:
    plain = [p for p in patterns if "(?!" not in p and "(?<!" not in p]
    rest = [p for p in patterns if p not in plain]
    terms = [matches(text, p, span) for p in plain + rest]
    return "(" + " OR ".join(terms) + ")"


def win(before: int, after: int, code_only: bool = False) -> str:
    lines = f"f.ls[greatest(l.i - {before}, 0) + 1 : l.i + {after} + 1]"
    if code_only:
        lines = f"list_filter({lines}, lambda t: NOT {rx('t', '^\\s*(?://|/\\*|\\*)')})"
    return lines


def scope(s) -> str:
    if s.kind == "line":
        return "l.text"
    if s.kind == "path":
        return "l.file"
    if s.kind == "content":
        return "f.content"
    if s.kind == "flat":
        return f"regexp_replace(array_to_string({win(s.before, s.after)}, ' '), '\\s+', ' ', 'g')"
    return f"array_to_string({win(s.before, s.after, s.code_only)}, chr(10))"


def client_file() -> str:
    server = r"(?i)/api/|\.server\.|getServerSideProps|getStaticProps|use server"
    client = r"(?i)/(?:components?|pages?|app)/|\.client\.|use client|useState|useEffect|useContext|window\.|document\."
    return (
        f"(CASE WHEN {rx('l.file', server)} OR {rx('f.content', server)} THEN false "
        f"WHEN {rx('l.file', client)} OR {rx('f.content', client)} THEN true "
        f"ELSE {rx('l.file', '(?i)/(?:src|components?|pages?|app|views?)/')} END)"
    )


def guard_sql(name: str) -> str:
    if name == "short_retention":
        p = _q(re2(r"(?i)deleteAfter\s*[:=]\s*(\d+)\s*(day|hour|minute)"))
        return (f"(lower(regexp_extract(l.text, {p}, 2)) <> 'day' OR "
                f"CAST(regexp_extract(l.text, {p}, 1) AS DOUBLE) < 2190)")
    v = f"regexp_extract(l.text, {_q(re2(chr(91) + ':=]' + chr(92) + 's*[' + chr(39) + chr(34) + '`]([^' + chr(39) + chr(34) + '`]+)[' + chr(39) + chr(34) + '`]'))}, 1)"
    hold = r"(?i)^(?:your|my|the|a|an|test|example|demo|sample|placeholder|xxx|changeme|replace|todo)"
    weak = r"(?i)^(?:12345|qwerty|password|admin|test)"
    return f"NOT ({v} <> '' AND ({rx(v, hold)} OR length({v}) < 8 OR {rx(v, weak)}))"


def rule_sql(pack, r) -> str:
    """Hits of one rule: project, file, i, rule_no."""
    w = [rx("l.file", pack.path), any_match(scope(r.on), r.patterns, r.on.kind == "span")]
    w += [f"NOT {rx('l.text', p)}" for p in r.skip]
    if r.skip_imports:
        trimmed = "regexp_replace(l.text, '^\\s+|\\s+$', '', 'g')"
        w.append("NOT " + any_match(trimmed, IMPORT_LINE))
    if r.skip_path:
        w.append(f"NOT {rx('l.file', r.skip_path)}")
    if r.guard:
        w.append(guard_sql(r.guard))
    if r.client_only:
        w.append(client_file())
    w += [any_match(scope(c.scope), c.patterns) for c in r.require]
    w += [f"NOT {any_match(scope(c.scope), c.patterns)}" for c in r.forbid if c.patterns]
    where = " AND ".join(w)
    source = "lines l JOIN files f ON f.file = l.file" if "f." in re.sub(r"'(?:[^']|'')*'", "", where) else "lines l"
    return f"SELECT l.project, l.file, l.i, {r.no} AS rule_no FROM {source} WHERE {where}"


def rules_values(rules) -> str:
    rows = []
    for p, r in rules:
        ctx = -1 if p.context is None else p.context
        vals = [r.no, _q(p.name), p.no, _q(r.id), _q(p.finding_id), ctx, _q(r.category), _q(r.severity),
                SEVERITY_RANK[r.severity], _q(r.title), _q(r.reference),
                "NULL" if r.fix_type is None else _q(r.fix_type),
                "NULL" if r.confidence is None else _q(r.confidence)]
        rows.append("(" + ", ".join(str(v) for v in vals) + ")")
    return (
        f"(VALUES {', '.join(rows)}) AS r(rule_no, pack, pack_no, rule_id, id_form, context_lines, category, "
        "severity, rank, title, reference, fix_type, confidence)"
    )


FROM = {"all": corpus_sql, "code": code_corpus_sql, "text": text_corpus_sql, "written": written_sql}


def base(source: str = "code", extra: str = "") -> str:
    """CTEs corpus, files (with ls) and lines."""
    return (
        f"WITH corpus AS MATERIALIZED ({FROM[source]()}{extra}), "
        "files AS MATERIALIZED (SELECT *, string_split(content, chr(10)) AS ls FROM corpus), "
        "lines AS MATERIALIZED (SELECT project, file, scan_id, unnest(range(len(ls))) AS i, unnest(ls) AS text "
        "FROM files)"
    )


def findings(rules, source: str = "code", extra: str = "") -> str:
    """CTEs up to ``findings``, one row per hit with the rule's attributes and context lines."""
    rules = list(rules)
    hits = " UNION ALL ".join(rule_sql(p, r) for p, r in rules)
    return (
        f"{base(source, extra)}, hits AS MATERIALIZED ({hits}), findings AS MATERIALIZED (SELECT h.project, h.file, "
        "h.i + 1 AS line, r.*, f.scan_id, f.ls[h.i + 1] AS code, CASE WHEN h.i > 0 THEN f.ls[h.i] END AS prev, "
        + ("f.scan_ts, " if source == "code" else "") +
        "(contains(f.ls[h.i + 1], '/*') OR (contains(array_to_string(f.ls[1:h.i], chr(10)), '/*') AND NOT contains("
        "regexp_replace(array_to_string(f.ls[1:h.i], chr(10)), '(?s)^.*/\\*', '') , '*/'))) AS in_block, "
        "replace(replace(replace(r.id_form, '{id}', r.rule_id), '{i}', CAST(h.i AS VARCHAR)), '{file}', h.file) "
        "AS finding_id, "
        "CASE WHEN context_lines < 0 THEN [] ELSE f.ls[greatest(h.i - context_lines, 0) + 1 : h.i + context_lines + 1] "
        "END AS ctx, CASE WHEN context_lines < 0 THEN NULL ELSE greatest(h.i - context_lines, 0) END AS ctx_from "
        f"FROM hits h JOIN {rules_values(rules)} ON r.rule_no = h.rule_no JOIN files f ON f.file = h.file)"
    )


def pack_findings(names=None, source: str = "code") -> str:
    return findings(line_rules(names), source)
