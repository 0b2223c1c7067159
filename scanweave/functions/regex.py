"""Rule patterns as Spark SQL regular expressions.

Rules are written with the ECMAScript meaning of ``\\b``, ``\\s`` and ``$``; Java differs for each, so
:func:`to_java` spells them out. :func:`keywords` finds literals that every match must contain: a cheap
``contains`` on them runs before the regular expression.
"""

from __future__ import annotations

import re
from functools import lru_cache

SPACE = r"\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


_WORD_NEXT = re.compile(r"(?:\\[dw]|[A-Za-z0-9])(?![?*{])|\\[dw]\{[1-9]")
_WORD_BEFORE = re.compile(r"(?:(?<!\\)[A-Za-z0-9]|\\[dw](?:\{[1-9]\d*(?:,\d*)?\})?)$")


def _boundary(pattern: str, i: int) -> str:
    """``\\b`` at position i; one look is enough where a word character surely stands on one side."""
    if _WORD_NEXT.match(pattern, i + 2):
        return r"(?<!\w)"
    if _WORD_BEFORE.search(pattern[:i]):
        return r"(?!\w)"
    return BOUNDARY


@lru_cache(maxsize=None)
def to_java(pattern: str) -> str:
    out, in_class, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            e = pattern[i + 1:i + 2]
            if e == "b" and not in_class:
                out.append(_boundary(pattern, i))
            elif e == "s":
                out.append(SPACE if in_class else f"[{SPACE}]")
            elif e == "S" and not in_class:
                out.append(f"[^{SPACE}]")
            else:
                out.append(c + e)
            i += 2
            continue
        if in_class:
            if c == "]":
                in_class = False
            elif c == "[" or pattern.startswith("&&", i):
                c = "\\" + c
        elif c == "[":
            in_class = True
            if pattern.startswith("[^", i):
                c, i = "[^", i + 1
        elif c == "$":
            c = r"\z"
        out.append(c)
        i += 1
    return "".join(out)


def any_of(patterns) -> str:
    """One pattern matching where any of ``patterns`` matches; all share their ``(?i)`` prefix or have none."""
    bodies = []
    for p in patterns:
        ci = p.startswith("(?i)")
        body = p[4:] if ci else p
        bodies.append(f"(?i:{body})" if ci else f"(?:{body})")
    return "|".join(bodies)


def _items(tree):
    for op, arg in tree:
        yield str(op), arg


def _usable(options):
    return [o for o in options if o and all(len(w) > 1 for w in o)]


def _best(options):
    options = _usable(options)
    return max(options, key=lambda o: (min(len(w) for w in o) > 3, -len(o), min(len(w) for w in o)), default=None)


def _required(tree):
    """A set of lowercase literals, one of which occurs in every match of the parsed pattern, or None."""
    return _best(_options(tree))


def _options(tree):
    """Sets of lowercase literals; every match of the parsed pattern has one of each set. Some may be None."""
    options, run = [], ""

    def flush():
        nonlocal run
        if run:
            options.append(frozenset([run]))
        run = ""

    items = list(_items(tree))
    for k, (op, arg) in enumerate(items):
        if op == "LITERAL" and 31 < arg < 127:
            if not run:
                options.append(_leading(items[k:]))
            run += chr(arg).lower()
            continue
        flush()
        if op == "SUBPATTERN":
            options.append(_required(arg[3]))
        elif op == "BRANCH":
            parts = [_required(b) for b in arg[1]]
            options.append(frozenset().union(*parts) if all(parts) else None)
        elif op in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            options.append(_required(arg[2]))
    flush()
    return options


def _alternatives(tree):
    """For each alternative of the parsed pattern all its sets of literals."""
    items = list(_items(tree))
    if len(items) == 1 and items[0][0] == "BRANCH":
        return [a for branch in items[0][1][1] for a in _alternatives(branch)]
    options = _usable(_options(tree))
    return [frozenset(o for o in options if not any(_says_more(other, o) for other in options))]


def _says_more(words, than) -> bool:
    return words != than and all(any(t in w for t in than) for w in words)


@lru_cache(maxsize=None)
def alternatives(pattern: str):
    """Alternatives that cover every match of the pattern, each a set of sets of lowercase literals of which a match has one of each;
    None where an alternative has none."""
    tree = _parse(pattern)
    found = None if tree is None else _alternatives(tree)
    return found if found and all(found) else None


@lru_cache(maxsize=None)
def found_in_text(pattern: str) -> bool:
    """Whether a match in a line surely is one in the line's text, too: nothing in the pattern asks for a line's ends or looks around."""
    def plain(tree):
        for op, arg in _items(tree):
            if op == "SUBPATTERN":
                ok = plain(arg[3])
            elif op == "BRANCH":
                ok = all(map(plain, arg[1]))
            elif op in ("MAX_REPEAT", "MIN_REPEAT"):
                ok = plain(arg[2])
            else:
                ok = op in ("LITERAL", "NOT_LITERAL", "ANY", "IN") or (op == "AT" and str(arg) in ("AT_BOUNDARY", "AT_NON_BOUNDARY"))
            if not ok:
                return False
        return True

    tree = _parse(pattern)
    return tree is not None and plain(tree)


#: More literals that start a pattern than these are cut.
_MOST_STARTS = 64


def _starts(tree) -> list[tuple[str, bool]]:
    """Lowercase literals, one of which starts every match of the parsed pattern, each with whether it is all of a match."""
    found = [("", True)]
    for op, arg in _items(tree):
        if not any(whole for _, whole in found):
            break
        if op in ("AT", "ASSERT", "ASSERT_NOT"):
            continue
        if op == "LITERAL" and 31 < arg < 127:
            more = [(chr(arg).lower(), True)]
        elif op == "IN" and all(str(o) == "LITERAL" and 31 < x < 127 for o, x in arg):
            more = [(chr(x).lower(), True) for _, x in arg]
        elif op == "SUBPATTERN":
            more = _starts(arg[3])
        elif op == "BRANCH":
            more = [m for branch in arg[1] for m in _starts(branch)]
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            once = _starts(arg[2])
            more = [("", True)] * (arg[0] == 0) + [(w, whole and arg[1] == 1) for w, whole in once]
        else:
            more = [("", False)]
        longer = list(dict.fromkeys((w + m, ends) for w, whole in found for m, ends in (more if whole else [("", False)])))
        if len(longer) > _MOST_STARTS:
            return _cut(longer)
        found = longer
    return found


def _cut(starts):
    """The literals cut to a length at which they are few enough."""
    longest = max(len(w) for w, _ in starts)
    while len(starts) > _MOST_STARTS:
        longest -= 1
        starts = list(dict.fromkeys((w[:longest], whole and len(w) <= longest) for w, whole in starts))
    return starts


def _leading(tree):
    """Literals, one of which starts every match, or None."""
    found = {w for w, _ in _starts(tree)}
    return frozenset(w for w in found if not any(o != w and w.startswith(o) for o in found)) if found and all(found) else None


def _parse(pattern):
    try:
        from re import _parser
    except ImportError:
        return None
    try:
        return _parser.parse(pattern)
    except re.error:
        return None


@lru_cache(maxsize=None)
def keywords(pattern: str):
    tree = _parse(pattern)
    return None if tree is None else _required(tree)


@lru_cache(maxsize=None)
def leading_keywords(pattern: str):
    tree = _parse(pattern)
    return None if tree is None else _leading(tree)


def all_keywords(patterns, find=keywords):
    """Literals covering every pattern, longest needed only, or None when one pattern has none."""
    found = [find(p) for p in patterns]
    if not found or not all(found):
        return None
    words = frozenset().union(*found)
    return sorted(w for w in words if not any(o != w and o in w for o in words))


def glob_to_regex(glob: str) -> str:
    """Path glob: ``**`` crosses folders (dot folders too), ``*`` and ``?`` stay inside one name, ``{a,b}`` is a choice."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^(?:{out})$"


def star_to_regex(text: str) -> str:
    """Id or path pattern in which only ``*`` is special to the writer: ``*`` stands for any text."""
    return text.replace("*", ".*")
