"""What a rule is: patterns, the text each one is tried on, and the conditions that drop a match."""

from __future__ import annotations

from dataclasses import dataclass, field

SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1}
CATEGORIES = ["phi-exposure", "encryption", "audit-logging", "access-control", "data-retention"]


@dataclass(frozen=True)
class Scope:
    """Text a condition is tried on.

    ``line``; ``window`` = lines from ``before`` above to ``after`` below joined by newlines, comment lines left
    out if ``code_only``; ``flat`` = the window with whitespace runs folded to one space; ``span`` = the line and
    ``after`` below, the match starting on the line itself; ``path``; ``content`` = the whole file.
    """

    kind: str
    before: int = 0
    after: int = 0
    code_only: bool = False


LINE = Scope("line")
PATH = Scope("path")
CONTENT = Scope("content")


def window(before: int, after: int, code_only: bool = False) -> Scope:
    return Scope("window", before, after, code_only)


@dataclass(frozen=True)
class Condition:
    scope: Scope
    patterns: tuple


@dataclass(frozen=True)
class Rule:
    no: int
    pack: str
    id: str
    category: str
    severity: str
    title: str
    reference: str
    patterns: tuple
    negatives: tuple = ()
    fix_type: str | None = None
    confidence: str | None = None
    on: Scope = LINE
    skip: tuple = ()
    skip_imports: bool = False
    skip_path: str | None = None
    client_only: bool = False
    require: tuple = ()
    forbid: tuple = ()
    guard: str | None = None
    include: tuple = ()
    exclude: tuple = ()
    adjust_confidence: bool = True
    advice: str | None = None


@dataclass(frozen=True)
class Pack:
    name: str
    no: int
    path: str
    finding_id: str
    context: int | None
    advice: str
    rules: tuple = field(default=())
