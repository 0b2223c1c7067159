"""The built-in rule catalog: pack tables plus the scope each pack applies to its rules."""

from __future__ import annotations

import importlib
import re
from functools import lru_cache

from scanweave.rules.model import CONTENT, LINE, PATH, Condition, Pack, Rule, Scope, window

# File types per pack.
CODE = r"\.(?:ts|js|tsx|jsx|py|java|go|rb|php)$"
CODE_SQL = r"\.(?:ts|js|tsx|jsx|py|java|go|rb|php|sql)$"
CODE_SQL_ENV = r"\.(?:ts|js|tsx|jsx|py|java|go|rb|php|env|sql)$"
CODE_SQL_YAML = r"\.(?:ts|js|tsx|jsx|py|java|go|rb|php|sql|yaml|yml)$"
CODE_DATA = r"\.(?:ts|js|tsx|jsx|py|java|go|rb|php|env|yaml|yml|json|xml)$"
CODE_CS = r"(?i)\.(?:js|ts|jsx|tsx|py|java|go|rb|php|cs)$"
WEB_CONFIG = r"(?i)\.(?:js|ts|jsx|tsx|json|yaml|yml|env)$"
WEB_SQL = r"(?i)\.(?:js|ts|jsx|tsx|sql|prisma)$"
CODE_SECRETS = r"(?i)\.(?:js|ts|jsx|tsx|py|java|go|rb|php|cs|yml|yaml|json)$|(?:^|[\\/])\.env(?:\.[\w-]+)*$|\.env$"
WEB_MODULES = r"\.(?:ts|tsx|js|jsx|mjs|cjs)$"
WEB_MODULES_DATA = r"\.(?:ts|tsx|js|jsx|mjs|cjs|json|yml|yaml)$"
WEB = r"\.(?:ts|tsx|js|jsx)$"
SKILL_FILES = r"(?:SKILL\.md|skill\.md|\.skill\.md)$|/skills/|/\.clawrc/"
AUDITED_CODE = r"\.(?:ts|js|tsx|jsx|py|java|go)$"

# Lines left out of matching.
COMMENT_OR_HASH = r"^\s*(?://|#|/\*|\*)"
COMMENT = r"^\s*(?://|/\*|\*)"
SLASH_COMMENT = r"^\s*//"
BLANK = r"^\s*$"
TEST_FILE = r"\.(?:test|spec)\.[jt]sx?$"
IMPORT_LINE = (
    r"^import\b",
    r"""^\}\s*from\s+['"]""",
    r"""^export\b[^=]*\bfrom\s+['"]""",
    r"^(?:const|let|var)\s+[^=]+=\s*require\s*\(",
    r"^require\s*\(",
)

# Hosts that may be linked over plain http.
SAFE_HTTP_DOMAINS = [
    "www.w3.org",
    "w3.org",
    "xmlns.com",
    "purl.org",
    "ns.adobe.com",
    "cdnjs.cloudflare.com",
    "unpkg.com",
    "jsdelivr.net",
    "cdn.jsdelivr.net",
    "googleapis.com",
    "fonts.googleapis.com",
    "ajax.googleapis.com",
    "gstatic.com",
    "fonts.gstatic.com",
    "cloudflare.com",
    "bootstrapcdn.com",
    "maxcdn.bootstrapcdn.com",
    "stackpath.bootstrapcdn.com",
    "code.jquery.com",
    "cdn.tailwindcss.com",
    "schema.org",
    "ogp.me",
    "rdfs.org",
    "hl7.org",
    "www.hl7.org",
    "fhir.org",
    "terminology.hl7.org",
    "loinc.org",
    "snomed.info",
    "icd.who.int",
    "unitsofmeasure.org",
    "nucc.org",
    "ada.org",
    "x12.org",
    "opensource.org",
    "creativecommons.org",
    "spdx.org",
    "json-schema.org",
    "yaml.org",
    "xml.org",
    "maven.apache.org",
    "www.apache.org",
    "registry.npmjs.org",
    "pypi.org",
    "rubygems.org",
    "crates.io",
    "pkg.go.dev",
    "mvnrepository.com",
    "example.com",
    "example.org",
    "localhost",
    "127.0.0.1",
]
SAFE_HTTP = "|".join(re.escape(d) for d in SAFE_HTTP_DOMAINS)
REDUCED_PATH = (
    r"(?i)\.(?:test|spec)\.[^.]+$|__tests__|__mocks__|/fixtures/|/examples/|/docs/|/migrations?/|/seeds?/"
)
REFERENCE_LINE = r"(?i)\b(?:see|docs|reference|spec|rfc|example|documentation)\b"
PASSWORD_WORDS = r"(?i)password|passwd|pwd|credential|auth"
CORS_TRIGGER = r"(?i)cors|setHeader|\.header|headers\.set|origin.*\*"
UPLOAD_CALL = r"(?i)\bmulter\s*\(|\bformidable\s*\(|\bBusboy\s*\(|IncomingForm\s*\("
WINDOWED_NEGATIVE = r"(?i)NODE_ENV|isDevelopment|redact|mask|sanitize|obfuscate"

# Name, file types, finding id form, lines of context.
PACKS = [
    ("phi", CODE, "phi-{id}-{i}", 2, "Keep personal health data out of code; read it from an encrypted store."),
    ("encryption", CODE_DATA, "{id}-{i}", 2, "Use strong ciphers and hashes, TLS in transit and encrypted backups."),
    ("access", CODE_SQL, "access-{id}-{i}", 2, "Grant the least access that works and decide it on the server."),
    ("security", CODE_SQL_ENV, "security-{id}-{i}", 2, "Move secrets to a vault, bind parameters, harden cookies."),
    ("retention", CODE_SQL_YAML, "retention-{id}-{i}", 2, "Keep records for the required years and log deletions."),
    ("skills", SKILL_FILES, "{id}", 3, "Remove personal data, secrets and harmful commands from the skill."),
    ("hipaa2026", CODE_CS, "{id}", None, "Add the control that the cited section requires."),
    ("authentication", WEB_CONFIG, "{id}", None, "Require a second factor for every sign-in."),
    ("rbac", WEB_SQL, "{id}", None, "Check the caller's role before records are read."),
    ("credentials", CODE_SECRETS, "{id}", None, "Hash with a slow algorithm; load secrets from the environment."),
    ("errors", WEB, "{id}", None, "Return neutral errors and redact personal data in logs."),
    ("sanitization", WEB, "{id}", None, "Validate request data and limit uploads."),
    ("revocation", WEB, "{id}", None, "Keep tokens short-lived and revocable."),
    ("configuration", WEB, "{id}", None, "Switch off debug modes, set security headers, drop test code."),
    ("api_security", WEB_MODULES, "{id}", None, "Throttle sign-in, name allowed origins, keep personal data out of links."),
    ("operational", WEB_MODULES, "{id}", None, "Plan backups, set retention fields and body limits."),
]
PACK_NAMES = [p[0] for p in PACKS]
LINE_PACKS = ["phi", "encryption", "access", "security", "retention"]

# Packs run for each category; errors runs for two.
CATEGORY_PACKS = {
    "phi-exposure": ["phi", "errors"],
    "encryption": ["encryption", "credentials"],
    "audit-logging": ["audit", "errors", "configuration"],
    "access-control": [
        "access", "security", "skills", "hipaa2026", "authentication", "rbac", "sanitization", "revocation",
        "api_security",
    ],
    "data-retention": ["retention", "operational"],
}

# Rules decided over a whole file or project, not on a line.
FILE_LEVEL = {"MFA-001", "BACKUP-001", "HIPAA-ASSET-001", "HIPAA-FLOW-001", "HIPAA-PENTEST-001"}


def _scopes(pack: str, rid: str, negatives: tuple) -> dict:
    """Run parameters of one rule: where it looks, what it skips, what drops a match."""
    ci_test = "(?i)" + TEST_FILE

    def drop(*scopes):
        return tuple(Condition(s, negatives) for s in scopes) if negatives else ()

    if pack == "encryption" and rid == "enc-http-url":
        return dict(skip_path=REDUCED_PATH, skip=(COMMENT_OR_HASH, REFERENCE_LINE, SAFE_HTTP))
    if pack == "security" and rid in ("hardcoded-password", "hardcoded-secret"):
        return dict(skip_path="test|spec|mock")
    if rid == "short-retention":
        return dict(guard="short_retention")
    if pack == "hipaa2026":
        return dict(on=Scope("span", 0, 5), skip_imports=True, forbid=drop(window(6, 5)))
    if pack == "authentication":
        negatives = tuple(p for p in negatives if "console" not in p.lower())
        extra = dict(skip_path=ci_test) if rid == "MFA-003" else {}
        console = (r"(?i)console\.(?:log|warn|error)",) if rid == "MFA-003" else ()
        return dict(on=Scope("span", 0, 5), skip=(COMMENT_OR_HASH, *console), skip_imports=True,
                    forbid=drop(window(6, 5)), **extra)
    if pack == "rbac":
        if rid == "RBAC-002":
            return dict(skip=(COMMENT_OR_HASH,), client_only=True, forbid=drop(PATH, CONTENT))
        return dict(skip=(COMMENT_OR_HASH,), forbid=drop(window(10, 5) if rid == "RBAC-001" else window(2, 2)))
    if rid == "CRED-001":
        return dict(skip=(COMMENT_OR_HASH,), require=(Condition(window(5, 5), (PASSWORD_WORDS,)),),
                    forbid=drop(window(5, 5)))
    if pack == "credentials":
        return dict(skip=(COMMENT_OR_HASH, BLANK), forbid=drop(LINE),
                    guard="literal_value" if rid == "CRED-002" else None)
    if pack == "errors":
        near = tuple(p for p in negatives if re.search(WINDOWED_NEGATIVE, p))
        same = tuple(p for p in negatives if p not in near)
        return dict(skip=(BLANK,), skip_path=TEST_FILE if rid == "ERROR-002" else None,
                    forbid=(Condition(window(5, 5), near), Condition(LINE, same)))
    if pack == "sanitization":
        call = dict(skip=(BLANK, SLASH_COMMENT, r"(?i)^import\s", r"(?i)^const\s+\w+\s*=\s*require"),
                    require=(Condition(LINE, (UPLOAD_CALL,)),)) if rid == "SANITIZE-002" else {}
        return dict(skip=(BLANK, SLASH_COMMENT), forbid=drop(window(10, 5, True))) | call
    if pack == "revocation":
        near = (window(20, 10, True),) if rid == "REVOKE-001" else (LINE, window(10, 5, True))
        return dict(skip=(BLANK, SLASH_COMMENT), forbid=drop(*near))
    if pack == "configuration":
        near = {"CONFIG-001": (window(5, 5, True),), "CONFIG-002": (window(20, 10, True),)}.get(rid, ())
        return dict(skip=(BLANK, SLASH_COMMENT), forbid=drop(*near),
                    skip_path=TEST_FILE if rid == "CONFIG-003" else None)
    if rid == "CORS-001":
        return dict(on=Scope("flat", 2, 2), skip=(COMMENT,), require=(Condition(LINE, (CORS_TRIGGER,)),),
                    forbid=drop(window(2, 2, True)))
    if pack in ("api_security", "operational"):
        near = {"RATE-001": (10, 9), "API-001": (1, 1), "RETENTION-001": (5, 9), "API-002": (2, 2)}[rid]
        return dict(skip=(COMMENT,), forbid=drop(window(*near, True)))
    return {}


@lru_cache(maxsize=None)
def packs() -> dict:
    """Pack name to :class:`Pack`; rule numbers follow the order of the tables."""
    out, no = {}, 0
    for pack_no, (name, path, finding_id, context, advice) in enumerate(PACKS):
        confidence = {"operational": "medium"}.get(name, None if context == 2 else "high")
        rules = []
        for row in importlib.import_module(f"scanweave.rules.packs.{name}").RULES:
            no += 1
            negatives = tuple(row.get("negatives", ()))
            scopes = {} if row["id"] in FILE_LEVEL else _scopes(name, row["id"], negatives)
            rules.append(Rule(
                no=no, pack=name, id=row["id"], category=row["category"], severity=row["severity"],
                title=row["title"], reference=row["reference"], patterns=tuple(row["patterns"]),
                negatives=negatives, fix_type=row.get("fix_type"),
                confidence=row.get("confidence", confidence), **scopes))
        out[name] = Pack(name, pack_no, path, finding_id, context, advice, tuple(rules))
    return out


def rule(rule_id: str) -> Rule:
    return next(r for p in packs().values() for r in p.rules if r.id == rule_id)


def line_rules(names=None):
    """Rules decided line by line, as (pack, rule)."""
    for name in names or PACK_NAMES:
        for r in packs()[name].rules:
            if r.id not in FILE_LEVEL:
                yield packs()[name], r
