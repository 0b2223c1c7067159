"""Text helpers used by reports: paths, citations, HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanweave.functions.regex import to_java
from scanweave.functions.sql import lit

# Section names and folders that end a runner prefix.
SECTION_NAMES = {
    "164.308(a)(1)(ii)(A)": "Risk Analysis",
    "164.308(a)(7)(ii)(A)": "Data Backup Plan",
    "164.308(a)(8)": "Evaluation",
    "164.312(a)(1)": "Access Control",
    "164.312(a)(2)(i)": "Unique User Identification",
    "164.312(a)(2)(iii)": "Automatic Logoff",
    "164.312(a)(2)(iv)": "Encryption and Decryption",
    "164.312(b)": "Audit Controls",
    "164.312(c)": "Integrity",
    "164.312(d)": "Person or Entity Authentication",
    "164.312(e)(1)": "Transmission Security",
    "164.502": "Uses and Disclosures of PHI: General Rules",
    "164.502(b)": "Minimum Necessary",
    "164.514": "De-identification and Minimum Necessary",
    "164.530(j)": "Documentation",
}
PROJECT_FOLDERS = "src|lib|app|components|pages|public|test|tests|spec|__tests__|config|scripts|packages"
THREATS = {
    "phi-exposure": "Unauthorized PHI Disclosure",
    "encryption": "Data Breach / Interception",
    "audit-logging": "Lack of Accountability / Forensics",
    "access-control": "Unauthorized Access / Privilege Escalation",
    "data-retention": "Non-Compliance with Retention Requirements",
}


def clean_path(column: str, scan_prefix: str = "scan") -> Column:
    """Strips build-runner and temporary scan prefixes."""
    c = F.regexp_replace(column, r"^/home/runner/work/[^/]+/[^/]+/", "")
    c = F.regexp_replace(c, rf"^/tmp/{scan_prefix}-[^/]+/[^/]+/", "")
    c = F.regexp_replace(c, rf"^/home/runner/work/.*?/({PROJECT_FOLDERS})/", "$1/")
    return F.regexp_replace(c, r"^\./", "")


def relative_path(column: str, root: str) -> Column:
    """Path below the scan root; a path outside it shows its last part only."""
    c, r = F.col(column), F.col(root)
    inside = F.startswith(c, F.concat(r, F.lit("/")))
    return (
        F.when(F.coalesce(c, F.lit("")) == "", "")
        .when(~F.startswith(c, F.lit("/")), c)
        .when(inside, F.expr(f"substring({column}, length({root}) + 2)"))
        .otherwise(F.element_at(F.split(c, "/"), -1))
    )


def format_reference(column: str) -> Column:
    """Citations in one style: ``45 CFR §x — name``, several joined by ``; ``."""
    space = to_java(r"\s")
    dash = "[-–—]"
    section = f"regexp_replace(regexp_extract(p, {lit(to_java(r'(\d{3}\.\d+(?:\s*\([^)]*\))*)'))}, 1), {lit(space + '+')}, '')"
    inline = f"regexp_extract(p, {lit(dash + to_java(r'\s*(.+)$'))}, 1)"
    names = "map(" + ", ".join(f"{lit(k)}, {lit(v)}" for k, v in SECTION_NAMES.items()) + ")"
    # the longest known section that the citation is, or lies below: what follows it starts with a bracket
    fits = f"filter(map_keys({names}), k -> {section} = k OR startswith({section}, concat(k, '(')))"
    longest = f"get(array_sort(transform({fits}, k -> named_struct('n', -length(k), 'k', k))), 0).k"
    name = f"coalesce(nullif(trim({inline}), ''), element_at({names}, {longest}))"
    canonical = (
        f"concat('45 CFR §', {section}, coalesce(concat(' — ', {name}), ''), "
        f"CASE WHEN p RLIKE {lit(to_java(r'(?i)\bNPRM\b'))} THEN ' (NPRM — proposed rule)' ELSE '' END)")
    cut = r",\s*(?=(?:45 CFR|NPRM|§|\d{3}\.))".replace(r"§", "§")
    parts = f"filter(transform(split({column}, {lit(to_java(cut))}), p -> trim(p)), p -> p NOT IN ('', '-', '—'))"
    joined = f"array_join(transform({parts}, p -> CASE WHEN {section} = '' THEN p ELSE {canonical} END), '; ')"
    return F.expr(f"coalesce(nullif({joined}, ''), '—')")


def escape_html(column: str) -> Column:
    c = F.col(column)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def title_category(column: str) -> Column:
    return F.initcap(F.replace(F.col(column), F.lit("-"), F.lit(" ")))


def threat(column: str) -> Column:
    names = F.create_map(*[F.lit(x) for kv in THREATS.items() for x in kv])
    return F.coalesce(names[F.col(column)], F.lit("Security Vulnerability"))


def risk_level(column: str) -> Column:
    return F.when(F.col(column).isin("critical", "high", "medium", "low", "info"), F.upper(column)).otherwise("MEDIUM")


def mitigation(fix_type: str) -> Column:
    return F.when(F.col(fix_type).isNotNull(), "Remediation Available (Auto-fix)").otherwise("Open")
