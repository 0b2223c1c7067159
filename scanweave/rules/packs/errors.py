"""Error details or personal data leaking through responses and logs."""

# Ids, severities, titles, citations and patterns of this pack.
RULES = [
    {
        "id": "ERROR-001",
        "category": "audit-logging",
        "severity": "high",
        "title": "Unsanitized Error Details Sent to User",
        "reference": "45 CFR §164.312(b) - Audit Controls",
        "patterns": [
            r"(?i)res\.(?:send|json)\s*\([^)]*err(?:or)?\.stack",
            r"(?i)res\.(?:send|json)\s*\([^)]*err(?:or)?\.message",
            r"(?i)res\.(?:send|json)\s*\(\s*err(?:or)?\s*\)",
            r"(?i)return.*?res\.(?:send|json)\s*\(\s*err(?:or)?\s*\)",
            r"(?i)response\.(?:send|json)\s*\([^)]*err(?:or)?\.(?:stack|message)",
            r"(?i)next\s*\(\s*err(?:or)?\s*\)",
            r"(?i)throw.*?err(?:or)?\.stack",
        ],
        "negatives": [
            r"(?i)sanitize",
            r"(?i)safe.*?error",
            r"(?i)filterError",
            r"""(?i)['"](?:An error occurred|Internal server error|Something went wrong)""",
            r"(?i)console\.",
            r"(?i)logger\.",
            r"(?i)log\(",
            r"""(?i)process\.env\.NODE_ENV\s*===?\s*['"]development['"]""",
            r"(?i)isDevelopment",
        ],
    },
    {
        "id": "ERROR-002",
        "category": "phi-exposure",
        "severity": "critical",
        "title": "PHI Data in Error Logs or Thrown Errors",
        "reference": "45 CFR §164.312(c) - Integrity Controls",
        "patterns": [
            r"(?i)console\.(?:log|error|warn|info|debug)\s*\([^)]*(?:patient|ssn|dob|mrn|diagnosis|medication|health[-_]?record)",
            r"(?i)logger\.(?:error|warn|info|debug|log)\s*\([^)]*(?:patient|ssn|dob|mrn|diagnosis|medication|health[-_]?record)",
            r"(?i)throw\s+(?:new\s+)?Error\s*\([^)]*(?:patient|ssn|dob|mrn|diagnosis|medication|health[-_]?record)",
            r"(?i)log\.(?:error|warn|info|debug)\s*\([^)]*(?:patient|ssn|dob|mrn|diagnosis|medication|health[-_]?record)",
            r"(?i)console\.[a-z]+\s*\([^)]*patient(?:Data|Info|Record|Object)",
            r"(?i)logger\.[a-z]+\s*\([^)]*health[-_]?record",
        ],
        "negatives": [
            r"(?i)redact",
            r"(?i)mask",
            r"(?i)sanitize",
            r"(?i)obfuscate",
            r"""(?i)['"]Patient not found['"]""",
            r"""(?i)['"]Invalid patient ID['"]""",
            r"""(?i)['"]Health record""",
            r"(?i)patient[-_]?id\b",
            r"(?i)\.test\.",
            r"(?i)\.spec\.",
            r"(?i)describe\(",
        ],
    },
]
