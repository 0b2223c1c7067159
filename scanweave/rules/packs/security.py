"""Hardcoded credentials, exposed keys, injection and unsafe cookies."""

# Ids, severities, titles, citations and patterns of this pack.
RULES = [
    {
        "id": "hardcoded-password",
        "category": "access-control",
        "severity": "critical",
        "title": "Hardcoded password detected",
        "reference": "§164.312(a)(1), §164.312(d)",
        "fix_type": "hardcoded-password",
        "patterns": [
            r"""(?i)password\s*[:=]\s*['"`][^'"`]{4,}['"`]""",
        ],
    },
    {
        "id": "hardcoded-pwd",
        "category": "access-control",
        "severity": "critical",
        "title": "Hardcoded password (pwd) detected",
        "reference": "§164.312(a)(1), §164.312(d)",
        "fix_type": "hardcoded-password",
        "patterns": [
            r"""(?i)pwd\s*[:=]\s*['"`][^'"`]{4,}['"`]""",
        ],
    },
    {
        "id": "hardcoded-secret",
        "category": "access-control",
        "severity": "critical",
        "title": "Hardcoded secret detected",
        "reference": "§164.312(a)(1), §164.312(d)",
        "fix_type": "hardcoded-secret",
        "patterns": [
            r"""(?i)secret\s*[:=]\s*['"`][^'"`]{8,}['"`]""",
        ],
    },
    {
        "id": "credentials-object",
        "category": "access-control",
        "severity": "high",
        "title": "Credentials object with password",
        "reference": "§164.312(a)(1), §164.312(d)",
        "patterns": [
            r"(?i)credentials?\s*[:=]\s*\{[^}]*password\s*:",
        ],
    },
    {
        "id": "api-key-exposed",
        "category": "access-control",
        "severity": "critical",
        "title": "API key exposed in source",
        "reference": "§164.312(a)(1), §164.312(d)",
        "fix_type": "api-key-exposed",
        "patterns": [
            r"""(?i)api[_-]?key\s*[:=]\s*['"`][A-Za-z0-9_-]{20,}['"`]""",
        ],
    },
    {
        "id": "apikey-exposed",
        "category": "access-control",
        "severity": "critical",
        "title": "API key (apikey) exposed in source",
        "reference": "§164.312(a)(1), §164.312(d)",
        "fix_type": "api-key-exposed",
        "patterns": [
            r"""(?i)apikey\s*[:=]\s*['"`][A-Za-z0-9_-]{20,}['"`]""",
        ],
    },
    {
        "id": "stripe-key-exposed",
        "category": "access-control",
        "severity": "critical",
        "title": "Stripe API key exposed",
        "reference": "§164.312(a)(1), §164.312(d)",
        "patterns": [
            r"(?i)(sk|pk)[_-](live|test)[_-][A-Za-z0-9]{20,}",
        ],
    },
    {
        "id": "aws-key-exposed",
        "category": "access-control",
        "severity": "critical",
        "title": "AWS Access Key exposed",
        "reference": "§164.312(a)(1), §164.312(d)",
        "patterns": [
            r"AKIA[0-9A-Z]{16}",
        ],
    },
    {
        "id": "bearer-token-exposed",
        "category": "access-control",
        "severity": "high",
        "title": "Bearer token in source",
        "reference": "§164.312(a)(1), §164.312(d)",
        "patterns": [
            r"(?i)bearer\s+[A-Za-z0-9_.-]{20,}",
        ],
    },
    {
        "id": "auth-token-exposed",
        "category": "access-control",
        "severity": "critical",
        "title": "Auth token exposed in source",
        "reference": "§164.312(a)(1), §164.312(d)",
        "patterns": [
            r"""(?i)auth[_-]?token\s*[:=]\s*['"`][A-Za-z0-9_.-]{20,}['"`]""",
        ],
    },
    {
        "id": "private-key-exposed",
        "category": "access-control",
        "severity": "critical",
        "title": "Private key exposed in source",
        "reference": "§164.312(a)(1), §164.312(d)",
        "patterns": [
            r"""(?i)private[_-]?key\s*[:=]\s*['"`]-----BEGIN""",
        ],
    },
    {
        "id": "mongodb-uri-credentials",
        "category": "access-control",
        "severity": "critical",
        "title": "MongoDB URI with credentials",
        "reference": "§164.312(a)(1), §164.312(d)",
        "patterns": [
            r"(?i)mongodb(\+srv)?://[^:]+:[^@]+@",
        ],
    },
    {
        "id": "postgres-uri-credentials",
        "category": "access-control",
        "severity": "critical",
        "title": "PostgreSQL URI with credentials",
        "reference": "§164.312(a)(1), §164.312(d)",
        "patterns": [
            r"(?i)postgres(ql)?://[^:]+:[^@]+@",
        ],
    },
    {
        "id": "mysql-uri-credentials",
        "category": "access-control",
        "severity": "critical",
        "title": "MySQL URI with credentials",
        "reference": "§164.312(a)(1), §164.312(d)",
        "patterns": [
            r"(?i)mysql://[^:]+:[^@]+@",
        ],
    },
    {
        "id": "innerhtml-unsanitized",
        "category": "access-control",
        "severity": "high",
        "title": "Unsanitized innerHTML assignment",
        "reference": "§164.312(a)(1), §164.312(d)",
        "fix_type": "innerhtml-unsanitized",
        "patterns": [
            r"""(?i)\.innerHTML\s*=\s*[^'"`\s;]+""",
        ],
    },
    {
        "id": "dangerous-innerhtml-react",
        "category": "access-control",
        "severity": "high",
        "title": "dangerouslySetInnerHTML usage",
        "reference": "§164.312(a)(1), §164.312(d)",
        "patterns": [
            r"(?i)dangerouslySetInnerHTML\s*=\s*\{\s*\{\s*__html:",
        ],
    },
    {
        "id": "eval-usage",
        "category": "access-control",
        "severity": "critical",
        "title": "eval() usage detected",
        "reference": "§164.312(a)(1), §164.312(d)",
        "patterns": [
            r"(?i)eval\s*\(\s*[^)]*\)",
        ],
    },
    {
        "id": "function-constructor",
        "category": "access-control",
        "severity": "high",
        "title": "Function constructor usage",
        "reference": "§164.312(a)(1), §164.312(d)",
        "patterns": [
            r"(?i)new\s+Function\s*\([^)]*\)",
        ],
    },
    {
        "id": "document-write",
        "category": "access-control",
        "severity": "medium",
        "title": "document.write usage",
        "reference": "§164.312(a)(1), §164.312(d)",
        "patterns": [
            r"(?i)document\.write\s*\(",
        ],
    },
    {
        "id": "sql-string-concat",
        "category": "access-control",
        "severity": "critical",
        "title": "SQL query string concatenation",
        "reference": "§164.312(a)(1), §164.312(d)",
        "fix_type": "sql-injection-concat",
        "patterns": [
            r"""(?i)\b(SELECT|INSERT|UPDATE|DELETE)\b.*['"`]\s*\+\s*\w+\s*\+?\s*['"`]?""",
        ],
    },
    {
        "id": "sql-template-literal",
        "category": "access-control",
        "severity": "critical",
        "title": "SQL query with template literal interpolation",
        "reference": "§164.312(a)(1), §164.312(d)",
        "fix_type": "sql-injection-template",
        "patterns": [
            r"(?i)\bSELECT\b.*\$\{[^}]+\}|\bWHERE\b.*\$\{[^}]+\}|\bINSERT\s+INTO\b.*\$\{[^}]+\}|\bUPDATE\b.*\bSET\b.*\$\{[^}]+\}|\bDELETE\s+FROM\b.*\$\{[^}]+\}",
        ],
    },
    {
        "id": "query-template-injection",
        "category": "access-control",
        "severity": "critical",
        "title": "Database query with template interpolation",
        "reference": "§164.312(a)(1), §164.312(d)",
        "fix_type": "sql-injection-template",
        "patterns": [
            r"(?i)\.(query|execute|raw|sql)\s*\(\s*`[^`]*\$\{",
        ],
    },
    {
        "id": "execute-string-concat",
        "category": "access-control",
        "severity": "critical",
        "title": "SQL execute with string concatenation",
        "reference": "§164.312(a)(1), §164.312(d)",
        "fix_type": "sql-injection-concat",
        "patterns": [
            r"""(?i)\.(query|execute|sql)\s*\(\s*['"][^'"]*['"]\s*\+""",
        ],
    },
    {
        "id": "raw-query-injection",
        "category": "access-control",
        "severity": "critical",
        "title": "Raw SQL query with interpolation",
        "reference": "§164.312(a)(1), §164.312(d)",
        "fix_type": "sql-injection-template",
        "patterns": [
            r"(?i)\$\{[^}]+\}\s*\)\s*$.*\b(SELECT|INSERT|UPDATE|DELETE)\b",
        ],
    },
    {
        "id": "cookie-no-httponly",
        "category": "access-control",
        "severity": "high",
        "title": "Cookie without httpOnly flag",
        "reference": "§164.312(a)(1), §164.312(d)",
        "fix_type": "cookie-insecure",
        "patterns": [
            r"(?i)res\.cookie\s*\([^)]+\)(?!.*httpOnly)",
        ],
    },
    {
        "id": "cookie-config-insecure",
        "category": "access-control",
        "severity": "high",
        "title": "Cookie configuration missing security flags",
        "reference": "§164.312(a)(1), §164.312(d)",
        "fix_type": "cookie-insecure",
        "patterns": [
            r"(?i)cookie\s*:\s*\{[^}]*\}(?!.*httpOnly)",
        ],
    },
]
