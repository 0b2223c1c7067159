"""Loose access control in queries, roles, sessions and cross-origin headers."""

# Ids, severities, titles, citations and patterns of this pack.
RULES = [
    {
        "id": "select-star",
        "category": "access-control",
        "severity": "medium",
        "title": "SELECT * on sensitive table",
        "reference": "§164.312(a)(1), §164.312(d)",
        "patterns": [
            r"(?i)\*\s*FROM\s+(patient|user|health|medical)",
        ],
    },
    {
        "id": "hardcoded-admin",
        "category": "access-control",
        "severity": "high",
        "title": "Hardcoded admin role",
        "reference": "§164.312(a)(1), §164.312(d)",
        "patterns": [
            r"""(?i)role\s*[:=]\s*['"`](admin|root|superuser)['"`]""",
        ],
    },
    {
        "id": "auth-bypass",
        "category": "access-control",
        "severity": "critical",
        "title": "Potential authentication bypass",
        "reference": "§164.312(a)(1), §164.312(d)",
        "patterns": [
            r"(?i)bypass.*auth|auth.*bypass|skip.*auth",
        ],
    },
    {
        "id": "admin-flag",
        "category": "access-control",
        "severity": "medium",
        "title": "Hardcoded admin flag",
        "reference": "§164.312(a)(1), §164.312(d)",
        "patterns": [
            r"(?i)isAdmin\s*[:=]\s*true|admin\s*[:=]\s*true",
        ],
    },
    {
        "id": "public-password",
        "category": "access-control",
        "severity": "critical",
        "title": "Password field with public visibility",
        "reference": "§164.312(a)(1), §164.312(d)",
        "patterns": [
            r"(?i)public\s+(static\s+)?.*password|password.*public",
        ],
    },
    {
        "id": "cors-wildcard",
        "category": "access-control",
        "severity": "high",
        "title": "CORS wildcard origin",
        "reference": "§164.312(a)(1), §164.312(d)",
        "patterns": [
            r"(?i)allow.*origin.*\*",
        ],
    },
    {
        "id": "no-session-expiry",
        "category": "access-control",
        "severity": "high",
        "title": "Session without expiration",
        "reference": "§164.312(a)(1), §164.312(d)",
        "patterns": [
            r"(?i)session.*expires?\s*[:=]\s*0|maxAge\s*:\s*0",
        ],
    },
]
