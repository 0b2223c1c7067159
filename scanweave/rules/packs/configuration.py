"""Debug switches, missing security headers, test code in production."""

# Ids, severities, titles, citations and patterns of this pack.
RULES = [
    {
        "id": "CONFIG-001",
        "category": "audit-logging",
        "severity": "high",
        "title": "Debug/Verbose Mode Without Environment Gate",
        "reference": "NPRM Configuration Management",
        "patterns": [
            r"(?i)\bdebug\s*:\s*true\b",
            r"\bDEBUG\s*:\s*true\b",
            r"(?i)\bverbose\s*:\s*true\b",
            r"(?i)\bdevTools\s*:\s*true\b",
            r"(?i)\bdebug\s*=\s*true\b",
            r"""(?i)process\.env\.DEBUG\s*=\s*['"]true['"]""",
        ],
        "negatives": [
            r"(?i)NODE_ENV",
            r"(?i)process\.env\.NODE_ENV",
            r"(?i)isDevelopment",
            r"(?i)isProduction",
            r"""(?i)\.env\s*===?\s*['"]development['"]""",
            r"""(?i)\.env\s*!==?\s*['"]production['"]""",
            r"(?i)if\s*\(",
            r"(?i)\?\s*true\s*:\s*false",
            r"(?i)\.test\.",
            r"(?i)\.spec\.",
            r"(?i)describe\(",
            r"(?i)it\(",
            r"(?i)interface\s+",
            r"(?i)type\s+\w+\s*=",
            r"^\s*//",
            r"^\s*/\*",
        ],
    },
    {
        "id": "CONFIG-002",
        "category": "audit-logging",
        "severity": "medium",
        "title": "Web Server Without Security Headers Middleware",
        "reference": "NPRM Configuration Management",
        "patterns": [
            r"(?i)(?:const|let|var)\s+\w+\s*=\s*express\s*\(\s*\)",
            r"(?i)(?:http|https)\.createServer\s*\(",
            r"(?i)new\s+Hono\s*\(",
            r"(?i)new\s+Elysia\s*\(",
            r"(?i)fastify\s*\(\s*\{",
            r"(?i)new\s+Koa\s*\(",
        ],
        "negatives": [
            r"(?i)helmet\s*\(",
            r"(?i)app\.use\s*\(\s*helmet",
            r"(?i)Content-Security-Policy",
            r"(?i)X-Frame-Options",
            r"(?i)X-Content-Type-Options",
            r"(?i)Strict-Transport-Security",
            r"(?i)X-XSS-Protection",
            r"(?i)setHeader\s*\(",
            r"""(?i)\.set\s*\(\s*['"]X-Frame-Options['"]""",
            r"(?i)\.header\s*\(",
            r"(?i)cors\s*\(",
            r"(?i)compression\s*\(",
            r"(?i)security",
        ],
    },
    {
        "id": "CONFIG-003",
        "category": "audit-logging",
        "severity": "low",
        "title": "Test Framework Imports in Production Code",
        "reference": "NPRM Configuration Management",
        "patterns": [
            r"""(?i)import\s+.*?from\s+['"]@?jest""",
            r"""(?i)require\s*\(\s*['"]@?jest""",
            r"""(?i)import\s+.*?from\s+['"]vitest['"]""",
            r"""(?i)require\s*\(\s*['"]vitest['"]""",
            r"""(?i)import\s+.*?from\s+['"]mocha['"]""",
            r"""(?i)require\s*\(\s*['"]mocha['"]""",
            r"""(?i)import\s+.*?from\s+['"]chai['"]""",
            r"""(?i)require\s*\(\s*['"]chai['"]""",
            r"""(?i)import\s+.*?from\s+['"]@?faker""",
            r"""(?i)require\s*\(\s*['"]@?faker""",
            r"""(?i)import\s+.*?from\s+['"]cypress['"]""",
            r"""(?i)require\s*\(\s*['"]cypress['"]""",
            r"""(?i)import\s+.*?from\s+['"]@testing-library""",
            r"""(?i)require\s*\(\s*['"]@testing-library""",
        ],
    },
]
