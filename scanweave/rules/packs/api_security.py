"""Unthrottled sign-in routes, open cross-origin access, personal data in links."""

# Ids, severities, titles, citations and patterns of this pack.
RULES = [
    {
        "id": "RATE-001",
        "category": "access-control",
        "severity": "high",
        "title": "Authentication Routes Without Rate Limiting",
        "reference": "45 CFR §164.312(a)(1) - Access Control",
        "patterns": [
            r"""(?i)(?:app|router)\.(?:post|get|put|patch|delete|all)\s*\(\s*['"`]/(?:api/)?(?:auth|login|signin|register|signup|password-reset|forgot-password)""",
            r"""(?i)fastify\.(?:post|get|route)\s*\(\s*['"`]/(?:api/)?(?:auth|login|signin|register|signup|password-reset|forgot-password)""",
            r"""(?i)app\.(?:post|get|put|patch|delete|all)\s*\(\s*['"`]/(?:api/)?(?:auth|login|signin|register|signup|password-reset|forgot-password)""",
            r"""(?i)route\s*\(\s*['"`]/(?:api/)?(?:auth|login|signin|register|signup|password-reset|forgot-password)""",
        ],
        "negatives": [
            r"(?i)rateLimit",
            r"(?i)rateLimiter",
            r"(?i)rate-limit",
            r"(?i)throttle",
            r"(?i)slowDown",
            r"(?i)slow-down",
            r"(?i)@upstash/ratelimit",
            r"(?i)upstash.*limit",
            r"(?i)express-rate-limit",
            r"(?i)express-slow-down",
            r"(?i)redis.*limit",
            r"(?i)limitAttempts",
            r"(?i)checkRateLimit",
            r"(?i)rateLimitMiddleware",
        ],
    },
    {
        "id": "CORS-001",
        "category": "access-control",
        "severity": "high",
        "title": "Open CORS Configuration (origin: \"*\")",
        "reference": "45 CFR §164.312(e)(1) - Transmission Security",
        "patterns": [
            r"""(?i)cors\s*\(\s*\{[^}]*origin\s*:\s*['"`]\*['"`]""",
            r"""(?i)cors\s*\(\s*\{[^}]*origin\s*:\s*['"`]\*['"`]""",
            r"""(?i)Access-Control-Allow-Origin['"`]?\s*[,:]?\s*['"`]\*""",
            r"""(?i)setHeader\s*\(\s*['"`]Access-Control-Allow-Origin['"`]\s*,\s*['"`]\*['"`]""",
            r"""(?i)\.header\s*\(\s*['"`]Access-Control-Allow-Origin['"`]\s*,\s*['"`]\*['"`]""",
            r"""(?i)headers\.set\s*\(\s*['"`]Access-Control-Allow-Origin['"`]\s*,\s*['"`]\*['"`]""",
        ],
        "negatives": [
            r"(?i)allowedOrigins",
            r"(?i)whitelist",
            r"(?i)allowlist",
            r"(?i)trustedOrigins",
            r"(?i)process\.env",
            r"(?i)env\.[A-Z_]*ORIGIN",
            r"(?i)ALLOWED_ORIGIN",
            r"(?i)validateOrigin",
            r"(?i)checkOrigin",
            r"(?i)\[.*?https?://",
            r"(?i)public",
            r"(?i)assets",
            r"(?i)static",
        ],
    },
    {
        "id": "API-001",
        "category": "phi-exposure",
        "severity": "high",
        "title": "PHI Data in URL Query Parameters",
        "reference": "45 CFR §164.312(a)(1) - Access Control",
        "patterns": [
            r"(?i)\?ssn=",
            r"(?i)&ssn=",
            r"(?i)\?dob=",
            r"(?i)&dob=",
            r"(?i)\?patient[-_]?name=",
            r"(?i)&patient[-_]?name=",
            r"(?i)\?patientName=",
            r"(?i)&patientName=",
            r"(?i)\?diagnosis=",
            r"(?i)&diagnosis=",
            r"(?i)\?medication=",
            r"(?i)&medication=",
            r"(?i)\?mrn=",
            r"(?i)&mrn=",
            r"(?i)\?health[-_]?record=",
            r"(?i)&health[-_]?record=",
            r"(?i)`[^`]*\?[^`]*(?:ssn|dob|patient[-_]?name|patientName|diagnosis|medication|mrn|health[-_]?record)=",
            r"""(?i)(?:params|searchParams|query)\.(?:append|set)\s*\(\s*['"`](?:ssn|dob|patient[-_]?name|patientName|diagnosis|medication|mrn|health[-_]?record)['"`]""",
        ],
        "negatives": [
            r"(?i)\.post\s*\(",
            r"(?i)\.put\s*\(",
            r"(?i)\.patch\s*\(",
            r"(?i)body:",
            r"(?i)data:",
            r"(?i)req\.body",
            r"(?i)request\.body",
            r"//",
            r"/\*",
            r"(?i)example",
            r"(?i)TODO",
            r"(?i)\.test\.",
            r"(?i)\.spec\.",
            r"(?i)describe\(",
        ],
    },
]
