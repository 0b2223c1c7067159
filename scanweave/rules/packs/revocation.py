"""Tokens without revocation or with long lives."""

# Ids, severities, titles, citations and patterns of this pack.
RULES = [
    {
        "id": "REVOKE-001",
        "category": "access-control",
        "severity": "high",
        "title": "JWT Without Server-Side Revocation Mechanism",
        "reference": "NPRM §164.308(a)(3)(ii)(C) - Access Revocation",
        "patterns": [
            r"(?i)jwt\.sign\s*\(",
            r"(?i)jsonwebtoken\.sign\s*\(",
            r"(?i)new\s+(?:SignJWT|CompactSign)\s*\(",
            r"(?i)jose\.(?:SignJWT|sign)",
            r"(?i)(?:create|generate)(?:Access)?Token\s*\([^)]*\)",
            r"(?i)\.sign\s*\([^)]*jwt",
        ],
        "negatives": [
            r"(?i)revoke",
            r"(?i)blacklist",
            r"(?i)allowlist",
            r"(?i)whitelist",
            r"(?i)denylist",
            r"(?i)tokenStore",
            r"(?i)invalidate",
            r"(?i)revokedTokens",
            r"(?i)tokenBlacklist",
            r"(?i)redis",
            r"(?i)session",
            r"(?i)tokenRepository",
            r"(?i)saveToken",
            r"(?i)storeToken",
            r"(?i)express-jwt-blacklist",
            r"(?i)jwt-redis",
            r"(?i)revocation.*handled",
            r"(?i)revoke.*separate",
        ],
    },
    {
        "id": "REVOKE-002",
        "category": "access-control",
        "severity": "medium",
        "title": "Excessive Token Expiration Time",
        "reference": "NPRM §164.308(a)(3)(ii)(C) - Access Revocation",
        "patterns": [
            r"""(?i)expiresIn\s*:\s*['"`](?:[2-9]|[1-9]\d+)d['"`]""",
            r"""(?i)expiresIn\s*:\s*['"`](?:2[5-9]|[3-9]\d|\d{3,})h['"`]""",
            r"""(?i)expiresIn\s*:\s*['"`]\d+[wy]['"`]""",
            r"""(?i)expiresIn\s*:\s*['"`]\d+\s*(?:month|months|mo)['"`]""",
            r"(?i)expiresIn\s*:\s*(?:8[7-9]\d{3}|\d{6,})\b",
            r"(?i)maxAge\s*:\s*(?:6[1-9]\d{7}|[7-9]\d{8}|\d{9,})\b",
            r"(?i)exp\s*:\s*Math\.floor\s*\([^)]*\+\s*(?:2[5-9]|[3-9]\d|\d{3,})\s*\*\s*(?:60\s*\*\s*60|3600)",
        ],
        "negatives": [
            r"""(?i)expiresIn\s*:\s*['"`](?:1?\d|2[0-4])h['"`]""",
            r"""(?i)expiresIn\s*:\s*['"`]1d['"`]""",
            r"""(?i)expiresIn\s*:\s*['"`]\d+m['"`]""",
            r"""(?i)expiresIn\s*:\s*['"`]\d+s['"`]""",
            r"(?i)expiresIn\s*:\s*(?:[1-7]\d{3}|[1-8][0-5]\d{3}|86[0-3]\d{2}|8640{1,2})\b",
            r"(?i)refresh.*token",
            r"(?i)refreshToken",
            r"(?i)remember.*me",
            r"(?i)rememberMe",
            r"(?i)api.*key",
            r"(?i)apiKey",
        ],
    },
]
