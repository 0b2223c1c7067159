"""Multi-factor authentication missing or bypassed."""

# Ids, severities, titles, citations and patterns of this pack.
RULES = [
    {
        "id": "MFA-001",
        "category": "access-control",
        "severity": "critical",
        "title": "Authentication Configuration Without MFA Enabled",
        "reference": "NPRM §164.312(d) - Person or Entity Authentication",
        "patterns": [
            r"(?i)NextAuth\s*\(",
            r"(?i)export\s+(?:default\s+)?NextAuth",
            r"(?i)authOptions\s*[:=]",
            r"(?i)ClerkProvider",
            r"(?i)clerk\.(?:setup|configure)",
            r"(?i)Auth0Provider",
            r"(?i)auth0\.WebAuth",
            r"(?i)new\s+Auth0Client",
            r"(?i)supabase\.auth\.signUp",
            r"(?i)createClient.*?supabase",
            r"(?i)authConfig\s*[:=]",
            r"(?i)authentication\s*:\s*\{",
        ],
        "negatives": [
            r"(?i)mfa",
            r"(?i)2fa",
            r"(?i)totp",
            r"(?i)otp",
            r"(?i)multiFactor",
            r"(?i)multi[-_]factor",
            r"(?i)twoFactor",
            r"(?i)two[-_]factor",
            r"(?i)authenticator",
        ],
    },
    {
        "id": "MFA-002",
        "category": "access-control",
        "severity": "high",
        "title": "Login Flow Without Second Factor Authentication",
        "reference": "NPRM §164.312(d) - Person or Entity Authentication",
        "patterns": [
            r"(?i)(?:signIn|login|authenticate)\s*\([^)]*(?:email|username)[^)]*password",
            r"(?i)(?:signIn|login|authenticate)\s*\(\s*\{[^}]*(?:email|username)[^}]*password[^}]*\}",
            r"(?i)credentials\s*:\s*\{[^}]*(?:email|username)[^}]*password[^}]*\}",
            r"(?i)(?:email|username)\s*,\s*password\s*\)",
            r"(?i)password\s*,\s*(?:email|username)\s*\)",
        ],
        "negatives": [
            r"(?i)mfaToken",
            r"(?i)totpCode",
            r"(?i)verificationCode",
            r"(?i)twoFactorCode",
            r"(?i)authenticatorCode",
            r"(?i)otp",
            r"(?i)mfaVerified",
            r"(?i)requireMfa",
            r"(?i)checkMfa",
            r"(?i)verifyMfa",
        ],
    },
    {
        "id": "MFA-003",
        "category": "access-control",
        "severity": "critical",
        "title": "MFA Bypass Detected in Code",
        "reference": "NPRM §164.312(d) - Person or Entity Authentication",
        "patterns": [
            r"(?i)skipMfa",
            r"(?i)bypassMfa",
            r"(?i)disableMfa",
            r"(?i)ignoreMfa",
            r"(?i)mfaEnabled\s*[:=]\s*false",
            r"(?i)requireMfa\s*[:=]\s*false",
            r"(?i)require(?:Two|2)Factor\s*[:=]\s*false",
            r"(?i)mfa\s*:\s*\{\s*enabled\s*:\s*false",
            r"(?i)twoFactor\s*:\s*false",
            r"(?i)if\s*\([^)]*skip.*mfa",
            r"(?i)if\s*\([^)]*!.*(?:mfa|2fa|totp)",
            r"(?i)process\.env\.(?:SKIP|DISABLE|BYPASS).*MFA",
        ],
        "negatives": [
            r"(?i)//.*test",
            r"(?i)/\*.*test",
            r"(?i)describe\(",
            r"(?i)it\(",
            r"(?i)test\(",
            r"(?i)\.test\.",
            r"(?i)\.spec\.",
            r"(?i)console\.(?:log|warn|error)",
            r"(?i)throw.*error",
        ],
    },
]
