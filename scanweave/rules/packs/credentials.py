"""Weak password hashing, hardcoded credentials, public secrets."""

# Ids, severities, titles, citations and patterns of this pack.
RULES = [
    {
        "id": "CRED-001",
        "category": "encryption",
        "severity": "critical",
        "title": "Weak Password Hashing Algorithm Detected",
        "reference": "45 CFR §164.312(d) - Person or Entity Authentication",
        "patterns": [
            r"""(?i)createHash\s*\(\s*['"`](?:md5|sha1|sha-?1|sha256|sha-?256)['"`]\s*\)""",
            r"(?i)hashlib\.(?:md5|sha1|sha256)\s*\(",
            r"(?i)(?:md5|sha1|sha256).*?(?:password|pass|pwd|hash)",
            r"(?i)(?:password|pass|pwd).*?(?:md5|sha1|sha256)",
        ],
        "negatives": [
            r"(?i)bcrypt",
            r"(?i)argon2",
            r"(?i)scrypt",
            r"(?i)pbkdf2",
            r"(?i)//.*(?:don't|do not|avoid|never).*md5",
            r"(?i)/\*.*(?:don't|do not|avoid|never).*md5",
            r"(?i)checksum",
            r"(?i)file.*hash",
            r"(?i)integrity",
        ],
    },
    {
        "id": "CRED-002",
        "category": "encryption",
        "severity": "critical",
        "title": "Hardcoded Credentials Detected",
        "reference": "45 CFR §164.312(a)(2)(i) - Unique User Identification",
        "patterns": [
            r"""(?i)(?:password|passwd|pwd)\s*[:=]\s*['"`][^'"`]{8,}['"`]""",
            r"""(?i)(?:api[-_]?key|apikey)\s*[:=]\s*['"`][^'"`]{8,}['"`]""",
            r"""(?i)(?:secret|private[-_]?key|privatekey)\s*[:=]\s*['"`][^'"`]{8,}['"`]""",
            r"""(?i)(?:token|auth[-_]?token|access[-_]?token)\s*[:=]\s*['"`][^'"`]{16,}['"`]""",
            r"""(?i)(?:connection[-_]?string|connectionstring|database[-_]?url)\s*[:=]\s*['"`][^'"`]{10,}['"`]""",
            r"""(?i)['"`]Bearer\s+[A-Za-z0-9_\-.]{16,}['"`]""",
            r"""(?i)(?:aws|service|client)[-_]?(?:key|secret)\s*[:=]\s*['"`][A-Za-z0-9+/]{20,}['"`]""",
        ],
        "negatives": [
            r"(?i)process\.env",
            r"(?i)import\.meta\.env",
            r"(?i)env\.",
            r"(?i)ENV\[",
            r"(?i)getenv",
            r"(?i)your[-_]?(?:key|secret|password|token)",
            r"(?i)(?:placeholder|example|dummy|test|sample)",
            r"(?i)changeme",
            r"(?i)replace[-_]?(?:this|me)",
            r"(?i)(?:xxx|yyy|zzz)",
            r"""(?i)['"]\s*['"]""",
            r"(?i)\$\{",
        ],
    },
    {
        "id": "CRED-003",
        "category": "encryption",
        "severity": "critical",
        "title": "Secrets Exposed to Client via NEXT_PUBLIC_ Prefix",
        "reference": "45 CFR §164.312(a)(2)(i) - Unique User Identification",
        "patterns": [
            r"(?i)NEXT_PUBLIC_SECRET",
            r"(?i)NEXT_PUBLIC_.*?KEY",
            r"(?i)NEXT_PUBLIC_.*?PASSWORD",
            r"(?i)NEXT_PUBLIC_SERVICE_ROLE",
            r"(?i)NEXT_PUBLIC_.*?TOKEN",
            r"(?i)NEXT_PUBLIC_.*?PRIVATE",
            r"(?i)NEXT_PUBLIC_DATABASE",
            r"(?i)NEXT_PUBLIC_.*?ADMIN",
        ],
        "negatives": [
            r"(?i)NEXT_PUBLIC_(?:SUPABASE|FIREBASE|CLERK)_(?:ANON|PUBLISHABLE)_KEY",
            r"(?i)NEXT_PUBLIC_.*?PUBLISHABLE",
            r"(?i)NEXT_PUBLIC_.*?PUBLIC_KEY",
            r"(?i)NEXT_PUBLIC_(?:GA|GTM|ANALYTICS|MIXPANEL|SEGMENT)_",
            r"(?i)NEXT_PUBLIC_(?:APP|SITE|BASE)_(?:URL|NAME|VERSION)",
            r"(?i)NEXT_PUBLIC_FEATURE_",
            r"(?i)//.*(?:don't|do not|avoid|never)",
        ],
    },
]
