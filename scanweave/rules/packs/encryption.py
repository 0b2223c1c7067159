"""Weak ciphers, plain transport and unprotected backups."""

# Ids, severities, titles, citations and patterns of this pack.
RULES = [
    {
        "id": "enc-md5",
        "category": "encryption",
        "severity": "high",
        "title": "Weak cryptography: MD5 hash function",
        "reference": "§164.312(a)(2)(iv), §164.312(e)(2)(ii)",
        "patterns": [
            r"(?i)\bmd5\s*\(",
        ],
    },
    {
        "id": "enc-sha1",
        "category": "encryption",
        "severity": "medium",
        "title": "Weak cryptography: SHA1 hash function",
        "reference": "§164.312(a)(2)(iv), §164.312(e)(2)(ii)",
        "patterns": [
            r"(?i)\bsha1\s*\(",
        ],
    },
    {
        "id": "enc-des",
        "category": "encryption",
        "severity": "critical",
        "title": "Weak cryptography: DES encryption",
        "reference": "§164.312(a)(2)(iv), §164.312(e)(2)(ii)",
        "patterns": [
            r"(?i)\bdes\b",
        ],
    },
    {
        "id": "enc-rc4",
        "category": "encryption",
        "severity": "critical",
        "title": "Weak cryptography: RC4 encryption",
        "reference": "§164.312(a)(2)(iv), §164.312(e)(2)(ii)",
        "patterns": [
            r"(?i)\b(rc4|arcfour)\b",
        ],
    },
    {
        "id": "enc-deprecated-cipher",
        "category": "encryption",
        "severity": "high",
        "title": "Weak cryptography: Deprecated cipher method",
        "reference": "§164.312(a)(2)(iv), §164.312(e)(2)(ii)",
        "patterns": [
            r"(?i)createCipher\s*\(",
        ],
    },
    {
        "id": "enc-ecb-mode",
        "category": "encryption",
        "severity": "high",
        "title": "Weak cryptography: ECB mode encryption",
        "reference": "§164.312(a)(2)(iv), §164.312(e)(2)(ii)",
        "patterns": [
            r"\bECB\b",
        ],
    },
    {
        "id": "enc-http-url",
        "category": "encryption",
        "severity": "high",
        "title": "Encryption issue: Unencrypted HTTP URL",
        "reference": "§164.312(e)(1)",
        "fix_type": "http-url",
        "patterns": [
            r"(?i)http://(?!localhost|127\.0\.0\.1)",
        ],
    },
    {
        "id": "enc-ssl-disabled",
        "category": "encryption",
        "severity": "critical",
        "title": "Encryption issue: SSL disabled",
        "reference": "§164.312(e)(1)",
        "patterns": [
            r"(?i)ssl\s*[:=]\s*false",
        ],
    },
    {
        "id": "enc-ssl-verify-disabled",
        "category": "encryption",
        "severity": "critical",
        "title": "Encryption issue: SSL verification disabled",
        "reference": "§164.312(e)(1)",
        "patterns": [
            r"(?i)verify\s*[:=]\s*false.*ssl",
        ],
    },
    {
        "id": "enc-tls-cert-validation-disabled",
        "category": "encryption",
        "severity": "critical",
        "title": "Encryption issue: TLS certificate validation disabled",
        "reference": "§164.312(e)(1)",
        "patterns": [
            r"(?i)rejectUnauthorized\s*:\s*false",
        ],
    },
    {
        "id": "enc-backup-encryption-disabled",
        "category": "encryption",
        "severity": "critical",
        "title": "Encryption issue: Backup encryption disabled",
        "reference": "§164.312(e)(1)",
        "fix_type": "backup-unencrypted",
        "patterns": [
            r"(?i)backup.*encrypt\s*[:=]\s*false|encrypt\s*[:=]\s*false.*backup",
        ],
    },
    {
        "id": "enc-db-backup-no-ssl",
        "category": "encryption",
        "severity": "high",
        "title": "Encryption issue: Database backup without SSL",
        "reference": "§164.312(e)(1)",
        "patterns": [
            r"(?i)mysqldump(?!.*--ssl).*password|pg_dump(?!.*--ssl)",
        ],
    },
    {
        "id": "enc-backup-file-unencrypted",
        "category": "encryption",
        "severity": "high",
        "title": "Encryption issue: Unencrypted backup file format",
        "reference": "§164.312(e)(1)",
        "fix_type": "backup-unencrypted",
        "patterns": [
            r"(?i)backup.*(\.sql|\.csv|\.json|\.txt)\b(?!.*encrypt|.*gpg|.*aes)",
        ],
    },
    {
        "id": "enc-phi-backup-unencrypted",
        "category": "encryption",
        "severity": "critical",
        "title": "Encryption issue: PHI backup without encryption",
        "reference": "§164.312(e)(1)",
        "fix_type": "backup-unencrypted",
        "patterns": [
            r"(?i)writeFile.*backup.*patient|patient.*backup.*writeFile",
        ],
    },
    {
        "id": "enc-s3-backup-no-sse",
        "category": "encryption",
        "severity": "high",
        "title": "Encryption issue: S3 backup without server-side encryption",
        "reference": "§164.312(e)(1)",
        "patterns": [
            r"(?i)s3.*upload.*backup(?!.*encrypt|.*sse|.*kms)",
        ],
    },
    {
        "id": "enc-backup-storage-unencrypted",
        "category": "encryption",
        "severity": "medium",
        "title": "Encryption issue: Backup storage without encryption specified",
        "reference": "§164.312(e)(1)",
        "patterns": [
            r"(?i)backup.*storage(?!.*encrypt)|storage.*backup(?!.*encrypt)",
        ],
    },
]
