"""Short retention, unlogged or bulk deletion, disabled backups, cached records."""

# Ids, severities, titles, citations and patterns of this pack.
RULES = [
    {
        "id": "short-retention",
        "category": "data-retention",
        "severity": "high",
        "title": "PHI retention period may be too short",
        "reference": "§164.530(j)",
        "patterns": [
            r"(?i)deleteAfter\s*[:=]\s*(\d+)\s*(day|hour|minute)",
        ],
    },
    {
        "id": "unlogged-delete",
        "category": "data-retention",
        "severity": "medium",
        "title": "Data deletion without apparent logging",
        "reference": "§164.530(j)",
        "patterns": [
            r"(?i)\.delete\s*\(\s*\)(?!.*audit|.*log)",
        ],
    },
    {
        "id": "bulk-delete",
        "category": "data-retention",
        "severity": "critical",
        "title": "Bulk data deletion operation",
        "reference": "§164.530(j)",
        "patterns": [
            r"(?i)truncate\s+table|drop\s+table",
        ],
    },
    {
        "id": "backup-disabled",
        "category": "data-retention",
        "severity": "high",
        "title": "Backup may be disabled",
        "reference": "§164.530(j)",
        "patterns": [
            r"(?i)backup.*disable|disable.*backup",
        ],
    },
    {
        "id": "phi-cache",
        "category": "data-retention",
        "severity": "medium",
        "title": "PHI caching detected",
        "reference": "§164.530(j)",
        "patterns": [
            r"(?i)cache.*patient|patient.*cache",
        ],
    },
]
