"""Missing backups, retention fields and body size limits."""

# Ids, severities, titles, citations and patterns of this pack.
RULES = [
    {
        "id": "BACKUP-001",
        "category": "data-retention",
        "severity": "medium",
        "title": "Database Without Backup Configuration",
        "reference": "45 CFR §164.308(a)(7)(ii)(A) - Data Backup Plan",
        "patterns": [
            r"""(?i)import.*from\s+['"]@supabase/supabase-js['"]""",
            r"""(?i)import.*from\s+['"]@prisma/client['"]""",
            r"""(?i)import.*from\s+['"]prisma['"]""",
            r"""(?i)import.*from\s+['"]mongoose['"]""",
            r"""(?i)import.*from\s+['"]drizzle-orm['"]""",
            r"""(?i)import.*from\s+['"]typeorm['"]""",
            r"""(?i)import.*from\s+['"]sequelize['"]""",
            r"""(?i)import.*from\s+['"]knex['"]""",
            r"(?i)new\s+PrismaClient\s*\(",
            r"(?i)mongoose\.connect\s*\(",
            r"(?i)createClient\s*\(.*supabase",
            r"(?i)new\s+Sequelize\s*\(",
            r"(?i)createConnection\s*\(.*typeorm",
        ],
        "negatives": [
            r"(?i)backup",
            r"(?i)snapshot",
            r"(?i)replicate",
            r"(?i)pg_dump",
            r"(?i)mongodump",
            r"(?i)restore",
            r"(?i)\.backup\(",
            r"(?i)backupSchedule",
            r"(?i)automaticBackup",
        ],
    },
    {
        "id": "RETENTION-001",
        "category": "data-retention",
        "severity": "medium",
        "title": "PHI Records Created Without Retention Fields",
        "reference": "45 CFR §164.316(b)(2)(i) - Retention Period",
        "patterns": [
            r"(?i)prisma\.patient\.create\s*\(",
            r"(?i)prisma\.health.*\.create\s*\(",
            r"(?i)prisma\.medical.*\.create\s*\(",
            r"(?i)prisma\.clinical.*\.create\s*\(",
            r"(?i)prisma\.patient\.upsert\s*\(",
            r"(?i)prisma\.health.*\.upsert\s*\(",
            r"(?i)Patient\.create\s*\(",
            r"(?i)Health.*\.create\s*\(",
            r"(?i)Medical.*\.create\s*\(",
            r"(?i)Clinical.*\.create\s*\(",
            r"(?i)new\s+Patient\s*\(.*\)\.save\s*\(",
            r"(?i)db\.insert\s*\(\s*patient",
            r"(?i)db\.insert\s*\(\s*health",
            r"(?i)db\.insert\s*\(\s*medical",
            r"(?i)db\.insert\s*\(\s*clinical",
            r"""(?i)\.insert\s*\(.*\)\s*\.into\s*\(\s*['"`]patient""",
            r"""(?i)\.insert\s*\(.*\)\s*\.into\s*\(\s*['"`]health""",
            r"(?i)Patient\.create\s*\(\s*\{",
            r"(?i)Health.*Model\.create\s*\(",
            r"(?i)Medical.*\.upsert\s*\(",
            r"(?i)db\.insert\s*\(.*patient.*\)",
            r"(?i)insertInto\s*\(\s*patient",
            r"""(?i)supabase\.from\s*\(\s*['"`]patient.*['"]\s*\)\.insert""",
            r"""(?i)supabase\.from\s*\(\s*['"`]health.*['"]\s*\)\.insert""",
            r"""(?i)supabase\.from\s*\(\s*['"`]medical.*['"]\s*\)\.insert""",
        ],
        "negatives": [
            r"(?i)expiresAt",
            r"(?i)ttl",
            r"(?i)retainUntil",
            r"(?i)retentionPeriod",
            r"(?i)deleteAfter",
            r"(?i)retention_date",
            r"(?i)expiration",
            r"(?i)expires_at",
            r"(?i)retain_until",
            r"(?i)delete_after",
            r"(?i)\.test\.",
            r"(?i)\.spec\.",
            r"(?i)describe\(",
            r"(?i)it\(",
        ],
    },
    {
        "id": "API-002",
        "category": "access-control",
        "severity": "low",
        "title": "JSON Body Parser Without Size Limit",
        "reference": "45 CFR §164.308(a)(1)(ii)(D) - System Security",
        "patterns": [
            r"(?i)express\.json\s*\(\s*\)",
            r"(?i)app\.use\s*\(\s*express\.json\s*\(\s*\)\s*\)",
            r"(?i)bodyParser\.json\s*\(\s*\)",
            r"(?i)app\.use\s*\(\s*bodyParser\.json\s*\(\s*\)\s*\)",
            r"(?i)express\.json\s*\(\s*\{\s*\}\s*\)",
            r"(?i)bodyParser\.json\s*\(\s*\{\s*\}\s*\)",
        ],
        "negatives": [
            r"(?i)limit\s*:",
            r"(?i)\{\s*limit",
            r'(?i)"limit"',
            r"(?i)'limit'",
            r"(?i)size:",
            r"(?i)maxBodySize",
        ],
    },
]
