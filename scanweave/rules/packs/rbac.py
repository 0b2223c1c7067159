"""Record access without role checks, privileged defaults in client code."""

# Ids, severities, titles, citations and patterns of this pack.
RULES = [
    {
        "id": "RBAC-001",
        "category": "access-control",
        "severity": "high",
        "title": "PHI Data Access Without Role/Permission Verification",
        "reference": "45 CFR §164.312(a)(1) - Access Control",
        "patterns": [
            r"(?i)(?:from|FROM)\s+(?:patients?|health_records?|medical_records?|diagnos[ei]s|treatments?|prescriptions?|medications?|encounters?|visits?|lab_results?)",
            r"""(?i)\.(?:from|table)\s*\(\s*['"`](?:patients?|health_records?|medical_records?|diagnos[ei]s|treatments?|prescriptions?|medications?|encounters?|visits?|lab_results?)['"`]""",
            r"(?i)(?:Patient|HealthRecord|MedicalRecord|Diagnosis|Treatment|Prescription|Medication|Encounter|Visit|LabResult)\.(?:find|findOne|findAll|findMany|query|where)",
            r"""(?i)supabase\.from\s*\(\s*['"`](?:patients?|health_records?|medical_records?|diagnos[ei]s|treatments?|prescriptions?|medications?)['"`]""",
            r"(?i)prisma\.(?:patient|healthRecord|medicalRecord|diagnosis|treatment|prescription|medication)\.(?:findMany|findUnique|findFirst)",
        ],
        "negatives": [
            r"(?i)\brole\b",
            r"(?i)permission",
            r"(?i)authorize",
            r"(?i)[.!]\s*(?:\w+\.)*isAdmin\b",
            r"(?i)canAccess",
            r"(?i)hasPermission",
            r"(?i)checkAccess",
            r"(?i)verifyRole",
            r"(?i)requireRole",
            r"(?i)isAuthorized",
            r"(?i)checkPermission",
        ],
    },
    {
        "id": "RBAC-002",
        "category": "access-control",
        "severity": "critical",
        "title": "Service Role Key or Admin Default in Client Code",
        "reference": "45 CFR §164.312(a)(1) - Access Control",
        "patterns": [
            r"(?i)service_role",
            r"(?i)serviceRole",
            r"(?i)SERVICE_ROLE",
            r"(?i)isAdmin\s*[:=]\s*true",
            r"""(?i)role\s*[:=]\s*['"`]admin['"`]""",
            r"(?i)admin\s*:\s*true",
            r"(?i)\[\s*isAdmin\b[^\]]*\]\s*=\s*useState\s*\(\s*true\s*\)",
            r"(?i)if\s*\(\s*true\s*\).*admin",
            r"(?i)const\s+isAdmin\s*=\s*true",
            r"(?i)let\s+isAdmin\s*=\s*true",
            r"""(?i)userId\s*===?\s*['"`]admin['"`]""",
            r"""(?i)email\s*===?\s*['"`]admin@""",
        ],
        "negatives": [
            r"(?i)/api/",
            r"(?i)\.server\.",
            r"(?i)getServerSideProps",
            r"(?i)getStaticProps",
            r"(?i)process\.env",
            r"(?i)\.test\.",
            r"(?i)\.spec\.",
            r"(?i)describe\(",
        ],
    },
    {
        "id": "RBAC-003",
        "category": "access-control",
        "severity": "medium",
        "title": "SELECT * on PHI Tables Violates Minimum Necessary Principle",
        "reference": "45 CFR §164.502(b) - Minimum Necessary Requirement",
        "patterns": [
            r"(?i)SELECT\s+\*\s+FROM\s+(?:patients?|health_records?|medical_records?|diagnos[ei]s|treatments?|prescriptions?|medications?|encounters?|visits?|lab_results?)",
            r"""(?i)\.select\s*\(\s*['"`]\*['"`]\s*\)""",
            r"(?i)\.select\s*\(\s*\*\s*\)",
            r"(?i)\.findMany\s*\(\s*\{[^}]*\}\s*\)(?!.*select)",
            r"(?i)\.find\s*\(\s*\{[^}]*\}\s*\)(?!.*select)",
            r"""(?i)supabase\.from\s*\([^)]*(?:patient|health|medical|diagnosis|treatment|prescription)[^)]*\)\.select\s*\(\s*['"`]\*['"`]""",
        ],
        "negatives": [
            r"""(?i)\.select\s*\(\s*['"`][a-zA-Z_,\s]+['"`]\s*\)""",
            r"(?i)SELECT\s+[a-zA-Z_,\s]+\s+FROM",
            r"(?i)select\s*:\s*\{",
            r"(?i)pick\s*\(",
            r"(?i)omit\s*\(",
        ],
    },
]
