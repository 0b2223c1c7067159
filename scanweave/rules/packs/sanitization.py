"""Request data reaching queries unchecked, uploads without limits."""

# Ids, severities, titles, citations and patterns of this pack.
RULES = [
    {
        "id": "SANITIZE-001",
        "category": "access-control",
        "severity": "critical",
        "title": "Unsanitized User Input in Database Operations",
        "reference": "NPRM Anti-malware",
        "patterns": [
            r"(?i)(?:insert|update|query|sql|where|execute)\s*\([^)]*req\.body",
            r"(?i)(?:insert|update|query|sql|where|execute)\s*\([^)]*req\['body'\]",
            r"(?i)(?:insert|update|query|sql|where|execute)\s*\([^)]*req\.params",
            r"(?i)(?:insert|update|query|sql|where|execute)\s*\([^)]*req\['params'\]",
            r"(?i)(?:insert|update|query|sql|where|execute)\s*\([^)]*req\.query",
            r"(?i)(?:insert|update|query|sql|where|execute)\s*\([^)]*req\['query'\]",
            r"(?i)(?:sql|query|execute)\s*`[^`]*\$\{req\.(?:body|params|query)",
            r"(?i)(?:SELECT|INSERT|UPDATE|DELETE).*?\+\s*req\.(?:body|params|query)",
            r"(?i)prisma\.\w+\.(?:create|update|upsert|delete)\s*\([^)]*req\.(?:body|params|query)",
            r"(?i)(?:create|findOneAndUpdate|updateOne|updateMany)\s*\([^)]*req\.(?:body|params|query)",
            r"(?i)(?:save|insert|update)\s*\([^)]*req\.(?:body|params|query)",
            r"(?i)knex\s*\([^)]*\)\.(?:insert|update|where)\s*\([^)]*req\.(?:body|params|query)",
            r"(?i)\.(?:values|set|data)\s*\([^)]*req\.(?:body|params|query)",
            r"(?i)\w+\.create\s*\(\s*req\.(?:body|params|query)",
        ],
        "negatives": [
            r"(?i)zod",
            r"(?i)yup",
            r"(?i)joi",
            r"(?i)validate",
            r"(?i)sanitize",
            r"(?i)parse(?:Int|Float|Body)?",
            r"(?i)safeParse",
            r"(?i)schema\.validate",
            r"(?i)\.schema\(",
            r"(?i)typeof\s+",
            r"(?i)instanceof\s+",
            r"(?i)validationResult",
            r"(?i)express-validator",
            r"(?i)sanitized",
            r"(?i)validated",
            r"(?i)checked",
        ],
    },
    {
        "id": "SANITIZE-002",
        "category": "access-control",
        "severity": "high",
        "title": "Insecure File Upload Configuration",
        "reference": "NPRM Anti-malware",
        "patterns": [
            r"(?i)multer\s*\(\s*\{",
            r"(?i)(?:new\s+)?formidable\.IncomingForm\s*\(",
            r"(?i)formidable\(\s*\(",
            r"(?i)(?:new\s+)?Busboy\s*\(\s*\{",
            r"(?i)busboy\s*\(\s*\{",
        ],
        "negatives": [
            r"(?i)fileFilter",
            r"(?i)limits\s*:",
            r"(?i)fileSize",
            r"(?i)maxFileSize",
            r"(?i)mimetype",
            r"(?i)mimeType",
            r"(?i)contentType",
            r"(?i)allowedTypes",
            r"(?i)allowedMimeTypes",
            r"(?i)\.endsWith\s*\(",
            r"(?i)\.includes\s*\(",
            r"(?i)test\s*\(",
            r"(?i)validateFile",
            r"(?i)checkFileType",
            r"(?i)isValidFile",
        ],
    },
]
