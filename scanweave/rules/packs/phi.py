"""Personal health data written into source, logs, storage, links and mail."""

# Ids, severities, titles, citations and patterns of this pack.
RULES = [
    {
        "id": "ssn-hardcoded",
        "category": "phi-exposure",
        "severity": "critical",
        "title": "Potential SSN detected",
        "reference": "§164.502, §164.514",
        "patterns": [
            r"\b\d{3}-\d{2}-\d{4}\b",
        ],
    },
    {
        "id": "medical-record-number",
        "category": "phi-exposure",
        "severity": "high",
        "title": "Medical Record Number exposure",
        "reference": "§164.502, §164.514",
        "patterns": [
            r"""(?i)\b(mrn|medical.?record.?number)\s*[:=]\s*['"`]\d+['"`]""",
        ],
    },
    {
        "id": "dob-exposed",
        "category": "phi-exposure",
        "severity": "high",
        "title": "Date of birth exposure",
        "reference": "§164.502, §164.514",
        "patterns": [
            r"""(?i)\b(date.?of.?birth|dob|birth.?date)\s*[:=]\s*['"`]""",
        ],
    },
    {
        "id": "diagnosis-code",
        "category": "phi-exposure",
        "severity": "medium",
        "title": "Diagnosis code in source",
        "reference": "§164.502, §164.514",
        "patterns": [
            r"""(?i)\b(icd.?10|diagnosis.?code|icd.?code)\s*[:=]\s*['"`][A-Z]\d{2}""",
        ],
    },
    {
        "id": "phi-in-url",
        "category": "phi-exposure",
        "severity": "high",
        "title": "PHI identifier in URL pattern",
        "reference": "§164.502, §164.514",
        "patterns": [
            r"(?i)/(patient|user)/\d+/(ssn|dob|mrn|diagnosis)",
        ],
    },
    {
        "id": "patient-name-log",
        "category": "phi-exposure",
        "severity": "high",
        "title": "Patient name in console output",
        "reference": "§164.502, §164.514",
        "fix_type": "phi-console-log",
        "patterns": [
            r"(?i)console\.(log|info|debug|warn|error)\s*\([^)]*patient.*name",
        ],
    },
    {
        "id": "phi-console-log",
        "category": "phi-exposure",
        "severity": "high",
        "title": "PHI data in console output",
        "reference": "§164.502, §164.514",
        "fix_type": "phi-console-log",
        "patterns": [
            r"(?i)console\.(log|info|debug|warn|error)\s*\([^)]*(ssn|social.?security|diagnosis|medical.?record|health.?info|patient.?data|dob|birth.?date)",
        ],
    },
    {
        "id": "phi-json-stringify-log",
        "category": "phi-exposure",
        "severity": "high",
        "title": "Patient object serialized to console",
        "reference": "§164.502, §164.514",
        "fix_type": "phi-console-log",
        "patterns": [
            r"(?i)console\.(log|info|debug)\s*\(\s*JSON\.stringify\s*\([^)]*patient",
        ],
    },
    {
        "id": "phi-template-log",
        "category": "phi-exposure",
        "severity": "high",
        "title": "PHI in template literal log",
        "reference": "§164.502, §164.514",
        "fix_type": "phi-console-log",
        "patterns": [
            r"(?i)console\.(log|info|debug)\s*\(\s*`[^`]*(patient|ssn|diagnosis|dob|\$\{.*patient)",
        ],
    },
    {
        "id": "phi-localstorage",
        "category": "phi-exposure",
        "severity": "critical",
        "title": "PHI stored in localStorage",
        "reference": "§164.502, §164.514",
        "fix_type": "phi-localstorage",
        "patterns": [
            r"""(?i)localStorage\.(setItem|getItem)\s*\(\s*['"`][^'"`]*(patient|ssn|diagnosis|medical|health|dob|mrn)""",
        ],
    },
    {
        "id": "phi-sessionstorage",
        "category": "phi-exposure",
        "severity": "high",
        "title": "PHI stored in sessionStorage",
        "reference": "§164.502, §164.514",
        "patterns": [
            r"""(?i)sessionStorage\.(setItem|getItem)\s*\(\s*['"`][^'"`]*(patient|ssn|diagnosis|medical|health|dob|mrn)""",
        ],
    },
    {
        "id": "phi-cookie-storage",
        "category": "phi-exposure",
        "severity": "critical",
        "title": "PHI stored in cookies",
        "reference": "§164.502, §164.514",
        "patterns": [
            r"(?i)document\.cookie\s*=.*?(patient|ssn|diagnosis|medical|health|dob|mrn)",
        ],
    },
    {
        "id": "phi-indexeddb",
        "category": "phi-exposure",
        "severity": "high",
        "title": "PHI potentially stored in IndexedDB",
        "reference": "§164.502, §164.514",
        "patterns": [
            r"(?i)indexedDB|IDBDatabase.*?(patient|health|medical|diagnosis)",
        ],
    },
    {
        "id": "email-phi-context",
        "category": "phi-exposure",
        "severity": "medium",
        "title": "Patient email handling detected",
        "reference": "§164.502, §164.514",
        "patterns": [
            r"(?i)patient.*email|email.*patient",
        ],
    },
    {
        "id": "phone-phi-context",
        "category": "phi-exposure",
        "severity": "medium",
        "title": "Patient phone handling detected",
        "reference": "§164.502, §164.514",
        "patterns": [
            r"(?i)patient.*(phone|mobile|cell)|phone.*patient",
        ],
    },
    {
        "id": "address-phi-context",
        "category": "phi-exposure",
        "severity": "medium",
        "title": "Patient address handling detected",
        "reference": "§164.502, §164.514",
        "patterns": [
            r"(?i)patient.*(address|street|city|zip)|address.*patient",
        ],
    },
    {
        "id": "phi-query-param",
        "category": "phi-exposure",
        "severity": "critical",
        "title": "PHI in URL query parameter",
        "reference": "§164.502, §164.514",
        "fix_type": "phi-url-param",
        "patterns": [
            r"(?i)[?&](ssn|social.?security|patient.?id|mrn|dob|birth.?date|diagnosis|medical.?record)=",
        ],
    },
    {
        "id": "phi-url-interpolation",
        "category": "phi-exposure",
        "severity": "critical",
        "title": "PHI interpolated into URL",
        "reference": "§164.502, §164.514",
        "patterns": [
            r"(?i)\$\{[^}]*(ssn|patientId|mrn|dob|diagnosis)[^}]*\}.*[?&]",
        ],
    },
    {
        "id": "phi-fetch-url",
        "category": "phi-exposure",
        "severity": "high",
        "title": "PHI in fetch URL",
        "reference": "§164.502, §164.514",
        "patterns": [
            r"(?i)fetch\s*\(\s*`[^`]*[?&](patient|ssn|mrn|dob)",
        ],
    },
    {
        "id": "phi-header-set",
        "category": "phi-exposure",
        "severity": "critical",
        "title": "PHI in HTTP header",
        "reference": "§164.502, §164.514",
        "patterns": [
            r"""(?i)setHeader\s*\(\s*['"`][^'"`]*(patient|ssn|mrn|dob|diagnosis|medical)""",
        ],
    },
    {
        "id": "phi-header-object",
        "category": "phi-exposure",
        "severity": "critical",
        "title": "PHI in headers object",
        "reference": "§164.502, §164.514",
        "patterns": [
            r"(?i)headers\s*[:=]\s*\{[^}]*(patient|ssn|mrn|dob|diagnosis|x-patient|x-medical)",
        ],
    },
    {
        "id": "phi-authorization-header",
        "category": "phi-exposure",
        "severity": "high",
        "title": "Patient data in authorization context",
        "reference": "§164.502, §164.514",
        "patterns": [
            r"(?i)authorization.*patient|patient.*authorization",
        ],
    },
    {
        "id": "phi-email-body",
        "category": "phi-exposure",
        "severity": "high",
        "title": "PHI in email content",
        "reference": "§164.502, §164.514",
        "patterns": [
            r"(?i)(sendMail|sendEmail|send_email|mailer\.send)\s*\([^)]*patient",
        ],
    },
    {
        "id": "phi-email-template",
        "category": "phi-exposure",
        "severity": "high",
        "title": "PHI in email template",
        "reference": "§164.502, §164.514",
        "patterns": [
            r"(?i)(email|mail).*template.*patient|patient.*(email|mail).*template",
        ],
    },
    {
        "id": "phi-email-subject",
        "category": "phi-exposure",
        "severity": "medium",
        "title": "Potential PHI in email subject",
        "reference": "§164.502, §164.514",
        "patterns": [
            r"(?i)subject\s*[:=].*patient|subject.*diagnosis|subject.*medical",
        ],
    },
    {
        "id": "phi-logger-unredacted",
        "category": "phi-exposure",
        "severity": "high",
        "title": "PHI logged without redaction",
        "reference": "§164.502, §164.514",
        "fix_type": "phi-log-unredacted",
        "patterns": [
            r"(?i)logger\.(info|debug|warn|error)\s*\([^)]*patient(?!.*redact|.*mask|.*sanitize)",
        ],
    },
    {
        "id": "phi-log-file",
        "category": "phi-exposure",
        "severity": "high",
        "title": "PHI written to log file",
        "reference": "§164.502, §164.514",
        "patterns": [
            r"(?i)writeFile.*log.*patient|patient.*writeFile.*log",
        ],
    },
    {
        "id": "phi-debug-output",
        "category": "phi-exposure",
        "severity": "medium",
        "title": "Debug mode with patient data",
        "reference": "§164.502, §164.514",
        "patterns": [
            r"(?i)debug\s*[:=]\s*true.*patient|patient.*debug\s*[:=]\s*true",
        ],
    },
]
