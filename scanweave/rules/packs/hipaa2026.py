"""Span rules matched over several lines with a two-sided compliance window."""

# Ids, severities, titles, citations and patterns of this pack.
RULES = [
    {
        "id": "HIPAA-MFA-001",
        "category": "access-control",
        "severity": "critical",
        "title": "Missing Multi-Factor Authentication for PHI Access",
        "reference": "45 CFR §164.312(a)(2)(i) - Access Control (Required)",
        "confidence": "high",
        "patterns": [
            r"(?i)(?:login|authenticate|signin|auth).*?(?:patient|phi|medical|health)(?!.*?(?:mfa|multi.?factor|2fa|totp|authenticator))",
            r"(?i)(?:passport|auth0|okta|cognito)\.(?:use|configure).*?(?!.*?(?:mfa|multiFactor|requireMFA))",
            r"(?i)/admin.*?(?:patient|medical|phi)(?!.*?(?:mfa|2fa))",
            r"(?i)createSession.*?(?:user|admin)(?!.*?mfaVerified)",
            r"(?i)jwt\.sign\(.*?(?:patient|phi)(?!.*?mfaVerified)",
        ],
        "negatives": [
            r"(?i)requireMFA:\s*true",
            r"(?i)mfaVerified",
            r"(?i)authenticator\.verify",
            r"(?i)totp\.validate",
        ],
    },
    {
        "id": "HIPAA-ENC-REST-001",
        "category": "encryption",
        "severity": "critical",
        "title": "ePHI Stored Without Encryption at Rest",
        "reference": "45 CFR §164.312(a)(2)(iv) - Encryption (Required)",
        "confidence": "high",
        "patterns": [
            r"(?i)(?:mongoose|sequelize|typeorm|prisma)\.(?:connect|createConnection).*?(?!.*?(?:encrypt|ssl|tls))",
            r"(?i)(?:fs\.writeFile|writeFileSync|s3\.putObject).*?(?:patient|phi|medical)(?!.*?(?:encrypt|cipher))",
            r"(?i)localStorage\.setItem.*?(?:patient|ssn|mrn|phi)",
            r"(?i)(?:res\.cookie|setCookie).*?(?:patient|phi|medical)(?!.*?(?:encrypt|secure|httpOnly))",
            r"(?i)MongoClient\.connect.*?(?!.*?(?:ssl|tls|encryption))",
            r"(?i)(?:pg|postgres)\.(?:connect|Pool).*?(?!.*?ssl)",
        ],
        "negatives": [
            r"(?i)encrypt:\s*true",
            r"(?i)ssl:\s*true",
            r"(?i)cipher\.",
            r"(?i)aes-256",
        ],
    },
    {
        "id": "HIPAA-SESSION-001",
        "category": "access-control",
        "severity": "high",
        "title": "Missing Automatic Session Timeout",
        "reference": "45 CFR §164.312(a)(2)(iii) - Session Control (Required)",
        "confidence": "high",
        "patterns": [
            r"(?i)(?:express-session|session)\.(?:configure|use)(?!.*?(?:maxAge|expires|timeout))",
            r"(?i)maxAge:\s*(?:9[0-9]{5}[0-9]+|[1-9][0-9]{6,})",
            r"(?i)jwt\.sign\([^)]*(?!.*?expiresIn)",
            r"(?i)cookie-session.*?(?!.*?maxAge)",
            r"(?i)session.*?(?!.*?(?:idle|inactivity).*?timeout)",
        ],
        "negatives": [
            r"(?i)maxAge:\s*[1-9][0-9]{0,5}\b",
            r"""(?i)expiresIn:\s*['"](?:1[0-5]m|[1-9]m)['"]""",
            r"(?i)idleTimeout",
        ],
    },
    {
        "id": "HIPAA-REVOKE-001",
        "category": "access-control",
        "severity": "critical",
        "title": "Missing Immediate Access Revocation",
        "reference": "45 CFR §164.308(a)(3)(ii)(C) - Termination Procedures (Required)",
        "confidence": "medium",
        "patterns": [
            r"(?i)(?:deactivate|disable|remove)User(?!.*?(?:revoke|invalidate|blacklist).*?(?:token|session))",
            r"(?i)(?:deleteUser|removeUser).*?(?!.*?(?:logout|invalidate|clearSessions))",
            r"(?i)(?:deactivat|terminat|disabl)e?(?:User|Account|Member|Employee)|(?:user|account|member|employee)(?:Deactivation|Termination)|(?:user|account|member)\.(?:deactivate|terminate|disable)\b",
            r"(?i)(?:updateRole|changePermissions)(?!.*?(?:logout|reauth|invalidate))",
        ],
        "negatives": [
            r"(?i)revokeAllTokens",
            r"(?i)invalidateAllSessions",
            r"(?i)tokenBlacklist\.add",
            r"(?i)clearUserSessions",
        ],
    },
    {
        "id": "HIPAA-BREACH-001",
        "category": "audit-logging",
        "severity": "critical",
        "title": "Missing Breach Notification Mechanism",
        "reference": "45 CFR §164.308(a)(6)(ii) - Security Incident Procedures (Required)",
        "confidence": "medium",
        "patterns": [
            r"(?i)catch\s*\(.*?error.*?\).*?(?:security|unauthorized|breach)(?!.*?(?:notifyBreach|incidentResponse|alertSecurity))",
            r"(?i)(?:failed|invalid).*?(?:login|auth)(?!.*?(?:monitor|alert|notify))",
            r"(?i)(?:unusual|suspicious).*?access(?!.*?(?:alert|notify|incident))",
        ],
        "negatives": [
            r"(?i)breachNotification\.",
            r"(?i)incidentResponse\.trigger",
            r"(?i)securityAlert\.send",
            r"(?i)notifyBreach",
        ],
    },
    {
        "id": "HIPAA-SEGMENT-001",
        "category": "access-control",
        "severity": "critical",
        "title": "Missing Network Segmentation for PHI",
        "reference": "45 CFR §164.312(e)(1) - Transmission Security (Required)",
        "confidence": "high",
        "patterns": [
            r"""(?i)cors\(\{?\s*origin:\s*['"]?\*['"]?.*?(?:patient|phi|medical)""",
            r"(?i)/api.*?(?:patient|phi|medical)(?!.*?(?:firewall|vpc|subnet|private))",
            r"(?i)(?:express|fastify|koa)\.listen.*?(?:patient|phi)(?!.*?(?:localhost|127\.0\.0\.1|private))",
            r"(?i)(?:database|(?<!local)(?<!session)storage).*?(?:patient|phi)(?!.*?(?:vpc|subnet|securityGroup))",
        ],
        "negatives": [
            r"(?i)origin:\s*\[.*?\]",
            r"(?i)private.*?subnet",
            r"(?i)securityGroup",
            r"(?i)firewall.*?rules",
            r"(?i)\bfetch\s*\(",
            r"(?i)\baxios\b",
        ],
    },
    {
        "id": "HIPAA-ASSET-001",
        "category": "data-retention",
        "severity": "high",
        "title": "Generate ePHI Technology Asset Inventory",
        "reference": "45 CFR §164.308(a)(1)(ii)(A) - Risk Analysis (Required)",
        "confidence": "high",
        "patterns": [
            r"(?i)(?:mongoose|sequelize|prisma|typeorm|knex)\.(?:connect|model)",
            r"(?i)(?:s3|azure\.storage|gcs)\.",
            r"(?i)(?:stripe|twilio|sendgrid|mailgun)\.(?:api|client)",
            r"(?i)(?:axios|fetch|got|request)\.",
        ],
    },
    {
        "id": "HIPAA-FLOW-001",
        "category": "data-retention",
        "severity": "high",
        "title": "Generate ePHI Flow Map",
        "reference": "45 CFR §164.308(a)(1)(ii)(A) - Risk Analysis (Required)",
        "confidence": "high",
        "patterns": [
            r"(?i)(?:req\.body|req\.params|req\.query).*?(?:patient|phi|medical)",
            r"(?i)(?:process|transform|validate).*?(?:patient|phi)",
            r"(?i)(?:save|insert|update).*?(?:patient|phi)",
            r"(?i)(?:res\.(?:send|json)|return).*?(?:patient|phi)",
        ],
    },
    {
        "id": "HIPAA-PENTEST-001",
        "category": "audit-logging",
        "severity": "high",
        "title": "Missing Vulnerability Scanning Configuration",
        "reference": "45 CFR §164.308(a)(8) - Evaluation (Required)",
        "confidence": "medium",
        "patterns": [
            r"(?i)package\.json(?!.*?(?:snyk|audit|vulnerability))",
        ],
        "negatives": [
            r"(?i)dependabot\.yml",
            r"(?i)snyk\.yml",
            r"(?i)trivy",
            r"(?i)npm audit",
            r"(?i)security.*?scan",
        ],
    },
]
