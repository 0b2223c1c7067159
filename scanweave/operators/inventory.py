"""Package manifests: dependency inventory, data-flow components, stack detection, guide lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.functions.sql import lit

# Package to category and provider, in lookup order.
PACKAGES = [
    ("next", "framework", "Next.js Framework"),
    ("react", "framework", "React Library"),
    ("vue", "framework", "Vue.js Framework"),
    ("nuxt", "framework", "Nuxt Framework"),
    ("svelte", "framework", "Svelte Framework"),
    ("express", "framework", "Express.js Framework"),
    ("fastify", "framework", "Fastify Framework"),
    ("hono", "framework", "Hono Framework"),
    ("elysia", "framework", "Elysia Framework"),
    ("nestjs", "framework", "NestJS Framework"),
    ("@prisma/client", "database", "Prisma ORM"),
    ("prisma", "database", "Prisma ORM"),
    ("mongoose", "database", "Mongoose ODM (MongoDB)"),
    ("drizzle-orm", "database", "Drizzle ORM"),
    ("typeorm", "database", "TypeORM"),
    ("sequelize", "database", "Sequelize ORM"),
    ("knex", "database", "Knex.js Query Builder"),
    ("pg", "database", "PostgreSQL Driver"),
    ("mysql2", "database", "MySQL Driver"),
    ("mongodb", "database", "MongoDB Driver"),
    ("redis", "database", "Redis Client"),
    ("next-auth", "auth", "NextAuth.js"),
    ("@auth/core", "auth", "Auth.js"),
    ("passport", "auth", "Passport.js"),
    ("jsonwebtoken", "auth", "JWT (JSON Web Tokens)"),
    ("bcrypt", "auth", "bcrypt Password Hashing"),
    ("argon2", "auth", "Argon2 Password Hashing"),
    ("@clerk/nextjs", "auth", "Clerk Authentication"),
    ("@supabase/auth-helpers", "auth", "Supabase Auth"),
    ("lucia", "auth", "Lucia Auth"),
    ("@supabase/supabase-js", "cloud", "Supabase BaaS"),
    ("@aws-sdk", "cloud", "AWS SDK"),
    ("aws-sdk", "cloud", "AWS SDK"),
    ("@google-cloud", "cloud", "Google Cloud SDK"),
    ("@azure", "cloud", "Azure SDK"),
    ("firebase", "cloud", "Firebase"),
    ("firebase-admin", "cloud", "Firebase Admin"),
    ("@vercel/analytics", "cloud", "Vercel Analytics"),
    ("@vercel/edge", "cloud", "Vercel Edge Functions"),
    ("stripe", "payment", "Stripe Payments"),
    ("@stripe/stripe-js", "payment", "Stripe.js"),
    ("paypal", "payment", "PayPal SDK"),
    ("@sendgrid/mail", "communication", "SendGrid Email"),
    ("nodemailer", "communication", "Nodemailer Email"),
    ("twilio", "communication", "Twilio SMS/Voice"),
    ("@twilio/conversations", "communication", "Twilio Conversations"),
    ("resend", "communication", "Resend Email"),
    ("axios", "utility", "Axios HTTP Client"),
    ("lodash", "utility", "Lodash Utility Library"),
    ("date-fns", "utility", "date-fns Date Utility"),
    ("dayjs", "utility", "Day.js Date Library"),
    ("zod", "utility", "Zod Validation"),
    ("joi", "utility", "Joi Validation"),
    ("yup", "utility", "Yup Validation"),
]
DEV_TOOLS = ["typescript", "eslint", "prettier", "vitest", "jest"]
DEV_PREFIXES = ["@types/", "eslint-", "@testing-library/"]

# Data-flow components (package, name, id).
DATA_STORES = [
    ("@prisma/client", "Prisma ORM", "prisma"), ("prisma", "Prisma", "prisma"),
    ("@supabase/supabase-js", "Supabase", "supabase"), ("mongoose", "MongoDB (Mongoose)", "mongodb"),
    ("mongodb", "MongoDB", "mongodb"), ("pg", "PostgreSQL", "postgresql"), ("mysql2", "MySQL", "mysql"),
    ("redis", "Redis", "redis"), ("drizzle-orm", "Drizzle ORM", "drizzle"),
]
AUTH_PROVIDERS = [
    ("next-auth", "NextAuth.js", "nextauth"), ("@clerk/nextjs", "Clerk", "clerk"),
    ("@auth0/nextjs-auth0", "Auth0", "auth0"), ("passport", "Passport.js", "passport"),
    ("@supabase/auth-helpers", "Supabase Auth", "supabase-auth"), ("lucia", "Lucia Auth", "lucia"),
]
EXTERNAL_SERVICES = [
    ("stripe", "Stripe (Payments)", "stripe"), ("@sendgrid/mail", "SendGrid (Email)", "sendgrid"),
    ("nodemailer", "Nodemailer (Email)", "nodemailer"), ("twilio", "Twilio (SMS)", "twilio"),
    ("resend", "Resend (Email)", "resend"), ("@aws-sdk", "AWS Services", "aws"), ("aws-sdk", "AWS Services", "aws"),
    ("@google-cloud", "Google Cloud", "gcp"), ("firebase", "Firebase", "firebase"),
]
API_FOLDERS = ["pages/api", "app/api", "src/pages/api", "src/app/api"]
SERVER_FRAMEWORKS = ["express", "fastify", "next"]

# Technologies in priority order: name, packages, config files or environment words.
FRAMEWORKS = [
    ("nextjs", ["next"], r"(?:^|/)next\.config\.(?:js|mjs|ts)$"), ("nuxt", ["nuxt"], r"(?:^|/)nuxt\.config\.(?:js|ts)$"),
    ("nestjs", ["@nestjs/core"], r"(?:^|/)nest-cli\.json$"), ("angular", ["@angular/core"], r"(?:^|/)angular\.json$"),
    ("fastify", ["fastify"], None), ("hono", ["hono"], None), ("koa", ["koa"], None), ("express", ["express"], None),
    ("vue", ["vue"], None), ("react", ["react", "react-dom"], None),
]
DATABASES = [
    ("supabase", ["@supabase/supabase-js", "@supabase/ssr", "@supabase/auth-helpers-nextjs"],
     "SUPABASE_URL|NEXT_PUBLIC_SUPABASE_URL|SUPABASE_ANON_KEY"),
    ("firebase", ["firebase", "firebase-admin", "@firebase/firestore"], "FIREBASE_API_KEY|NEXT_PUBLIC_FIREBASE"),
    ("prisma", ["@prisma/client", "prisma"], None), ("drizzle", ["drizzle-orm"], None),
    ("mongodb", ["mongodb", "mongoose"], "MONGODB_URI|MONGO_URL"),
    ("postgresql", ["pg", "postgres", "@vercel/postgres", "node-postgres"], "DATABASE_URL|POSTGRES_URL|PG_CONNECTION"),
    ("mysql", ["mysql", "mysql2"], "MYSQL_URL|MYSQL_HOST"),
]
AUTHS = [
    ("clerk", ["@clerk/nextjs", "@clerk/clerk-react"], None),
    ("auth0", ["@auth0/nextjs-auth0", "@auth0/auth0-react", "auth0"], None),
    ("nextauth", ["next-auth", "@auth/core"], r"(?:^|/)auth\.(?:ts|js)$"),
    ("supabase-auth", ["@supabase/auth-helpers-nextjs", "@supabase/auth-helpers-react", "@supabase/ssr"], None),
    ("firebase-auth", ["firebase/auth", "@firebase/auth"], None), ("lucia", ["lucia", "lucia-auth"], None),
    ("passport", ["passport", "passport-local", "passport-jwt"], None),
]
ENV_FILES = r"\.(?:ts|tsx|js|jsx|env)$|\.env\.local$"

# Remediation guides and the title or id texts that lead to them, in order.
GUIDES = [
    ("dob-exposure", ["Date of birth exposure", "dob-exposed"]),
    ("phi-console-log", ["PHI data in console output", "Patient name in console", "phi-console-log",
                         "Patient object serialized"]),
    ("phi-storage", ["PHI stored in localStorage", "PHI stored in sessionStorage", "PHI stored in cookies",
                     "phi-localstorage"]),
    ("no-audit-logging", ["No audit logging framework detected", "audit-framework-missing"]),
    ("phi-read-no-audit", ["PHI read operation may lack audit logging", "phi-access-unlogged"]),
    ("data-deletion-no-audit", ["Data deletion without apparent logging", "unlogged-delete"]),
    ("hardcoded-credentials", ["Hardcoded password", "Hardcoded secret", "API key exposed", "hardcoded-password",
                               "hardcoded-secret", "api-key-exposed"]),
    ("sql-injection", ["SQL query string concatenation", "SQL query with template literal", "Database query with template",
                       "sql-injection"]),
    ("xss-innerhtml", ["Unsanitized innerHTML", "dangerouslySetInnerHTML", "innerHTML", "document.write"]),
    ("http-not-https", ["Unencrypted HTTP URL", "http-url", "HTTP endpoint"]),
    ("diagnosis-code-exposure", ["Diagnosis code in source", "ICD-10", "diagnosis-code"]),
]

MANIFEST_SCHEMA = "struct<dependencies:map<string,string>,devDependencies:map<string,string>>"


def read_manifests(manifests: DataFrame) -> DataFrame:
    """``project, body`` JSON to one map of all dependencies; development entries win on a repeated name."""
    m = manifests.select("project", F.from_json("body", MANIFEST_SCHEMA).alias("m"))
    empty = F.expr("map()").cast("map<string,string>")
    m = m.select("project", F.coalesce("m.dependencies", empty).alias("a"), F.coalesce("m.devDependencies", empty).alias("b"))
    return m.select("project", F.expr(
        "map_concat(transform_values(a, (k, v) -> coalesce(element_at(b, k), v)), "
        "map_filter(b, (k, v) -> NOT map_contains_key(a, k)))").alias("deps"))


def dependency_inventory(manifests: DataFrame) -> DataFrame:
    """Runtime dependencies with category and provider: exact name first, else the first prefix in table order.

    Numbering follows the manifest's order and happens inside the row, so nothing is shuffled.
    """
    table = "array(" + ", ".join(
        f"named_struct('k', {lit(k)}, 'category', {lit(c)}, 'provider', {lit(p)})" for k, c, p in PACKAGES) + ")"
    tools = ", ".join(lit(t) for t in DEV_TOOLS)
    prefixes = " OR ".join(f"startswith(e.key, {lit(p)})" for p in DEV_PREFIXES)
    kept = f"filter(map_entries(deps), e -> NOT (e.key IN ({tools}) OR {prefixes}))"
    d = read_manifests(manifests).select("project", F.posexplode(F.expr(kept)).alias("k", "e"))
    d = d.select("project", "k", F.col("e.key").alias("name"), F.col("e.value").alias("value"))
    hit = F.expr(
        f"coalesce(get(filter({table}, t -> t.k = name), 0), get(filter({table}, t -> startswith(name, t.k)), 0))")
    number = (F.col("k") + 1).cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return d.withColumn("hit", hit).select(
        "project", F.concat(F.lit("TECH-"), padded).alias("id"), "name", F.regexp_replace("value", "[\\^~]", "").alias("version"),
        F.coalesce("hit.category", F.lit("other")).alias("category"), F.coalesce("hit.provider", "name").alias("provider"))


def _flags(findings: DataFrame) -> DataFrame:
    """Per project, the facts about its findings that the component table asks for; one aggregate."""
    cat, file, title = F.col("category"), F.lower("file"), F.lower("title")
    ids = sorted({i for _, _, i in DATA_STORES})
    any_of = {
        "store_issue": cat.isin("encryption", "data-retention"), "auth_issue": cat.isin("access-control", "audit-logging"),
        "external_issue": (cat == "encryption") | F.contains(title, F.lit("api")) | F.contains(title, F.lit("external")),
        "entry_issue": cat.isin("access-control", "phi-exposure"), "api_file": F.contains(F.col("file"), F.lit("/api/")),
        **{f"file_{i}": F.contains(file, F.lit(i)) for i in ids},
    }
    return findings.groupBy("project").agg(*[F.bool_or(c).alias(n) for n, c in any_of.items()])


def data_flow_components(manifests: DataFrame, findings: DataFrame, corpus: DataFrame, root: str = "root") -> DataFrame:
    """Stores, auth providers, external services and entry points of each project, with an issue flag."""
    rel = F.expr(f"substring(file, length({root}) + 2)")
    in_api = F.lit(False)
    for folder in API_FOLDERS:
        in_api = in_api | rel.startswith(folder + "/")
    routes = corpus.filter(in_api & F.col("file").rlike(r"\.(?:ts|js)$")).groupBy("project").agg(
        F.count("*").alias("routes"))
    m = read_manifests(manifests).join(_flags(findings), "project", "left").join(routes, "project", "left")

    def yes(c):
        return f"coalesce({c}, false)"

    items = [
        f"CASE WHEN map_contains_key(deps, {lit(p)}) THEN named_struct('type', 'data-store', 'id', {lit(i)}, 'name', {lit(n)}, "
        f"'has_issues', {yes(f'file_{i}')} OR {yes('store_issue')}) END" for p, n, i in DATA_STORES]
    items += [
        f"CASE WHEN map_contains_key(deps, {lit(p)}) THEN named_struct('type', 'auth-provider', 'id', {lit(i)}, 'name', "
        f"{lit(n)}, 'has_issues', {yes('auth_issue')}) END" for p, n, i in AUTH_PROVIDERS]
    items += [
        f"CASE WHEN exists(map_keys(deps), d -> contains(d, {lit(p)})) THEN named_struct('type', 'external-service', 'id', "
        f"{lit(i)}, 'name', {lit(n)}, 'has_issues', {yes('external_issue')}) END" for p, n, i in EXTERNAL_SERVICES]
    server = " OR ".join(f"map_contains_key(deps, {lit(f)})" for f in SERVER_FRAMEWORKS)
    items.append(
        "CASE WHEN routes > 0 THEN named_struct('type', 'entry-point', 'id', 'api-routes', 'name', "
        f"concat('API Routes (', routes, ' detected)'), 'has_issues', {yes('api_file')} OR {yes('entry_issue')}) "
        f"WHEN {server} THEN named_struct('type', 'entry-point', 'id', 'api-endpoints', 'name', 'API Endpoints', "
        f"'has_issues', {yes('entry_issue')}) END")
    return m.select("project", F.explode(F.expr(f"array_compact(array({', '.join(items)}))")).alias("c")).select(
        "project", "c.*")


def detect_stack(manifests: DataFrame, corpus: DataFrame) -> DataFrame:
    """Framework, database and auth of each project: first in priority whose package is there.

    Config files and environment words anywhere in the project raise the confidence.
    """
    env = F.col("file").rlike(ENV_FILES)
    evidence = {}
    for name, _, p in FRAMEWORKS + AUTHS:
        if p:
            evidence[f"has_{name}"] = F.col("file").rlike(p)
    for name, _, p in DATABASES:
        if p:
            evidence[f"env_{name}"] = env & F.col("content").rlike(p)
    seen = corpus.groupBy("project").agg(*[F.bool_or(c).alias(n) for n, c in evidence.items()])
    m = read_manifests(manifests).join(seen, "project", "left")

    def has(packages):
        return "exists(map_keys(deps), d -> " + " OR ".join(
            f"d = {lit(p)} OR startswith(d, {lit(p + '/')})" for p in packages) + ")"

    def choose(table, base, prefix, rest=""):
        cases = []
        for name, packages, p in table:
            boost = f"CASE WHEN coalesce(`{prefix}_{name}`, false) THEN 0.95D ELSE {base}D END" if p else f"{base}D"
            cases.append(f"WHEN {has(packages)} THEN named_struct('name', {lit(name)}, 'confidence', {boost}, 'version', "
                         f"element_at(deps, {lit(packages[0])}))")
        none = "named_struct('name', 'unknown', 'confidence', 0D, 'version', CAST(NULL AS STRING))"
        return F.expr(f"CASE {' '.join(cases)} {rest} ELSE {none} END")

    def part(word, name):
        return (f"WHEN exists(map_keys(deps), d -> contains(d, '{word}')) THEN named_struct('name', '{name}', 'confidence', "
                "0.6D, 'version', CAST(NULL AS STRING))")

    rest = part("supabase", "supabase-auth") + " " + part("firebase", "firebase-auth")
    s = m.select(
        "project", choose(FRAMEWORKS, 0.7, "has").alias("f"), choose(DATABASES, 0.8, "env").alias("d"),
        choose(AUTHS, 0.8, "has", rest).alias("a"))
    return s.select(
        "project", *[F.col(f"{k}.{c}").alias(f"{n}{s_}") for k, n in (("f", "framework"), ("d", "database"), ("a", "auth"))
                     for c, s_ in (("name", ""), ("confidence", "_confidence"), ("version", "_version"))])


def remediation_guide(findings: DataFrame) -> DataFrame:
    """The first guide one of whose texts is part of the title or id."""
    cases = []
    for guide, texts in GUIDES:
        cond = " OR ".join(f"contains(lower(title), {lit(t.lower())}) OR contains(lower(finding_id), {lit(t.lower())})"
                           for t in texts)
        cases.append(f"WHEN {cond} THEN {lit(guide)}")
    return findings.withColumn("guide", F.expr(f"CASE {' '.join(cases)} END"))


def vulnerabilities(reports: DataFrame) -> DataFrame:
    """``project, body`` audit reports to one row per package; ``via`` is a text or a list of objects or texts."""
    schema = "struct<vulnerabilities:map<string,struct<severity:string,via:string,range:string,fixAvailable:string>>>"
    v = reports.select("project", F.explode(F.from_json("body", schema)["vulnerabilities"]).alias("name", "v"))
    first = F.get_json_object("v.via", "$[0]")
    title, url = F.get_json_object(first, "$.title"), F.get_json_object(first, "$.url")
    is_list = F.col("v.via").startswith("[")
    via = F.when(is_list & url.isNotNull(), F.coalesce(F.nullif(title, F.lit("")), "name")).when(
        is_list, first).otherwise(F.col("v.via"))
    return v.select("project", "name", F.col("v.severity").alias("severity"), via.alias("via"),
                    F.col("v.range").alias("range"), (F.col("v.fixAvailable") != "false").alias("fix_available"),
                    F.when(is_list, url).alias("url"))


