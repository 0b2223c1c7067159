"""Streaming queries: each runs the given tables through micro-batches and reads back what the sinks hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import oracle as o
from checks.corpus import DOC_ENDS, _array, _q, read
from checks.lifecycle import FOUND, found
from checks.registry import query
from scanweave.functions.sql import lit
from scanweave.operators import lifecycle as lc
from scanweave.rules.catalog import LINE_PACKS, line_rules
from scanweave.sources.folders import stored, work_folder
from scanweave.streaming import watch as w

_FILE = (f"concat('/repos/docs/', lang, '/doc_', doc_id, element_at(array({_array(DOC_ENDS, lit)}), "
         f"CAST(doc_id % {len(DOC_ENDS)} AS INT) + 1))")


def _documents_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    return w.read_stream(spark, sf, schema, "documents.parquet").selectExpr(
        "concat('docs-', source) AS project", f"{_FILE} AS file", "text AS content")


_DOCS = (f"SELECT 'docs-' || source AS project, '/repos/docs/' || lang || '/doc_' || doc_id || ([{_array(DOC_ENDS, _q)}])[CAST("
         f"doc_id % {len(DOC_ENDS)} AS INT) + 1] AS file, text AS content, doc_id AS scan_id FROM documents")
o.FROM["docs"] = lambda: _DOCS


@query("x01_watch_scan", f"{o.findings(line_rules(LINE_PACKS), 'docs')} SELECT severity, count(*) AS findings FROM findings GROUP "
       "BY severity")
def watch_scan(spark, sf):
    path = work_folder(spark, "watch")
    findings = w.scan_stream(_documents_stream(spark, sf), LINE_PACKS)
    w.write_findings(findings, f"{path}/out", f"{path}/checkpoint")
    return w.severity_report(spark.read.schema(findings.schema).parquet(f"{path}/out"))


_EXTRA = "const password = \"hunter2hunter2\";"
# The final text of each file: alerts of the first version plus what the second adds are the alerts of this text.
o.FROM["docs2"] = lambda: (
    "SELECT project, file, CASE WHEN scan_id % 2 = 0 THEN content || chr(10) || " + _q(_EXTRA)
    + f" ELSE content END AS content, scan_id FROM ({_DOCS})")


@query("x02_new_alerts", f"{o.findings(line_rules(LINE_PACKS), 'docs2')} SELECT file, file || ':' || line || ':' || finding_id AS "
       "key FROM findings WHERE rank <= 1")
def new_alerts(spark, sf):
    """Every alert of the first scan, then only what a second version of half the files adds."""
    path = work_folder(spark, "alerts")
    docs = read(spark, sf, "documents").selectExpr(
        "concat('docs-', source) AS project", f"{_FILE} AS file", "text AS content", "doc_id")
    docs.drop("doc_id").write.parquet(f"{path}/in/v1")
    again = docs.filter("doc_id % 2 = 0").withColumn("content", F.concat("content", F.lit("\n" + _EXTRA))).drop("doc_id")
    schema = docs.drop("doc_id").schema
    handle = w.alert_batches(f"{path}/log", f"{path}/alerts", LINE_PACKS)
    for _ in range(2):
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/in")
        w.run_available(stream.writeStream.foreachBatch(handle), f"{path}/checkpoint")
        if _ == 0:
            again.write.parquet(f"{path}/in/v2")
    return spark.read.parquet(f"{path}/alerts").select("file", "key")


def _in_turns(spark, rows, path, ts, turns, handle) -> None:
    """Runs a stream over ``rows`` in the order of their time: each turn adds the rows of its share of the time and processes them."""
    rows = stored(rows, "rows")
    low, high = rows.agg(F.min(F.unix_micros(ts)), F.max(F.unix_micros(ts))).first()
    if low is None:
        rows.write.parquet(f"{path}/in/turn=0")
        handle()
        return
    width = (high - low) // turns + 1
    for k in range(turns):
        rows.filter(F.floor((F.unix_micros(ts) - low) / width) == k).write.parquet(f"{path}/in/turn={k}")
        handle()


@query("x03_notify_once", f"{FOUND} SELECT DISTINCT project || ':' || rule_id AS key FROM findings WHERE rank <= 1")
def notify(spark, sf):
    """Findings of all scans stream in by the time of their scan, in four turns; a project hears of a rule once. The horizon is
    longer than all scans take, so no key is forgotten before the last."""
    path = work_folder(spark, "notify")
    keyed = found(spark, sf).select(
        F.concat_ws(":", "project", "rule_id").alias("key"), "rank", F.col("scan_ts").cast("timestamp").alias("scan_ts"))
    w.on_disk_state(spark)

    def handle():
        source = spark.readStream.schema(keyed.schema).option("recursiveFileLookup", "true").parquet(f"{path}/in")
        w.write_findings(w.notify_once(source, "high", "scan_ts", "4000 days"), f"{path}/out", f"{path}/checkpoint")

    _in_turns(spark, keyed, path, "scan_ts", 4, handle)
    return spark.read.parquet(f"{path}/out").select("key")


_BURSTS = ("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER p <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s "
           "FROM events WINDOW p AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) "
           "AS b FROM e) SELECT user_id, count(*) AS changes, epoch_us(max(ts)) AS last_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS "
           "scan_us FROM g GROUP BY user_id, b")


@query("x04_debounce", _BURSTS)
def debounced(spark, sf):
    e = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    b = w.debounce(e, "user_id", "ts", "30 minutes")
    return b.select("user_id", "changes", F.unix_micros("last_change").alias("last_us"), F.unix_micros("scan_at").alias("scan_us"))


@query("x04_debounce_stream", _BURSTS)
def debounced_stream(spark, sf):
    """The same as a stream in six turns. A change of nobody, a year later, lets the watermark pass the last bursts."""
    path = work_folder(spark, "bursts")
    e = read(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    last = e.agg((F.max("ts") + F.expr("INTERVAL 365 DAYS")).alias("ts")).filter("ts IS NOT NULL")
    w.on_disk_state(spark)
    shape = e.schema

    def handle():
        source = spark.readStream.schema(shape).option("recursiveFileLookup", "true").parquet(f"{path}/in")
        w.write_findings(w.debounce(source, "user_id", "ts", "30 minutes"), f"{path}/out", f"{path}/checkpoint")

    _in_turns(spark, e, path, "ts", 6, handle)
    last.select(F.lit(None).cast(shape["user_id"].dataType).alias("user_id"), "ts").write.parquet(f"{path}/in/turn=last")
    handle()
    b = spark.read.parquet(f"{path}/out").filter("user_id IS NOT NULL")
    return b.select("user_id", "changes", F.unix_micros("last_change").alias("last_us"), F.unix_micros("scan_at").alias("scan_us"))


@query("x05_result_upsert", "SELECT user_id || '/' || event_type AS key, arg_max(props, (ts, event_type, props)) AS detail, count(*) "
       "FILTER (WHERE false) + 1 AS n FROM events GROUP BY 1")
def upsert(spark, sf):
    path = work_folder(spark, "results")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    rows = w.read_stream(spark, sf, schema, "events.parquet").selectExpr(
        "concat(user_id, '/', event_type) AS key", "CAST(ts AS TIMESTAMP) AS ts", "event_type AS status", "props AS detail")
    w.run_available(rows.writeStream.foreachBatch(w.ingest_batches(f"{path}/log")), f"{path}/checkpoint")
    log = spark.read.schema(w.RESULT_SCHEMA).parquet(f"{path}/log")
    return w.current_results(log).select("key", "detail", F.lit(1).alias("n"))


@query("x06_short_reuse", "WITH t AS (SELECT user_id, list_sort(list(epoch_us(ts))) AS l FROM events GROUP BY user_id), k AS (SELECT "
       "user_id, list_reduce(list_transform(l, lambda v: [v]), lambda acc, x: CASE WHEN x[1] - acc[-1] >= 3600000000 THEN "
       "list_concat(acc, x) ELSE acc END) AS kept FROM t) SELECT user_id, unnest(kept) AS us FROM k")
def reuse(spark, sf):
    path = work_folder(spark, "reuse")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    kept = w.keep_after_gap(w.read_stream(spark, sf, schema, "events.parquet"), "user_id", "ts", 3600)
    w.write_findings(kept, f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out")


@query("x06_reuse_of_hot_keys", "WITH t AS (SELECT event_type, list_sort(list(epoch_us(ts))) AS l FROM events GROUP BY event_type), k AS ("
       "SELECT event_type, list_reduce(list_transform(l, lambda v: [v]), lambda acc, x: CASE WHEN x[1] - acc[-1] >= 60000000 THEN "
       "list_concat(acc, x) ELSE acc END) AS kept FROM t) SELECT event_type, unnest(kept) AS us FROM k")
def reuse_hot(spark, sf):
    """The same over a table whose few keys hold all events, cut at gaps of a minute."""
    return w.keep_after_gap(read(spark, sf, "events"), "event_type", "ts", 60)


@query("l11_virtual_findings_and_artifacts", "SELECT DISTINCT 'cust-' || o_custkey AS project, 'HIPAA-PENTEST-001' AS finding_id, false AS artifact FROM orders "
       "UNION ALL SELECT DISTINCT 'cust-' || o_custkey, 'HIPAA-ASSET-001', true FROM orders")
def virtual(spark, sf):
    """Scan-wide findings reported once per scan collapse to one per project; the inventory is an artifact."""
    rows = read(spark, sf, "orders").selectExpr(
        "concat('cust-', o_custkey) AS project",
        "explode(array(named_struct('r', 'HIPAA-PENTEST-001', 'f', 'project-level'), named_struct('r', 'HIPAA-ASSET-001', 'f', "
        "'ASSET-INVENTORY'))) AS x").selectExpr("project", "x.r AS rule_id", "x.r AS finding_id", "x.f AS file")
    kept, artifacts = lc.split_artifacts(lc.dedupe_virtual(rows))
    return kept.select("project", "finding_id", F.lit(False).alias("artifact")).unionByName(
        artifacts.select("project", "finding_id", F.lit(True).alias("artifact")))
