import datetime as dt

from checks.corpus import code_corpus
from scanweave.operators import detect as d
from scanweave.streaming import watch as w


def test_streamed_findings_equal_batch(spark, sf, tmp_path):
    c = code_corpus(spark, sf).select("project", "file", "content")
    c.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = w.read_stream(spark, str(tmp_path / "in"), c.schema, files_per_batch=2)
    w.write_findings(w.scan_stream(stream, ["access"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    cols = ["finding_id", "file", "line"]
    got, want = spark.read.parquet(str(tmp_path / "out")).select(*cols), d.detect(c, ["access"]).select(*cols)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_tables_of_one_or_many_files_stream(spark, tmp_path):
    spark.range(7).repartition(3).write.parquet(str(tmp_path / "in" / "many.parquet"))
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("part-*")).rename(tmp_path / "in" / "one.parquet")
    for name, n in (("many.parquet", 7), ("one.parquet", 5)):
        out = str(tmp_path / f"out-{name}")
        w.write_findings(w.read_stream(spark, str(tmp_path / "in"), "id long", name), out, str(tmp_path / f"cp-{name}"))
        assert spark.read.schema("id long").parquet(out).count() == n


def test_alert_batches_replay_and_resolve(spark, tmp_path):
    schema = "project string, file string, content string"
    handle = w.alert_batches(str(tmp_path / "log"), str(tmp_path / "alerts"), ["security"], every=2)
    v = [[("p", "a.ts", "pwd = 'hunter22'")], [("p", "a.ts", "x"), ("p", "b.ts", "y")], [("p", "a.ts", "pwd = 'hunter22'")],
         [("p", "a.ts", "pwd = 'hunter22'\npwd = 'hunter33'")]]
    for n, rows in enumerate(v):
        for _ in range(2):  # a batch may run again
            handle(spark.createDataFrame(rows, schema), n)
    got = {(r.batch, r.key) for r in spark.read.parquet(str(tmp_path / "alerts")).collect()}
    assert got == {(0, "a.ts:1:security-hardcoded-pwd-0"), (2, "a.ts:1:security-hardcoded-pwd-0"),
                   (3, "a.ts:2:security-hardcoded-pwd-1")}


def test_results_after_compaction(spark, tmp_path):
    t, log = dt.datetime(2024, 1, 1), str(tmp_path / "log")
    handle, want = w.ingest_batches(log, every=2), {}
    for n in range(6):
        rows = [(k, t + dt.timedelta(n), "open", f"{k}{n}") for k in ("k", f"only{n}")]
        for _ in range(2):
            handle(spark.createDataFrame(rows, w.RESULT_SCHEMA), n)
        want |= {k: detail for k, _, _, detail in rows}
        assert {r.key: r.detail for r in w.stored_results(spark, log, n + 1, every=2).collect()} == want


def test_report_counts_active_findings(spark):
    c = spark.createDataFrame([("p", "a.ts", "pwd = 'hunter22'\n\n// scan-ignore * -- sample\npwd = 'hunter33'")], "project string, file string, content string")
    assert [r.findings for r in w.severity_report(d.detect(c, ["security"])).collect()] == [1]


def test_keep_after_gap_over_batches(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    offsets = [[0, 10, 29, 31, 45], [62, 70, 95, 200]]
    for n, part in enumerate(offsets):
        rows = [("k", t0 + dt.timedelta(seconds=s)) for s in part]
        spark.createDataFrame(rows, "key string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = w.read_stream(spark, str(tmp_path / "in"), "key string, ts timestamp")
        w.write_findings(w.keep_after_gap(stream, "key", "ts"), str(tmp_path / "out"), str(tmp_path / "cp"))
    base = spark.createDataFrame([(t0,)], "t timestamp").selectExpr("unix_micros(t) AS u").first().u
    got = sorted((r.us - base) // 1_000_000 for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [0, 31, 62, 95, 200]


def test_notify_once_and_latest_result(spark):
    f = spark.createDataFrame([("a", 0), ("a", 0), ("b", 3)], "key string, rank int")
    assert [r.key for r in w.notify_once(f).collect()] == ["a"]
    f = spark.createDataFrame([("p", "a", 0), ("q", "a", 0), ("q", "a", 0)], "project string, key string, rank int")
    assert sorted(r.project for r in w.notify_once(f).collect()) == ["p", "q"]
    t = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([("k", t, "open", "1"), ("k", t + dt.timedelta(1), "done", "2")], w.RESULT_SCHEMA)
    assert [(r.status, r.detail) for r in w.current_results(log).collect()] == [("done", "2")]


def test_debounce(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("p", t + dt.timedelta(milliseconds=m)) for m in (0, 400, 900, 3000)]
    got = w.debounce(spark.createDataFrame(rows, "project string, ts timestamp"), "project", "ts").orderBy("scan_at").collect()
    assert [(r.changes, (r.scan_at - t).total_seconds()) for r in got] == [(3, 1.9), (1, 4.0)]


def test_debounce_stream_with_watermark(spark, tmp_path):
    t, schema = dt.datetime(2024, 1, 1), "project string, ts timestamp"
    for part in ([0, 400, 900], [3000, 60_000], [200_000]):
        rows = [("p", t + dt.timedelta(milliseconds=m)) for m in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = w.read_stream(spark, str(tmp_path / "in"), schema)
        w.write_findings(w.debounce(stream, "project", "ts"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("scan_at").collect()
    assert [(r.changes, (r.scan_at - t).total_seconds()) for r in got] == [(3, 1.9), (1, 4.0), (1, 61.0)]


def _turns(spark, tmp_path, rows, schema, make):
    """Runs ``make(stream)`` once for each list of rows and returns the rows of state after each batch."""
    w.on_disk_state(spark)
    states = []
    for n, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/turn={n}"))
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        states.append(w.write_findings(make(source), str(tmp_path / "out"), str(tmp_path / "cp")))
    return states


def test_notified_keys_are_forgotten_after_the_horizon(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    days = [[("p", f"k{n % 3}", 0, t0 + dt.timedelta(days=n)), ("p", f"day{n}", 0, t0 + dt.timedelta(days=n, hours=1))] * 2 for n in range(12)]
    states = _turns(spark, tmp_path, days, "project string, key string, rank int, ts timestamp",
                    lambda s: w.notify_once(s, ts="ts", horizon="2 days"))
    told = sorted(r.key for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.key.startswith("day"))
    assert told == sorted(f"day{n}" for n in range(12))
    assert max(s[-1] for s in states) <= 10 and states[-1][-1] < 15  # 15 keys came in all


def test_debounce_over_turns_keeps_open_bursts_only(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    at = [[0, 0.5, 40], [40.4, 41.1, 90], [200], [500]]
    rows = [[("p", t0 + dt.timedelta(seconds=x)) for x in part] for part in at]
    states = _turns(spark, tmp_path, rows, "project string, ts timestamp", lambda s: w.debounce(s, "project", "ts"))
    got = {(round((r.last_change - t0).total_seconds(), 1), r.changes) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(0.5, 2), (41.1, 3), (90.0, 1), (200.0, 1)}
    assert all(s[-1] <= 2 for s in states)
