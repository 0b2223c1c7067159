from pyspark.sql import functions as F

from checks.corpus import code_corpus
from checks.lifecycle import ACKS, AS_OF
from scanweave.operators import aggregate as a
from scanweave.operators import detect as d
from scanweave.operators import history as h
from scanweave.operators import lifecycle as lc
from scanweave.operators import stored as st
from scanweave.plans.scan import detect_categories, scan
from scanweave.sources import corpus as src

FILES = "project string, file string, content string"


def test_running_a_pack_twice_gives_no_duplicates(spark, sf):
    c = code_corpus(spark, sf)
    twice = detect_categories(c, ["phi-exposure", "audit-logging"])
    once = lc.dedupe(twice)
    keys = ["finding_id", "file", "line"]
    assert twice.filter("pack = 'errors'").count() == 2 * once.filter("pack = 'errors'").count() > 0
    assert once.count() == once.select(*keys).distinct().count() == lc.dedupe(once).count()


def test_suppression_rules(spark):
    text = "\n".join([
        "// scan-ignore security-hardcoded-pwd-* -- reviewed", "pwd = 'hunter22'",
        "// scan-ignore *", "pwd = 'hunter33' // scan-ignore * -- same line",
        "x", "pwd = 'hunter44' // scan-ignore * -- fine", "// scan-ignore phi-* -- other", "pwd = 'hunter55'"])
    c = spark.createDataFrame([("p", "/p/a.ts", text)], FILES)
    f = lc.suppress(d.detect(c, ["security"]))
    got = {r.line: (r.suppressed, r.suppression and r.suppression.reason) for r in f.collect()}
    assert got == {2: (True, "reviewed"), 4: (False, None), 6: (True, "fine"), 8: (False, None)}


def test_acknowledgement_first_match_and_dot_folders(spark):
    c = spark.createDataFrame([("p", "/p/.claude/src/a.ts", "pwd = 'hunter22'"), ("p", "/p/b.ts", "pwd = 'hunter22'")], FILES)
    acks = [lc.Ack("**/src/**", "one", "x", "2024-01-01", expires_at="2024-02-01"), lc.Ack("**/*.ts", "two", "x", "2024-01-01")]
    f = lc.acknowledge(d.detect(c, ["security"]), acks, "2024-03-01")
    got = {r.file: (r.acknowledgment.reason, r.acknowledgment.expired) for r in f.collect()}
    assert got == {"/p/.claude/src/a.ts": ("one", True), "/p/b.ts": ("two", False)}


def test_confidence_context(spark):
    text = "\n".join(["/* block", "pwd = 'hunter22'", "*/", "pwd = 'hunter33'", "// pwd = 'hunter44'"])
    c = spark.createDataFrame([("p", "/p/a.ts", text), ("p", "/p/a.py", "pwd = 'hunter22'"), ("p", "/p/a.test.ts", "pwd = 'hunter22'")],
                              FILES)
    got = {(r.file, r.line): r.confidence for r in lc.classify_confidence(d.detect(c, ["security"])).collect()}
    assert got == {("/p/a.ts", 2): "low", ("/p/a.ts", 4): "high", ("/p/a.ts", 5): "low", ("/p/a.py", 1): "medium",
                   ("/p/a.test.ts", 1): "low"}


def test_proposed_finding_does_not_raise_group(spark):
    rows = [("f", 1, "c", 0, "A", "critical", "x", "NPRM §164.1"), ("f", 1, "c", 2, "B", "medium", "y", "§164.2"),
            ("g", 1, "c", 1, "A", "high", "x", "NPRM §164.1")]
    f = spark.createDataFrame(rows, "file string, line int, category string, rank int, title string, severity string, "
                                    "finding_id string, reference string")
    got = {r.file: (r.severity, len(r.members)) for r in a.group_by_location(f).collect()}
    assert got == {"f": ("medium", 2), "g": ("high", 1)}


def test_scan_plan_counts_add_up(spark, sf):
    c = code_corpus(spark, sf)
    f = scan(c, acks=ACKS, as_of=AS_OF, min_confidence="medium").cache()
    groups = a.group_findings(f)
    assert groups.agg(F.sum("occurrence_count")).first()[0] == f.count() > 0
    scores = a.compliance_score(f, ("project",))
    assert scores.filter("score < 0 OR score > 100").count() == 0


def test_score_quarter_weight_and_empty_scan(spark):
    rows = [("p", "critical", True, False, False), ("p", "high", False, False, False), ("q", "critical", False, True, False)]
    f = spark.createDataFrame(rows, "project string, severity string, acknowledged boolean, suppressed boolean, is_baseline boolean")
    got = {r.project: (r.score, r.grade, r.total) for r in a.compliance_score(f).collect()}
    assert got == {"p": (93, "A", 2), "q": (100, "A", 0)}


def test_excludes_and_own_outputs(spark):
    paths = ["/p/src/a.ts", "/p/node_modules/x/a.ts", "/p/yarn.lock", "/p/.scanweave/x.json", "/p/samples/a.ts"]
    c = spark.createDataFrame([("p", x, "") for x in paths], FILES)
    assert [r.file for r in src.exclude_globs(c).collect()] == ["/p/src/a.ts"]
    assert {r.file for r in src.exclude_globs(c, include_own_outputs=True).collect()} == {
        "/p/src/a.ts", "/p/.scanweave/x.json", "/p/samples/a.ts"}


def test_read_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.ts").write_text("password = 'hunter22'\nügly")
    (tmp_path / "src" / "big.ts").write_text("x" * 2000)
    (tmp_path / "node_modules" / "b.ts").write_text("y")
    got = src.read_files(spark, str(tmp_path), max_bytes=1000).collect()
    assert [(r.file.split("/")[-1], r.content.split("\n")[1]) for r in got] == [("a.ts", "ügly")]


def test_previous_scan_across_buckets(spark):
    import datetime as dt
    import random

    random.seed(1)
    rows = [("hot" if i % 3 else f"p{i % 4}", i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=random.randint(0, 4000)),
             random.randint(0, 100)) for i in range(400)]
    df = spark.createDataFrame(rows, "project string, scan_id bigint, scan_ts timestamp, score int")
    got = {r.scan_id: r.prev and r.prev.score for r in h.with_previous(df, ["score"]).collect()}
    want, last = {}, {}
    for p, i, ts, s in sorted(rows, key=lambda r: (r[2], r[1])):
        want[i], last[p] = last.get(p), s
    assert got == want


def test_rate_limit_and_budget_against_brute_force(spark):
    import datetime as dt
    import random

    random.seed(2)
    rows = [(i, "k", f"s{i % 3 // 2}", dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=random.randint(0, 400_000)), 1000 + i, i)
            for i in range(300)]
    df = spark.createDataFrame(rows, "event_id bigint, key string, scan string, ts timestamp, input_tokens bigint, output_tokens bigint")
    got = {r.event_id: (r.in_minute, r.in_scan, r.allowed) for r in h.rate_limited(df, "scan", "ts").collect()}
    cost = {r.event_id: r.cents_before for r in h.budget_cutoff(df, "scan", "ts", 5, "minute").collect()}
    order = sorted(rows, key=lambda r: (r[3], r[0]))
    recorded = {}
    for n, (i, _, scan, ts, _, _) in enumerate(order):
        kept = recorded.setdefault(scan, [])
        minute = sum(1 for t in kept if ts - t < dt.timedelta(minutes=1))
        assert got[i] == (minute, len(kept), minute < 20 and len(kept) < 50)
        if got[i][2]:
            kept.append(ts)
        before = [r for r in order[:n] if r[2] == scan]
        assert abs(cost[i] - sum(r[4] * 3 + r[5] * 15 for r in before) / 10_000) < 1e-9


def test_refused_calls_are_not_recorded(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "s", t0 + dt.timedelta(seconds=2 * i)) for i in range(120)]
    got = h.rate_limited(spark.createDataFrame(rows, "event_id bigint, scan string, ts timestamp"), "scan", "ts").collect()
    assert sorted(r.event_id for r in got if r.allowed) == [*range(20), *range(30, 50), *range(60, 70)]


def test_registry_page(spark):
    rows = [(f"r{i}", f"name {i}", "text", ["a", "b"] if i % 2 else ["a"], i, 4.0, 10) for i in range(9)]
    reg = spark.createDataFrame(rows, "id string, name string, description string, tags array<string>, downloads bigint, "
                                      "rating double, reviews bigint")
    got = st.search_registry(reg, "NAME", tags=["b"], page=2, page_size=3).collect()
    assert [(r.id, r.n, r.total) for r in got] == [("r1", 4, 4)]


def _limited(rows):
    """The limiter's rule in plain Python: (event, calls of the last minute, calls of the scan, allowed)."""
    recorded, out = {}, []
    for i, scan, us in sorted(rows, key=lambda r: (r[2], r[0])):
        kept = recorded.setdefault(scan, [])
        minute = sum(us - t < 60_000_000 for t in kept)
        ok = minute < 20 and len(kept) < 50
        out.append((i, minute, len(kept), ok))
        if ok:
            kept.append(us)
    return sorted(out)


def test_rate_limit_of_hot_and_sparse_scans(spark):
    import random

    draw, rows = random.Random(4), []
    for scan, step, n in (("hot", 900_000, 900), ("bursts", 25_000_000, 250), ("sparse", 70_000_000, 90), (None, 2_900_000, 120)):
        t = -3_000_000_000
        for k in range(n):
            t += draw.choice((0, step, draw.randrange(2 * step), 61_000_000 if scan == "bursts" and k % 30 == 0 else step))
            rows.append((len(rows), scan, t))
    df = spark.createDataFrame(rows, "event_id bigint, scan string, us bigint").selectExpr("event_id", "scan", "timestamp_micros(us) AS ts")
    got = h.rate_limited(df.repartition(5), "scan", "ts").collect()
    assert sorted((r.event_id, r.in_minute, r.in_scan, r.allowed) for r in got) == _limited(rows)


def test_pieces_are_cut_at_gaps(spark):
    from scanweave.operators.gaps import cut_at_gaps

    rows = [("a", t) for t in (0, 5, 14, 24, 25, 90, 99, 200)] + [("b", 7), (None, 3), (None, 13)]
    cut = cut_at_gaps(spark.createDataFrame(rows, "k string, us long").repartition(3), ["k"], 10, 30)
    assert sorted((r.k or "", r.us, r.piece) for r in cut.collect()) == [
        ("", 3, 1), ("", 13, 2), ("a", 0, 1), ("a", 5, 1), ("a", 14, 1), ("a", 24, 2), ("a", 25, 2), ("a", 90, 3), ("a", 99, 3),
        ("a", 200, 4), ("b", 7, 1)]
    assert cut_at_gaps(spark.createDataFrame([], "k string, us long"), ["k"], 10, 30).collect() == []


def _moved_columns(df):
    """Columns of the rows that a plan's exchanges hand on."""
    import re

    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    parts = re.split(r"\n\(\d+\) ", text)
    return [re.search(r"Input \[\d+\]: \[(.*?)\]\n", p + "\n").group(1) for p in parts if re.match(r"(?:Broadcast)?Exchange", p)]


def test_cached_results_move_no_text(spark):
    import datetime as dt

    from scanweave.operators import lifecycle as lc

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        now = dt.datetime(2024, 1, 10)
        rows = [("p", f"f{i}", f"text {i % 7 if i % 3 else 0}") for i in range(90)] + [("q", None, None), ("q", "e", "")]
        corpus = spark.createDataFrame(rows, "project string, file string, content string").repartition(5)
        hashed = corpus.selectExpr("sha2(content, 256) AS content_hash", "content").distinct()
        cache = hashed.selectExpr("content_hash", "explode(array('A', 'B', 'Z')) AS rule_id", "content AS verdict").filter(
            "rule_id <> 'B' OR verdict <> 'text 0'").selectExpr("*", "timestamp '2024-01-09 20:00:00' AS cached_at")
        old = cache.selectExpr("content_hash", "rule_id", "'old' AS verdict", "timestamp '2024-01-09 19:00:00' AS cached_at")
        run, hit = lc.reuse_cached(corpus, ["A", "B", "C"], cache.unionByName(old), str(now))
        for plan in (run, hit):
            moved = _moved_columns(plan)
            assert moved and not any("content#" in m for m in moved)
        got = {(r.project, r.file, r.rule_id): r.content for r in run.collect()}
        want = {(p, f, r): c for p, f, c in rows for r in "ABC" if r == "C" or c is None or (r == "B" and c == "text 0")}
        assert got == want
        hits = hit.collect()
        assert {(r.project, r.file, r.rule_id) for r in hits} == {(p, f, r) for p, f, c in rows for r in "AB"} - got.keys()
        assert all(r.verdict != "old" for r in hits) and len(hits) + len(want) == 3 * len(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_short_reuse_of_hot_keys_in_a_table(spark):
    import random

    from scanweave.streaming import watch as w

    draw, rows = random.Random(8), []
    for key, step, n in (("hot", 7_000_000, 800), ("rare", 90_000_000, 60), (None, 20_000_000, 50)):
        t = 1_700_000_000_000_000
        for _ in range(n):
            t += draw.choice((0, 1, step, 30_000_000, draw.randrange(2 * step)))
            rows.append((key, t))
    want = []
    for key in ("hot", "rare", None):
        last = None
        for t in sorted(t for k, t in rows if k == key):
            if last is None or t - last >= 30_000_000:
                want.append((str(key), t))
                last = t
    df = spark.createDataFrame(rows, "k string, us long").selectExpr("k", "timestamp_micros(us) AS at").repartition(6)
    got = w.keep_after_gap(df, "k", "at").collect()
    assert sorted((str(r.k), r.us) for r in got) == sorted(want)


def test_deep_pages_of_the_registry(spark):
    from scanweave.operators.stored import search_registry

    rows = [(f"r{i:03}", f"name {i}", "text", ["a"], i % 7, 4.0, 10) for i in range(95)]
    r = spark.createDataFrame(rows, "id string, name string, description string, tags array<string>, downloads int, rating double, reviews int")
    whole = [x.id for x in search_registry(r, "name", page_size=95).orderBy("n").collect()]
    seen, after = [], None
    while True:
        page = search_registry(r, "name", page_size=20, after=after).orderBy("n").collect()
        if not page:
            break
        assert {x.total for x in page} == {95} and [x.n for x in page] == list(range(1, len(page) + 1))
        seen += [x.id for x in page]
        after = (page[-1].relevance, page[-1].id)
    assert seen == whole and len(set(seen)) == 95
    assert [x.id for x in search_registry(r, "name", page=2, page_size=20).orderBy("n").collect()] == whole[20:40]


def test_block_comments_of_a_file_with_many(spark):
    import time

    from scanweave.operators import detect as d

    lines = ["/* a", "pwd = 'hunter22'", "*/ b */", "pwd = 'hunter22' /* x */"] * 25_000 + ["/* open", "pwd = 'hunter22'"]
    c = spark.createDataFrame([("p", "a.ts", "\n".join(lines))], "project string, file string, content string")
    start = time.time()
    got = {r.line: r.in_block for r in d.detect(c, ["security"]).select("line", "in_block").collect()}
    assert len(got) == 50_001 and all(got.values()) and time.time() - start < 60


def test_processed_findings_are_written_without_their_texts(spark, sf):
    from checks.lifecycle import processed

    columns = processed(spark, sf).columns
    assert not {"code", "prev", "ctx"} & set(columns) and {"title", "acknowledged", "suppressed", "is_baseline"} <= set(columns)


def test_documents_take_a_part_of_their_length(spark, tmp_path):
    from scanweave.sources.tables import write_documents

    documents = spark.range(200).selectExpr("id", "concat(id, repeat('{\"severity\":\"high\"}', 200)) AS document")
    write_documents(documents, str(tmp_path / "out"))
    written = sum(f.stat().st_size for f in (tmp_path / "out").glob("part-*"))
    back = spark.read.text(str(tmp_path / "out"))
    assert written < documents.selectExpr("sum(length(document))").first()[0] / 10
    assert sorted(r.value for r in back.collect()) == sorted(r.document for r in documents.collect())
