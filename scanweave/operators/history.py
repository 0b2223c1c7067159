"""Scan history: entries, comparison with the scan before, trends and deadlines.

Windows run per project over scan entries, which are one row per scan and carry no findings.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanweave.operators.aggregate import active, compliance_score, js_round, severity_counts
from scanweave.operators.gaps import cut_at_gaps, same
from scanweave.sources.folders import stored

SEVERITY_NAMES = ["critical", "high", "medium", "low"]
# Days to review per severity, call limits, prices per million tokens.
DEADLINE_DAYS = {"critical": 7, "high": 14, "medium": 30}
OTHER_DEADLINE_DAYS = 60
CALLS_PER_MINUTE = 20
CALLS_PER_SCAN = 50
INPUT_PRICE, OUTPUT_PRICE = 3, 15


def history_entries(findings: DataFrame, scan=("project", "scan_id", "scan_ts"), scans: DataFrame | None = None) -> DataFrame:
    """One row per scan: score, active counts, distinct failed rules; distinct rules are bounded by the rule table.

    ``scans`` holds every scan, and may hold ``files``, the number of files that it read: then clean scans have an entry
    too. Without it, only scans with findings have one, and ``files`` counts files with findings.
    """
    names = [c.alias(f"active_{n}") for c, n in zip(severity_counts(active(), SEVERITY_NAMES), SEVERITY_NAMES)]
    extra = [*names, F.array_sort(F.collect_set(F.when(active(), F.col("rule_id")))).alias("failed_rules")]
    if scans is not None and "files" in scans.columns:
        # One join gives a scan its counts and its files.
        g = compliance_score(findings, scan, extra, scans, ("files",))
    else:
        g = compliance_score(findings, scan, [*extra, F.count_distinct("file").alias("files")], scans)
    return g.select(*scan, "score", *[F.col(f"active_{n}").alias(n) for n in SEVERITY_NAMES], "failed_rules", "files")


def _by_time(newest_first: bool = False):
    order = [F.desc("scan_ts"), F.desc("scan_id")] if newest_first else ["scan_ts", "scan_id"]
    return Window.partitionBy("project").orderBy(*order)


def with_previous(history: DataFrame, fields, bucket: str = "month") -> DataFrame:
    """Adds ``prev``: the fields of the project's scan before, null for its first.

    Windows run per project and calendar bucket; only the first scan of a bucket looks to the bucket before, through
    one row per bucket. So a project with very many scans is still spread over tasks.
    """
    key = F.struct("scan_ts", "scan_id")
    h = history.withColumn("_b", F.date_trunc(bucket, "scan_ts"))
    inside = Window.partitionBy("project", "_b").orderBy("scan_ts", "scan_id")
    h = h.withColumn("_in", F.lag(F.struct(*fields)).over(inside))
    ends = h.groupBy("project", "_b").agg(F.max_by(F.struct(*fields), key).alias("_end"))
    across = Window.partitionBy("project").orderBy("_b")
    ends = ends.select("project", "_b", F.lag("_end").over(across).alias("_before"))
    return h.join(ends, ["project", "_b"], "left").withColumn("prev", F.coalesce("_in", "_before")).drop(
        "_b", "_in", "_before")


def latest_scan(history: DataFrame) -> DataFrame:
    row = F.struct(*history.columns)
    return history.groupBy("project").agg(F.max_by(row, F.struct("scan_ts", "scan_id")).alias("s")).select("s.*")


def compare_with_previous(history: DataFrame) -> DataFrame:
    """Score and severity changes, new and resolved rules; zeros and empty lists for a first scan."""
    fields = ["score", *SEVERITY_NAMES, "failed_rules"]
    h = with_previous(history, fields)
    first = F.col("prev").isNull()
    empty = F.array().cast("array<string>")
    out = {
        f"{c}_change": F.when(first, 0).otherwise(F.col(c) - F.col(f"prev.{c}")) for c in ["score", *SEVERITY_NAMES]
    }
    out["new_rules"] = F.when(first, empty).otherwise(F.array_except("failed_rules", "prev.failed_rules"))
    out["resolved_rules"] = F.when(first, empty).otherwise(F.array_except("prev.failed_rules", "failed_rules"))
    return h.withColumns(out).drop("prev")


def history_view(history: DataFrame, limit: int = 10) -> DataFrame:
    """The newest scans of each project with the change to the scan before and best and lowest marks.

    Each project is cut to the newest rows first; best and lowest come from an aggregate over all its scans.
    """
    extremes = history.groupBy("project").agg(F.max("score").alias("_best"), F.min("score").alias("_low"))
    newest = history.withColumn("n", F.row_number().over(_by_time(True))).filter(F.col("n") <= limit + 1)
    change = F.col("score") - F.lag("score").over(_by_time())
    shown = newest.withColumn("change", F.coalesce(change, F.lit(0))).filter(F.col("n") <= limit)
    return shown.join(extremes, "project").withColumns({
        "best": F.col("score") == F.col("_best"), "lowest": F.col("score") == F.col("_low"),
        "arrow": F.when(F.col("change") > 0, "up").when(F.col("change") < 0, "down").otherwise("flat"),
    }).drop("_best", "_low")


def history_stats(history: DataFrame) -> DataFrame:
    key = F.struct("scan_ts", "scan_id")
    return history.groupBy("project").agg(
        F.count("*").alias("scans"), js_round(F.avg("score")).alias("avg_score"), F.max("score").alias("best"),
        F.min("score").alias("lowest"), (F.max_by("score", key) - F.min_by("score", key)).alias("trend"))


def score_direction(history: DataFrame) -> DataFrame:
    h = with_previous(history, ["score"]).withColumn("change", F.col("score") - F.col("prev.score")).drop("prev")
    return h.withColumn(
        "direction",
        F.when(F.col("change").isNull(), F.lit(None)).when(F.abs("change") < 1, "same")
        .when(F.col("change") > 0, "up").otherwise("down"))


def chart_series(history: DataFrame, points: int = 10) -> DataFrame:
    """The last scans of each project, oldest first."""
    last = history.withColumn("_n", F.row_number().over(_by_time(True))).filter(F.col("_n") <= points)
    return last.withColumn("point", F.row_number().over(_by_time())).drop("_n")


def review_deadline(created: str, severity: str = "severity") -> Column:
    days = F.lit(OTHER_DEADLINE_DAYS)
    for name, n in DEADLINE_DAYS.items():
        days = F.when(F.col(severity) == name, n).otherwise(days)
    return F.date_add(F.to_date(created), days)


#: Microseconds of a limiter's memory, and of the time buckets that calls are counted in: two minutes.
MEMORY, BUCKET = 60_000_000, 120_000_000


def _admit(batches):
    """Calls sorted by (scan, piece, time, id) to the same calls with what a limiter that begins with each piece, and knows no
    bound for the scan, had recorded before each of them."""
    last, recent, total = None, deque(), 0
    for batch in batches:
        out = []
        for s, piece, us in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if (s, piece) != last:
                last, recent, total = (s, piece), deque(), 0
            while recent and recent[0] <= us - MEMORY:
                recent.popleft()
            ok = len(recent) < CALLS_PER_MINUTE
            out.append((len(recent), total, ok))
            if ok:
                recent.append(us)
                total += 1
        minute, before, ok = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(minute, pa.int32()), pa.array(before, pa.int64()),
             pa.array(ok, pa.bool_())], names=["scan", "piece", "event_id", "recent", "before", "ok"])


def rate_limited(calls: DataFrame, scan: str, ts: str, event_id: str = "event_id") -> DataFrame:
    """scan, event_id, in_minute, in_scan and allowed: a call is allowed while fewer than the limits are recorded, in the
    minute before it and in its scan; only allowed calls are recorded.

    Whether a call is recorded depends on the ones before it, so calls are cut where nothing is remembered: after a minute without
    calls. Pieces run apart; a running sum over a scan's pieces says how many calls were recorded before each, and the bound of the
    scan then is arithmetic. Two minutes that follow each other record at least as many calls as the second one has, up to its limit:
    where that adds up to the bound of the scan, all later calls are refused, and don't pass through Python at all. So a scan
    with a third of all calls costs Python its first minutes only; counts run in time buckets, one row each for a scan.
    A minute without limits on its calls still is one piece, of which a task keeps the recorded calls only.
    """
    slim = calls.select(
        F.col(scan).cast("string").alias("scan"), F.col(event_id).cast("bigint").alias("event_id"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("us")).withColumn("b", F.floor(F.col("us") / BUCKET))
    later_minute = F.pmod("us", F.lit(BUCKET)) >= MEMORY
    buckets = slim.groupBy("scan", "b").agg(F.least(F.count_if(later_minute), F.lit(CALLS_PER_MINUTE)).alias("least"))
    over = Window.partitionBy("scan").orderBy("b")
    # What the bucket before recorded may still be in memory, so it doesn't count yet.
    sure = F.coalesce(F.sum("least").over(over.rangeBetween(Window.unboundedPreceding, -2)), F.lit(0))
    buckets = buckets.select("scan", "b", (sure >= CALLS_PER_SCAN).alias("spent"))
    timed = slim.join(buckets, same(slim, buckets, ["scan", "b"])).select(slim["*"], "spent")
    refused = timed.filter("spent").select(
        "scan", "event_id", F.lit(0).alias("in_minute"), F.lit(CALLS_PER_SCAN).alias("in_scan"), F.lit(False).alias("allowed"))
    open_calls = timed.filter("NOT spent").select("scan", "event_id", "us")
    pieces = cut_at_gaps(open_calls, ["scan"], MEMORY, BUCKET, ("us", "event_id")).select("scan", "piece", "event_id", "us")
    local = stored(pieces.repartition("scan", "piece").sortWithinPartitions("scan", "piece", "us", "event_id").mapInArrow(
        _admit, "scan string, piece bigint, event_id bigint, recent int, before bigint, ok boolean"), "calls")
    sums = local.groupBy("scan", "piece").agg(F.count_if("ok").alias("n"))
    order = Window.partitionBy("scan").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("scan", "piece", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    known = local.join(sums, same(local, sums, ["scan", "piece"])).select(local["*"], "base")
    # Of the piece's recorded calls only the first ``room`` were.
    room = F.greatest(CALLS_PER_SCAN - F.col("base"), F.lit(0))
    recorded = F.least("before", room)
    return known.select(
        "scan", "event_id", F.greatest(recorded - (F.col("before") - F.col("recent")), F.lit(0)).cast("int").alias("in_minute"),
        F.least(F.col("base") + F.col("before"), F.lit(CALLS_PER_SCAN)).cast("int").alias("in_scan"),
        (F.col("ok") & (F.col("before") < room)).alias("allowed")).unionByName(refused)


def budget_cutoff(calls: DataFrame, scan: str, ts: str, budget_cents: float, bucket: str = "hour") -> DataFrame:
    """Running token cost of a scan in cents; a call runs while the cost of the calls before it is under budget.

    The running sum is the sum of earlier time buckets plus the sum inside the bucket, so a long scan is not one task.
    """
    c = calls.withColumns({
        "_price": F.col("input_tokens") * INPUT_PRICE + F.col("output_tokens") * OUTPUT_PRICE,
        "_b": F.date_trunc(bucket, ts)})
    earlier = Window.partitionBy(scan).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = c.groupBy(scan, "_b").agg(F.sum("_price").alias("_sum")).select(
        scan, "_b", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(scan, "_b").orderBy(ts, "event_id").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("_run", F.coalesce(F.sum("_price").over(inside), F.lit(0))).join(sums, [scan, "_b"])
    cost = (F.col("_base") + F.col("_run")) * 100 / 1_000_000
    return c.withColumn("cents_before", cost).withColumn("runs", F.col("cents_before") < budget_cents).drop(
        "_price", "_b", "_run", "_base")
