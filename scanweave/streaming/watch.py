"""Watching: scans of arriving files, alerts, one-time notices, bursts, stored results and short reuse.

Stored state is a log with one folder per micro-batch. A batch that runs again writes the same folder again, so replays
after a lost executor change nothing; the current state is the latest entry of each key. Every ``COMPACT_EVERY`` batches it
is written beside the log, and later batches read it and what came since: a batch's work follows the current state, not the
stream's age. Folders before the latest but one compacted state are no longer read and may be deleted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scanweave.operators.aggregate import active
from scanweave.operators.detect import detect
from scanweave.operators.gaps import cut_at_gaps
from scanweave.operators.lifecycle import acknowledge, scope, suppress
from scanweave.rules.model import SEVERITY_RANK

COMPACT_EVERY = 50
REUSE_SECONDS = 30
DEBOUNCE = "1 second"


def read_stream(spark: SparkSession, folder: str, schema, name: str = "*.parquet", files_per_batch: int | None = None):
    """A stream of what fits ``name`` in a folder: files, or tables that are folders of files."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # In braces a plain name is a pattern too: a source takes one that leads to a file, but no file by itself.
    return reader.parquet(f"{folder.rstrip('/')}/{{{name}}}")


#: State on local disk with its changes in the checkpoint, so its size isn't bound by the executors' heap.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def on_disk_state(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB; a cluster's own choice of a store stays."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def run_available(writer, checkpoint: str) -> list[int]:
    """Processes what is there, in as many micro-batches as the source gives, and stops. Returns the rows of state after each of
    the last batches."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return [sum(op.numRowsTotal for op in p.stateOperators) for p in query.recentProgress]


def scan_stream(corpus: DataFrame, pack_names=None, keep=()) -> DataFrame:
    """Findings of arriving files; detection keeps no state, so the batch operator runs as it is."""
    return detect(corpus, pack_names, keep=keep)


def write_findings(findings: DataFrame, path: str, checkpoint: str) -> list[int]:
    return run_available(findings.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint)


def severity_report(findings: DataFrame, acks=(), as_of: str | None = None) -> DataFrame:
    """Active findings by severity: those that no acknowledgement, marker comment or baseline covers."""
    if "acknowledged" not in findings.columns:
        findings = acknowledge(findings, acks, as_of)
    if "suppressed" not in findings.columns:
        findings = suppress(findings)
    if "is_baseline" not in findings.columns:
        findings = findings.withColumn("is_baseline", F.lit(False))
    return findings.filter(active()).groupBy("severity").agg(F.count("*").alias("findings"))


def finding_key(findings: DataFrame) -> DataFrame:
    return findings.withColumn("key", F.concat_ws(":", "file", "line", "finding_id"))


def _append_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def _log(spark: SparkSession, path: str, schema: str, first: int, last: int) -> DataFrame:
    """The state compacted before batch ``first`` and the log of the batches from there to before ``last``."""
    schema += ", batch int"
    rows = spark.createDataFrame([], schema)
    if first < last:
        parts = [f"{path}/batch={n}" for n in range(first, last)]
        rows = spark.read.schema(schema).option("basePath", path).parquet(*parts)
    return rows.unionByName(spark.read.schema(schema).parquet(f"{path}_before/{first}")) if first else rows


def _before(spark: SparkSession, path: str, schema: str, batch_id: int, newest, every: int) -> DataFrame:
    """What ``newest`` leaves of the rows of earlier batches, and all rows since the last compaction.

    Batches are numbered from 0 without gaps. A batch that is due compacts first, from folders that don't change any more.
    """
    first = batch_id - batch_id % every
    if first and first == batch_id:
        newest(_log(spark, path, schema, first - every, first)).write.mode("overwrite").parquet(f"{path}_before/{first}")
    return _log(spark, path, schema, first, batch_id)


def _last_version(log: DataFrame) -> DataFrame:
    """The rows of each file's latest batch."""
    last = F.max("batch").over(Window.partitionBy("project", "file"))
    return log.withColumn("last", last).filter("batch = last").drop("last")


def alert_batches(log: str, alerts: str, pack_names=None, every: int = COMPACT_EVERY):
    """foreachBatch function: critical and high findings of rescanned files that their last scan did not have.

    The log keeps one row per finding of each file version, and one without a key for a file with none.
    """
    schema = "project string, file string, key string, rank int"
    own = ["project", "file"]

    def handle(files: DataFrame, batch_id: int) -> None:
        spark = files.sparkSession
        now = finding_key(detect(files, pack_names)).select(*own, "key", "rank")
        versions = files.select(*own).distinct().join(now, own, "left")
        _append_batch(versions, log, batch_id)
        current = spark.read.schema(schema).parquet(f"{log}/batch={batch_id}")
        seen = current.select(*own).distinct()
        old = _before(spark, log, schema, batch_id, _last_version, every).join(seen, own, "left_semi")
        previous = _last_version(old).select("project", "key")
        new = current.filter("rank <= 1").join(previous, ["project", "key"], "left_anti")
        _append_batch(new, alerts, batch_id)

    return handle


def notify_once(findings: DataFrame, min_severity: str = "high", ts: str | None = None, horizon: str = "7 days") -> DataFrame:
    """Findings not notified before, at or above a severity; a project's findings are its own. With a time column the memory
    ends at the horizon; without one a stream remembers every key."""
    keyed = finding_key(findings) if "key" not in findings.columns else findings
    key = [*scope(keyed, of=("project",)), "key"]
    if ts and findings.isStreaming:
        once = keyed.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(key)
    else:
        once = keyed.dropDuplicates(key)
    return once.filter(F.col("rank") <= SEVERITY_RANK[min_severity])


def debounce(changes: DataFrame, key: str, ts: str, delay: str = DEBOUNCE, lateness: str = "10 seconds") -> DataFrame:
    """One scan per burst: changes closer than the delay belong together; the scan is due when the delay has passed."""
    c = changes.withWatermark(ts, lateness) if changes.isStreaming else changes
    bursts = c.groupBy(key, F.session_window(ts, delay).alias("w")).agg(
        F.count("*").alias("changes"), F.max(ts).alias("last_change"))
    return bursts.select(key, "changes", "last_change", F.col("w.end").alias("scan_at"))


RESULT_SCHEMA = "key string, ts timestamp, status string, detail string"


def ingest_batches(log: str, every: int = COMPACT_EVERY):
    """foreachBatch function: appends posted results; later posts of a key update it."""

    def handle(rows: DataFrame, batch_id: int) -> None:
        if batch_id % every == 0:
            _before(rows.sparkSession, log, RESULT_SCHEMA, batch_id, _last_result, every)
        _append_batch(rows, log, batch_id)

    return handle


def stored_results(spark: SparkSession, log: str, batches: int, every: int = COMPACT_EVERY) -> DataFrame:
    """The latest row of each key after so many batches of ``ingest_batches``."""
    first = max(0, batches - 1) // every * every
    return current_results(_log(spark, log, RESULT_SCHEMA, first, batches))


def _last_result(log: DataFrame) -> DataFrame:
    return current_results(log).withColumn("batch", F.lit(-1))


def current_results(log: DataFrame, key: str = "key", ts: str = "ts") -> DataFrame:
    """The latest row of each key."""
    columns = [c for c in log.columns if c not in (key, "batch")]
    tie = F.struct(ts, *[c for c in columns if c != ts])
    return log.groupBy(key).agg(F.max_by(F.struct(*columns), tie).alias("r")).select(key, "r.*")


def _starts(times: np.ndarray, last: int | None, gap: int) -> list[int]:
    """Places of the sorted times that are kept: each the first that is ``gap`` or more after the one kept before."""
    out, at = [], 0 if last is None else int(np.searchsorted(times, last + gap))
    while at < len(times):
        out.append(at)
        at = int(np.searchsorted(times, times[at] + gap))
    return out


def _kept_rows(gap: int):
    """Rows sorted by key, piece and time to those that are kept; a piece begins with one that is."""
    def run(batches):
        last_of, last = None, None
        for batch in batches:
            key, piece, times = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            begins = [i for i in range(len(piece)) if not i or piece[i] != piece[i - 1] or key[i] != key[i - 1]]
            kept = []
            for a, b in zip(begins, [*begins[1:], len(piece)], strict=True):
                if (key[a], piece[a]) != last_of:
                    last_of, last = (key[a], piece[a]), None
                some = _starts(times[a:b], last, gap)
                if some:
                    last = int(times[a + some[-1]])
                    kept += [a + i for i in some]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(times[kept])], names=["key", "us"])

    return run


def keep_after_gap(events: DataFrame, key: str, ts: str, seconds: int = REUSE_SECONDS, lateness: str = "10 seconds") -> DataFrame:
    """Events that start a new scan: the first of a key, then each one at least the gap after the last kept.

    Whether an event is kept depends on the one kept before it. An event that comes the gap or more after the event before it is
    always kept, so a table is cut there and a key's pieces run apart, in time order and in as much memory as a batch takes. In
    a stream, state per key holds the last time kept. Once the watermark is past it by the gap, any event that may still come is
    kept without it, and the key's state goes. Events that come later than ``lateness`` are left out of a stream.
    """
    gap = seconds * 1_000_000
    typ = events.schema[key].dataType.simpleString()
    timed = events.select(key, F.col(ts).cast("timestamp").alias("at__"))
    if not events.isStreaming:
        rows = timed.select(F.col(key).alias("key"), F.unix_micros("at__").alias("us"))
        cut = cut_at_gaps(rows, ["key"], gap, max(gap, 3_600_000_000)).select("key", "piece", "us")
        return cut.repartition("key", "piece").sortWithinPartitions("key", "piece", "us").mapInArrow(
            _kept_rows(gap), f"key {typ}, us bigint").select(F.col("key").alias(key), "us")

    def keep(group, chunks, state: GroupState):
        last = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            return
        times = np.sort(np.concatenate([chunk["us"].to_numpy() for chunk in chunks] or [np.empty(0, np.int64)]))
        out = times[_starts(times, last, gap)]
        last = int(out[-1]) if len(out) else last
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max((last + gap) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({key: [group[0]] * len(out), "us": out})

    timed = timed.withWatermark("at__", lateness)
    return timed.withColumn("us", F.unix_micros("at__")).groupBy(key).applyInPandasWithState(
        keep, f"{key} {typ}, us bigint", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)
