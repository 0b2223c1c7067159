"""Written intermediate tables, in the folder that the cluster shares, and reads of many small files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that opening a file counts as when files are dealt to tasks, and the tasks for each core that list folders.
OPEN_COST, LISTING_TASKS = 32 << 10, 20


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared folder; a temporary one only in a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.gettempdir() + "/scanweave"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table, for results that several later steps read."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, by: str | list[str], buckets: int | None = None) -> DataFrame:
    """The rows as a written table in buckets of ``by``, one column or several: joins and groups on it read them without a shuffle.

    Every task writes its own share of each bucket, so no row moves. There are as many buckets as shuffle partitions, unless told.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(n, by).sortBy(by).option("path", work_folder(spark, name)).format("parquet").saveAsTable(table)
    return spark.table(table)


def read_together(spark: SparkSession, read: Callable[[SparkSession], DataFrame]) -> DataFrame:
    """The rows of ``read(session)``, with as many small files in a task as their bytes allow.

    Spark counts 4 MB for opening a file and lists up to 10,000 folders by a task each, so a task has a handful of small files or a
    folder, and costs more than they do. No option of a single read changes that: the read is planned in a session of its own, with
    the same settings but these two, which stay where ``spark`` sets them.
    """
    settings, own = spark.conf.getAll, spark.newSession()
    few = {
        "spark.sql.files.openCostInBytes": OPEN_COST,
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": LISTING_TASKS * spark.sparkContext.defaultParallelism}
    for key, value in ({k: str(v) for k, v in few.items()} | settings).items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    rows = read(own)
    # A union takes its session from its first part; the optimizer drops an empty one.
    none = spark.range(1).filter("false").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
    return none.unionByName(rows)
