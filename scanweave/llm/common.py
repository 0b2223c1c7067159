"""What several operators share: written tables, row keys, and places in an order that is too long for one task."""

from __future__ import annotations

import inspect

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanweave.sources.tables import stored, work_folder

#: Bytes that end a word: blank, and tab to carriage return. Every other byte belongs to one.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

__all__ = ["WORD", "lower_ascii", "whole_text", "row_key", "Scratch", "one_of_each", "ordered", "running", "stored", "hashed_sample", "sampled_texts", "arrow_function"]


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else."""
    return F.translate(text, _UPPER, _LOWER)


def whole_text(docs: DataFrame) -> DataFrame:
    """doc_id and the whole text; null counts as empty. Other columns go, so their names can't clash."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def row_key(*digests: str) -> Column:
    """doc_id beside a digest as one text that is never null, to join and group on."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), *digests)


class Scratch:
    """Written tables that go together once all that was made of them is written too."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = work_folder(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
        self.paths = []


def one_of_each(df: DataFrame, key: str) -> DataFrame:
    """One row for each value of ``key``, without it: the smallest by all its columns, so the same one however the table is split."""
    columns = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*columns)).alias("one__")).select("one__.*")


def ordered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """The rows as a written table, split by ranges of (group, order), with the range's number in ``part_no``.

    ``order`` must tell rows apart (but for rows alike in all of it): then a group with a third of all rows spreads over
    many ranges, and no task holds more than a range.
    """
    ranges = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    return stored(ranges.withColumn("part_no", F.spark_partition_id()), name)


def running(table: DataFrame, group: list[str], order: list[str], weight: Column, into: str) -> DataFrame:
    """``into``: the sum of ``weight`` over the rows before this one in its group. ``table`` comes from ``ordered``.

    Each range sums its own rows; what earlier ranges of the group hold is added from one row for each group and range.
    """
    t = table.withColumn("w__", weight)
    heads = t.groupBy("part_no", *group).agg(F.sum("w__").alias("w__"))
    before = Window.partitionBy(*group).orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(
        F.col("part_no").alias("p__"), *[F.col(c).alias(f"g__{c}") for c in group],
        F.coalesce(F.sum("w__").over(before), F.lit(0)).alias("head__"))
    inside = Window.partitionBy("part_no", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("in__", F.coalesce(F.sum("w__").over(inside), F.lit(0)))
    on = [F.col("part_no") == F.col("p__"), *[F.col(c).eqNullSafe(F.col(f"g__{c}")) for c in group]]
    joined = t.join(heads, on)
    return joined.withColumn(into, F.col("head__") + F.col("in__")).drop(
        "w__", "in__", "head__", "p__", *[f"g__{c}" for c in group])


def hashed_sample(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """About ``rows`` rows, those whose hash of ``keys`` is small; twice as many at most, which only binds where one key
    repeats so often that it alone exceeds the sample."""
    share = min(1.0, rows / max(1, df.count()))
    return df.filter(F.pmod(F.xxhash64(*keys), F.lit(1 << 31)) < F.lit(int(share * (1 << 31)))).limit(2 * rows)


def sampled_texts(texts: DataFrame, rows: int) -> DataFrame:
    """text and copies: about ``rows`` rows of ``whole_text``, the same ones however the table is split.

    n rows alike in doc_id and text are drawn n * share times, rounded up or down by their hash, and come as one row with
    the number drawn; so neither a null or repeated doc_id nor a repeated row is in the sample beyond its share of the table.
    """
    share = min(1.0, rows / max(1, texts.count()))
    keyed = texts.withColumn("key__", F.xxhash64("doc_id", "text"))
    part = F.pmod(F.xxhash64("key__"), F.lit(1 << 31)) / F.lit(float(1 << 31))
    drawn = keyed.groupBy("key__").agg(F.floor(F.count("*") * F.lit(share) + F.first(part)).cast("int").alias("copies"))
    chosen = keyed.join(F.broadcast(drawn.filter("copies > 0")), "key__")
    return chosen.dropDuplicates(["key__"]).select("text", "copies")


def arrow_function(make, *given):
    """A function for mapInArrow that builds its state with ``make(*given)`` once per task and maps each record batch to
    any number of batches."""
    if inspect.isgeneratorfunction(make):
        raise TypeError("make returns the function that handles a batch")

    def run(batches):
        step = make(*given)
        for batch in batches:
            yield from step(batch)

    return run
