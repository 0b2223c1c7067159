"""Mixing sources to target weights by capped water-filling.

A source's target is its weight's share of the words wanted, but no more than its size times the largest number of epochs;
what is above goes to the other sources by weight, until none is above. A source is then taken whole as often as its target
holds its size; the rest is filled by its documents in an order drawn from a seed, the last of them in part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.llm.common import WORD, ordered, running, stored

#: Weights of the sources in order, repeating; the share of all words that the mix wants; how often a source may be used.
WEIGHTS, SHARE, MAX_EPOCHS, SEED = (3, 1, 2), 1.5, 2, "mix"


def water_fill(sources: DataFrame, wanted: float, max_epochs: int) -> DataFrame:
    """Adds ``target`` to rows of source_size and weight.

    Every round one aggregate gives the size of the sources above their cap and the weight of the others; only these two
    numbers reach the driver. The level rises from round to round and with it the clamped sources, so it ends.
    """
    cap, level, clamped = F.col("source_size") * max_epochs, 0.0, -1
    while True:
        above = cap <= F.col("weight") * F.lit(level) if clamped >= 0 else F.col("source_size") == 0
        n, full, weight = sources.agg(
            F.count(F.when(above, 1)), F.coalesce(F.sum(F.when(above, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        if n == clamped or not weight:
            break
        clamped, level = n, (wanted - float(full)) / float(weight)
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(level)))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, weight and target of every source in ``sizes`` (source, size); weights go to the sources by
    code point, null last, and repeat."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("last__", F.col("source").isNull())
    table = ordered(sources, [], ["last__", "source"], "sources")
    ranked = running(table, [], ["last__", "source"], F.lit(1), "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int") + 1)
    ranked = stored(ranked.select("source", "source_size", weight.alias("weight")), "weights")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    return water_fill(ranked, share * total, max_epochs)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED,
        keep=()) -> DataFrame:
    """doc_id, the columns ``keep``, source, digest of the text, size, source_size, target, whole (full repetitions), taken (words, the last repetition
    possibly in part) and copies (repetitions, the last one rounded), one row per row of ``docs``.

    Size is the number of words; null has none. The order within a source hangs on seed, doc_id and text alone, so reruns
    agree. Repeated rows are documents of their own. An empty table gives an empty one.
    """
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(
        "doc_id", *keep, "source", digest.alias("digest"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    drawn = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("digest")))
    table = ordered(rows.withColumn("draw", drawn), ["source"], ["draw"], "sizes")
    targets = source_targets(table.select("source", "size"), weights, share, max_epochs).withColumnRenamed("source", "s__")
    placed = running(table, ["source"], ["draw"], F.col("size"), "before")
    placed = placed.join(targets, F.col("source").eqNullSafe(F.col("s__")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5) - F.col("before")
    part = F.least(F.greatest(rest, F.lit(0)), F.col("size"))
    return placed.withColumn("whole", whole).select(
        "doc_id", *keep, "source", "digest", "size", "source_size", "target", "whole",
        (F.col("whole") * F.col("size") + part).cast("long").alias("taken"),
        (F.col("whole") + ((rest > 0) & (part * 2 >= F.col("size"))).cast("long")).alias("copies"))


def mixed_documents(docs: DataFrame, **given) -> DataFrame:
    """The documents of the mix, whole, each as often as it is repeated.

    Rows are written with a number first, so each of several rows alike has repetitions of its own and their sum is the mix's.
    """
    numbered = stored(docs.withColumn("row__", F.monotonically_increasing_id()), "numbered")
    times = mix(numbered.select("doc_id", "text", "source", "row__"), keep=("row__",), **given)
    times = times.filter("copies > 0").select("row__", F.col("copies").cast("int").alias("copies__"))
    both = numbered.join(times, "row__")
    return both.withColumn("again__", F.explode(F.array_repeat(F.lit(1), F.col("copies__")))).select(docs.columns)


SQL = """
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         ([3, 1, 2])[CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS INTEGER) + 1] AS weight
  FROM d GROUP BY source),
lined AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS wanted,
         coalesce(sum(2 * source_size) OVER o, 0) AS full_, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS open_,
         2 * source_size / weight AS ratio
  FROM s WINDOW o AS (ORDER BY 2 * source_size / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT min((wanted - full_) / open_) AS lv FROM (
  SELECT * FROM lined WHERE ratio >= (wanted - full_) / open_ ORDER BY ratio, source IS NULL, encode(source) LIMIT 1)),
t AS (SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), weight * lv) AS target FROM s, level),
p AS (
  SELECT d.*, t.source_size, t.target, coalesce(sum(size) OVER (
           PARTITION BY d.source ORDER BY md5('mix:' || CAST(doc_id AS VARCHAR) || ':' || digest)
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
w AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM p)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + least(greatest(floor(target - whole * source_size + 0.5) - before, 0), size) AS BIGINT) AS taken
FROM w
"""
