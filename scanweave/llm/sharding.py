"""Sharding by a k-d tree over metadata, split at weighted medians until every leaf is one shard's bytes.

What is placed are units: documents with equal texts form one, but a group above a small part of a shard is dealt into
several by doc_id, and rows that repeat a doc_id too often for one part by their place in the written table as well, so that
a group with a third of all rows doesn't weigh on the balance. A node that must give n shards is
split at the byte that gives n // 2 of them, along the dimension in which its units spread widest. Medians come from running
sums over range-sorted units; the driver sees one row for each node.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.llm.common import ordered, running, stored

SHARDS, ROW_BYTES = 24, 8
#: A unit's largest part of a shard's target.
FINE = 1 / 200
#: Metadata dimensions as numbers from 0 to 1: size on a log scale, language and content by checksum.
DIMENSIONS = ("by_size", "by_lang", "by_text")


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"))


def kd_tree(units: DataFrame, shards: int) -> tuple[DataFrame, list[dict]]:
    """Units (dimensions from 0 to 1, tie, bytes) with their shard, and the nodes from the root down: first shard, number of
    shards, dimension and the first unit right of the cut."""
    table, nodes, tree = units.withColumn("node", F.lit(0)), {0: (0, shards)}, []
    while any(n > 1 for _, n in nodes.values()):
        stats = table.groupBy("node").agg(F.sum("bytes").alias("bytes"), *[
            (F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]).collect()  # a row for each node, and so for each shard at most
        split, cut, step, after = F.lit(0.0), F.lit(0.0), F.lit(0), {}
        for s in sorted(stats, key=lambda r: r["node"]):
            first, n = nodes[s["node"]]
            if n == 1:
                after[first] = (first, 1)
                continue
            widest, here = max(DIMENSIONS, key=lambda d: s[d]), F.col("node") == s["node"]
            split = F.when(here, F.col(widest)).otherwise(split)
            cut = F.when(here, F.lit(s["bytes"] * (n // 2) / n)).otherwise(cut)
            step = F.when(here, F.lit(n // 2)).otherwise(step)
            after[first], after[first + n // 2] = (first, n // 2), (first + n // 2, n - n // 2)
            tree.append({"first": first, "shards": n, "dimension": widest})
        if not stats:
            break
        level = ordered(table.select(*units.columns, "node", split.alias("along"), cut.alias("cut"), step.alias("step")),
                        ["node"], ["along", "by_text", "tie"], "kd")
        sums = running(level, ["node"], ["along", "by_text", "tie"], F.col("bytes"), "before")
        right = (F.col("step") > 0) & (F.col("before") + F.col("bytes") / 2 >= F.col("cut"))
        table = sums.select(*units.columns, (F.col("node") + F.when(right, F.col("step")).otherwise(0)).alias("node"))
        table, nodes = stored(table, "kd"), after
    return table.withColumnRenamed("node", "shard"), tree


def shard(docs: DataFrame, shards: int = SHARDS, fine: float = FINE) -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot (its place in the shard) and grown_shard (null), one row per
    row of ``docs``.

    Size is the bytes of the text and eight; null texts have none and count as empty. Rows with equal texts (size, checksum
    and language) share a shard unless the group is above ``fine`` of a shard. Repeated rows get slots of their own. Fewer
    units than shards leave shards empty.
    """
    rows = stored(_rows(docs).withColumn("row_no", F.monotonically_increasing_id()), "sizes")
    total, low, high = rows.agg(F.sum("size"), F.min("size"), F.max("size")).first()
    most = max(1.0, (total or 0) / shards * fine)
    group = ["size", "text_crc32", "lang"]
    # a group with several parts is above ``most``, so there are fewer of them than shards / fine
    large = rows.groupBy(*group).agg(F.ceil(F.sum("size") / F.lit(most)).alias("parts")).filter("parts > 1")
    # rows alike in group and doc_id that are above ``most`` together; there are no more of them than of parts
    alike = rows.join(F.broadcast(large), group, "left_semi").groupBy(*group, "doc_id").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("n")).filter((F.col("bytes") > most) & (F.col("n") > 1))
    alike = alike.select(*[F.col(c).alias(f"a__{c}") for c in [*group, "doc_id"]])
    parts, same = F.coalesce("parts", F.lit(1)), [F.col(c).eqNullSafe(F.col(f"a__{c}")) for c in [*group, "doc_id"]]
    by = F.when(F.col("a__size").isNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("doc_id", "row_no"))
    dealt = rows.join(F.broadcast(large), group, "left").join(F.broadcast(alike), same, "left").withColumn("tie", F.pmod(by, parts))
    dealt = stored(dealt.drop("parts", *alike.columns), "dealt")
    spread = max(1e-9, (math.log2(high or 1) - math.log2(low or 1)))
    units = dealt.groupBy(*group, "tie").agg(F.sum("size").alias("bytes")).select(
        *group, "tie", "bytes", ((F.log2("size") - F.lit(math.log2(low or 1))) / spread).alias("by_size"),
        (F.crc32("lang") / F.lit(2.0 ** 32)).alias("by_lang"), (F.col("text_crc32") / F.lit(2.0 ** 32)).alias("by_text"))
    placed, _ = kd_tree(stored(units, "units"), shards)
    rows = dealt.join(placed.select(*group, "tie", "shard"), [*group, "tie"])
    order = ["text_crc32", "size", "lang", "doc_id", "row_no"]
    slots = running(ordered(rows, ["shard"], order, "slots"), ["shard"], order, F.lit(1), "slot")
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
