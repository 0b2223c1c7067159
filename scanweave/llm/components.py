"""Connected components of a table of links, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """node and root (smallest node of its component) for every node of ``links`` (a, b) but the roots themselves.

    Every round links each node's larger neighbours to its smallest one, then its smaller ones; it ends when a round
    changes nothing. The smallest neighbour is an aggregate that combines before the shuffle, and meets the links in a join
    that adaptive execution splits at nodes with many links. Each round is a written table.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        n, mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if (n, mark) == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = n, mark
