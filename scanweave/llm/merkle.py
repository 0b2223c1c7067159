"""Merkle dataset manifest: levels of digests as parent-linked node rows, and a recursive query that climbs them.

Every row of a table is a leaf. Within a group leaves are numbered in order, and every eight consecutive nodes become the
digest of their digests until one is left, the group's subroot; the subroots, in the order of their groups, make a second tree of
the same kind. Built levels are written as node rows that hold the digests of their children and the id of their parent.

A recursive common table expression ascends from every run of eight leaves: each step joins the parent's row, appends the
siblings found there to the proof and folds the (perhaps tampered) digest of each leaf of the run with them. The leaves of
a run share all of their path, so a climbing row carries one proof and up to eight folded digests. All leaves meet in the last
nodes; those rows are stored once for every ``SPREAD`` runs below them, and a run joins the copy that its hash names, so no
join key holds more than about that many rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanweave.llm.common import lower_ascii, stored

#: Children of a node, and runs of leaves that join one copy of a node.
FAN, SPREAD = 8, 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The group of the tree over all subroots; others begin with "=" (a value) or "-" (null).
TOP = "*"


def field_text(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[field_text(c) for c in fields.values()]), 256)


def folded(parts: Column) -> Column:
    """The digest, as bytes, of digests that lie one after another as bytes; they are hashed as lowercase hex text."""
    return F.unhex(F.sha2(F.lower(F.hex(parts)), 256))


def _up(n: Column) -> Column:
    """Nodes in the level above n nodes."""
    return F.floor((n + (FAN - 1)) / FAN).cast("long")


def _placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``place`` of each row in its ``grp`` and ``n``, the group's rows. Groups are cut into ranges, numbered apart and joined
    by one row for each group and range, so a group with a third of all rows spreads over tasks."""
    ranges = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    table = stored(ranges.withColumn("part_no", F.spark_partition_id()), name)
    heads = table.groupBy("grp", "part_no").agg(F.count("*").alias("rows__"))
    whole = Window.partitionBy("grp")
    heads = heads.select(
        F.col("grp").alias("grp__"), F.col("part_no").alias("part__"), F.sum("rows__").over(whole).alias("n"),
        F.coalesce(F.sum("rows__").over(whole.orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("head__"))
    inside = F.row_number().over(Window.partitionBy("part_no", "grp").orderBy(*order)) - 1
    numbered = table.withColumn("in__", inside)
    joined = numbered.join(heads, (F.col("grp") == F.col("grp__")) & (F.col("part_no") == F.col("part__")))
    return joined.withColumn("place", F.col("head__") + F.col("in__")).drop("grp__", "part__", "head__", "in__", "part_no")


def _node_id(level: Column, idx: Column, grp: Column) -> Column:
    return F.concat_ws(":", level.cast("string"), idx.cast("string"), grp)


def _levels(rows: DataFrame, largest: int, name: str, keep=()) -> list[DataFrame]:
    """Written levels above rows of (grp, place, n, digest): grp, level, idx, m (nodes of the level), runs (of the lowest level),
    kids and digest. A lone row passes as it is. The lowest level has the columns ``keep`` of its rows as ``leaves``."""
    member = F.struct(F.col("place"), F.col("digest"), *keep)
    runs = rows.groupBy("grp", F.floor(F.col("place") / FAN).cast("long").alias("idx")).agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(member)).alias("leaves"))
    kids = F.array_join(F.transform("leaves", lambda x: F.hex(x["digest"])), "")
    runs = runs.withColumn("kids", F.unhex(kids)).select(
        "grp", F.lit(1).alias("level"), "idx", _up(F.col("n")).alias("m"), _up(F.col("n")).alias("runs"), "kids",
        F.when(F.col("n") == 1, F.col("kids")).otherwise(folded(F.col("kids"))).alias("digest"), "leaves")
    levels = [stored(runs, f"{name}-1")]
    held, level = FAN, 1
    while held < largest:
        below, held, level = levels[-1].filter("m > 1"), held * FAN, level + 1
        up = below.groupBy("grp", F.floor(F.col("idx") / FAN).cast("long").alias("idx")).agg(
            F.first("m").alias("m"), F.first("runs").alias("runs"),
            F.sort_array(F.collect_list(F.struct(F.col("idx"), F.col("digest")))).alias("some"))
        up = up.withColumn("kids", F.unhex(F.array_join(F.transform("some", lambda x: F.hex(x["digest"])), "")))
        levels.append(stored(up.select(
            "grp", F.lit(level).alias("level"), "idx", _up(F.col("m")).alias("m"), "runs", "kids",
            folded(F.col("kids")).alias("digest")), f"{name}-{level}"))
    return levels


@dataclass
class Manifest:
    """``runs``: the lowest level, with its leaves as (place, digest, doc_id, given) where ``given`` is the digest to fold.
    ``nodes``: node_id, salt, parent_id, parent_salts, place among the parent's children, kids, digest, is_subroot, is_run."""

    runs: DataFrame
    nodes: DataFrame


def build(leaves: DataFrame) -> Manifest | None:
    """The manifest of rows (grp, doc_id, digest, given), whose digests are bytes; None where there are none.

    Leaves of a group ascend by doc_id, null first, then by digest; rows alike in both have interchangeable places.
    """
    rows = stored(leaves.withColumn("row_no", F.monotonically_increasing_id()), "leaves")
    placed = _placed(rows, ["doc_id", "digest", "row_no"], "leaf-order")
    spread = rows.groupBy("grp").count().agg(F.max("count"), F.sum(_up(F.col("count")))).head()
    if spread[0] is None:
        return None
    largest, all_runs = int(spread[0]), int(spread[1])
    levels = _levels(placed, largest, "level", ("doc_id", "given"))
    flat = ["grp", "level", "idx", "m", "runs", "kids", "digest"]
    nodes = levels[0].select(flat)
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
    ended = stored(nodes.filter("m = 1").withColumn("sub", F.col("grp")), "subroots")
    order = F.when(F.col("sub") == "-", F.lit(0)).otherwise(F.lit(1))
    subroots = stored(_placed(ended.withColumn("grp", F.lit(TOP)).withColumn("first", order), ["first", "sub"], "subroot-order"),
                      "subroots-placed")
    tops = _levels(subroots, subroots.count(), "top")
    top_salts = -(-all_runs // SPREAD)
    # A run of leaves joins its parent's copy; below a node of level l lie 8^(l-1) runs at most, and those of its group.
    def salts(level):
        below = F.least(F.pow(F.lit(float(FAN)), level - 1), F.col("runs").cast("double"))
        return F.greatest(F.ceil(below / SPREAD), F.lit(1)).cast("long")

    inner = nodes.filter("m > 1").select(
        _node_id(F.col("level"), F.col("idx"), F.col("grp")).alias("node_id"), salts(F.col("level")).alias("salts"),
        _node_id(F.col("level") + 1, F.floor(F.col("idx") / FAN), F.col("grp")).alias("parent_id"),
        salts(F.col("level") + 1).alias("parent_salts"), (F.col("idx") % FAN).alias("place"), "kids", "digest",
        F.lit(False).alias("is_subroot"), (F.col("level") == 1).alias("is_run"))
    linked = subroots.select(
        _node_id(F.col("level"), F.col("idx"), F.col("sub")).alias("node_id"), salts(F.col("level")).alias("salts"),
        F.when(F.col("n") > 1, _node_id(F.lit(1), F.floor(F.col("place") / FAN), F.lit(TOP))).alias("parent_id"),
        F.lit(top_salts).cast("long").alias("parent_salts"), (F.col("place") % FAN).alias("place"), "kids", "digest",
        F.lit(True).alias("is_subroot"), (F.col("level") == 1).alias("is_run"))
    everything = inner.unionByName(linked)
    if subroots.limit(2).count() > 1:
        for top in tops:
            everything = everything.unionByName(top.select(
                _node_id(F.col("level"), F.col("idx"), F.col("grp")).alias("node_id"), F.lit(top_salts).cast("long").alias("salts"),
                F.when(F.col("m") > 1, _node_id(F.col("level") + 1, F.floor(F.col("idx") / FAN), F.col("grp"))).alias("parent_id"),
                F.lit(top_salts).cast("long").alias("parent_salts"), (F.col("idx") % FAN).alias("place"), "kids", "digest",
                F.lit(False).alias("is_subroot"), F.lit(False).alias("is_run")))
    copies = everything.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    return Manifest(levels[0], stored(copies, "nodes"))


#: One step joins the parent of every climbing row. kids, folds and proof are bytes, 32 to a digest.
CLIMB = """
WITH RECURSIVE climb(run_id, folds, proof, subroot, root, parent_id, place, spread, salt) AS (
  SELECT run_id, folds, proof, subroot, root, parent_id, place, spread, salt FROM {start}
  UNION ALL
  SELECT c.run_id,
         transform(c.folds, f -> unhex(sha2(lower(hex(concat(
           substring(n.kids, 1, 32 * c.place), f, substring(n.kids, 32 * c.place + 33)))), 256))),
         concat(c.proof, substring(n.kids, 1, 32 * c.place), substring(n.kids, 32 * c.place + 33)),
         coalesce(c.subroot, if(n.is_subroot, n.digest, NULL)), n.digest, n.parent_id, CAST(n.place AS INT), c.spread,
         pmod(c.spread, n.parent_salts)
  FROM climb c JOIN {nodes} n ON n.node_id = c.parent_id AND n.salt = c.salt)
SELECT run_id, folds, proof, subroot, root FROM climb WHERE parent_id IS NULL LIMIT ALL
"""


def climb(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (bytes: the siblings met, level by level) and folded_root of every leaf."""
    spark = manifest.runs.sparkSession
    runs = manifest.runs.withColumn("run_id", _node_id(F.col("level"), F.col("idx"), F.col("grp")))
    own = manifest.nodes.filter("is_run AND salt = 0").select(
        F.col("node_id").alias("run_id"), "parent_id", "parent_salts", F.col("place").cast("int").alias("place"), "is_subroot")

    def fold(x):
        at = x["place"] % FAN * 32
        before, after = F.substring("kids", F.lit(1), at), F.substring("kids", at + 33, F.lit(32 * FAN))
        return F.concat(before, x["given"], after)

    # The only leaf of a group is its subroot; it isn't hashed again.
    alone = (F.col("m") == 1) & (F.size("leaves") == 1)
    folds = F.when(alone, F.transform("leaves", lambda x: x["given"])).otherwise(F.transform("leaves", lambda x: folded(fold(x))))
    start = runs.join(own, "run_id").select(
        "run_id", folds.alias("folds"), F.unhex(F.lit("")).alias("proof"), F.when(F.col("is_subroot"), F.col("digest")).alias("subroot"),
        F.col("digest").alias("root"), "parent_id", "place", F.xxhash64("run_id").alias("spread"),
        F.pmod(F.xxhash64("run_id"), F.col("parent_salts")).alias("salt"))
    climbed = stored(spark.sql(CLIMB, start=stored(start, "climb-start"), nodes=manifest.nodes.filter("NOT is_run")),
                     "climbed")
    met = runs.select("run_id", "kids", "leaves").join(climbed, "run_id")
    each = met.select("kids", "proof", "subroot", "root", F.explode(F.arrays_zip("leaves", "folds")).alias("x"))
    at = F.col("x.leaves.place") % FAN * 32
    siblings = F.concat(F.substring("kids", F.lit(1), at), F.substring("kids", at + 33, F.lit(32 * FAN)))
    return each.select(
        F.col("x.leaves.doc_id").alias("doc_id"), F.col("x.leaves.digest").alias("leaf"), "subroot", "root",
        F.concat(siblings, "proof").alias("proof"), F.col("x.folds").alias("folded_root"))


def document_leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """Leaves of ``documents`` by lang; where ``tampered`` holds, the digest to fold is that of the text with A-Z in lower case."""
    fields = {c: F.col(c) for c in FIELDS}
    changed = fields | {"text": lower_ascii(F.col("text"))}
    leaf = F.unhex(leaf_digest(fields))
    return docs.select(
        F.when(F.col("lang").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("lang").cast("string"))).alias("grp"), "doc_id",
        leaf.alias("digest"), F.when(tampered, F.unhex(leaf_digest(changed))).otherwise(leaf).alias("given"))


def merkle_report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, one row per row of ``docs``.

    Null fields count as ``-``. Rows whose unsigned crc32 of the decimal doc_id is a multiple of 3 are tampered with, those
    without a doc_id aren't. Equal rows are leaves of their own, and which of them has which place doesn't show. Columns
    beside the five fields play no part. A single leaf is subroot and root, its proof empty. An empty table gives no rows.
    """
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    manifest = build(document_leaves(docs, tampered))
    text = lambda c: F.lower(F.hex(c))
    if manifest is None:
        strings = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
        return docs.limit(0).select("doc_id", *[F.lit("").alias(c) for c in strings], F.lit(True).alias("verified"))
    return climb(manifest).select(
        "doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        F.sha2(text("proof"), 256).alias("proof_sha256"), text("folded_root").alias("folded_root"),
        (F.col("folded_root") == F.col("root")).alias("verified"))


SQL = """
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, text,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END
    || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
    || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
    || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
    list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::UBIGINT)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, y: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))) AS inverted
  FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    CASE WHEN coalesce(xor(inverted, 4294967295::UBIGINT) % 3 = 0, false)
      THEN sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(lowered) || ':' || lowered END) END AS changed
  FROM fields),
placed AS (
  SELECT *, coalesce(changed, leaf) AS given, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    count(*) OVER (PARTITION BY lang) AS n FROM leaves),
tree(lang, level, idx, m, digest) AS (
  SELECT lang, 0, place, n, leaf FROM placed
  UNION ALL
  SELECT lang, level + 1, idx // 8, any_value((m + 7) // 8), sha256(string_agg(digest, '' ORDER BY idx))
  FROM tree WHERE m > 1 GROUP BY lang, level, idx // 8),
subs AS (
  SELECT lang, level, digest AS subroot, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS place, count(*) OVER () AS n
  FROM tree WHERE m = 1),
top(level, idx, m, digest) AS (
  SELECT 0, place, n, subroot FROM subs
  UNION ALL
  SELECT level + 1, idx // 8, any_value((m + 7) // 8), sha256(string_agg(digest, '' ORDER BY idx))
  FROM top WHERE m > 1 GROUP BY level, idx // 8),
members AS (
  SELECT false AS up, lang, level, idx // 8 AS run, list(digest ORDER BY idx) AS kids FROM tree WHERE m > 1 GROUP BY lang, level, idx // 8
  UNION ALL
  SELECT true, NULL, level, idx // 8, list(digest ORDER BY idx) FROM top WHERE m > 1 GROUP BY level, idx // 8),
climb(doc_id, leaf, lang, first, up, level, idx, depth, top_idx, proof, folded) AS (
  SELECT p.doc_id, p.leaf, p.lang, p.place, s.level = 0, 0, CASE WHEN s.level = 0 THEN s.place ELSE p.place END, s.level, s.place, '', p.given
  FROM placed p JOIN subs s ON p.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT c.doc_id, c.leaf, c.lang, c.first, c.up OR c.level + 1 = c.depth, CASE WHEN NOT c.up AND c.level + 1 = c.depth THEN 0 ELSE c.level + 1 END,
    CASE WHEN NOT c.up AND c.level + 1 = c.depth THEN c.top_idx ELSE c.idx // 8 END, c.depth, c.top_idx,
    c.proof || array_to_string(list_concat(k.kids[:c.idx % 8], k.kids[c.idx % 8 + 2:]), ''),
    sha256(array_to_string(list_concat(list_concat(k.kids[:c.idx % 8], [c.folded]), k.kids[c.idx % 8 + 2:]), ''))
  FROM climb c JOIN members k ON k.up = c.up AND (c.up OR k.lang IS NOT DISTINCT FROM c.lang) AND k.level = c.level AND k.run = c.idx // 8),
ended AS (SELECT * FROM climb c WHERE c.up AND c.level = (SELECT max(level) FROM top))
SELECT e.doc_id, e.leaf, s.subroot, t.digest AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root,
  e.folded = t.digest AS verified
FROM ended e JOIN subs s ON e.lang IS NOT DISTINCT FROM s.lang, (SELECT digest FROM top WHERE m = 1) t
"""
