"""Line dedup: removes later occurrences of passages of three lines that repeat anywhere in the corpus.

Every three consecutive lines of a document are a window, known by two 64-bit hashes. A window that occurs more than once
keeps its first occurrence (smallest doc_id, then smallest digest of the text, then position); the lines that any later
occurrence covers are merged and removed. All of it is DataFrame operations. The count of a window is combined before the
shuffle; occurrences meet the few windows that repeat in a plain join, whose hot keys Spark's adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.llm.common import row_key, whole_text

WINDOW = 3


def _bind(fields: dict[str, Column], body) -> Column:
    """``body`` over columns that are computed once a row; named in place, the optimizer would copy them into lambdas."""
    return F.transform(F.array(F.struct(*[c.alias(n) for n, c in fields.items()])), body)[0]


def occurrences(texts: DataFrame) -> DataFrame:
    """key, doc_id, digest, start and the hashes a and b of every window that isn't blank throughout."""
    def hashes(s):
        def one(i):
            three = [F.element_at(s["lines"], i + F.lit(k)) for k in range(1, WINDOW + 1)]
            return F.struct(
                i.alias("start"), F.xxhash64(*three).alias("a"), F.xxhash64(F.lit("b"), *reversed(three)).alias("b"),
                (F.length(F.trim(F.concat(*three))) > 0).alias("full"))

        last = F.size(s["lines"]) - WINDOW
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), one))

    windows = F.explode(_bind({"lines": F.split("text", "\n", -1)}, hashes)).alias("w")
    rows = texts.select("key", "doc_id", "digest", windows)
    return rows.select("key", "doc_id", "digest", "w.start", "w.a", "w.b", "w.full").filter("full").drop("full")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that is left, one row per row of ``docs``.

    Lines end at a line feed and are compared as they are. Null counts as empty, which is one line. Texts under three
    lines have no window. Rows alike in doc_id and text are one document and get one result, each of them; other columns
    play no part. An empty table gives an empty one.
    """
    texts = whole_text(docs).withColumn("digest", F.md5("text")).withColumn("key", row_key("digest"))
    seen = occurrences(texts)
    place = F.struct("doc_id", "digest", "start")
    repeated = seen.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = seen.join(repeated, ["a", "b"]).filter(~F.col("first").eqNullSafe(place))
    starts = later.groupBy("key").agg(F.collect_set("start").alias("starts"))

    def left(s):
        none = F.array().cast("array<int>")
        covered = F.flatten(F.transform(F.coalesce(s["starts"], none), lambda p: F.sequence(p, p + F.lit(WINDOW - 1))))
        kept = F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), covered)
        return F.struct(
            F.size(s["lines"]).cast("long").alias("n_lines"), (F.size(s["lines"]) - F.size(kept)).cast("long").alias("n_removed"),
            F.array_join(F.transform(kept, lambda i: F.element_at(s["lines"], i + 1)), "\n").alias("text"))

    rest = texts.join(starts, "key", "left").select(
        "doc_id", _bind({"lines": F.split("text", "\n", -1), "starts": F.col("starts")}, left).alias("r"))
    return rest.select("doc_id", "r.n_lines", "r.n_removed", "r.text")


def line_report(docs: DataFrame) -> DataFrame:
    """The result with the remaining text as its digest."""
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH docs AS (SELECT doc_id, md5(coalesce(text, '')) AS digest, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lined AS (SELECT doc_id, digest, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM docs),
win AS (
  SELECT doc_id, digest, pos AS start, line AS l0, lead(line, 1) OVER w AS l1, lead(line, 2) OVER w AS l2 FROM lined
  WINDOW w AS (PARTITION BY doc_id, digest ORDER BY pos)),
ranked AS (
  SELECT doc_id, digest, start, row_number() OVER (PARTITION BY l0, l1, l2 ORDER BY doc_id, digest, start) AS k FROM win
  WHERE l2 IS NOT NULL AND length(trim(l0 || l1 || l2, ' ')) > 0),
gone AS (
  SELECT DISTINCT doc_id, digest, start + d AS pos FROM ranked, (VALUES (0), (1), (2)) AS v(d) WHERE k > 1),
kept AS (
  SELECT l.doc_id, l.digest, count(*) AS n_lines, count(g.pos) AS n_removed,
         sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '')) AS kept_sha256
  FROM lined l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.digest = g.digest AND l.pos = g.pos
  GROUP BY l.doc_id, l.digest)
SELECT doc_id, n_lines, n_removed, kept_sha256 FROM kept
"""
