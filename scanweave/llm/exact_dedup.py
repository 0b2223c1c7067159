"""Exact dedup over a cuckoo-filter index of live digests.

Digests are combined within each input partition's share of the shuffle first, so a group of copies with a third of all
rows arrives as a few partial rows. A partition of the index holds its keys in arrays and a cuckoo filter whose slots carry
a fingerprint and the number of the key: a fingerprint hit is verified against the whole key that its bucket points to, a
free slot takes a new key, a full one pushes others on, and when that doesn't end the filter is built anew at twice the
size from the stored keys. Removal empties the slot.
"""

from __future__ import annotations

import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.llm.common import lower_ascii, one_of_each, row_key, stored

SLOTS, MAX_KICKS = 4, 200


class CuckooIndex:
    """A set of live keys (bytes of a digest, 16 at least); ``find`` gives a key's number or -1."""

    def __init__(self, buckets: int = 64):
        self.keys: list[bytes | None] = []
        self.live = 0
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.buckets = buckets
        self.prints = array.array("H", bytes(2 * buckets * SLOTS))  # 0: free
        self.entry = array.array("q", bytes(8 * buckets * SLOTS))

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "big") or 1
        first = int.from_bytes(key[2:10], "big") & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) & (self.buckets - 1))

    def _slot(self, key: bytes) -> int:
        mark, first, second = self._places(key)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[slot] == mark and self.keys[self.entry[slot]] == key:
                    return slot
        return -1

    def find(self, key: bytes) -> int:
        slot = self._slot(key)
        return self.entry[slot] if slot >= 0 else -1

    def insert(self, key: bytes) -> int:
        """The number of a key that isn't in the index yet."""
        self.keys.append(key)
        self.live += 1
        number = len(self.keys) - 1
        if not self._place(key, number):
            self._grow()
        return number

    def _place(self, key: bytes, number: int) -> bool:
        mark, first, second = self._places(key)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.entry[slot] = mark, number
                    return True
        bucket = second
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + (kick + number) % SLOTS
            self.prints[slot], mark = mark, self.prints[slot]
            self.entry[slot], number = number, self.entry[slot]
            bucket = self._other(bucket, mark)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.entry[slot] = mark, number
                    return True
        return False

    def _grow(self) -> None:
        """Twice the buckets, filled from the keys that are live."""
        size = self.buckets
        while True:
            size *= 2
            self._empty(size)
            if all(self._place(k, i) for i, k in enumerate(self.keys) if k is not None):
                return

    def delete(self, key: bytes) -> bool:
        slot = self._slot(key)
        if slot < 0:
            return False
        self.keys[self.entry[slot]] = None
        self.prints[slot] = 0
        self.live -= 1
        return True


def _index_rows(batches):
    """Live digests of one partition: rows (digest, doc_id, row_no, n) with n zero and no row_no where all documents went."""
    index, best, count = CuckooIndex(), [], array.array("q")
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        for digest, doc, row, n in zip(*columns, strict=True):
            key = bytes.fromhex(digest)
            at, place = index.find(key), (doc is not None, doc or 0, -1 if row is None else row)
            if at < 0:
                at = index.insert(key)
                best.append(place)
                count.append(n)
            else:
                best[at] = max(best[at], place)
                count[at] += n
            if count[at] == 0:
                index.delete(key)
    kept = [i for i, k in enumerate(index.keys) if k is not None]
    for a in range(0, len(kept), 20_000):
        some = kept[a:a + 20_000]
        yield pa.RecordBatch.from_pydict({
            "digest": [index.keys[i].hex() for i in some], "keep_id": [best[i][1] if best[i][0] else None for i in some],
            "keep_row": [best[i][2] for i in some], "group_size": [count[i] for i in some],
        }, schema=_INDEX)


_INDEX = pa.schema([("digest", pa.string()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])


def live_digests(changes: DataFrame) -> DataFrame:
    """digest, keep_id (largest live doc_id), keep_row and group_size of every digest that has live documents.

    ``changes``: digest, doc_id, row_no, and n: 1 for a document that came, -1 for one that went. A removal cancels an
    addition of its digest and doc_id, that of its row_no where there is one; one that finds none to cancel counts for
    nothing. Changes are combined by document before digests are, so a group with a third of all rows stays spread.
    """
    by_row = changes.groupBy("digest", "doc_id", "row_no").agg(F.sum("n").alias("n"))
    by_doc = by_row.groupBy("digest", "doc_id").agg(
        F.max(F.when(F.col("n") > 0, F.col("row_no"))).alias("row_no"), F.greatest(F.sum("n"), F.lit(0)).alias("n"))
    return _indexed(by_doc)


def _indexed(rows: DataFrame) -> DataFrame:
    """``live_digests`` of rows that hold no removals; partial sums meet in the index partition that the digest belongs to,
    which holds the distinct digests of its share only."""
    here = F.when(F.col("n") > 0, F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "row_no"))
    partial = rows.groupBy("digest", F.spark_partition_id().alias("from_part")).agg(F.max(here).alias("last"), F.sum("n").alias("n"))
    dealt = partial.repartition("digest").select("digest", "last.doc_id", "last.row_no", "n")
    return dealt.mapInArrow(_index_rows, "digest string, keep_id long, keep_row long, group_size long")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256, one row per row of ``docs``.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty. The row with the largest doc_id
    stays (null is smaller than any); of rows that repeat that doc_id and text one stays. Other columns play no part.
    """
    text = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    rows = stored(docs.select("doc_id", F.sha2(text, 256).alias("digest"), F.monotonically_increasing_id().alias("row_no")),
                  "digests")
    live = _indexed(rows.withColumn("n", F.lit(1)))
    return rows.join(live, "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"),
        F.col("digest").alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns. Of rows that share doc_id and normalised text the
    smallest by all columns stays, so reruns over other partitions agree."""
    text = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    kept = exact_dedup(docs.select("doc_id", "text")).filter("kept").select(row_key("text_sha256").alias("key__"))
    keyed = docs.withColumn("key__", row_key(F.sha2(text, 256)))
    return one_of_each(keyed.join(kept, "key__", "left_semi"), "key__").select(docs.columns)


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
