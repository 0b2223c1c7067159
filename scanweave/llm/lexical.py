"""Ranked lexical search: every item of a query table against every document, term at a time with limited accumulators.

Documents are tokenised once into a forward table (length, terms that may be in a query, how often each occurs). Corpus
statistics give every query term its weight and the largest contribution that any document gets from it. Items then come in
blocks of bounded size; a block meets the forward table in tasks that turn some documents at a time into posting lists and go
through an item's terms from the rarest on. A document gets an accumulator when a term is its first; once the bounds of the terms
that are left add up to less than the k-th best partial score, no new accumulators come, those that can't reach that score either go, and the
survivors are updated exactly with the rest. Each task hands on its best k for an item; the best k of those are the result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanweave.llm.common import arrow_function, lower_ascii, ordered, running, stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Results for an item, bits of the filter of query terms, terms in a block of items, postings and documents that a task
#: handles at a time, terms that it remembers.
K, FILTER_BITS, BLOCK_TERMS, POSTINGS_AT_ONCE, DOCS_AT_ONCE, KEPT_TERMS = 50, 1 << 22, 100_000, 1_000_000, 32_768, 300_000
#: A-Z in lower case; bytes outside a term become blanks.
_AS_TERM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

_FORWARD = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.string())), ("tfs", pa.list_(pa.int64()))])


def query_terms(items: DataFrame) -> DataFrame:
    """item_no, item_id and each term of the item's text once; ``item_no`` tells rows apart that share an item_id."""
    rows = items.select("item_id", F.monotonically_increasing_id().alias("item_no"), "text")
    terms = F.array_distinct(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(TERM), F.lit(0)))
    return rows.select("item_no", "item_id", F.explode(terms).alias("term"))


def term_filter(terms: DataFrame) -> bytes:
    """A bitmap of the query terms' hashes, of the same size for any number of terms. It lets other terms pass now and then."""
    seen = terms.select(F.pmod(F.xxhash64("term"), F.lit(FILTER_BITS)).alias("bit"))
    words = seen.groupBy(F.floor(F.col("bit") / 32).cast("int").alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit % 32 as int)))").alias("bits"))
    bitmap = np.zeros(FILTER_BITS // 32, np.uint32)
    for at, bits in words.collect():  # FILTER_BITS / 32 rows at most
        bitmap[at] = bits
    return bitmap.tobytes()


class _Wanted(dict):
    """Whether a term passes the filter, remembered."""

    def __init__(self, bitmap: bytes):
        self.bits = np.frombuffer(bitmap, np.uint32)

    def __missing__(self, term: bytes) -> bool:
        if len(self) > KEPT_TERMS:
            self.clear()
        bit = xxhash.xxh64_intdigest(term, 42) % FILTER_BITS
        self[term] = found = bool(self.bits[bit >> 5] >> np.uint32(bit & 31) & np.uint32(1))
        return found


def _tokenise(bitmap: bytes):
    wanted = _Wanted(bitmap)

    def step(batch):
        texts, n, terms, tfs = batch.column(1).cast(pa.binary()), [], [], []
        for text in texts:
            words = (text.as_py() or b"").translate(_AS_TERM).split()
            some = [(t, c) for t, c in Counter(words).items() if wanted[t]]
            n.append(len(words))
            terms.append([t.decode() for t, _ in some])
            tfs.append([c for _, c in some])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(terms, _FORWARD.field(2).type), pa.array(tfs, _FORWARD.field(3).type)],
            schema=_FORWARD)

    return step


def forward_table(docs: DataFrame, bitmap: bytes) -> DataFrame:
    """doc_id, n (terms of the document), and its terms that pass the filter with their counts, as a written table."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(arrow_function(_tokenise, bitmap), "doc_id long, n long, terms array<string>, tfs array<long>"),
                  "forward")


def _impact(tf: Column, n: Column, documents: int, length: int) -> Column:
    """What a document's occurrences of a term weigh, for a weight of one."""
    t, m = "cast(tf as bigint)", f"(50 + (50 * n * {documents}L) div {length}L)"
    return F.expr(f"(1000000000 * {t}) div (1000 * {t} + 20 * {m})")


def _statistics(forward: DataFrame, terms: DataFrame, documents: int, length: int) -> DataFrame:
    """term, df, and ``best``, the largest impact in any document, of all query terms that occur."""
    each = forward.select("n", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("n", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))
    stats = each.groupBy("term").agg(F.count("*").alias("df"), F.max(_impact(F.col("tf"), F.col("n"), documents, length)).alias("best"))
    return stats.join(terms.select("term").distinct(), "term")


def _block_items(weighted: DataFrame) -> DataFrame:
    """One row per item with its terms from the rarest on, their weights and bounds, and the number of its block.

    Blocks hold fewer than ``BLOCK_TERMS`` terms beside those of their last item.
    """
    rows = weighted.groupBy("item_no", "item_id").agg(F.sort_array(F.collect_list(F.struct("df", "term", "w", "best"))).alias("x"))
    rows = rows.withColumn("all", F.lit(0))
    numbered = running(ordered(rows, ["all"], ["item_no"], "items"), ["all"], ["item_no"], F.size("x"), "before")
    return stored(numbered.select(
        "item_no", "item_id", F.floor(F.col("before") / BLOCK_TERMS).cast("int").alias("block"), F.col("x.term").alias("terms"),
        F.col("x.w").alias("weights"), F.transform("x", lambda e: e["w"] * e["best"]).alias("bounds")), "item-blocks")


class _Best:
    """The best k of an item so far: scores and documents, best first; of equal scores the smaller doc_id, null before any."""

    def __init__(self, k: int):
        self.k, self.score, self.doc, self.known = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def worst(self) -> int:
        """What a document must reach; 0 while there are fewer than k."""
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def add(self, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        if len(score) > self.k:
            keep = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, doc, known = score[keep], doc[keep], known[keep]
        score, doc, known = (np.concatenate(x) for x in ((self.score, score), (self.doc, doc), (self.known, known)))
        order = np.lexsort((doc, known, -score))[: self.k]
        self.score, self.doc, self.known = score[order], doc[order], known[order]


class Postings:
    """Posting lists of some documents for the terms of a block of items; documents and impacts of a term by its number."""

    def __init__(self, batches: list[pa.RecordBatch], number: dict[str, int], documents: int, length: int):
        table = pa.Table.from_batches(batches)
        column = lambda i: table.column(i).combine_chunks()
        ids, n, lists = column(0), column(1).to_numpy(), column(2)
        self.known = ~ids.is_null().to_numpy(zero_copy_only=False)
        self.doc = ids.fill_null(0).to_numpy()
        coded = lists.flatten().dictionary_encode()
        names = np.array([number.get(t, -1) for t in coded.dictionary.to_pylist()], np.int64)
        tf = column(3).flatten().to_numpy()
        at = np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy())
        term = names[coded.indices.to_numpy()] if len(names) else np.empty(0, np.int64)
        at, term, tf = (x[term >= 0] for x in (at, term, tf))
        m = 50 + 50 * n * documents // length
        order = np.argsort(term, kind="stable")
        self.at, tf = at[order], tf[order]
        self.impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[self.at])
        self.start = np.searchsorted(term[order], np.arange(len(number) + 1))

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.start[term], self.start[term + 1]
        return self.at[a:b], self.impact[a:b]


def term_at_a_time(postings: Postings, terms, weights, bounds, best: _Best) -> int:
    """Adds the best documents of ``postings`` for one item to ``best``; returns how many terms made accumulators.

    ``bounds``: the most that any document gets from each term. A document that has none of the first j terms scores the sum of
    the bounds from j on at most; it is left out only where that is less than what k documents have already.
    """
    left = np.concatenate([np.cumsum(bounds[::-1])[::-1], [0]])
    acc, j, floor = np.zeros(len(postings.doc), np.int64), 0, best.worst()
    while j < len(terms):
        if floor > left[j]:
            break
        if left[0] - left[j] > left[j]:  # else no partial score can exceed what is left
            some = acc[acc > 0]
            if len(some) >= best.k:
                floor = max(floor, int(np.partition(some, len(some) - best.k)[len(some) - best.k]))
                if floor > left[j]:
                    break
        at, impact = postings.of(terms[j])
        acc[at] += weights[j] * impact
        j += 1
    made = j
    survivors = np.flatnonzero((acc > 0) & (acc + left[j] >= floor))
    score = acc[survivors]
    while j < len(terms) and len(survivors):
        at, impact = postings.of(terms[j])
        if len(at):
            place = np.minimum(np.searchsorted(at, survivors), len(at) - 1)
            score = score + np.where(at[place] == survivors, weights[j] * impact[place], 0)
        j += 1
    best.add(score, postings.doc[survivors], postings.known[survivors])
    return made


def _score(items, k: int, documents: int, length: int):
    """A function for mapInArrow: the best k documents of a task for every item of a block."""
    def run(batches):
        number: dict[str, int] = {}
        block = [(no, np.array([number.setdefault(t, len(number)) for t in terms]), np.array(w, np.int64), np.array(b, np.int64), _Best(k))
                 for no, terms, w, b in items]
        kept, postings, rows = [], 0, 0

        def flush():
            some = Postings(kept, number, documents, length)
            for _, terms, weights, bounds, best in block:
                term_at_a_time(some, terms, weights, bounds, best)

        for batch in batches:
            kept.append(batch)
            postings, rows = postings + len(batch.column(2).flatten()), rows + len(batch)
            if postings > POSTINGS_AT_ONCE or rows > DOCS_AT_ONCE:
                flush()
                kept, postings, rows = [], 0, 0
        if kept:
            flush()
        for no, *_, best in block:
            if len(best.score):
                yield pa.RecordBatch.from_arrays([
                    pa.array([no] * len(best.score), pa.int64()), pa.array(best.doc, mask=~best.known), pa.array(best.score)],
                    names=["item_no", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's best ``k`` documents with a score above 0.

    Terms are runs of digits, letters and everything beyond ASCII, A-Z in lower case. A null or empty text has none; such items
    get no rows, such documents don't count. Equal scores go by doc_id, null first; rows that repeat a doc_id rank each for
    itself, and so do items that repeat an item_id. Other columns play no part. Without documents or items there are no rows.
    """
    spark = docs.sparkSession
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    terms = stored(query_terms(items), "query-terms")
    forward = forward_table(docs, term_filter(terms))
    documents, length = forward.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).head()
    if not length:
        return empty
    stats = _statistics(forward, terms, documents, length)
    weight = F.floor(F.lit(1000.0) * F.ln(F.lit(2.0 * documents + 2.0) / (2 * F.col("df") + 1))).cast("long")
    weighted = terms.join(stats, "term").withColumn("w", weight).filter("w > 0")
    blocks = _block_items(weighted)
    number = (blocks.agg(F.max("block")).head()[0] or 0) + 1
    found = None
    for block in range(number):
        some = blocks.filter(F.col("block") == block).select("item_no", "terms", "weights", "bounds").collect()
        if some:
            rows = stored(forward.select("doc_id", "n", "terms", "tfs").mapInArrow(
                _score([tuple(r) for r in some], k, documents, length), "item_no long, doc_id long, score long"), "found")
            found = rows if found is None else found.unionByName(rows)
    if found is None:
        return empty
    order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(blocks.select("item_no", "item_id"), "item_no").select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
i AS (
  SELECT row_number() OVER () AS item_no, item_id,
    list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS ts FROM benchmark),
all_docs AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS big_n, sum(len(ts))::BIGINT AS big_l FROM d),
p AS (SELECT row_no, doc_id, len(ts) AS n, unnest(ts) AS t FROM d),
tf AS (SELECT row_no, doc_id, n, t, count(*) AS tf FROM p GROUP BY ALL),
weights AS (
  SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, all_docs GROUP BY t, big_n),
terms AS (SELECT item_no, item_id, unnest(ts) AS t FROM i),
scored AS (
  SELECT item_no, item_id, row_no, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))))::BIGINT AS score
  FROM terms JOIN weights USING (t) JOIN tf USING (t), all_docs GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
