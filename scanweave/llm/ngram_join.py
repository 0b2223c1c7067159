"""N-gram Jaccard join: pairs of texts whose sets of word n-grams are similar, found by MinHash bands.

Texts alike in all words are one node. Its signature is cut into bands; nodes that share a band's hash meet in a bucket,
and only the hashes are shuffled. Buckets with the same members are one. The members' full n-gram sets are then sent to
their buckets and every pair there is verified inside a task, in blocks of bounded bytes, so a large group of near copies
is spread over many tasks and none of its pairs becomes a row: a task returns each node's number of links, a pair counted
in the first bucket it shares only, and the links of a spanning forest, from which the classes come.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.llm.common import arrow_function, one_of_each, row_key, stored
from scanweave.llm.components import components

WORDS, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 96
#: Nodes and bytes of n-gram sets of a block; two blocks meet in one task. Words that a task remembers.
BLOCK_NODES, BLOCK_BYTES, KEPT_WORDS = 1024, 24 << 20, 200_000


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the longest rows, and so the fewest false candidates, whose bands find a pair at the threshold with
    the probability ``recall`` and need no more than ``most`` hashes."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))
        if bands * rows > most:
            break
        best = bands, rows
    return best


class Shingler:
    """Texts as sets of hashes of their word n-grams, and the sets' MinHash bands."""

    def __init__(self, words: int, bands: int, rows: int):
        draw = np.random.default_rng(11)
        self.words, self.bands, self.rows = words, bands, rows
        self.weights = draw.integers(1, 1 << 63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.factors = draw.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.masks = draw.integers(1, 1 << 63, bands * rows, dtype=np.uint64)
        self.known: dict[str, int] = {}

    def read(self, text: str) -> tuple[str, np.ndarray]:
        """A digest of all words, and the sorted set of n-gram hashes; a text with fewer words is one n-gram, none with
        none."""
        words = text.lower().split()
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return xxhash.xxh3_128_hexdigest(b""), h
        k = min(self.words, len(h))
        grams = sum((h[i:len(h) - k + 1 + i] * self.weights[i] for i in range(k)), np.uint64(0))
        grams ^= grams >> np.uint64(29)
        grams *= np.uint64(0xBF58476D1CE4E5B9)
        grams ^= grams >> np.uint64(32)
        return xxhash.xxh3_128_hexdigest(h.tobytes()), np.unique(grams)

    def sign(self, grams: np.ndarray) -> list[int]:
        """One hash a band."""
        if not len(grams):
            return [0] * self.bands
        low = np.full(self.bands * self.rows, np.iinfo(np.uint64).max, np.uint64)
        for a in range(0, len(grams), 4096):
            some = (grams[a:a + 4096, None] ^ self.masks) * self.factors
            np.minimum(low, some.min(axis=0), out=low)
        low = low.reshape(self.bands, self.rows)
        return [xxhash.xxh3_64_intdigest(band.tobytes(), seed=i) - (1 << 63) for i, band in enumerate(low)]


def _signer(words: int, bands: int, rows: int):
    shingler = Shingler(words, bands, rows)

    def step(batch):
        nodes, sizes, signs = [], [], []
        for text in batch.column(3):
            node, grams = shingler.read(text.as_py() or "")
            nodes.append(node)
            sizes.append(len(grams))
            signs.append(shingler.sign(grams) if len(grams) else [])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(nodes, pa.string()), pa.array(sizes, pa.int64()), pa.array(signs, pa.list_(pa.int64()))],
            names=["doc_id", "row_no", "digest", "node", "grams", "bands"])

    return step


def _setter(words: int):
    """Rows (text, node, buckets) to the n-gram set, where the text is the node's."""
    shingler = Shingler(words, 1, 1)

    def step(batch):
        texts, wanted, kept, sets = batch.column(0), batch.column(1).to_pylist(), [], []
        size = 0
        for i, node in enumerate(wanted):
            found, grams = shingler.read(texts[i].as_py() or "")
            if found == node:
                kept.append(i)
                sets.append(grams.tobytes())
                size += len(sets[-1])
            if size > 16 << 20 or i == len(wanted) - 1:
                some = batch.select([1, 2]).take(pa.array(kept, pa.int64()))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(sets, pa.binary())], names=["node", "buckets", "set"])
                kept, sets, size = [], [], 0

    return step


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share."""
    n = len(sets)
    if n == 2:
        both = np.intersect1d(*sets, assume_unique=True)
        return np.array([[len(sets[0]), len(both)], [len(both), len(sets[1])]])
    whole = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(whole, kind="stable")
    new = np.concatenate([[True], whole[order][1:] != whole[order][:-1]])
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1
    place = np.cumsum(often) - 1
    row, column = row[order][often[column]], place[column[often[column]]]
    out = np.zeros((n, n), np.float32)
    for a in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
        some = slice(*np.searchsorted(column, [a, a + 4096]))
        dense = np.zeros((n, 4096), np.float32)
        dense[row[some], column[some] - a] = 1
        out += dense @ dense.T
    return out.astype(np.int64)


def _links(nodes, sides, ids, sets, band: int, diagonal: bool, threshold: float):
    """Of one meeting of blocks: each linked node's number of links that no earlier band shares, and its forest root."""
    order = sorted(range(len(nodes)), key=nodes.__getitem__)
    order = [i for k, i in enumerate(order) if not k or nodes[i] != nodes[order[k - 1]]]  # a text that came twice
    nodes, sets = [nodes[i] for i in order], [sets[i] for i in order]
    sides, ids = np.array([sides[i] for i in order]), np.array([ids[i] for i in order])
    if len(nodes) < 2:
        return []
    size = np.array([len(s) for s in sets])
    both = _overlaps(sets)
    linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
    np.fill_diagonal(linked, False)
    if not diagonal:
        linked &= sides[:, None] != sides[None, :]
    if not linked.any():
        return []
    first = linked.copy()
    for earlier in range(band):
        own = ids[:, earlier]
        first &= ~((own[:, None] == own[None, :]) & (own != 0)[:, None])
    root = np.full(len(nodes), -1)
    for i in range(len(nodes)):
        if root[i] < 0:
            reach, root[i] = [i], i
            while reach:
                new = np.flatnonzero(linked[reach.pop()] & (root < 0))
                root[new] = i
                reach.extend(new)
    counts = first.sum(axis=1)
    return [(nodes[i], int(counts[i]), nodes[root[i]]) for i in np.flatnonzero(linked.any(axis=1))]


def _verifier(threshold: float):
    def run(batches):
        last, rows, out = None, [], []

        def meet():
            (_, band, i, j), (nodes, sides, ids, sets) = last, zip(*rows, strict=True)
            return _links(nodes, sides, ids, sets, band, i == j, threshold)

        def give():
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["node", "links", "root"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(8)]
            for bucket, band, i, j, node, side, ids, found in zip(*columns, strict=True):
                key = (bucket, band, i, j)
                if key != last:
                    if rows:
                        out += meet()
                    last, rows = key, []
                    if len(out) > 20_000:
                        yield give()
                        out = []
                rows.append((node, side, ids, np.frombuffer(found, np.uint64)))
        if rows:
            out += meet()
        yield give()

    return run


def join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> DataFrame:
    """doc_id, digest (of the text), row_no, class_id, copies, links and kept, one row per row of ``docs``.

    Words are what white space leaves, in lower case; texts alike in all words are copies, and so are texts without words,
    null among them. Similarity is the Jaccard index of the sets of word n-grams; a text with fewer words is one n-gram.
    links: other nodes, that is texts different in words, at ``threshold`` or above. Classes are what links connect, and
    class_id is the class's smallest doc_id (null is smaller than any). One row of each class is kept, the first by doc_id. A pair
    at the threshold is found with the probability ``recall``, the more similar ones with more. Other columns play no part.
    """
    bands, rows = bands_for(threshold, recall, most_hashes)
    texts = docs.select("doc_id", F.monotonically_increasing_id().alias("row_no"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "text")
    signed = stored(texts.mapInArrow(
        arrow_function(_signer, words, bands, rows),
        "doc_id long, row_no long, digest string, node string, grams long, bands array<long>"), "signatures")
    first = F.struct("doc_id", "digest", "row_no")
    nodes = stored(signed.groupBy("node").agg(
        F.min(first).alias("first"), F.count("*").alias("copies"), F.max("grams").alias("grams"), F.max("bands").alias("bands")), "nodes")
    banded = nodes.select("node", "grams", F.posexplode("bands").alias("band", "hash"))
    sets = banded.groupBy("band", "hash").agg(
        F.count("*").alias("n"), F.sum("grams").alias("grams"), F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")).filter("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_NODES), F.ceil(F.col("grams") * 8 / BLOCK_BYTES)).cast("int").alias("blocks")
    buckets = sets.groupBy("n", "grams", "x", "y").agg(F.min(F.struct("band", "hash")).alias("b")).select("b.band", "b.hash", blocks)
    members = banded.join(buckets, ["band", "hash"]).groupBy("node").agg(
        F.collect_list(F.struct("band", "hash", "blocks")).alias("buckets"))  # one for each band at most
    wanted = members.join(nodes.select("node", "first.doc_id", "first.digest"), "node")
    wanted = wanted.select("node", "buckets", row_key("digest").alias("key"))
    fetched = texts.select(row_key("digest").alias("key"), "text").join(wanted, "key").select("text", "node", "buckets").mapInArrow(
        arrow_function(_setter, words), "node string, buckets array<struct<band:int,hash:long,blocks:int>>, set binary")
    at = F.explode("buckets").alias("b")
    ids = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.coalesce(
        F.get(F.filter("buckets", lambda b: b["band"] == k), F.lit(0))["hash"], F.lit(0).cast("long"))).alias("ids")
    dealt = fetched.select("node", "set", ids, at).select("node", "set", "ids", "b.*").withColumn(
        "side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "hash", "band", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "node", "side", "ids", "set")
    met = ["hash", "band", "i", "j"]
    found = stored(dealt.repartition(*met).sortWithinPartitions(*met).mapInArrow(
        _verifier(threshold), "node string, links long, root string"), "links")
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = nodes.join(links, "node", "left").join(roots, "node", "left").select(
        "node", "copies", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    heads = classes.groupBy("root").agg(F.min("first").alias("head"))
    classes = classes.join(heads, "root").select("node", "copies", "links", "head")
    return signed.select("doc_id", "digest", "row_no", "node").join(classes, "node").select(
        "doc_id", "digest", "row_no", F.col("head.doc_id").alias("class_id"), "copies", "links",
        (F.col("row_no") == F.col("head.row_no")).alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, copies, links and kept."""
    return join(docs).select("doc_id", "class_id", "copies", "links", "kept")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, with all columns of ``docs``; of rows that share doc_id and text the smallest by all columns."""
    kept = join(docs.select("doc_id", "text")).filter("kept").select(row_key("digest").alias("key__"))
    keyed = docs.withColumn("key__", row_key(F.md5(F.coalesce(F.col("text"), F.lit("")))))
    return one_of_each(keyed.join(kept, "key__", "left_semi"), "key__").select(docs.columns)
