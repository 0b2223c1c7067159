"""Approximate nearest neighbours with learned partitions.

On a bounded sample the graph of nearest neighbours is cut into parts of nearly equal size, and a small network learns to
tell from a vector in which parts its neighbours lie. Every row is indexed in its most probable part; a query goes to as
many of its most probable parts as held-out queries of the sample need, and is ranked there by exact cosine. Equal vectors
are indexed once with their smallest ids, which is all that a result can show of them; parts are dealt into blocks of
bounded rows and their queries too, so neither a hot vector nor a hot part lands in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanweave.llm.common import hashed_sample, stored

#: Vectors that the model is fitted on, parts, neighbours in the graph, recall that the probes must reach on the sample.
SAMPLE, PARTS, NEIGHBOURS, RECALL = 8_000, 32, 10, 0.96
#: Rows and queries that meet in one task.
BLOCK_ROWS, BLOCK_QUERIES = 20_000, 5_000


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def nearest(queries: np.ndarray, rows: np.ndarray, k: int, own: np.ndarray | None = None, at_once: int = 128) -> np.ndarray:
    """Places of the k nearest rows of each query, in no order; ``own``: the place of each query's own row."""
    out = []
    for a in range(0, len(queries), at_once):
        s = queries[a:a + at_once] @ rows.T
        if own is not None:
            s[np.arange(len(s)), own[a:a + at_once]] = -np.inf
        out.append(np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k])
    return np.concatenate(out) if out else np.empty((0, k), int)


def partition_graph(links: np.ndarray, parts: int, rng: np.random.Generator, slack: float = 1.05, rounds: int = 12) -> np.ndarray:
    """A part for each node: grown from seeds along the links, then moved to where most of a node's links lead, while no
    part exceeds ``slack`` times the mean."""
    n, most = len(links), int(np.ceil(len(links) / parts * slack))
    part, fill, at = np.full(n, -1), int(np.ceil(n / parts)), 0
    order, current, size = rng.permutation(n), 0, 0
    queue: list[int] = []
    while at < n or queue:
        if not queue:
            if part[order[at]] >= 0:
                at += 1
                continue
            queue = [order[at]]
        node = queue.pop(0)
        if part[node] >= 0:
            continue
        part[node], size = current, size + 1
        if size == fill:
            current, size, queue = current + 1, 0, []
        else:
            queue.extend(x for x in links[node] if part[x] < 0)
    both = [[] for _ in range(n)]
    for i, row in enumerate(links):
        for j in row:
            both[i].append(j)
            both[j].append(i)
    count = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n):
            lead = np.bincount(part[both[i]], minlength=parts)
            lead[(count >= most) & (np.arange(parts) != part[i])] = -1
            to = int(lead.argmax())
            if lead[to] > lead[part[i]]:
                count[part[i]] -= 1
                count[to] += 1
                part[i], moved = to, moved + 1
        if not moved:
            break
    return part


class Router:
    """A network with one hidden layer that gives the parts of a vector's neighbours."""

    def __init__(self, rows: np.ndarray, wanted: np.ndarray, rng: np.random.Generator, hidden: int = 128, epochs: int = 25):
        d, parts = rows.shape[1], wanted.shape[1]
        w = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
        first, second, step = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
        for _ in range(epochs):
            for some in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 128)):
                x, y = rows[some], wanted[some]
                h = np.maximum(x @ w[0] + w[1], 0)
                z = h @ w[2] + w[3]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                e = (p / p.sum(axis=1, keepdims=True) - y) / len(some)
                back = (e @ w[2].T) * (h > 0)
                step += 1
                for i, g in enumerate((x.T @ back, back.sum(axis=0), h.T @ e, e.sum(axis=0))):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    w[i] = w[i] - 0.003 * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
        self.w = [x.astype(np.float32) for x in w]

    def parts(self, rows: np.ndarray) -> np.ndarray:
        """All parts, most probable first, for each row."""
        x = unit(rows).astype(np.float32)
        z = np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]
        return np.argsort(-z, axis=1, kind="stable")


def fit(sample: np.ndarray, parts: int = PARTS, k: int = 5, recall: float = RECALL) -> tuple[Router, int]:
    """The router and the number of parts that a query must visit."""
    rng, rows = np.random.default_rng(7), unit(sample.astype(np.float64))
    parts = max(1, min(parts, len(rows) // 8))
    held = rng.permutation(len(rows))[:min(800, len(rows) // 5)]
    train = np.setdiff1d(np.arange(len(rows)), held)
    graph = nearest(rows[train], rows[train], min(NEIGHBOURS, len(train)), np.arange(len(train)))
    label = partition_graph(graph, parts, rng)
    wanted = np.zeros((len(train), parts))
    np.add.at(wanted, (np.repeat(np.arange(len(train)), graph.shape[1]), label[graph].ravel()), 1)
    wanted[np.arange(len(train)), label] += 1
    router = Router(rows[train], wanted / wanted.sum(axis=1, keepdims=True), rng)
    home = router.parts(rows)[:, 0]
    if len(held) == 0:
        return router, parts
    true = nearest(rows[held], rows, min(k, len(rows) - 1), held)
    where = np.argmax(router.parts(rows[held])[:, :, None] == home[true][:, None, :], axis=1)  # visits until each is met
    for probes in range(1, parts + 1):
        if (where < probes).mean() >= recall:
            return router, probes
    return router, parts


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding and key (equal for equal vectors), without rows that take no part: null ids or vectors, null or
    non-finite components, length zero, and another number of components than most rows have (more of them on a tie)."""
    v = vectors.select("vec_id", "embedding").filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    v = v.filter(fine).filter((square > 0) & (square < float("inf")))
    lengths = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if lengths is None:
        return v.withColumn("key", F.lit(""))
    zero = F.transform("embedding", lambda x: x + F.lit(0).cast("float"))  # -0.0 counts as 0.0
    return v.filter(F.size("embedding") == lengths["n"]).withColumn("key", F.md5(zero.cast("string")))


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _route(router: Router, first: int):
    def run(frames):
        for f in frames:
            if len(f):
                yield f.assign(part=list(router.parts(_matrix(f["embedding"]))[:, :first].astype(np.int32)))

    return run


def _best(k: int):
    """Top k different ids of the block for each query, by exact cosine and then by id."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"key": [], "vec_id": [], "score": []}).astype({"key": object, "vec_id": "int64", "score": "float64"})
        if not len(left) or not len(right):
            return empty
        q, r = _matrix(left["embedding"]), _matrix(right["embedding"])
        r_size, q_size = np.sqrt((r * r).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
        low, ids, keys, out = np.array([x[0] for x in right["ids"]]), right["ids"].tolist(), left["key"].tolist(), []
        for a in range(0, len(q), 256):
            near = (q[a:a + 256] @ r.T) / r_size
            for i in range(len(near)):
                take, rows = 0, []
                while take < len(r) and len(rows) < k:  # vectors that share an id are one result
                    take = min(len(r), max(k, 4 * take))
                    edge = np.partition(near[i], len(r) - take)[len(r) - take]
                    some = np.flatnonzero(near[i] >= edge - 1e-9 * q_size[a + i])
                    score = (r[some] * q[a + i]).sum(axis=1) / (r_size[some] * q_size[a + i])
                    found: dict[int, float] = {}
                    for b in np.lexsort((low[some], -score))[:take]:
                        for v in ids[some[b]]:
                            found.setdefault(v, score[b])
                    rows = sorted((-s, v) for v, s in found.items())[:k]
                out += [(keys[a + i], v, -s) for s, v in rows]
        return pd.DataFrame(out, columns=["key", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, parts: int = PARTS, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id and score (cosine in double precision) of the k nearest rows found for each row of
    ``queries``, a part of ``vectors``; a row with the query's own id is none of them.

    Rows that ``usable`` leaves out take no part. A row that repeats counts once, and so do different vectors that share a vec_id, with
    the best of their scores; ties go to the smaller vec_id. With fewer
    candidates than k all that the visited parts hold come. An empty table gives an empty one.
    """
    rows = usable(vectors)
    first = Window.partitionBy("key").orderBy("vec_id")
    few = rows.dropDuplicates(["vec_id", "key"]).withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k + 1)
    distinct = stored(few.groupBy("key").agg(
        F.min_by("embedding", "vec_id").alias("embedding"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    sample = sorted(hashed_sample(distinct, ["key"], SAMPLE).select("key", "embedding").collect())
    if not sample:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    router, probes = fit(np.array([r[1] for r in sample]), parts, k, recall)
    kind = distinct.schema["embedding"].dataType.simpleString()
    index = distinct.mapInPandas(_route(router, 1), f"key string, embedding {kind}, ids array<long>, part array<int>")
    index = stored(index.withColumn("part", F.col("part")[0]), "index")
    held = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}  # a row a part
    least = np.cumsum(sorted(held.get(p, 0) for p in range(len(router.w[3]))))
    probes = min(len(least), max(probes, int(np.searchsorted(least, k + 1)) + 1))  # any so many parts hold k other rows
    asked = usable(queries).select(F.col("vec_id").alias("query_id"), "key", "embedding")
    asked = stored(asked.groupBy("query_id", "key").agg(F.first("embedding").alias("embedding")), "queries")
    unique = asked.groupBy("key").agg(F.first("embedding").alias("embedding"))
    routed = unique.mapInPandas(_route(router, probes), f"key string, embedding {kind}, part array<int>")
    routed = stored(routed.withColumn("part", F.explode("part")), "routed")
    n_rows = {p: -(-n // BLOCK_ROWS) for p, n in held.items()}
    n_asked = {r["part"]: -(-r["count"] // BLOCK_QUERIES) for r in routed.groupBy("part").count().collect()}

    def dealt(t, own, other, own_name, other_name):
        of = lambda n: F.element_at(F.create_map(*[F.lit(x) for p in n.items() for x in p]), F.col("part"))
        t = t.withColumn(own_name, F.pmod(F.xxhash64("key"), of(own)).cast("int"))
        return t.withColumn(other_name, F.explode(F.sequence(F.lit(0), of(other) - 1)))

    visited = [p for p in n_asked if p in n_rows]
    left = dealt(routed.filter(F.col("part").isin(visited)), n_asked, n_rows, "q", "r")
    right = dealt(index.filter(F.col("part").isin(visited)), n_rows, n_asked, "r", "q")
    found = left.groupBy("part", "q", "r").cogroup(right.groupBy("part", "q", "r")).applyInPandas(
        _best(k + 1), "key string, vec_id long, score double")
    order = [F.desc("score"), F.col("vec_id")]
    found = found.groupBy("key", "vec_id").agg(F.max("score").alias("score"))
    top = found.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(*order))).filter(F.col("nth") <= k + 1)
    pairs = asked.select("query_id", "key").join(top.drop("nth"), "key").filter("query_id != vec_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
