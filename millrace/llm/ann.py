"""Operator 6: nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample (FIT_SAMPLE vectors) by k-means with a size penalty and kept
in memory as a neighbour graph; a best-first search over the graph finds the centroids near a vector.
Every vector is put in its nearest list and, at a boundary, into up to ``replicas`` lists whose centroid
is within a ratio of the nearest one. A query opens the lists within a ratio of its nearest centroid, at most
``probes`` or one in PROBE_SHARE of all lists, whichever is more; and always half as many and enough to hold several
times k vectors. It takes exact distances to all centroids, as it opens too many for a beam. Lists larger than BLOCK vectors are split into salted blocks that the
query visits too, so no list is capped and none has to fit one task. Partial top-k lists are merged.

Vectors that are null, empty, zero or hold a null or non-finite component take no part; nor do null
ids. Rows that repeat an id count as one candidate at their smallest distance.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

FIT_SAMPLE = 131_072
MAX_LISTS = 8_192
BLOCK = 4_096
DEGREE = 24
#: Of so many lists a query opens one, where that is more than ``probes``: a fixed number loses recall as lists grow in number.
PROBE_SHARE = 48


def sq_dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def balanced_centroids(x: np.ndarray, k: int, seed: int = 5, rounds: int = 10) -> np.ndarray:
    """k-means whose assignment adds a penalty that grows with a cluster's share."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    load = np.ones(k, np.float32)
    for _ in range(rounds):
        own = np.empty(len(x), np.int64)
        scale = None
        for lo in range(0, len(x), 4096):
            d = sq_dist(x[lo : lo + 4096], c)
            scale = float(d.min(1).mean()) if scale is None else scale
            own[lo : lo + 4096] = (d + 0.3 * scale * np.log2(load)[None, :]).argmin(1)
        sizes = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        some = sizes > 0
        c[some] = sums[some] / sizes[some, None]
        if not some.all():
            c[~some] = x[rng.choice(len(x), int((~some).sum()))]
        load = np.maximum(sizes / (len(x) / k), 0.25).astype(np.float32)
    return np.unique(c, axis=0)


class Graph:
    """Centroids with their nearest neighbours; ``search`` is best-first with a beam, in step for a batch."""

    def __init__(self, centroids: np.ndarray, seed: int = 9):
        self.c = np.ascontiguousarray(centroids, np.float32)
        k = len(self.c)
        deg = min(DEGREE, k - 1)
        near = np.empty((k, deg), np.int32)
        for lo in range(0, k, 1024):
            d = sq_dist(self.c[lo : lo + 1024], self.c)
            d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
            near[lo : lo + 1024] = np.argpartition(d, deg - 1, axis=1)[:, :deg] if deg else 0
        far = np.random.default_rng(seed).integers(0, k, (k, min(8, k)))  # long edges keep it connected
        self.links = np.concatenate([near, far.astype(np.int32)], axis=1)
        self.entries = np.random.default_rng(seed + 1).permutation(k)[: max(16, int(k**0.5))]

    def search(self, x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """(lists, squared distances): up to m near centroids for each row, nearest first (-1, inf where fewer)."""
        x = x.astype(np.float32)
        k, q = len(self.c), len(x)
        m = min(m, k)
        beam = min(k, max(2 * m, 32))
        ids = np.full((q, beam), -1, np.int64)
        dist = np.full((q, beam), np.inf, np.float32)
        done = np.ones((q, beam), bool)
        first = np.tile(self.entries, (q, 1))
        ids, dist, done = self._merge(x, ids, dist, done, first, beam)
        rows = np.arange(q)
        for _ in range(4 * beam):
            todo = np.where(done, np.inf, dist)
            nxt = todo.argmin(1)
            live = np.isfinite(todo[rows, nxt])
            if not live.any():
                break
            a = rows[live]
            done[a, nxt[live]] = True
            got = self._merge(x[a], ids[a], dist[a], done[a], self.links[ids[a, nxt[live]]], beam)
            ids[a], dist[a], done[a] = got
        return ids[:, :m], dist[:, :m]

    def _merge(self, x, ids, dist, done, new, beam):
        d = ((self.c[new] - x[:, None, :]) ** 2).sum(2)
        all_ids = np.concatenate([ids, new], axis=1)
        all_d = np.concatenate([dist, d], axis=1)
        all_done = np.concatenate([done, np.zeros(new.shape, bool)], axis=1)
        order = np.lexsort((~all_done, all_ids), axis=1)  # of equal ids the expanded one first
        s = np.take_along_axis(all_ids, order, 1)
        again = np.zeros(s.shape, bool)
        again[:, 1:] = s[:, 1:] == s[:, :-1]
        sd = np.where(again | (s < 0), np.inf, np.take_along_axis(all_d, order, 1))
        best = np.argsort(sd, axis=1, kind="stable")[:, :beam]
        pick = lambda v: np.take_along_axis(v, best, 1)
        out_d = pick(sd)
        return np.where(np.isinf(out_d), -1, pick(s)), out_d, pick(np.take_along_axis(all_done, order, 1)) | np.isinf(out_d)


def lists_to_open(centroids: np.ndarray, n_of: np.ndarray, x: np.ndarray, k: int, probes: int, search_ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of the lists that each row of ``x`` opens; n_of holds the lists' sizes."""
    m = min(len(centroids), max(probes, -(-len(centroids) // PROBE_SHARE)))
    every = sq_dist(x.astype(np.float64), centroids.astype(np.float64))
    lists = np.argpartition(every, m - 1, axis=1)[:, :m]
    d = np.take_along_axis(every, lists, 1)
    order = np.argsort(d, axis=1, kind="stable")
    lists, d = np.take_along_axis(lists, order, 1), np.take_along_axis(d, order, 1)
    held = n_of[lists]
    before = np.cumsum(held, axis=1) - held
    row, at = np.nonzero((held > 0) & ((d <= search_ratio**2 * d[:, :1]) | (np.arange(m) < m // 2) | (before < 20 * k)))
    return row, lists[row, at]


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id long, v array<double>) of the vectors that take part."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return df.where(F.col(id_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda e: e != 0)).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def _matrix(column) -> np.ndarray:
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, query_mod: int = 100, replicas: int = 6, build_ratio: float = 1.15, search_ratio: float = 1.35, probes: int = 48, list_size: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by Euclidean distance, ties to smaller ids.

    Vectors take part if they have the table's commonest length. Queries are the rows whose id divides by ``query_mod``.
    """
    spark = df.sparkSession
    rows = valid_vectors(df, id_col, vec_col)
    schema = "query_id long, rank int, vec_id long, score double"
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dims, total = lengths
    rows = rows.where(F.size("v") == dims)
    n_lists = max(1, min(MAX_LISTS, total // list_size))
    if n_lists > 1:
        fit = rows.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(min(FIT_SAMPLE, 64 * n_lists, total)).toPandas()
        x = np.array(fit["v"].tolist())
        graph = Graph(balanced_centroids(np.unique(x, axis=0), min(n_lists, len(np.unique(x, axis=0))))) if len(np.unique(x, axis=0)) > 1 else Graph(x[:1])
    else:
        graph = Graph(np.zeros((1, dims)))
    shared = spark.sparkContext.broadcast(graph)

    def post(batches):
        import pyarrow as pa

        g = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                piece = batch.slice(lo, 2048)
                x = _matrix(piece.column(1))
                lists, d = g.search(x, replicas)
                keep = (d <= build_ratio**2 * d[:, :1]) & (lists >= 0)
                row, at = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(lists[row, at].astype(np.int32)), piece.column(0).take(pa.array(row)), piece.column(1).take(pa.array(row))], names=["list", "vec_id", "v"])

    posts = materialize(rows.mapInArrow(post, "list int, vec_id long, v array<double>"), "ann-posts")
    sizes = np.zeros(len(graph.c), np.int64)
    for r in posts.groupBy("list").count().collect():  # at most MAX_LISTS rows
        sizes[r["list"]] = r["count"]
    salts = np.maximum(1, -(-sizes // BLOCK))
    spread = spark.sparkContext.broadcast((sizes, salts))

    def ask(batches):
        import pyarrow as pa

        g, (n_of, salt_of) = shared.value, spread.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                piece = batch.slice(lo, 256)
                row, chosen = lists_to_open(g.c, n_of, _matrix(piece.column(1)), k, probes, search_ratio)
                times = salt_of[chosen]
                row, chosen = np.repeat(row, times), np.repeat(chosen, times)
                salt = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                yield pa.RecordBatch.from_arrays([pa.array(chosen.astype(np.int32)), pa.array(salt.astype(np.int32)), piece.column(0).take(pa.array(row)), piece.column(1).take(pa.array(row))], names=["list", "salt", "query_id", "q"])

    queries = rows.where(F.col("vec_id") % query_mod == 0).mapInArrow(ask, "list int, salt int, query_id long, q array<double>")

    def salted(batches):
        import pyarrow as pa

        _, salt_of = spread.value
        for batch in batches:
            at, ids = np.asarray(batch.column(0)), np.asarray(batch.column(1)).astype(np.uint64)
            salt = ((ids * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) + np.arange(len(ids))) % salt_of[at]  # rows of a repeated id are dealt out too
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(salt.astype(np.int32)), batch.column(1), batch.column(2)], names=["list", "salt", "vec_id", "v"])

    blocks = posts.mapInArrow(salted, "list int, salt int, vec_id long, v array<double>")

    def scan(key, left, right):
        import pyarrow as pa

        out_q, out_v, out_d = [], [], []
        if left.num_rows and right.num_rows:
            ids, x = np.asarray(left.column("vec_id").combine_chunks()), _matrix(left.column("v").combine_chunks())
            asked, q = np.asarray(right.column("query_id").combine_chunks()), _matrix(right.column("q").combine_chunks())
            for i in range(len(asked)):
                gap = x - q[i]
                d = np.sqrt((gap * gap).sum(1))
                d[ids == asked[i]] = np.inf
                near, want = np.arange(len(d)), k
                while True:  # repeated ids can fill the nearest rows: look further until k ids are in them
                    cut = np.partition(d, want - 1)[want - 1] if want < len(d) else np.inf
                    near = np.flatnonzero((d <= cut) & np.isfinite(d))
                    near = near[np.lexsort((ids[near], d[near]))]
                    near = near[np.sort(np.unique(ids[near], return_index=True)[1])][:k]  # an id's nearest row
                    if len(near) == k or want >= len(d):
                        break
                    want *= 4
                out_q += [asked[i]] * len(near)
                out_v += ids[near].tolist()
                out_d += d[near].tolist()
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_d, pa.float64())})

    found = blocks.groupBy("list", "salt").cogroup(queries.groupBy("list", "salt")).applyInArrow(scan, "query_id long, vec_id long, score double")
    single = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = single.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op6_ann_search(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
