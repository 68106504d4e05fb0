"""Connected components of a link table, by alternating large-star and small-star steps.

Every step groups by one end with a partial minimum and joins back, so a vertex with many links is
split by adaptive skew handling; each round is a stored table. Nothing is collected but two numbers a round.
Up to LOCAL_LINKS counted links (16 bytes each) are joined by union-find in one executor task instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


LOCAL_LINKS = 500_000


def _union_find(batches):
    """(node, root) of all links in the batches."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "root"])


def _star(pairs: DataFrame, least: DataFrame) -> DataFrame:
    return pairs.join(least, "u")


def connected(links: DataFrame, a: str, b: str, name: str = "components", local_links: int = LOCAL_LINKS) -> DataFrame:
    """(node, root) for every node in ``links``: root is the smallest node reachable."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = materialize(edges, name)
    if edges.count() <= local_links:
        return edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).coalesce(1).mapInArrow(_union_find, "node long, root long")
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _star(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _star(large, least).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u <> v").distinct(), name)
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first()
        if tuple(seen) == before:
            break
        before = tuple(seen)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
