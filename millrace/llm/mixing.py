"""Operator 3: mixing sources to target weights by Poisson replication.

A document of source s is repeated X times, X Poisson with mean ``epochs * N * w_s / n_s``: X is the
number of entries of the cumulative distribution not above a uniform number made from an MD5 of
seed and id, so a document's count does not depend on partitioning. Means above 16 are split
into equal parts with their own uniforms (a sum of Poisson variables). Copies are dealt out by a hash of
seed, id and copy number and sorted by it within a partition, which shuffles the corpus globally.

Only built-in functions. The rates table has one row for each source; it is broadcast only if counted
small. Null sources count as source ''; a null id is hashed as the text 'null'. Documents drawn
zero times are the sampling this operator is for. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hint_small, table

PART = 16.0
#: Terms of a cumulative distribution: beyond it lies less than 2**-53 for means up to PART.
TERMS = 80


def _uniform(*parts):
    """53-bit-safe uniform in [0, 1): the first 13 hex digits of an MD5."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """(_source, n, rate, parts, cdf): by default weights go with the square root of a source's size."""
    counts = docs.select(F.coalesce(F.col(source_col), F.lit("")).alias("_source")).groupBy("_source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.sqrt(F.col("n").cast("double"))
    else:
        weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]), F.col("_source")), F.lit(0.0)) if weights else F.lit(0.0)
    weighted = counts.withColumn("w", weight)
    total = weighted.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    out = weighted.join(F.broadcast(total))  # one row
    out = out.withColumn("rate", F.coalesce(F.try_divide(F.lit(float(epochs)) * F.col("all_n") * F.col("w"), F.col("all_w") * F.col("n")), F.lit(0.0)))
    out = out.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
    mean = F.col("rate") / F.col("parts")
    first = F.exp(-mean)
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        F.struct(first.alias("term"), F.array(first).alias("cdf")),
        lambda acc, k: F.struct((acc["term"] * mean / k).alias("term"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["term"] * mean / k)).alias("cdf")),
    )
    return out.select("_source", "n", "rate", "parts", steps["cdf"].alias("cdf"))


def replicate(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = 17, max_broadcast: int = 10_000, copy_col: str = "_copy", order_col: str = "_order_key") -> DataFrame:
    """``docs`` with each row as often as drawn, plus its copy number (from 1) and order key, in global random order.

    Every column of ``docs`` is kept, whatever its name; only ``copy_col`` and ``order_col`` may not be among them.
    """
    if taken := {copy_col, order_col} & set(docs.columns):
        raise ValueError(f"choose other names than {sorted(taken)} for the added columns")
    table_ = rates(docs, source_col, weights, epochs)
    n_sources = table_.count()
    key = F.coalesce(F.col(f"row.`{id_col}`").cast("string"), F.lit("null"))
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{source_col}`"), F.lit("")).alias("_source"))
    joined = left.join(hint_small(table_.drop("n", "rate"), n_sources, max_broadcast), "_source")
    draws = F.aggregate(
        F.sequence(F.lit(1), F.col("parts")), F.lit(0),
        lambda acc, p: acc + F.size(F.filter(F.col("cdf"), lambda c: c <= _uniform(F.lit(seed), key, p))),
    )
    one = F.size(F.filter(F.col("cdf"), lambda c: c <= F.col("u")))
    drawn = joined.withColumn("u", _uniform(F.lit(seed), key, F.lit(1))).withColumn("times", F.when(F.col("parts") == 1, one).otherwise(draws)).where("times > 0")
    copies = drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    keyed = copies.withColumn("order_key", F.md5(F.concat_ws(":", F.lit(f"order{seed}"), key, F.col("copy").cast("string"))))
    out = keyed.repartition("order_key").sortWithinPartitions("order_key")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], F.col("copy").alias(copy_col), F.col("order_key").alias(order_col))


def op3_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return replicate(docs, copy_col="copy", order_col="order_key")


SQL = """WITH RECURSIVE s AS (SELECT coalesce(source, '') AS src, count(*) AS n, sqrt(count(*)::DOUBLE) AS w FROM documents GROUP BY 1),
tot AS (SELECT sum(n)::BIGINT AS all_n, sum(w) AS all_w FROM s),
r AS (SELECT src, coalesce((1.0::DOUBLE * all_n * w) / nullif(all_w * n, 0), 0) AS rate FROM s, tot),
p AS (SELECT src, rate, greatest(1, ceil(rate / 16.0))::INT AS parts, rate / greatest(1, ceil(rate / 16.0))::INT AS mean FROM r),
c(src, parts, mean, k, term, cdf) AS (
  SELECT src, parts, mean, 0, exp(-mean), exp(-mean) FROM p
  UNION ALL SELECT src, parts, mean, k + 1, term * mean / (k + 1), cdf + term * mean / (k + 1) FROM c WHERE k < 80),
d AS (SELECT *, coalesce(doc_id::VARCHAR, 'null') AS key_, coalesce(source, '') AS src_ FROM documents),
u AS (SELECT d.doc_id, key_, src_, p.src, part, ('0x' || substr(md5('17:' || key_ || ':' || part), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
      FROM (SELECT DISTINCT doc_id, key_, src_ FROM d) d JOIN p ON p.src = d.src_, unnest(range(1, p.parts + 1)) AS q(part)),
n AS (SELECT u.key_, u.src_, count(*) AS n FROM u JOIN c ON c.src = u.src AND c.cdf <= u.u GROUP BY 1, 2)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, copy::INT AS copy, md5('order17:' || d.key_ || ':' || copy) AS order_key
FROM d JOIN n ON n.key_ = d.key_ AND n.src_ = d.src_, unnest(range(1, n.n + 1)) AS x(copy)"""
