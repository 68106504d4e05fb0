"""Splits and metrics, each one aggregate job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ordering import POSITION, with_position
from ..semantics import col, present

# splits ---------------------------------------------------------------------


def _drawn(keys: Sequence[str], seed: int) -> Column:
    """The MD5 of seed and keys, which any engine can draw again."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(col(k).cast("string"), F.lit("")) for k in keys]))


def _shuffled(df: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """Adds __pos by a seeded hash of the keys: exact sizes without a global window."""
    return with_position(df.withColumn("__h", _drawn(keys, seed)), ["__h", *keys]).drop("__h")


def _shuffled_within(df: DataFrame, stratum: str, keys: Sequence[str], seed: int) -> DataFrame:
    """Adds __r, the 0-based drawn position in the row's class, and __n, the class's size; a large class is not one task."""
    at = with_position(df.withColumn("__h", _drawn(keys, seed)), [stratum, "__h", *keys]).drop("__h")
    sizes = df.groupBy(present(df, stratum).alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(F.col("__c").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a class
    sizes = sizes.withColumn("__first", before)
    joined = at.join(sizes, present(df, stratum).eqNullSafe(F.col("__c")))
    return joined.withColumn("__r", F.col(POSITION) - F.col("__first")).drop(POSITION, "__c", "__first")


def train_test_split(df: DataFrame, keys: Sequence[str], test_size: float = 0.2, seed: int = 0, stratify: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Exact sizes; stratified ones take at least one test row of every class."""
    if stratify is None:
        n = df.count()
        cut = round(n * test_size)
        at = _shuffled(df, keys, seed)
        return at.where(F.col(POSITION) >= cut).drop(POSITION), at.where(F.col(POSITION) < cut).drop(POSITION)
    ranked = _shuffled_within(df, stratify, keys, seed)
    test = F.col("__r") < F.greatest(F.lit(1), F.round(F.col("__n") * test_size).cast("int"))
    return ranked.where(~test).select(*map(col, df.columns)), ranked.where(test).select(*map(col, df.columns))


def train_val_test_split(df: DataFrame, keys: Sequence[str], val_size: float = 0.1, test_size: float = 0.2, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = df.count()
    a, b = round(n * test_size), round(n * test_size) + round(n * val_size)
    at = _shuffled(df, keys, seed)
    return tuple(at.where(c).drop(POSITION) for c in (F.col(POSITION) >= b, (F.col(POSITION) >= a) & (F.col(POSITION) < b), F.col(POSITION) < a))


def k_fold(df: DataFrame, keys: Sequence[str], k: int, seed: int = 0, stratify: str | None = None) -> DataFrame:
    """Adds 'fold' 0..k-1, sizes within one of each other (within each class if stratified)."""
    if stratify is None:
        return _shuffled(df, keys, seed).withColumn("fold", F.pmod(F.col(POSITION), F.lit(k)).cast("int")).drop(POSITION)
    return _shuffled_within(df, stratify, keys, seed).withColumn("fold", F.pmod(F.col("__r"), F.lit(k)).cast("int")).drop("__r", "__n")


def time_series_split(df: DataFrame, order_by: Sequence[str], k: int) -> list[tuple[DataFrame, DataFrame]]:
    """k growing training sets, each followed by its test block."""
    n = df.count()
    block = n // (k + 1)
    at = with_position(df, order_by)
    p = F.col(POSITION)
    return [(at.where(p < n - (k - i) * block).drop(POSITION), at.where((p >= n - (k - i) * block) & (p < n - (k - i - 1) * block)).drop(POSITION)) for i in range(k)]


# metrics ----------------------------------------------------------------------


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def classification_metrics(df: DataFrame, label: str, prediction: str, positive=1) -> DataFrame:
    """accuracy, precision, recall, f1, specificity and the four counts of a binary problem."""
    y, p = col(label) == F.lit(positive), col(prediction) == F.lit(positive)
    tp, fp, fn, tn = F.count_if(y & p), F.count_if(~y & p), F.count_if(y & ~p), F.count_if(~y & ~p)
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return df.agg(_ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), _ratio(2 * precision * recall, precision + recall).alias("f1"), _ratio(tn, tn + fp).alias("specificity"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))


def multiclass_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """A row for each class: precision, recall, f1, support."""
    counts = df.groupBy(col(label).alias("y"), col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    by_y = counts.groupBy(F.col("y").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    by_p = counts.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("predicted"))
    both = by_y.join(by_p, "class", "full").fillna(0, ["support", "tp", "predicted"])
    precision, recall = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("support"))
    return both.select("class", precision.alias("precision"), recall.alias("recall"), _ratio(2 * precision * recall, precision + recall).alias("f1"), "support")


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(col(label).alias("label"), col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def roc_auc(df: DataFrame, label: str, score: str, positive=1) -> float | None:
    """Area under the ROC curve from counts per distinct score (ties count half)."""
    from ..ordering import cumulative

    y = (col(label) == F.lit(positive)).cast("long")
    by = df.groupBy(present(df, score).cast("double").alias("s")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    run = cumulative(by, ["s"], {"below": ("sum", F.col("neg"))})
    row = run.agg(F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    return None if not row["p"] or not row["n"] else float(row["u"] / (row["p"] * row["n"]))


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """mae, mse, rmse, r2, mape (actual zeros add nothing but count)."""
    y, p = col(label).cast("double"), col(prediction).cast("double")
    e = y - p
    mse = F.avg(e * e)
    mape = F.sum(F.coalesce(F.abs(F.try_divide(e, y)), F.lit(0.0))) / F.count(e)
    return df.agg(F.avg(F.abs(e)).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"), (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(e))).alias("r2"), mape.alias("mape"))


def ranking_metrics(df: DataFrame, query: str, score: str, relevance: str, k: int = 10) -> DataFrame:
    """Mean NDCG@k (linear gain), MRR and MAP over queries."""
    w = Window.partitionBy(col(query)).orderBy(F.desc(score), F.desc(relevance))
    ideal = Window.partitionBy(col(query)).orderBy(F.desc(relevance))
    rel = col(relevance).cast("double")
    r = df.select(col(query).alias("q"), rel.alias("g"), F.row_number().over(w).alias("r"), F.row_number().over(ideal).alias("i"))
    hits = F.sum(F.when(F.col("g") > 0, 1).otherwise(0)).over(Window.partitionBy("q").orderBy("r"))
    r = r.withColumn("h", hits)
    per = r.groupBy("q").agg(
        F.sum(F.when(F.col("r") <= k, F.col("g") / F.log2(F.col("r") + 1)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("i") <= k, F.col("g") / F.log2(F.col("i") + 1)).otherwise(0.0)).alias("best"),
        F.coalesce(1 / F.min(F.when(F.col("g") > 0, F.col("r"))), F.lit(0.0)).alias("rr"),
        F.coalesce(F.avg(F.when(F.col("g") > 0, F.col("h") / F.col("r"))), F.lit(0.0)).alias("ap"),
    )
    return per.agg(F.avg(_ratio(F.col("dcg"), F.col("best"))).alias("ndcg"), F.avg("rr").alias("mrr"), F.avg("ap").alias("map"))


def cluster_metrics(df: DataFrame, cluster: str, features: Sequence[str]) -> dict[str, float]:
    """Davies-Bouldin and Calinski-Harabasz from centroids (one row a cluster)."""
    import numpy as np

    x = [col(f).cast("double") for f in features]
    centers = df.groupBy(col(cluster).alias("__c")).agg(F.count(F.lit(1)).alias("__n"), *[F.avg(v).alias(f"__m{i}") for i, v in enumerate(x)])
    sq = sum(((v - F.col(f"__m{i}")) * (v - F.col(f"__m{i}")) for i, v in enumerate(x)), F.lit(0.0))
    spread = df.join(F.broadcast(centers), df[cluster] == centers["__c"]).groupBy("__c").agg(F.avg(F.sqrt(sq)).alias("s"), F.sum(sq).alias("w"))
    rows = centers.join(spread, "__c").collect()  # one row a cluster
    n, c = np.array([r["__n"] for r in rows], float), np.array([[r[f"__m{i}"] for i in range(len(x))] for r in rows])
    s, w = np.array([r["s"] for r in rows]), sum(r["w"] for r in rows)
    mean = (n[:, None] * c).sum(0) / n.sum()
    between = float((n * ((c - mean) ** 2).sum(1)).sum())
    k = len(rows)
    gap = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))
    np.fill_diagonal(gap, np.inf)
    return {"davies_bouldin": float((((s[:, None] + s[None]) / gap).max(1)).mean()) if k > 1 else 0.0, "calinski_harabasz": float(between / (k - 1) / (w / (n.sum() - k))) if k > 1 and w else 0.0}
