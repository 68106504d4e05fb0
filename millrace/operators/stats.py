"""Describe, correlations, value counts, profile: few wide aggregates, never a pass per column."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..semantics import col, is_numeric, kurtosis, missing, numeric_columns, present, skewness
from .quantiles import exact_quantiles
from .windows import rank

QUARTILES = (0.25, 0.5, 0.75)


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows count, mean, std, min, 25%, 50%, 75%, max for the numeric columns: one aggregate, and the quartiles (which run jobs when called)."""
    cols = list(columns or numeric_columns(df))
    quartiles = exact_quantiles(df, {n: present(df, n) for n in cols}, QUARTILES)
    wide = df.agg(*[
        F.array(F.count(c).cast("double"), F.avg(c), F.coalesce(F.stddev_samp(c), F.when(F.count(c) == 1, 0.0)), F.min(c).cast("double"), *[F.lit(q).cast("double") for q in quartiles[n]], F.max(c).cast("double")).alias(n)
        for n, c in ((n, present(df, n)) for n in cols)
    ])
    names = F.array(*map(F.lit, ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]))
    rows = wide.select(F.explode(F.arrays_zip(names.alias("statistic"), *map(col, cols))).alias("x"))
    return rows.select("x.statistic", *[F.col(f"x.`{c}`").alias(c) for c in cols])


def describe_all(df: DataFrame) -> DataFrame:
    """One row for each column: kind, count, missing, unique, top value and its count."""
    aggs = []
    for n in df.columns:
        c = present(df, n)
        aggs.append(F.struct(F.lit(n).alias("column"), F.lit(df.schema[n].dataType.simpleString()).alias("dtype"), F.count(c).alias("count"), (F.count(F.lit(1)) - F.count(c)).alias("missing"), F.countDistinct(c).alias("unique"), F.mode(c.cast("string"), True).alias("top")))
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def corr(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson matrix (pairs with both present); null for a constant column. All pairs in one aggregate."""
    return _matrix(df, list(columns or numeric_columns(df)), F.corr, 1.0)


def cov(df: DataFrame, columns: Sequence[str] | None = None, ddof: int = 1) -> DataFrame:
    return _matrix(df, list(columns or numeric_columns(df)), F.covar_samp if ddof else F.covar_pop, None)


def _matrix(df: DataFrame, cols: list[str], f, diagonal) -> DataFrame:
    value = {}
    for i, a in enumerate(cols):
        for b in cols[i:]:
            x, y = present(df, a).cast("double"), present(df, b).cast("double")
            made = f(x, y)
            made = F.when(~F.isnan(made), made)
            if a == b and diagonal is not None:
                made = F.when(F.stddev_pop(x) > 0, F.lit(diagonal))
            value[a, b] = value[b, a] = made
    rows = F.array(*[F.struct(F.lit(a).alias("column"), *[value[a, b].alias(b) for b in cols]) for a in cols])
    return df.agg(rows.alias("m")).select(F.inline("m"))


def corr_spearman(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson of average ranks."""
    cols = list(columns or numeric_columns(df))
    ranked = df.select(*map(col, cols))
    for c in cols:
        ranked = rank(ranked, c, out=f"__rank_{c}")
    return corr(ranked.select(*[col(f"__rank_{c}").alias(c) for c in cols]), cols)


def corr_kendall(df: DataFrame, a: str, b: str, max_values: int = 100_000) -> float | None:
    """tau-b of two columns, by merge counting over the distinct pairs (an error above ``max_values``)."""
    import numpy as np

    pairs = df.select(present(df, a).cast("double").alias("x"), present(df, b).cast("double").alias("y")).dropna().groupBy("x", "y").count().limit(max_values + 1).toPandas()
    if len(pairs) > max_values:
        raise ValueError(f"more than {max_values} distinct pairs")
    x, y, w = (pairs[c].to_numpy() for c in ("x", "y", "count"))
    w = w.astype(float)
    n = w.sum()
    if n < 2:
        return None
    ry = np.unique(y, return_inverse=True)[1]
    order = np.lexsort((ry, x))
    tree = np.zeros(ry.max() + 2)
    concordant = discordant = 0.0
    i = 0
    while i < len(order):
        j = i
        while j < len(order) and x[order[j]] == x[order[i]]:
            j += 1
        for k in order[i:j]:
            below = _prefix(tree, ry[k])
            upto = _prefix(tree, ry[k] + 1)
            total = _prefix(tree, len(tree) - 1)
            concordant += w[k] * below
            discordant += w[k] * (total - upto)
        for k in order[i:j]:
            p = ry[k] + 1
            while p < len(tree):
                tree[p] += w[k]
                p += p & -p
        i = j
    ties = lambda v: sum(c * (c - 1) / 2 for c in np.bincount(np.unique(v, return_inverse=True)[1], weights=w))
    all_pairs = n * (n - 1) / 2
    down = ((all_pairs - ties(x)) * (all_pairs - ties(y))) ** 0.5
    return float((concordant - discordant) / down) if down else None


def _prefix(tree, p: int) -> float:
    out = 0.0
    while p > 0:
        out += tree[p]
        p -= p & -p
    return out


def value_counts(df: DataFrame, name: str, normalize: bool = False, keep_null: bool = False) -> DataFrame:
    """Values by count, largest first, then by value."""
    base = df.select(present(df, name).alias(name))
    base = base if keep_null else base.where(col(name).isNotNull())
    out = base.groupBy(col(name)).agg(F.count(F.lit(1)).alias("count"))
    if normalize:
        total = base.agg(F.count(F.lit(1)).alias("__n"))
        out = out.join(F.broadcast(total)).select(col(name), "count", (F.col("count") / F.col("__n")).alias("share"))
    return out.orderBy(F.desc("count"), col(name).asc_nulls_last())


def nunique(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct present values of every column, in one row."""
    f = F.approx_count_distinct if approximate else F.countDistinct
    return df.agg(*[f(present(df, c)).alias(c) for c in columns or df.columns])


def mode(df: DataFrame, name: str):
    """The commonest value, the smallest of equals."""
    row = value_counts(df, name).first()
    return None if row is None else row[0]


def info(df: DataFrame) -> DataFrame:
    """Column, type, present and missing counts."""
    rows = F.array(*[F.struct(F.lit(n).alias("column"), F.lit(df.schema[n].dataType.simpleString()).alias("dtype"), F.count(present(df, n)).alias("present"), F.count_if(missing(df, n)).alias("missing")) for n in df.columns])
    return df.agg(rows.alias("i")).select(F.inline("i"))


def profile(df: DataFrame, top: int = 10, exact: bool = False) -> dict:
    """Per column: missing, unique, moments, quantiles, zeros, lengths, top values; plus correlations and duplicate rows.

    One wide aggregate for the figures, one long one for the top values of all columns.
    """
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, n in enumerate(df.columns):
        c = present(df, n)
        aggs += [F.count(c).alias(f"{i}:present"), (F.countDistinct(c) if exact else F.approx_count_distinct(c)).alias(f"{i}:unique")]
        if is_numeric(df, n):
            d = c.cast("double")
            quant = F.percentile(d, F.array(*map(F.lit, QUARTILES))) if exact else F.percentile_approx(d, list(QUARTILES))
            aggs += [F.avg(d).alias(f"{i}:mean"), F.stddev_samp(d).alias(f"{i}:std"), F.min(d).alias(f"{i}:min"), F.max(d).alias(f"{i}:max"), skewness(d).alias(f"{i}:skew"), kurtosis(d).alias(f"{i}:kurtosis"), F.count_if(d == 0).alias(f"{i}:zeros"), quant.alias(f"{i}:quartiles")]
        elif df.schema[n].dataType.simpleString() == "string":
            aggs += [F.min(F.length(c)).alias(f"{i}:min_length"), F.max(F.length(c)).alias(f"{i}:max_length"), F.avg(F.length(c)).alias(f"{i}:mean_length")]
    row = df.agg(*aggs).first().asDict()
    out = {"rows": row.pop("rows"), "columns": {n: {"dtype": df.schema[n].dataType.simpleString()} for n in df.columns}}
    for key, v in row.items():
        i, what = key.split(":")
        out["columns"][df.columns[int(i)]][what] = v
    for c in out["columns"].values():
        c["missing"] = out["rows"] - c["present"]
    cells = F.array(*[F.struct(F.lit(n).alias("c"), present(df, n).cast("string").alias("v")) for n in df.columns])
    counted = df.select(F.explode(cells).alias("x")).where("x.v IS NOT NULL").groupBy("x.c", "x.v").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    best = counted.withColumn("k", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("n"), "v"))).where(F.col("k") <= top)
    for n in df.columns:
        out["columns"][n]["top"] = []
    for r in best.orderBy("c", "k").collect():  # top x columns rows
        out["columns"][r["c"]]["top"].append((r["v"], r["n"]))
    nums = numeric_columns(df)
    out["correlations"] = {r["column"]: {c: r[c] for c in nums} for r in corr(df, nums).collect()} if len(nums) > 1 else {}
    out["duplicate_rows"] = df.groupBy(*map(col, df.columns)).agg((F.count(F.lit(1)) - 1).alias("d")).agg(F.coalesce(F.sum("d"), F.lit(0))).first()[0]
    return out


def pairs_of(columns: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(columns, 2))


def timed(df: DataFrame, f, repeat: int = 3) -> dict:
    """Seconds that f(df) takes to run in full."""
    import time

    took = []
    for _ in range(repeat):
        began = time.perf_counter()
        f(df).write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    return {"best": min(took), "mean": sum(took) / len(took)}
