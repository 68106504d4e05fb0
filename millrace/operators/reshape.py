"""Pivot, melt, dummies, explode and cross-tabulation.

Where the output columns depend on the data, the values may be given; otherwise one aggregate finds them, and more than
``max_columns`` is an error rather than a cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import quote
from ..semantics import AGGREGATES, col, missing, present


def column_values(df: DataFrame, name: str, values: Sequence | None = None, max_columns: int = 1000, order_by: Sequence[str] = ()) -> list:
    """Distinct values that become columns, in order of appearance (or of value)."""
    if values is not None:
        return list(values)
    order = F.min(F.struct(*map(col, order_by))) if order_by else col(name)
    rows = df.groupBy(col(name)).agg(order.alias("__o")).orderBy("__o").limit(max_columns + 1).collect() if order_by else df.select(col(name)).distinct().orderBy(col(name)).limit(max_columns + 1).collect()
    if len(rows) > max_columns:
        raise ValueError(f"{name} has more than {max_columns} values")
    return [r[0] for r in rows]


def pivot(df: DataFrame, index: str, columns: str, values: str, order_by: Sequence[str], column_names: Sequence | None = None) -> DataFrame:
    """One column for each value of ``columns``; of duplicates the last in order wins; null becomes 'null'."""
    named = df.withColumn("__c", F.coalesce(col(columns).cast("string"), F.lit("null")))
    names = [str(x) for x in column_names] if column_names is not None else column_values(named, "__c", order_by=order_by)
    order = F.struct(*[F.struct(missing(df, c), col(c)).alias(f"o{i}") for i, c in enumerate(order_by)])
    return named.groupBy(col(index)).pivot("__c", names).agg(F.max_by(F.struct(col(values).alias("v")), order)["v"])


def pivot_table(df: DataFrame, index: str, columns: str, values: str, how: str = "sum", column_names: Sequence | None = None) -> DataFrame:
    """Aggregated pivot of rows with present index and column, as doubles; empty cells are null."""
    kept = df.where(col(index).isNotNull() & col(columns).isNotNull())
    names = column_values(kept, columns, column_names)
    agg = AGGREGATES["sum_or_null" if how == "sum" else how](present(df, values)).cast("double")
    return kept.groupBy(col(index)).pivot(columns, names).agg(agg)


def melt(df: DataFrame, id_columns: Sequence[str], value_columns: Sequence[str] | None = None, variable: str = "variable", value: str = "value") -> DataFrame:
    rest = list(value_columns) if value_columns is not None else [c for c in df.columns if c not in id_columns]
    return df.unpivot([col(c) for c in id_columns], [col(c) for c in rest], variable, value)


stack = melt
unstack = pivot


def get_dummies(df: DataFrame, name: str, prefix: str | None = None, values: Sequence | None = None) -> DataFrame:
    """A boolean column for each value; null is false everywhere; the column itself goes."""
    found = column_values(df.where(col(name).isNotNull()), name, values)
    return df.withColumns({f"{prefix or name}_{v}": F.coalesce(col(name) == F.lit(v), F.lit(False)) for v in found}).drop(name)


def explode(df: DataFrame, name: str, sep: str = ",") -> DataFrame:
    """A row for each trimmed part; a null keeps its row."""
    parts = F.transform(F.split(col(name), quote(sep)), lambda p: F.trim(p))
    return df.withColumn(name, F.explode_outer(parts))


def crosstab(df: DataFrame, index: str, columns: str, column_names: Sequence | None = None) -> DataFrame:
    """Counts, zero where a pair does not occur."""
    names = column_values(df.where(col(columns).isNotNull()), columns, column_names)
    made = df.groupBy(col(index)).pivot(columns, names).agg(F.count(F.lit(1)))
    return made.fillna(0, subset=[str(n) for n in names])


def dissolve(df: DataFrame, key: str, lat: str, lon: str, **aggregates: tuple[str, str]) -> DataFrame:
    """Aggregates by key plus the mean position."""
    made: list[Column] = [AGGREGATES[how](present(df, c)).alias(a) for a, (c, how) in aggregates.items()]
    return df.groupBy(col(key)).agg(*made, F.avg(col(lat)).alias("centroid_lat"), F.avg(col(lon)).alias("centroid_lon"))
