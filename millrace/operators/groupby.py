"""Group-by with named aggregates, ordered picks, group-wise windows and user functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..semantics import AGGREGATES, col, missing, numeric_columns, present, sort_keys


class Grouped:
    """Groups of ``df`` by ``keys``; ``order_by`` fixes first, last, nth and the row-wise functions."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order_by: Sequence[str] = (), null_groups: bool = True):
        unknown = [k for k in keys if k not in df.columns]
        if unknown:
            raise KeyError(f"no columns {unknown}")
        self.keys, self.order_by = list(keys), list(order_by)
        self.df = df if null_groups else df.dropna(subset=self.keys)

    def _by(self):
        return self.df.groupBy(*map(col, self.keys))

    def _window(self):
        if not self.order_by:
            raise ValueError("this needs an order")
        return Window.partitionBy(*map(col, self.keys)).orderBy(*sort_keys(self.df, self.order_by))

    def _order(self) -> Column:
        if not self.order_by:
            raise ValueError("this needs an order")
        return F.struct(*[F.struct(missing(self.df, c), col(c)).alias(f"o{i}") for i, c in enumerate(self.order_by)])

    def _one(self, name: str, how: str) -> Column:
        c = present(self.df, name)
        if how in ("first", "last"):
            order = F.when(c.isNotNull(), self._order())
            return (F.min_by if how == "first" else F.max_by)(c, order)
        if how not in AGGREGATES:
            raise ValueError(f"unknown aggregate {how!r}")
        return AGGREGATES[how](c)

    def agg(self, *specs: tuple[str, str] | tuple[str, str, str], **named: tuple[str, str]) -> DataFrame:
        """('col', 'how'[, 'alias']) or alias=('col', 'how'); the default name is col_how."""
        made = [self._one(s[0], s[1]).alias(s[2] if len(s) > 2 else f"{s[0]}_{s[1]}") for s in specs]
        made += [self._one(c, how).alias(alias) for alias, (c, how) in named.items()]
        return self._by().agg(*made)

    def _all(self, how: str) -> DataFrame:
        return self._by().agg(*[self._one(c, how).alias(c) for c in numeric_columns(self.df, self.keys)])

    def sum(self):
        return self._all("sum")

    def mean(self):
        return self._all("mean")

    def median(self):
        return self._all("median")

    def std(self):
        return self._all("std")

    def var(self):
        return self._all("var")

    def min(self):
        return self._all("min")

    def max(self):
        return self._all("max")

    def count(self) -> DataFrame:
        """Present values of every other column."""
        return self._by().agg(*[F.count(present(self.df, c)).alias(c) for c in self.df.columns if c not in self.keys])

    def size(self) -> DataFrame:
        return self._by().agg(F.count(F.lit(1)).alias("size"))

    def first(self) -> DataFrame:
        return self._by().agg(*[self._one(c, "first").alias(c) for c in self.df.columns if c not in self.keys])

    def last(self) -> DataFrame:
        return self._by().agg(*[self._one(c, "last").alias(c) for c in self.df.columns if c not in self.keys])

    def nth(self, n: int) -> DataFrame:
        """The n-th row of each group (negative: from the end); short groups have none."""
        w = self._window() if n >= 0 else Window.partitionBy(*map(col, self.keys)).orderBy(*[present(self.df, c).desc_nulls_first() for c in self.order_by])
        return self.df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == (n + 1 if n >= 0 else -n)).drop("__n")

    def get_group(self, *values) -> DataFrame:
        cond = F.lit(True)
        for k, v in zip(self.keys, values, strict=True):
            cond = cond & col(k).eqNullSafe(F.lit(v))
        return self.df.where(cond)

    def n_groups(self) -> int:
        return self.df.select(*map(col, self.keys)).distinct().count()

    def _joined(self, groups: DataFrame, name: str | None) -> DataFrame:
        """The rows with column ``name`` of their group's row (or, without a name, those that have one)."""
        renamed = groups.select(*[col(k).alias(f"__k{i}") for i, k in enumerate(self.keys)], *([col(name).alias("__g")] if name else []))
        cond = None
        for i, k in enumerate(self.keys):
            c = col(k).eqNullSafe(F.col(f"__k{i}"))
            cond = c if cond is None else cond & c
        if name is None:
            return self.df.join(renamed, cond, "left_semi")
        return self.df.join(renamed, cond).drop(*[f"__k{i}" for i in range(len(self.keys))]).withColumnRenamed("__g", name)

    # group-wise rows

    def cumcount(self, name: str = "cumcount") -> DataFrame:
        return self.df.withColumn(name, F.row_number().over(self._window()) - 1)

    def ngroup(self, name: str = "ngroup") -> DataFrame:
        """Number of the group, by its first row in order: one row per group is ranked and joined back."""
        order = self._order()
        groups = self._by().agg(F.min(order).alias("__o"))
        ranked = groups.withColumn(name, (F.row_number().over(Window.orderBy("__o")) - 1).cast("long")).drop("__o")
        return self._joined(ranked, name)

    def shift(self, name: str, k: int = 1, out: str | None = None) -> DataFrame:
        c = col(name)
        return self.df.withColumn(out or f"{name}_shift_{k}", (F.lag(c, k) if k >= 0 else F.lead(c, -k)).over(self._window()))

    def diff(self, name: str, k: int = 1, out: str | None = None) -> DataFrame:
        c = present(self.df, name)
        return self.df.withColumn(out or f"{name}_diff", c - (F.lag(c, k) if k >= 0 else F.lead(c, -k)).over(self._window()))

    def pct_change(self, name: str, k: int = 1, out: str | None = None) -> DataFrame:
        c = present(self.df, name).cast("double")
        before = (F.lag(c, k) if k >= 0 else F.lead(c, -k)).over(self._window())
        return self.df.withColumn(out or f"{name}_pct_change", F.try_divide(c - before, before))

    def cumulative(self, name: str, how: str = "sum", out: str | None = None) -> DataFrame:
        from ..ordering import cumulative

        return cumulative(self.df, self.order_by, {out or f"{name}_cum{how}": (how, present(self.df, name))}, self.keys)

    def rank(self, name: str, method: str = "average", ascending: bool = True, out: str | None = None) -> DataFrame:
        from .windows import rank

        return rank(self.df, name, method, ascending, self.keys, self.order_by, out)

    def transform(self, name: str, how: str, out: str | None = None) -> DataFrame:
        """A group aggregate repeated on every row: aggregated first, then joined, so hot groups are pre-combined."""
        target = out or name
        stats = self._by().agg(self._one(name, how).alias("__v"))
        return self._joined(stats, "__v").drop(target).withColumnRenamed("__v", target)

    def filter(self, condition: Column) -> DataFrame:
        """Rows of the groups whose aggregate condition holds."""
        good = self._by().agg(condition.alias("__ok")).where("__ok").drop("__ok")
        return self._joined(good, None)

    def apply(self, f: Callable, schema: str) -> DataFrame:
        """f(pandas frame) -> pandas frame for each group; a group must fit one task."""
        return self._by().applyInPandas(f, schema)

    def transform_values(self, name: str, f: Callable, out: str | None = None) -> DataFrame:
        """f(numpy array) -> array of the same length for each group, in order."""
        target, order = out or f"{name}_out", self.order_by
        schema = T.StructType([*[f for f in self.df.schema.fields if f.name != target], T.StructField(target, T.DoubleType())])

        def run(pdf):
            pdf = pdf.sort_values(order) if order else pdf
            pdf = pdf.drop(columns=[target], errors="ignore")
            pdf[target] = f(pdf[name].to_numpy(float))
            return pdf

        return self._by().applyInPandas(run, schema)


def group_by(df: DataFrame, *keys: str, order_by: Sequence[str] = (), null_groups: bool = True) -> Grouped:
    return Grouped(df, keys, order_by, null_groups)
