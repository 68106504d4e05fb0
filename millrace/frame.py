"""A thin immutable wrapper: a Spark frame plus the row order and index columns the order-sensitive verbs need.

Every verb adds to the lazy plan and gives a new Frame; ``.df`` is the Spark frame. Without ``order_by`` an ingest
order column is added when a verb needs one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame

from .functions import columns as fc
from .functions import parser
from .operators import groupby, joins, missing, reshape, selection, stats, windows
from .ordering import with_row_id
from .semantics import col, numeric_columns

ROW_ID = "__row_id"


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    order_by: tuple[str, ...] = ()
    index: tuple[str, ...] = ()

    # plumbing

    def _with(self, df: DataFrame) -> Frame:
        return replace(self, df=df)

    def ordered(self) -> Frame:
        """This frame with an order: its own, or the ingest order."""
        return self if self.order_by else replace(self, df=with_row_id(self.df, ROW_ID), order_by=(ROW_ID,))

    def pipe(self, f: Callable, *args, **kwargs):
        return f(self, *args, **kwargs)

    def lazy(self) -> Frame:
        return self

    def collect(self):
        return self.df.drop(ROW_ID).collect()

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != ROW_ID]

    @property
    def shape(self) -> tuple[int, int]:
        return self.df.count(), len(self.columns)

    @property
    def dtypes(self) -> dict[str, str]:
        return {n: t for n, t in self.df.dtypes if n != ROW_ID}

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    # projection

    def select(self, *cols: str | Column) -> Frame:
        keep = [c for c in (*self.order_by, *self.index) if c not in cols]
        return self._with(self.df.select(*[col(c) for c in cols], *map(col, keep)))

    def with_column(self, name: str, value: Column) -> Frame:
        return self._with(selection.with_new_column(self.df, name, value))

    def with_columns(self, **values: Column) -> Frame:
        return self._with(self.df.withColumns(values))

    assign = with_columns

    def drop(self, *names: str) -> Frame:
        return self._with(self.df.drop(*names))

    def rename(self, mapping: dict[str, str]) -> Frame:
        swap = lambda names: tuple(mapping.get(n, n) for n in names)
        return Frame(selection.rename(self.df, mapping), swap(self.order_by), swap(self.index))

    def cast(self, name: str, kind: str) -> Frame:
        return self._with(self.df.withColumn(name, fc.cast(self.df, name, kind)))

    def numeric_only(self) -> Frame:
        return self.select(*[c for c in numeric_columns(self.df) if c != ROW_ID])

    # rows

    def filter(self, condition: Column | str) -> Frame:
        return self._with(self.df.where(condition if isinstance(condition, Column) else parser.compile_expression(self.df, condition)[0]))

    def query(self, text: str) -> Frame:
        return self._with(self.df.where(parser.query_condition(self.df, text)))

    def eval(self, text: str) -> Frame:
        return self._with(parser.evaluate(self.df, text))

    def sort(self, *by: str, ascending: bool | Sequence[bool] = True) -> Frame:
        return self._with(selection.sort(self.df, by, ascending, [c for c in self.order_by if c not in by]))

    def head(self, n: int = 5) -> Frame:
        f = self.ordered()
        return f._with(selection.head(f.df, n, f.order_by))

    def tail(self, n: int = 5) -> Frame:
        f = self.ordered()
        return f._with(selection.tail(f.df, n, f.order_by))

    def slice(self, offset: int, length: int) -> Frame:
        f = self.ordered()
        return f._with(selection.slice_rows(f.df, offset, length, f.order_by))

    def iloc(self, positions: Sequence[int]) -> Frame:
        f = self.ordered()
        return f._with(selection.take_positions(f.df, positions, f.order_by))

    def at(self, position: int, name: str):
        f = self.ordered()
        return selection.value_at(f.df, position, name, f.order_by)

    def sample(self, n: int, seed: int = 0) -> Frame:
        f = self.ordered()
        return f._with(selection.sample(f.df, n, f.order_by, seed))

    def nlargest(self, n: int, by: str) -> Frame:
        f = self.ordered()
        return f._with(selection.nlargest(f.df, n, by, f.order_by))

    def nsmallest(self, n: int, by: str) -> Frame:
        f = self.ordered()
        return f._with(selection.nsmallest(f.df, n, by, f.order_by))

    def drop_duplicates(self, *subset: str) -> Frame:
        f = self.ordered()
        return f._with(selection.drop_duplicates(f.df, list(subset) or f.columns, f.order_by))

    def set_index(self, *names: str) -> Frame:
        return replace(self, index=tuple(names))

    def reset_index(self) -> Frame:
        return replace(self, index=())

    def xs(self, value, name: str | None = None) -> Frame:
        target = name or self.index[0]
        return replace(self._with(selection.cross_section(self.df, target, value)), index=tuple(i for i in self.index if i != target))

    # groups, joins, windows, shape

    def group_by(self, *keys: str, null_groups: bool = True) -> groupby.Grouped:
        f = self.ordered()
        return groupby.Grouped(f.df, keys, f.order_by, null_groups)

    def join(self, other: Frame | DataFrame, on, how: str = "inner", **options) -> Frame:
        return self._with(joins.join(self.df, other.df if isinstance(other, Frame) else other, on, how, **options))

    merge = join

    def join_asof(self, other: Frame | DataFrame, on: str, direction: str = "backward", by: Sequence[str] = (), **options) -> Frame:
        return self._with(joins.asof_join(self.df, other.df if isinstance(other, Frame) else other, on, direction, by, **options))

    def rolling(self, name: str, size: int, how: str, **options) -> Frame:
        f = self.ordered()
        return f._with(windows.rolling(f.df, name, size, how, f.order_by, **options))

    def expanding(self, name: str, how: str, **options) -> Frame:
        f = self.ordered()
        return f._with(windows.expanding(f.df, name, how, f.order_by, **options))

    def cum(self, name: str, how: str = "sum", **options) -> Frame:
        f = self.ordered()
        return f._with(windows.cum(f.df, name, how, f.order_by, **options))

    def shift(self, name: str, k: int = 1, **options) -> Frame:
        f = self.ordered()
        return f._with(windows.shift(f.df, name, k, f.order_by, **options))

    def rank(self, name: str, method: str = "average", **options) -> Frame:
        f = self.ordered()
        return f._with(windows.rank(f.df, name, method, tie_break=f.order_by, **options))

    def pivot_table(self, index: str, columns: str, values: str, how: str = "sum") -> Frame:
        return Frame(reshape.pivot_table(self.df, index, columns, values, how))

    def melt(self, id_columns: Sequence[str], value_columns: Sequence[str] | None = None) -> Frame:
        rest = value_columns or [c for c in self.columns if c not in id_columns]
        return Frame(reshape.melt(self.df, id_columns, rest))

    def explode(self, name: str, sep: str = ",") -> Frame:
        return self._with(reshape.explode(self.df, name, sep))

    def fill_na(self, values: dict) -> Frame:
        return self._with(missing.fill_value(self.df, values))

    def fill_forward(self, name: str, **options) -> Frame:
        f = self.ordered()
        return f._with(missing.fill_direction(f.df, name, True, f.order_by, **options))

    def drop_na(self, threshold: int | None = None) -> Frame:
        return self._with(missing.drop_na(self.df, threshold, self.columns))

    def interpolate(self, name: str, **options) -> Frame:
        f = self.ordered()
        return f._with(missing.interpolate_linear(f.df, name, f.order_by, **options))

    def describe(self) -> Frame:
        return Frame(stats.describe(self.df, [c for c in numeric_columns(self.df) if c != ROW_ID]))

    def corr(self) -> Frame:
        return Frame(stats.corr(self.df, [c for c in numeric_columns(self.df) if c != ROW_ID]))

    # row and column functions of the user

    def apply(self, f: Callable, name: str, kind: str) -> Frame:
        """f(dict of a row) -> value, in Arrow batches."""
        from pyspark.sql import functions as F

        @F.pandas_udf(kind)
        def run(rows: pd.DataFrame) -> pd.Series:
            return pd.Series([f(r) for r in rows.to_dict("records")])

        return self._with(self.df.withColumn(name, run(F.struct(*map(col, self.columns)))))

    def map(self, name: str, f: Callable, kind: str, out: str | None = None) -> Frame:
        """f(value) -> value of one column, in Arrow batches."""
        from pyspark.sql import functions as F

        @F.pandas_udf(kind)
        def run(s: pd.Series) -> pd.Series:
            return s.map(f)

        return self._with(self.df.withColumn(out or name, run(col(name))))

    def map_partitions(self, f: Callable, schema: str) -> Frame:
        """f(pandas frame) -> pandas frame for each Arrow batch."""
        return Frame(self.df.mapInPandas(lambda it: (f(p) for p in it), schema))

    def repartition(self, n: int, *keys: str) -> Frame:
        return self._with(self.df.repartition(n, *map(col, keys)) if keys else self.df.repartition(n))

    def spill(self, path: str) -> Frame:
        """Writes the frame to Parquet and goes on from there."""
        self.df.write.mode("overwrite").parquet(path)
        return self._with(self.df.sparkSession.read.parquet(path))


def frame(df: DataFrame, *order_by: str) -> Frame:
    return Frame(df, tuple(order_by))
