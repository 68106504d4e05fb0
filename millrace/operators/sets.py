"""Set operations, grouping sets and ranking windows beyond the frame verbs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ordering import POSITION, with_position
from ..semantics import col, missing, present, sort_keys


def intersect(a: DataFrame, b: DataFrame, keep_repeats: bool = False) -> DataFrame:
    """Rows of both; null equals null."""
    return a.intersectAll(b) if keep_repeats else a.intersect(b)


def difference(a: DataFrame, b: DataFrame, keep_repeats: bool = False) -> DataFrame:
    """Rows of ``a`` that are not in ``b``; null equals null."""
    return a.exceptAll(b) if keep_repeats else a.subtract(b)


def rollup(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Totals for every prefix of the keys; ``grouping`` tells how many bits of keys are summed away."""
    return df.rollup(*map(col, keys)).agg(F.grouping_id().alias("grouping"), *aggregates)


def cube(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Totals for every subset of the keys."""
    return df.cube(*map(col, keys)).agg(F.grouping_id().alias("grouping"), *aggregates)


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Totals for the named subsets of the keys."""
    return df.groupingSets([[col(k) for k in s] for s in sets], *map(col, keys)).agg(F.grouping_id().alias("grouping"), *aggregates)


def ranking(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str], tiles: int = 4) -> DataFrame:
    """Adds ntile, percent_rank and cume_dist in each partition."""
    w = Window.partitionBy(*map(col, partition_by)).orderBy(*sort_keys(df, order_by))
    return df.withColumns({"ntile": F.ntile(tiles).over(w), "percent_rank": F.percent_rank().over(w), "cume_dist": F.cume_dist().over(w)})


def nth_value(df: DataFrame, name: str, n: int, order_by: Sequence[str], partition_by: Sequence[str], out: str) -> DataFrame:
    """The n-th (from 1) present value of the partition so far."""
    w = Window.partitionBy(*map(col, partition_by)).orderBy(*sort_keys(df, order_by)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.nth_value(present(df, name), n, True).over(w))


def range_window(df: DataFrame, name: str, how: Callable[[Column], Column], by: str, before: float, after: float, partition_by: Sequence[str], out: str) -> DataFrame:
    """A statistic of the rows whose ``by`` lies within [value - before, value + after]."""
    w = Window.partitionBy(*map(col, partition_by)).orderBy(col(by)).rangeBetween(-before, after)
    return df.withColumn(out, how(present(df, name)).over(w))


def reduce_columns(df: DataFrame, columns: Sequence[str], zero: float, step: Callable, merge: Callable) -> dict[str, float]:
    """A custom reducer of columns: ``step(state, numpy array)`` in each batch, ``merge(state, state)`` of the batches' states.

    One state a partition travels; 32 tasks merge them before the driver sees any.
    """
    names = list(columns)
    present_of = df.select(*[present(df, c).cast("double").alias(c) for c in names])

    def partial(batches):
        import pyarrow as pa

        states = dict.fromkeys(names, zero)
        for batch in batches:
            for c in names:
                values = batch.column(batch.schema.get_field_index(c)).drop_null().to_numpy(zero_copy_only=False)
                states[c] = step(states[c], values)
        yield pa.RecordBatch.from_arrays([pa.array([float(states[c])]) for c in names], names=names)

    schema = ", ".join(f"`{c}` double" for c in names)
    states = present_of.mapInArrow(partial, schema)

    def joined(batches):
        import pyarrow as pa

        total = dict.fromkeys(names, zero)
        for batch in batches:
            for c in names:
                for v in batch.column(batch.schema.get_field_index(c)).to_pylist():
                    total[c] = merge(total[c], v)
        yield pa.RecordBatch.from_arrays([pa.array([float(total[c])]) for c in names], names=names)

    rows = states.repartition(32).mapInArrow(joined, schema).collect()  # 32 rows
    out = dict.fromkeys(names, zero)
    for r in rows:
        out = {c: merge(out[c], r[c]) for c in names}
    return out


class MultiIndex:
    """Several columns as row labels, in a frame's order."""

    def __init__(self, df: DataFrame, names: Sequence[str], order_by: Sequence[str]):
        self.df, self.names, self.order_by = df, list(names), list(order_by)

    @classmethod
    def from_arrays(cls, spark, arrays: Sequence[Sequence], names: Sequence[str]) -> MultiIndex:
        rows = [(i, *r) for i, r in enumerate(zip(*arrays, strict=True))]
        return cls(spark.createDataFrame(rows, ["__row", *names]), names, ["__row"])

    @classmethod
    def from_tuples(cls, spark, tuples: Sequence[tuple], names: Sequence[str]) -> MultiIndex:
        return cls.from_arrays(spark, list(zip(*tuples, strict=True)), names)

    def locations(self, *values) -> DataFrame:
        """Positions of the rows with these labels (fewer values: a prefix of the levels); a null label is found by None."""
        at = with_position(self.df, self.order_by, name=POSITION)
        for name, v in zip(self.names, values, strict=False):
            at = at.where(missing(self.df, name) if v is None else col(name) == F.lit(v))
        return at.select(F.col(POSITION).alias("position"))

    def levels(self) -> dict[str, int]:
        """How many distinct labels each level has."""
        return self.df.agg(*[F.countDistinct(col(c)).alias(c) for c in self.names]).first().asDict()
