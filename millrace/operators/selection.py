"""Row selection, sorting, sampling, duplicates and row-aligned combination."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ordering import POSITION, with_position
from ..semantics import col, missing, numeric_columns, present, sort_keys


def sort(df: DataFrame, by: Sequence[str], ascending: bool | Sequence[bool] = True, tie_break: Sequence[str] = ()) -> DataFrame:
    """Missing values last in both directions; ``tie_break`` columns make it stable."""
    return df.orderBy(*sort_keys(df, by, ascending), *map(col, tie_break))


def nlargest(df: DataFrame, n: int, by: str, tie_break: Sequence[str] = ()) -> DataFrame:
    return sort(df, [by], False, tie_break).limit(n)


def nsmallest(df: DataFrame, n: int, by: str, tie_break: Sequence[str] = ()) -> DataFrame:
    return sort(df, [by], True, tie_break).limit(n)


def head(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    if n < 0:
        raise ValueError("n must not be negative")
    return df.orderBy(*sort_keys(df, order_by)).limit(n)


def tail(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The last n rows, in order."""
    if n < 0:
        raise ValueError("n must not be negative")
    last = df.orderBy(*(k for k in _reversed_keys(df, order_by))).limit(n)
    return last.orderBy(*sort_keys(df, order_by))


def _reversed_keys(df: DataFrame, by: Sequence[str]) -> list[Column]:
    return [present(df, c).desc_nulls_first() for c in by]


def slice_rows(df: DataFrame, offset: int, length: int, order_by: Sequence[str]) -> DataFrame:
    """Rows offset .. offset + length - 1, by position and without a one-task window."""
    at = with_position(df, order_by)
    return at.where((F.col(POSITION) >= offset) & (F.col(POSITION) < offset + length)).orderBy(POSITION).drop(POSITION)


def take_positions(df: DataFrame, positions: Sequence[int], order_by: Sequence[str]) -> DataFrame:
    return with_position(df, order_by).where(F.col(POSITION).isin(list(positions))).orderBy(POSITION).drop(POSITION)


def value_at(df: DataFrame, position: int, name: str, order_by: Sequence[str]):
    """One cell by position and column."""
    row = take_positions(df, [position], order_by).select(col(name)).first()
    if row is None:
        raise IndexError(position)
    return row[0]


def batches(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """Adds 'batch': groups of n consecutive rows."""
    at = with_position(df, order_by)
    return at.withColumn("batch", F.floor(F.col(POSITION) / n)).drop(POSITION)


def sample(df: DataFrame, n: int, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """Exactly n rows (all, if fewer) by the order of the MD5 of seed and ``keys``."""
    return df.orderBy(_drawn(keys, seed), *map(col, keys)).limit(n)


def sample_fraction(df: DataFrame, fraction: float, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """Rows the first 32 bits of whose MD5 of seed and ``keys`` fall under the fraction: no shuffle."""
    return df.where(F.conv(F.substring(_drawn(keys, seed), 1, 8), 16, 10).cast("long") < fraction * (1 << 32))


def _drawn(keys: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(col(k).cast("string"), F.lit("")) for k in keys]))


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None, order_by: Sequence[str] | None = None) -> DataFrame:
    """Keeps the first row in order of each group; null equals null, NaN equals NaN.

    Without a subset, or without an order, rows of a group are alike and a hash aggregate suffices; with an
    order the smallest row is found by a partial aggregate, so a hot group is combined before the shuffle.
    """
    if subset is None or order_by is None:
        return df.dropDuplicates(list(subset)) if subset else df.dropDuplicates()
    named = F.struct(*[F.struct(missing(df, c), col(c)).alias(f"o{i}") for i, c in enumerate(order_by)], F.struct(*map(col, df.columns)).alias("row"))
    return df.groupBy(*map(col, subset)).agg(F.min(named).alias("__e")).select("__e.row.*")


def duplicated(df: DataFrame, subset: Sequence[str], order_by: Sequence[str], name: str = "duplicated") -> DataFrame:
    """True for every row but the first of its group."""
    w = Window.partitionBy(*map(col, subset)).orderBy(*sort_keys(df, order_by))
    return df.withColumn(name, F.row_number().over(w) > 1)


def select_dtypes(df: DataFrame, *kinds: str, exclude: bool = False) -> DataFrame:
    """Columns whose simple type name is (or is not) among ``kinds``; 'number' means every numeric type."""
    numeric = set(numeric_columns(df))
    hit = lambda f: f.dataType.simpleString() in kinds or ("number" in kinds and f.name in numeric)
    return df.select(*[col(f.name) for f in df.schema.fields if hit(f) != exclude])


def drop_column(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        raise KeyError(name)
    return df.drop(name)


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    kept = [mapping.get(c, c) for c in df.columns]
    if len(set(kept)) != len(kept):
        raise ValueError("renaming makes two columns of one name")
    return df.withColumnsRenamed(mapping)


def reorder(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*map(col, names), *[col(c) for c in df.columns if c not in names])


def with_new_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column; an existing name is an error."""
    if name in df.columns:
        raise ValueError(f"column {name!r} exists")
    return df.withColumn(name, value)


def row_extreme_name(df: DataFrame, largest: bool, name: str) -> DataFrame:
    """For each row the name of the numeric column with the extreme value; the first wins."""
    cols = numeric_columns(df)
    best = reduce(lambda a, b: (F.greatest if largest else F.least)(a, b), [present(df, c).cast("double") for c in cols]) if len(cols) > 1 else present(df, cols[0]).cast("double")
    out = None
    for c in cols:
        hit = present(df, c).cast("double") == best
        out = F.when(hit, c) if out is None else out.when(hit, c)
    return df.withColumn(name, out)


def clip_frame(df: DataFrame, lo: float, hi: float) -> DataFrame:
    """All int and double columns between the bounds (bounds of ints are cut to ints)."""
    out = {}
    for f in df.schema.fields:
        if f.name in numeric_columns(df):
            whole = not isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType))
            a, b = (int(lo), int(hi)) if whole else (float(lo), float(hi))
            c = col(f.name)
            out[f.name] = F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(b).cast(f.dataType)), F.lit(a).cast(f.dataType)))
    return df.withColumns(out)


# frames aligned by position or key ------------------------------------------


def _paired(a: DataFrame, b: DataFrame, on: Sequence[str]) -> tuple[DataFrame, list[str]]:
    joined = a.alias("a").join(b.alias("b"), list(on), "full")
    return joined, [c for c in a.columns if c not in on]


def by_position(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    return with_position(df, order_by)


def combine_first(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """a's values, and b's where a's are null; rows and columns of both."""
    joined, _ = _paired(a, b, on)
    rest = [c for c in dict.fromkeys([*a.columns, *b.columns]) if c not in on]
    pick = lambda c: F.coalesce(F.col(f"a.`{c}`"), F.col(f"b.`{c}`")) if c in a.columns and c in b.columns else F.col(f"{'a' if c in a.columns else 'b'}.`{c}`")
    return joined.select(*on, *[pick(c).alias(c) for c in rest])


def combine(a: DataFrame, b: DataFrame, on: Sequence[str], f: Callable[[Column, Column], Column]) -> DataFrame:
    """f of each pair of numeric columns of the same name."""
    joined, _ = _paired(a, b, on)
    both = [c for c in numeric_columns(a, on) if c in b.columns]
    return joined.select(*on, *[f(F.col(f"a.`{c}`"), F.col(f"b.`{c}`")).alias(c) for c in both])


def compare(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Cells that differ: the keys, column name, and both values as text."""
    joined, cols = _paired(a, b, on)
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"a.`{c}`").cast("string").alias("self"), F.col(f"b.`{c}`").cast("string").alias("other"), (~F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))).alias("differs")) for c in cols if c in b.columns]
    return joined.select(*on, F.explode(F.array(*cells)).alias("x")).where("x.differs").select(*on, "x.column", "x.self", "x.other")


def content_equals(a: DataFrame, b: DataFrame) -> bool:
    """Same columns, types and rows as bags."""
    if a.dtypes != b.dtypes:
        return False
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def transpose(df: DataFrame, order_by: Sequence[str], max_rows: int = 1000) -> DataFrame:
    """Strings; a row for each column and a column row_i for each row (at most ``max_rows`` rows, else an error)."""
    n = df.limit(max_rows + 1).count()
    if n > max_rows:
        raise ValueError(f"more than {max_rows} rows cannot become columns")
    names = list(df.columns)
    at = with_position(df, order_by).select(POSITION, *[col(c).cast("string").alias(c) for c in names])
    long = at.unpivot(POSITION, names, "column", "value")
    order = F.create_map(*[F.lit(x) for i, c in enumerate(names) for x in (c, i)])
    wide = long.groupBy("column").pivot(POSITION, list(range(n))).agg(F.first("value"))
    return wide.orderBy(order[F.col("column")]).select("column", *[F.col(f"`{i}`").alias(f"row_{i}") for i in range(n)])


def cross_section(df: DataFrame, name: str, value) -> DataFrame:
    """Rows where the column has the value, without the column."""
    return df.where(col(name).eqNullSafe(F.lit(value))).drop(name)


def set_cells(df: DataFrame, key: Sequence[str], edits: DataFrame) -> DataFrame:
    """A batch of edits (key columns, column, value as text) written into the frame."""
    wide = edits.groupBy(*key).pivot("column", [c for c in df.columns if c not in key]).agg(F.max_by(F.struct("value"), F.monotonically_increasing_id()))
    joined = df.alias("a").join(wide.alias("e"), list(key), "left")
    return joined.select(*[col(c) if c in key else F.when(F.col(f"e.`{c}`").isNotNull(), F.col(f"e.`{c}`.value").cast(df.schema[c].dataType)).otherwise(F.col(f"a.`{c}`")).alias(c) for c in df.columns])


def memory_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
