"""Equi, anti, cross, star and as-of joins, and concatenation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ordering import _BUCKET, POSITION, find_borders, range_bucket, with_position
from ..semantics import col, key_equal

BROADCAST_ROWS = 2_000_000


def join(left: DataFrame, right: DataFrame, on: str | Sequence[str] | None = None, how: str = "inner", *, left_on: Sequence[str] | None = None, right_on: Sequence[str] | None = None, suffixes: tuple[str, str] = ("_x", "_y"), null_equals: bool = True) -> DataFrame:
    """inner, left, right, outer, anti, semi or cross.

    Null keys match each other unless ``null_equals`` is off; NaN never matches. Key columns appear once, under the
    left name, with the value of whichever side has it; other clashing names take the suffixes.
    """
    if how == "cross":
        return _cross(left, right, suffixes)
    lk = [on] if isinstance(on, str) else list(on) if on is not None else list(left_on or [])
    rk = lk if on is not None else list(right_on or [])
    if not lk or len(lk) != len(rk):
        raise ValueError("keys are needed, as many on each side")
    for df, keys, side in ((left, lk, "left"), (right, rk, "right")):
        gone = [k for k in keys if k not in df.columns]
        if gone:
            raise KeyError(f"{side} has no {gone}; it has {df.columns}")
    right = right.select(*[col(c).alias(f"__r_{c}") for c in right.columns])
    cond = None
    for a, b in zip(lk, rk, strict=True):
        c = key_equal(left, right, a, f"__r_{b}", null_equals)
        cond = c if cond is None else cond & c
    kind = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "anti": "left_anti", "semi": "left_semi"}[how]
    joined = left.join(right, cond, kind)
    if how in ("anti", "semi"):
        return joined
    rest = [c[4:] for c in right.columns if c[4:] not in rk]
    clash = set(left.columns) & set(rest)
    out = []
    for c in left.columns:
        value = left[c]
        if c in lk and how in ("right", "outer"):
            value = F.coalesce(value, right[f"__r_{rk[lk.index(c)]}"])
        out.append(value.alias(c + suffixes[0] if c in clash else c))
    out += [right[f"__r_{c}"].alias(c + suffixes[1] if c in clash else c) for c in rest]
    return joined.select(*out)


merge = join


def _cross(left: DataFrame, right: DataFrame, suffixes) -> DataFrame:
    clash = set(left.columns) & set(right.columns)
    a = left.select(*[col(c).alias(c + suffixes[0] if c in clash else c) for c in left.columns])
    b = right.select(*[col(c).alias(c + suffixes[1] if c in clash else c) for c in right.columns])
    return a.crossJoin(b)


def join_many(fact: DataFrame, dimensions: Sequence[tuple[str, DataFrame]], order_by: dict[str, str] | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left look-ups of several dimensions by key; clashing columns are skipped, a miss is null.

    Duplicate keys in a dimension keep the last row (by ``order_by[key]``, else any). A dimension is broadcast only
    if its counted rows are within ``broadcast_rows``.
    """
    out = fact
    for key, dim in dimensions:
        keep = [c for c in dim.columns if c != key and c not in out.columns]
        dim = dim.where(col(key).isNotNull()).select(col(key), *map(col, keep), *([] if not order_by or key not in order_by or order_by[key] in keep else [col(order_by[key])]))
        if order_by and key in order_by:
            dim = dim.groupBy(col(key)).agg(F.max_by(F.struct(*map(col, keep)), col(order_by[key])).alias("__d")).select(col(key), "__d.*")
        else:
            dim = dim.dropDuplicates([key])
        small = dim.limit(broadcast_rows + 1).count() <= broadcast_rows
        out = out.join(F.broadcast(dim) if small else dim, key, "left")
    return out.select(*[col(c) for c in [*fact.columns, *[c for c in out.columns if c not in fact.columns]]])


def asof_join(left: DataFrame, right: DataFrame, on: str, direction: str = "backward", by: Sequence[str] = (), suffix: str = "_y", tolerance=None, right_order: str | None = None) -> DataFrame:
    """Every left row with the nearest right row by ``on``: backward (at or before), forward or nearest.

    Both sides are tagged and united; the last (next) right row is carried along the order inside each ``by`` group
    by a window, so no pair is built. Of equal candidates the first right row (by
    ``right_order``, else by its values) wins. Rows go in range buckets of ``on``, so a ``by`` group of any size is
    split: the last and first right row of each group's bucket, one row each, is carried across its buckets.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(direction)
    by = list(by)
    rest = [c for c in right.columns if c not in (on, *by)]
    names = {c: c + suffix if c in left.columns else c for c in rest}
    pay = F.struct(col(on).alias("__on"), *[col(c).alias(f"v{i}") for i, c in enumerate(rest)])
    tie = col(right_order) if right_order else F.struct(*map(col, rest)) if rest else F.lit(0)
    # one row for each (by, on) on the right: the first of equal ones
    single = right.where(col(on).isNotNull()).groupBy(*map(col, by), col(on)).agg(F.min(F.struct(tie.alias("t"), pay.alias("p"))).alias("__m"))
    r = single.select(*map(col, by), col(on), F.col("__m.p").alias("__pay"), F.lit(0).alias("__side"), F.lit(None).cast(T.StructType(left.schema.fields)).alias("__left"))
    l = left.select(*map(col, by), col(on), F.lit(None).cast(r.schema["__pay"].dataType).alias("__pay"), F.lit(1).alias("__side"), F.struct(*map(col, left.columns)).alias("__left"))
    both = r.unionByName(l)
    both, _ = range_bucket(both, on, borders=find_borders(left.select(col(on)).unionAll(right.select(col(on))), [on]))
    keys = [*(col(b) for b in by), F.col(_BUCKET)]
    edge = both.groupBy(*keys).agg(F.max_by("__pay", F.when(F.col("__side") == 0, col(on))).alias("__hi"), F.min_by("__pay", F.when(F.col("__side") == 0, col(on))).alias("__lo"))
    along = Window.partitionBy(*map(col, by)).orderBy(_BUCKET)  # one row a bucket
    prior = F.last("__hi", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("__lo", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))
    edge = edge.select(*[col(b).alias(f"__by{i}") for i, b in enumerate(by)], F.col(_BUCKET).alias("__b"), prior.alias("__prior"), after.alias("__after"))
    same = reduce(lambda p, q: p & q, (col(b).eqNullSafe(F.col(f"__by{i}")) for i, b in enumerate(by)), F.col(_BUCKET) == F.col("__b"))
    both = both.join(edge if by else F.broadcast(edge), same).drop("__b", *[f"__by{i}" for i in range(len(by))])
    back = F.last("__pay", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(col(on), "__side").rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.last("__pay", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(col(on).desc(), "__side").rowsBetween(Window.unboundedPreceding, 0))
    back, ahead = F.coalesce(back, F.col("__prior")), F.coalesce(ahead, F.col("__after"))
    made = both
    if direction != "forward":
        made = made.withColumn("__back", back)
    if direction != "backward":
        made = made.withColumn("__ahead", ahead)
    kept = made.where("__side = 1")
    number = lambda c: F.unix_micros(c.cast("timestamp")).cast("double") if isinstance(left.schema[on].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else c.cast("double")
    if direction == "backward":
        hit = F.col("__back")
    elif direction == "forward":
        hit = F.col("__ahead")
    else:
        a, b = F.col("__back"), F.col("__ahead")
        gap_a, gap_b = number(col(on)) - number(a["__on"]), number(b["__on"]) - number(col(on))
        hit = F.when(b.isNull() | (a.isNotNull() & (gap_a <= gap_b)), a).otherwise(b)
    hit = F.when(col(on).isNotNull(), hit)
    if tolerance is not None:
        hit = F.when(F.abs(number(hit["__on"]) - number(col(on))) <= float(tolerance), hit)
    return kept.withColumn("__hit", hit).select("__left.*", *[F.col(f"__hit.v{i}").alias(names[c]) for i, c in enumerate(rest)])


_RANK = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]


def concat_rows(*frames: DataFrame) -> DataFrame:
    """Union by name: missing columns are null, numbers widen, otherwise the first frame's type wins."""
    kinds: dict[str, T.DataType] = {}
    for df in frames:
        for f in df.schema.fields:
            have = kinds.get(f.name)
            if have is None:
                kinds[f.name] = f.dataType
            elif type(have) in _RANK and type(f.dataType) in _RANK:
                kinds[f.name] = max(have, f.dataType, key=lambda t: _RANK.index(type(t)))
    out = None
    for df in frames:
        cast = df.select(*[(col(c) if c in df.columns else F.lit(None)).try_cast(t).alias(c) for c, t in kinds.items()])
        out = cast if out is None else out.unionByName(cast)
    return out


def concat_columns(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Side by side by position; clashing names of the right get _1."""
    a = with_position(left, left_order)
    b = with_position(right.select(*[col(c).alias(f"{c}_1" if c in left.columns else c) for c in right.columns]), [f"{c}_1" if c in left.columns else c for c in right_order])
    return a.join(b, POSITION, "full").drop(POSITION)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def condition_join(left: DataFrame, right: DataFrame, cond: Column, how: str = "inner") -> DataFrame:
    """A join on any condition (an equality in it keeps it from being a nested loop)."""
    return left.join(right, cond, how)
