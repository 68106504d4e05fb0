"""Exact quantiles of whole columns without a table of all values in one task.

Up to DIRECT present values the built-in percentile is used. Beyond that each order statistic is bracketed by sketches of a sketch's bracket,
with exact counts of what lies below, until the bracket holds at most DIRECT values; the result is the same.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIRECT = 1_000_000
ACCURACY = 10_000


def _order_statistic(df: DataFrame, c: Column, k: int, n: int, direct: int) -> float:
    """The k-th smallest (from 0) of n present values."""
    lo, hi = df.agg(F.min(c), F.max(c)).first()
    below, inside = 0, n
    while inside > direct and lo < hi:
        here = F.when((c >= lo) & (c <= hi), c)
        share, slack = (k - below) / inside, 2 / ACCURACY
        a, b = df.agg(F.percentile_approx(here, [max(0.0, share - slack), min(1.0, share + slack)], ACCURACY)).first()[0]
        less, to_b, at_a, at_b = df.agg(F.count_if(c < a), F.count_if(c <= b), F.count_if(c == a), F.count_if(c == b)).first()
        if less <= k < less + at_a:
            return float(a)
        if to_b - at_b <= k < to_b:
            return float(b)
        if k < less:  # the sketch missed: keep the part that holds k
            hi, inside = a, less - below
        elif k >= to_b:
            lo, below, inside = b, to_b - at_b, inside - (to_b - at_b - below)
        else:
            lo, hi, below, inside = a, b, less, to_b - less
    if lo == hi:
        return float(lo)
    here = F.when((c >= lo) & (c <= hi), c)
    return float(df.agg(F.element_at(F.sort_array(F.collect_list(here)), k - below + 1)).first()[0])


def exact_quantiles(df: DataFrame, columns: dict[str, Column], points: Sequence[float], direct: int = DIRECT) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles (at q (n - 1)) of every column; None where it has no present value. Runs Spark jobs."""
    if not columns:
        return {}
    sizes = df.agg(*[F.count(c).alias(name) for name, c in columns.items()]).first()
    out: dict[str, list[float | None]] = {}
    small = {name: c.cast("double") for name, c in columns.items() if 0 < sizes[name] <= direct}
    if small:
        row = df.agg(*[F.percentile(c, F.array(*[F.lit(float(q)) for q in points])).alias(name) for name, c in small.items()]).first()
        out |= {name: [float(v) for v in row[name]] for name in small}
    for name, c in columns.items():
        n = sizes[name]
        if not n:
            out[name] = [None] * len(points)
        elif n > direct:
            value, known = c.cast("double"), {}
            ranks = [q * (n - 1) for q in points]
            for k in {int(x) for r in ranks for x in (math.floor(r), math.ceil(r))}:
                known[k] = _order_statistic(df, value, k, n, direct)
            out[name] = [known[math.floor(r)] + (r - math.floor(r)) * (known[math.ceil(r)] - known[math.floor(r)]) for r in ranks]
    return out
