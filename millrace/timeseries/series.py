"""Series-wise kernels over groups: one series per group, each in one task, all series in parallel."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from ..semantics import col
from . import numeric


def _schema(df: DataFrame, keys: Sequence[str], rest: str) -> str:
    return ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), rest])


def _per_series(df: DataFrame, keys: Sequence[str], name: str, order_by: Sequence[str], rest: str, f) -> DataFrame:
    keys, order = list(keys), list(order_by)
    schema = _schema(df, keys, rest)

    def run(key, table):
        import pyarrow as pa

        y = np.asarray(table.sort_by([(o, "ascending") for o in order]).column(name).cast(pa.float64()).to_numpy(), float)
        rows = f(y[~np.isnan(y)])
        kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(rest.split(", "))
        made = {k: pa.array([key[i].as_py()] * len(rows), table.schema.field(k).type) for i, k in enumerate(keys)}
        made |= {c.split()[0]: pa.array(v, kinds[c.split()[1]]) for c, v in zip(rest.split(", "), cols, strict=True)}
        return pa.table(made)

    return df.groupBy(*map(col, keys)).applyInArrow(run, schema)


def seasonal_decompose(df: DataFrame, name: str, period: int, keys: Sequence[str], order_by: Sequence[str], multiplicative: bool = False) -> DataFrame:
    def f(y):
        if len(y) < 2 * period:
            return []
        t, s, r = numeric.decompose(y, period, multiplicative)
        none = lambda v: None if v != v else float(v)
        return [(i, float(y[i]), none(t[i]), float(s[i]), none(r[i])) for i in range(len(y))]

    return _per_series(df, keys, name, order_by, "position long, observed double, trend double, seasonal double, residual double", f)


def forecast(df: DataFrame, name: str, steps: int, keys: Sequence[str], order_by: Sequence[str], model: str = "arima", **params) -> DataFrame:
    """(keys, step, forecast); a series a model cannot be fitted to gives no rows."""

    def f(y):
        try:
            return [(i + 1, float(v)) for i, v in enumerate(numeric.make_model(model, **params).fit(y).forecast(steps))]
        except (ValueError, IndexError, np.linalg.LinAlgError):
            return []

    return _per_series(df, keys, name, order_by, "step int, forecast double", f)


def backtest(df: DataFrame, name: str, horizon: int, folds: int, keys: Sequence[str], order_by: Sequence[str], model: str = "arima", sliding: bool = False, **params) -> DataFrame:
    def f(y):
        if len(y) - folds * horizon < 2:
            return []
        return [(r["fold"], r["mae"], r["rmse"], r["mape"]) for r in numeric.backtest(y, model, horizon, folds, sliding, **params)]

    return _per_series(df, keys, name, order_by, "fold int, mae double, rmse double, mape double", f)


def diagnostics(df: DataFrame, name: str, lags: int, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """ADF, KPSS and Ljung-Box of each series (none if it is too short)."""

    def f(y):
        if len(y) < 3 * (lags + 2) or np.ptp(y) == 0:
            return []
        a, k = numeric.adf(y), numeric.kpss(y)
        q, p = numeric.ljung_box(y, lags)
        return [(a["statistic"], a["stationary"], k["statistic"], k["stationary"], q, p)]

    return _per_series(df, keys, name, order_by, "adf double, adf_stationary boolean, kpss double, kpss_stationary boolean, ljung_box double, ljung_box_p double", f)


def partial_autocorrelation(df: DataFrame, name: str, lags: int, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    return _per_series(df, keys, name, order_by, "lag int, pacf double", lambda y: [(i, float(v)) for i, v in enumerate(numeric.pacf(y, lags))] if len(y) > lags + 1 else [])


def spectrum(df: DataFrame, name: str, keys: Sequence[str], order_by: Sequence[str], top: int = 3) -> DataFrame:
    return _per_series(df, keys, name, order_by, "rank int, frequency double, power double", lambda y: [(i + 1, *fp) for i, fp in enumerate(numeric.dominant_frequencies(y, top))] if len(y) > 3 else [])


def changepoints(df: DataFrame, name: str, keys: Sequence[str], order_by: Sequence[str], penalty: float | None = None) -> DataFrame:
    return _per_series(df, keys, name, order_by, "position long", lambda y: [(p,) for p in numeric.pelt(y, penalty)] if len(y) > 3 else [])
