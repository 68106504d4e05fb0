"""Fitted column transformers: one aggregate to fit, column expressions to transform, JSON to store."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.quantiles import exact_quantiles
from ..operators.reshape import column_values
from ..semantics import col, present

_KINDS: dict[str, type] = {}


class Transformer:
    """``fit`` learns ``params`` (plain values), ``transform`` only adds expressions."""

    def __init_subclass__(cls):
        _KINDS[cls.__name__] = cls

    def __init__(self, *columns: str, **options):
        self.columns, self.options, self.params = list(columns), options, {}

    def fit(self, df: DataFrame):
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def to_json(self) -> str:
        return json.dumps({"kind": type(self).__name__, "columns": self.columns, "options": self.options, "params": self.params})


def from_json(text: str) -> Transformer:
    d = json.loads(text)
    out = _KINDS[d["kind"]](*d["columns"], **d["options"])
    out.params = d["params"]
    return out


def _value(df: DataFrame, c: str):
    return present(df, c).cast("double")


class StandardScaler(Transformer):
    """(x - mean) / sample std; a zero std counts as 1."""

    def fit(self, df):
        row = df.agg(*[F.struct(F.avg(_value(df, c)), F.stddev_samp(_value(df, c))).alias(c) for c in self.columns]).first()
        self.params = {c: [row[c][0], row[c][1] or 1.0] for c in self.columns}
        return self

    def transform(self, df):
        return df.withColumns({c: (_value(df, c) - m) / s if m is not None else F.lit(None).cast("double") for c, (m, s) in self.params.items()})


class MinMaxScaler(Transformer):
    def fit(self, df):
        row = df.agg(*[F.struct(F.min(_value(df, c)), F.max(_value(df, c))).alias(c) for c in self.columns]).first()
        self.params = {c: [row[c][0], ((row[c][1] or 0) - (row[c][0] or 0)) or 1.0] for c in self.columns}
        return self

    def transform(self, df):
        return df.withColumns({c: (_value(df, c) - lo) / r if lo is not None else F.lit(None).cast("double") for c, (lo, r) in self.params.items()})


class RobustScaler(Transformer):
    """(x - median) / IQR, from exact quartiles (or sketches with approximate=True)."""

    def fit(self, df):
        points = [0.25, 0.5, 0.75]
        if self.options.get("approximate"):
            row = df.agg(*[F.percentile_approx(_value(df, c), points, 10_000).alias(c) for c in self.columns]).first()
        else:
            row = exact_quantiles(df, {c: _value(df, c) for c in self.columns}, points)
        self.params = {c: [row[c][1], (row[c][2] - row[c][0]) or 1.0] if row[c] and row[c][0] is not None else [None, 1.0] for c in self.columns}
        return self

    def transform(self, df):
        return df.withColumns({c: (_value(df, c) - m) / r if m is not None else F.lit(None).cast("double") for c, (m, r) in self.params.items()})


def _at_most(x):
    return lambda e: e <= x


def _equals(t):
    return lambda w: w == t


def _power(x, lam: float, method: str):
    if method == "box-cox":
        return F.ln(x) if abs(lam) < 1e-9 else (F.pow(x, F.lit(lam)) - 1) / lam
    up = F.log1p(x) if abs(lam) < 1e-9 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


class PowerTransformer(Transformer):
    """Box-Cox or Yeo-Johnson; lambda in [-5, 5] by golden section, each round one aggregate for all columns."""

    def fit(self, df):
        method = self.options.get("method", "yeo-johnson")
        ratio = (math.sqrt(5) - 1) / 2
        spans = {c: [-5.0, 5.0] for c in self.columns}

        def scores(points: dict[str, float]) -> dict[str, float]:
            aggs = []
            for c, lam in points.items():
                x = _value(df, c)
                x = F.when(x > 0, x) if method == "box-cox" else x
                y = _power(x, lam, method)
                jac = F.sum(F.ln(x)) if method == "box-cox" else F.sum(F.signum(x) * F.log1p(F.abs(x)))
                aggs.append((-F.count(y) / 2 * F.ln(F.var_pop(y)) + (lam - 1) * jac).alias(c))
            row = df.agg(*aggs).first()
            return {c: row[c] if row[c] is not None else -math.inf for c in points}

        for _ in range(self.options.get("rounds", 18)):
            left = {c: b - ratio * (b - a) for c, (a, b) in spans.items()}
            right = {c: a + ratio * (b - a) for c, (a, b) in spans.items()}
            sl, sr = scores(left), scores(right)
            for c in self.columns:
                spans[c] = [spans[c][0], right[c]] if sl[c] >= sr[c] else [left[c], spans[c][1]]
        self.params = {c: (a + b) / 2 for c, (a, b) in spans.items()}
        return self

    def transform(self, df):
        method = self.options.get("method", "yeo-johnson")
        return df.withColumns({c: _power(_value(df, c), lam, method) for c, lam in self.params.items()})


class QuantileTransformer(Transformer):
    """Rank by interpolated quantiles, uniform or normal."""

    def fit(self, df):
        n = self.options.get("quantiles", 100)
        points = [i / n for i in range(n + 1)]
        row = df.agg(*[F.percentile_approx(_value(df, c), points, 100_000).alias(c) for c in self.columns]).first()
        self.params = {c: [float(v) for v in row[c] or []] for c in self.columns}
        return self

    def transform(self, df):
        out = {}
        for c, edges in self.params.items():
            if not edges:
                out[c] = F.lit(None).cast("double")
                continue
            x, n = _value(df, c), len(edges) - 1
            lit = F.array(*map(F.lit, edges))
            k = F.least(F.greatest(F.size(F.filter(lit, _at_most(x))), F.lit(1)), F.lit(n))
            lo, hi = F.element_at(lit, k), F.element_at(lit, k + 1)
            u = (k - 1 + F.coalesce(F.try_divide(x - lo, hi - lo), F.lit(0.0))) / n
            u = F.when(x.isNotNull(), F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0)))
            out[c] = _probit(F.least(F.greatest(u, F.lit(1e-7)), F.lit(1 - 1e-7))) if self.options.get("output") == "normal" else u
        return df.withColumns(out)


#: Fixed: coefficients of Acklam's rational approximation of the normal quantile.
_PA = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_PB = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_PC = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_PD = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _poly(x, coefficients):
    out = F.lit(0.0)
    for a in coefficients:
        out = out * x + a
    return out


def _probit(p):
    q = p - 0.5
    r = q * q
    mid = _poly(r, _PA) * q / (_poly(r, _PB) * r + 1)
    tail = lambda t: _poly(t, _PC) / (_poly(t, _PD) * t + 1)
    low, high = F.sqrt(-2 * F.ln(p)), F.sqrt(-2 * F.ln(1 - p))
    return F.when(p < 0.02425, tail(low)).when(p > 1 - 0.02425, -tail(high)).otherwise(mid)


class OneHotEncoder(Transformer):
    """c_value columns of 0 and 1; unknown: 'ignore', 'error' or 'indicator' (c_unknown)."""

    def fit(self, df):
        self.params = {c: column_values(df.where(col(c).isNotNull()), c) for c in self.columns}
        return self

    def transform(self, df):
        how, made = self.options.get("unknown", "ignore"), {}
        for c, values in self.params.items():
            known = col(c).isin(values)
            for v in values:
                one = F.when(col(c) == F.lit(v), 1).otherwise(0)
                if how == "error":
                    one = F.when(F.coalesce(~known, F.lit(False)), F.raise_error(F.lit(f"unknown value in {c}")).cast("int")).otherwise(one)
                made[f"{c}_{v}"] = one
            if how == "indicator":
                made[f"{c}_unknown"] = F.when(F.coalesce(known, F.lit(False)), 0).otherwise(1)
        return df.withColumns(made).drop(*self.columns)


class LabelEncoder(Transformer):
    """Codes by first appearance in ``order_by`` (else by value); unknown is null. Codes are looked up by a join above 1,000 values."""

    def fit(self, df):
        self.params = {c: column_values(df.where(col(c).isNotNull()), c, max_columns=1_000_000, order_by=self.options.get("order_by", ())) for c in self.columns}
        return self

    def transform(self, df):
        for c, values in self.params.items():
            if len(values) <= 1000:
                table = F.create_map(*[x for i, v in enumerate(values) for x in (F.lit(v), F.lit(i))]) if values else None
                df = df.withColumn(c, F.try_element_at(table, col(c)) if values else F.lit(None).cast("int"))
            else:
                codes = df.sparkSession.createDataFrame(list(enumerate(values)), ["__code", "__v"])
                df = df.join(F.broadcast(codes), col(c) == col("__v"), "left").withColumn(c, col("__code").cast("int")).drop("__code", "__v")  # at most a million rows
        return df

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.get(F.array(*map(F.lit, values)), col(c)) for c, values in self.params.items()})


class OrdinalEncoder(Transformer):
    """Codes by the given order: OrdinalEncoder('c', orders={'c': [...]})."""

    def transform(self, df):
        made = {}
        for c, values in self.options["orders"].items():
            made[c] = F.try_element_at(F.create_map(*[x for i, v in enumerate(values) for x in (F.lit(v), F.lit(i))]), col(c))
        return df.withColumns(made)


class TargetEncoder(Transformer):
    """(n mean + s global) / (n + s); an unknown category gets the global mean. Kept as a frame of one row per category."""

    def fit(self, df):
        target, s = self.options["target"], float(self.options.get("smoothing", 10.0))
        y = present(df, target).cast("double")
        total = df.agg(F.avg(y)).first()[0]
        self.params = {"global": total}
        self.tables = {}
        for c in self.columns:
            stats = df.groupBy(col(c).alias("__k")).agg(F.count(y).alias("n"), F.avg(y).alias("m"))
            self.tables[c] = stats.select("__k", ((F.col("n") * F.coalesce("m", F.lit(0.0)) + F.lit(s) * total) / (F.col("n") + s)).alias("__e"))
        return self

    def transform(self, df):
        names = df.columns
        for c in self.columns:
            t = self.tables[c]
            df = df.join(t, df[c].eqNullSafe(t["__k"]), "left").withColumn(c, F.coalesce("__e", F.lit(self.params["global"]))).drop("__k", "__e")
        return df.select(*map(col, names))


class Discretizer(Transformer):
    """Integer bins, closed on the left, clamped; strategy 'uniform' or 'quantile'."""

    def fit(self, df):
        n = self.options.get("bins", 5)
        if self.options.get("strategy", "uniform") == "quantile":
            row = exact_quantiles(df, {c: _value(df, c) for c in self.columns}, [i / n for i in range(1, n)])
            self.params = {c: sorted({v for v in row[c] if v is not None}) for c in self.columns}
        else:
            row = df.agg(*[F.struct(F.min(_value(df, c)), F.max(_value(df, c))).alias(c) for c in self.columns]).first()
            self.params = {c: [row[c][0] + (row[c][1] - row[c][0]) * i / n for i in range(1, n)] if row[c][0] is not None else [] for c in self.columns}
        return self

    def transform(self, df):
        made = {}
        for c, edges in self.params.items():
            x = _value(df, c)
            made[c] = F.when(x.isNotNull(), sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(0)))
        return df.withColumns(made)


class Imputer(Transformer):
    """strategy mean, median, mode or constant (value=...); nulls only, columns without any stay as they are."""

    def fit(self, df):
        how = self.options.get("strategy", "mean")
        if how == "constant":
            self.params = {c: self.options["value"] for c in self.columns}
            return self
        if how == "median":
            holes = df.agg(*[F.count_if(col(c).isNull()).alias(c) for c in self.columns]).first()
            middle = exact_quantiles(df, {c: present(df, c) for c in self.columns if holes[c]}, [0.5])
            self.params = {c: v[0] for c, v in middle.items()}
            return self
        f = {"mean": lambda c: F.avg(present(df, c)), "mode": lambda c: F.mode(present(df, c), True)}[how]
        row = df.agg(*[F.struct(f(c).alias("v"), F.count_if(col(c).isNull()).alias("n")).alias(c) for c in self.columns]).first()
        self.params = {c: row[c]["v"] for c in self.columns if row[c]["n"]}
        return self

    def transform(self, df):
        return df.withColumns({c: F.coalesce(col(c), F.lit(v)) for c, v in self.params.items()})


class PolynomialFeatures(Transformer):
    """c^d powers and, from degree 2, products a*b."""

    def transform(self, df):
        degree, made = self.options.get("degree", 2), {}
        for c in self.columns:
            for d in range(2, degree + 1):
                made[f"{c}^{d}"] = F.pow(_value(df, c), F.lit(d))
        if degree > 1:
            for i, a in enumerate(self.columns):
                for b in self.columns[i + 1 :]:
                    made[f"{a}*{b}"] = _value(df, a) * _value(df, b)
        return df.withColumns(made)


class TextVectorizer(Transformer):
    """Count or tf-idf columns for the ``max_features`` commonest terms of one column."""

    def fit(self, df):
        from ..text import tokens

        c = self.columns[0]
        terms = df.select(F.explode(F.array_distinct(tokens(c))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
        totals = df.select(F.explode(tokens(c)).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
        best = totals.join(terms, "t").orderBy(F.desc("n"), "t").limit(self.options.get("max_features", 1000)).collect()  # the feature list
        n = df.count()
        self.params = {"terms": [r["t"] for r in best], "idf": [math.log((n + 1) / (r["df"] + 1)) + 1 for r in best]}
        return self

    def transform(self, df):
        from ..text import tokens

        c = self.columns[0]
        words = F.coalesce(tokens(c), F.array().cast("array<string>"))
        wide = df.withColumn("__w", words)
        made = {}
        for t, idf in zip(self.params["terms"], self.params["idf"], strict=True):
            n = F.size(F.filter("__w", _equals(t)))
            made[f"{c}_{t}"] = n if self.options.get("mode", "count") == "count" else F.coalesce(F.try_divide(n.cast("double"), F.size("__w").cast("double")), F.lit(0.0)) * idf
        return wide.withColumns(made).drop("__w")


class FeaturePipeline:
    """Transformers in order."""

    def __init__(self, *steps: Transformer):
        self.steps = list(steps)

    def fit(self, df: DataFrame) -> FeaturePipeline:
        for s in self.steps:
            df = s.fit(df).transform(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            df = s.transform(df)
        return df

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def to_json(self) -> str:
        return json.dumps([json.loads(s.to_json()) for s in self.steps])

    @classmethod
    def from_json(cls, text: str) -> FeaturePipeline:
        return cls(*[from_json(json.dumps(d)) for d in json.loads(text)])
