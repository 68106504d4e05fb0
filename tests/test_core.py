"""Literal-frame tests of the core operators."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from millrace import frame
from millrace.functions import columns as fc
from millrace.functions import datetimes as dt
from millrace.functions import parser
from millrace.functions import strings as st
from millrace.operators import joins, missing, reshape, schema, selection, stats, windows
from millrace.operators.groupby import group_by

NAN = float("nan")


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_group_by(spark):
    df = spark.createDataFrame([("Sales", 25, 50000.0, 1), ("Eng", 30, 62000.0, 2), ("Sales", 35, 75000.0, 3), ("Eng", 28, 58000.0, 4), ("Sales", 42, 91000.0, 5), (None, 1, NAN, 6)], "d string, age int, pay double, id int")
    g = group_by(df, "d", order_by=["id"])
    assert rows(g.agg(("pay", "sum"), ("pay", "mean"), n=("pay", "count")), "d") == [(None, 0.0, None, 0), ("Eng", 120000.0, 60000.0, 2), ("Sales", 216000.0, 72000.0, 3)]
    assert rows(group_by(df, "d", null_groups=False).size(), "d") == [("Eng", 2), ("Sales", 3)]
    assert rows(g.nth(-1).select("d", "id"), "d") == [(None, 6), ("Eng", 4), ("Sales", 5)]
    assert rows(g.agg(f=("pay", "first"), l=("pay", "last")), "d")[1:] == [("Eng", 62000.0, 58000.0), ("Sales", 50000.0, 91000.0)]
    assert [r.g for r in g.ngroup("g").orderBy("id").collect()] == [0, 1, 0, 1, 0, 2]
    assert [r.cumcount for r in g.cumcount().orderBy("id").collect()] == [0, 0, 1, 1, 2, 0]
    assert rows(g.filter(F.count(F.lit(1)) > 2).select("id"), "id") == [(1,), (3,), (5,)]
    out = g.transform_values("pay", lambda v: v - v.min())
    assert [r.pay_out for r in out.where("d = 'Sales'").orderBy("id").collect()] == [0.0, 25000.0, 41000.0]
    one = group_by(df.where("id = 1"), "d").std()
    assert one.first()["pay"] is None
    with pytest.raises(KeyError):
        group_by(df, "nope")


def test_joins(spark):
    e = spark.createDataFrame([(1, "Alice", 10), (2, "Bob", 20), (3, "Charlie", 10), (4, "Diana", 30)], "id int, name string, dept int")
    d = spark.createDataFrame([(10, "Sales"), (20, "Engineering"), (40, "Marketing")], "dept int, name string")
    assert [joins.join(e, d, "dept", how).count() for how in ("inner", "left", "right", "outer", "anti", "semi")] == [3, 4, 4, 5, 1, 3]
    out = joins.join(e, d, "dept", "outer")
    assert out.columns == ["id", "name_x", "dept", "name_y"] and {r.dept for r in out.collect()} == {10, 20, 30, 40}
    a = spark.createDataFrame([(None, 1), (1.0, 2), (NAN, 3)], "k double, v int")
    b = spark.createDataFrame([(None, 10), (1.0, 20), (NAN, 30)], "k double, w int")
    assert rows(joins.join(a, b, "k").select("v", "w"), "v") == [(1, 10), (2, 20)]
    assert rows(joins.join(a, b, "k", null_equals=False).select("v", "w"), "v") == [(2, 20)]
    with pytest.raises(KeyError):
        joins.join(e, d, "nope")
    wide = joins.concat_rows(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2.5, "x")], "a double, b string"))
    assert wide.dtypes == [("a", "double"), ("b", "string")] and rows(wide, "a") == [(1.0, None), (2.5, "x")]
    fact = spark.createDataFrame([(1, 5), (None, 6), (9, 7)], "k int, v int")
    dim = spark.createDataFrame([(1, "old", 1), (1, "new", 2)], "k int, label string, seq int")
    assert rows(joins.join_many(fact, [("k", dim)], {"k": "seq"}).select("v", "label"), "v") == [(5, "new"), (6, None), (7, None)]


@pytest.mark.parametrize(("direction", "want"), [("backward", [None, 101.0, 101.5]), ("forward", [99.5, 101.5, 100.5]), ("nearest", [99.5, 101.0, 100.5])])
def test_asof(spark, direction, want):
    t = spark.createDataFrame([(1, "A", 1.0), (5, "A", 2.0), (10, "A", 3.0)], "time int, sym string, price double")
    q = spark.createDataFrame([(2, 99.5, 1), (4, 101.0, 2), (4, 7.0, 3), (7, 101.5, 4), (11, 100.5, 5)], "time int, bid double, seq int")
    out = joins.asof_join(t, q, "time", direction, right_order="seq")
    assert [r.bid for r in out.orderBy("time").collect()] == want
    by = joins.asof_join(t, q.withColumn("sym", F.lit("A")), "time", direction, ["sym"], right_order="seq")
    assert [r.bid for r in by.orderBy("time").collect()] == want
    assert [r.bid for r in joins.asof_join(t, q.limit(0), "time", direction).collect()] == [None] * 3


def test_asof_by_key(spark):
    a = spark.createDataFrame([("A", 5), ("B", 5), ("A", 10)], "s string, t int")
    b = spark.createDataFrame([("A", 3, 10), ("B", 4, 20), ("A", 8, 30)], "s string, t int, bid int")
    assert rows(joins.asof_join(a, b, "t", by=["s"]).select("s", "t", "bid"), "s", "t") == [("A", 5, 10), ("A", 10, 30), ("B", 5, 20)]
    assert rows(joins.asof_join(a, b, "t", by=["s"], tolerance=1).select("s", "t", "bid"), "s", "t") == [("A", 5, None), ("A", 10, None), ("B", 5, 20)]


def test_windows_in_blocks(spark):
    data = [(i, float((i * 7919) % 101) if i % 11 else None) for i in range(1200)]
    df = spark.createDataFrame(data, "i int, x double").repartition(5)
    v = [x for _, x in data]
    for size, center, least in ((3, False, None), (4, True, 2), (10, False, 1)):
        out = {r.i: r.r for r in windows.rolling(df, "x", size, "sum", ["i"], min_periods=least, center=center, out="r", block=100).collect()}
        for i in range(1200):
            lo = i - size // 2 if center else i - size + 1
            part = [y for y in v[max(lo, 0) : max(lo + size, 0)] if y is not None]
            want = sum(part) if len(part) >= (size if least is None else least) else None
            assert out[i] == want, (size, i)
    total, best = 0.0, -math.inf
    out = {r.i: r for r in windows.cum(windows.cum(df, "x", "sum", ["i"], out="s"), "x", "max", ["i"], out="m").collect()}
    shifted = {r.i: r.s2 for r in windows.shift(df, "x", 2, ["i"], out="s2").collect()}
    for i, x in enumerate(v):
        if x is not None:
            total, best = total + x, max(best, x)
        assert (out[i].s, out[i].m) == ((total, best) if x is not None else (None, None))
        assert shifted[i] == (v[i - 2] if i > 1 else None)
    filled = {r.i: r.f for r in missing.fill_direction(df, "x", True, ["i"], out="f").collect()}
    back = {r.i: r.f for r in missing.fill_direction(df, "x", False, ["i"], out="f").collect()}
    assert filled[0] is None and filled[11] == v[10] and back[0] == v[1] and all(filled[i] == v[i] for i in range(1200) if v[i] is not None)
    std = {r.i: r.e for r in windows.expanding(df, "x", "std", ["i"], out="e").collect()}
    part = [x for x in v[:500] if x is not None]
    mean = sum(part) / len(part)
    assert std[499] == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in part) / (len(part) - 1)))


def test_ewm_rank_and_prod(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", None), (3, "a", 3.0), (4, "b", -2.0), (5, "b", 0.0), (6, "b", 5.0)], "i int, k string, x double")
    assert [r.x_ewm for r in windows.ewm_mean(df, "x", ["i"], ["k"], alpha=0.5).where("k = 'a'").orderBy("i").collect()] == [1.0, None, 2.0]
    prod = [r.p for r in windows.cum(df, "x", "prod", ["i"], ["k"], "p").orderBy("i").collect()]
    assert prod[0] == 1.0 and prod[1] is None and prod[2] == pytest.approx(3.0) and prod[3] == pytest.approx(-2.0) and prod[4] == 0.0 and prod[5] == 0.0
    r = spark.createDataFrame([(1, 5.0), (2, 3.0), (3, 5.0), (4, None), (5, NAN), (6, 1.0)], "i int, x double")
    for method, want in (("average", [3.5, 2, 3.5]), ("min", [3, 2, 3]), ("max", [4, 2, 4]), ("dense", [3, 2, 3]), ("first", [3, 2, 4])):
        got = [x.x_rank for x in windows.rank(r, "x", method, tie_break=["i"]).orderBy("i").collect()]
        assert got == [*want, None, None, 1], method


def test_sort_and_selection(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, NAN), (4, 1.0), (5, 2.0)], "i int, x double")
    assert [r.i for r in selection.sort(df, ["x"], True, ["i"]).collect()][:3] == [4, 1, 5]
    assert [r.i for r in selection.sort(df, ["x"], False, ["i"]).collect()][:3] == [1, 5, 4]
    f = frame(df, "i")
    assert [r.i for r in f.head(2).collect()] == [1, 2] and [r.i for r in f.tail(2).collect()] == [4, 5] and [r.i for r in f.slice(1, 2).collect()] == [2, 3]
    assert f.at(3, "x") == 1.0 and [r.i for r in f.iloc([0, 4]).collect()] == [1, 5]
    assert [r.i for r in f.drop_duplicates("x").df.orderBy("i").collect()] == [1, 2, 3, 4]
    assert f.sample(3, seed=1).df.count() == 3
    assert [r.i for r in f.nlargest(2, "x").collect()] == [1, 5]
    with pytest.raises(ValueError):
        f.head(-1)
    with pytest.raises(ValueError):
        f.with_column("x", F.lit(1))
    a = spark.createDataFrame([(1, None, 5), (2, 3, None)], "k int, v int, w int")
    b = spark.createDataFrame([(1, 9, 9), (3, 1, 1)], "k int, v int, w int")
    assert rows(selection.combine_first(a, b, ["k"]), "k") == [(1, 9, 5), (2, 3, None), (3, 1, 1)]
    assert rows(selection.compare(a, b, ["k"]).where("k = 1"), "column") == [(1, "v", None, "9"), (1, "w", "5", "9")]
    assert rows(selection.transpose(a, ["k"])) == [("k", "1", "2"), ("v", None, "3"), ("w", "5", None)]
    assert selection.content_equals(a, a.orderBy(F.desc("k"))) and not selection.content_equals(a, b)


def test_parser(spark):
    df = spark.createDataFrame([(i, 10.0 * i, q, f"n{i}") for i, q in enumerate([5.0, 3.0, 2.0, 0.0, 4.0], 1)], "id int, price double, quantity double, name string")
    run = lambda text: frame(df).eval(text).df
    assert [r.id for r in run("price * quantity > 60 and not (id == 5)").collect()] == []
    assert [r.id for r in run("price > 15 and quantity < 3 or name = 'n1'").orderBy("id").collect()] == [1, 3, 4]
    assert [r.total for r in run("total = price / quantity").orderBy("id").collect()][3] is None
    assert run("-price + 2 * (quantity - 1)").columns[-1] == "result"
    assert [r.id for r in frame(df).query("price >= 20 and price <= 30 or id == 5").df.orderBy("id").collect()] == [2, 3, 5]
    for bad in ("price >", "nope > 1", "price @ 2", "(price"):
        with pytest.raises(parser.ParseError):
            run(bad)


def test_reshape(spark):
    s = spark.createDataFrame([("East", "A", 100.0, 1), ("East", "B", 200.0, 2), ("West", "A", 150.0, 3), ("West", "B", 250.0, 4), ("East", "A", 50.0, 5), (None, "A", 9.0, 6)], "r string, p string, v double, i int")
    assert rows(reshape.pivot_table(s, "r", "p", "v"), "r") == [("East", 150.0, 200.0), ("West", 150.0, 250.0)]
    assert rows(reshape.pivot(s, "r", "p", "v", ["i"]), "r")[1:] == [("East", 50.0, 200.0), ("West", 150.0, 250.0)]
    assert reshape.melt(s.select("i", "v"), ["i"]).count() == 6
    d = reshape.get_dummies(s.select("i", "p"), "p")
    assert d.columns == ["i", "p_A", "p_B"] and d.orderBy("i").first()[1:] == (True, False)
    t = spark.createDataFrame([("Alice", "a, b,c"), ("Bob", "x"), ("Nul", None), ("E", "")], "n string, t string")
    assert rows(reshape.explode(t, "t"), "n", "t") == [("Alice", "a"), ("Alice", "b"), ("Alice", "c"), ("Bob", "x"), ("E", ""), ("Nul", None)]
    assert rows(reshape.crosstab(s.dropna(), "r", "p"), "r") == [("East", 2, 1), ("West", 1, 1)]
    with pytest.raises(ValueError):
        reshape.column_values(s, "i", max_columns=3)


def test_missing(spark):
    df = spark.createDataFrame([(1, 1.0, "x"), (2, NAN, "y"), (3, None, None), (4, 7.0, "z")], "i int, a double, b string")
    assert [r.i for r in missing.drop_na(df).orderBy("i").collect()] == [1, 4]
    assert [r.i for r in missing.drop_na(df, 2).orderBy("i").collect()] == [1, 2, 4]
    assert missing.drop_na_columns(df).columns == ["i"]
    assert [r.a for r in missing.fill_value(df, {"a": 0}).orderBy("i").collect()] == [1.0, 0.0, 0.0, 7.0]
    assert [r.a for r in missing.interpolate_linear(df, "a", ["i"]).orderBy("i").collect()] == [1.0, 3.0, 5.0, 7.0]
    sq = spark.createDataFrame([("s", i, float(i * i) if i not in (2, 5) else None) for i in range(8)], "k string, i int, a double")
    poly = [r.a for r in missing.interpolate_series(sq, "a", "polynomial", ["i"], ["k"]).orderBy("i").collect()]
    assert poly == pytest.approx([i * i for i in range(8)])
    spline = [r.a for r in missing.interpolate_series(sq, "a", "spline", ["i"], ["k"]).orderBy("i").collect()]
    assert spline[5] == pytest.approx(25, abs=0.3)


def test_statistics(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (2.0, 4.0, "b"), (3.0, 6.0, "a"), (10.0, NAN, None)], "x double, y double, s string")
    d = {r.statistic: r.x for r in stats.describe(df).collect()}
    assert d["count"] == 4 and d["25%"] == 1.75 and d["50%"] == 2.5
    m = {r["column"]: r for r in stats.corr(df).collect()}
    assert m["x"]["y"] == pytest.approx(1.0) and m["y"]["y"] == 1.0
    assert stats.corr_kendall(df, "x", "y") == pytest.approx(1.0)
    assert rows(stats.value_counts(df, "s")) == [("a", 2), ("b", 1)]
    p = stats.profile(df, exact=True)
    assert p["rows"] == 4 and p["columns"]["y"]["missing"] == 1 and p["columns"]["s"]["top"] == [("a", 2), ("b", 1)] and p["columns"]["x"]["skew"] == pytest.approx(1.76363, abs=1e-4) and p["columns"]["x"]["kurtosis"] == pytest.approx(3.228, abs=1e-3)
    rules = schema.FrameSchema().column("x", "double", minimum=2.0, unique=True).column("s", no_nulls=True, allowed=["a"]).column("z").no_extra_columns().min_rows(9)
    errors = rules.errors(df)
    assert len(errors) == 6 and any("under 2.0 (1)" in e for e in errors)
    with pytest.raises(schema.SchemaError):
        rules.validate(df)
    assert schema.FrameSchema().column("x", maximum=10.0).no_duplicate_rows().is_valid(df)


def test_functions(spark):
    df = spark.createDataFrame([("  Hello world-x ", 2.5, 7), ("ß", -2.5, 0), (None, None, None)], "s string, x double, n int")
    one = lambda c: df.select(c.alias("v")).first()["v"]
    assert one(st.trim("s")) == "Hello world-x" and one(st.title("s")) == "  Hello World-X " and one(st.center(F.lit("ab"), 5)) == " ab  "
    assert one(st.find("s", "zz")) == -1 and one(st.count_text("s", "l")) == 3 and one(st.slice_text(F.lit("abcdef"), -2)) == "ef" and one(st.pad_left(F.lit("abcdef"), 3)) == "abcdef"
    assert one(st.replace_ignore_case("s", "HELLO", "$1")) == "  $1 world-x " and one(st.extract("s", "(q)")) is None and one(st.normalize_unicode(F.lit("é"))) == "é"
    assert one(fc.rounded("x")) == 2.0 and one(fc.safe_divide("x", F.lit(0.0), ieee=True)) == math.inf and one(fc.safe_divide("x", F.lit(0))) is None
    assert [r.n for r in df.select(fc.cast(df, "x", "int").alias("n")).collect()] == [2, -2, None]
    assert [r.v for r in df.select(fc.gt("x", 0).alias("v")).collect()] == [True, False, False]
    assert [r.v for r in df.select(fc.replace_values("n", {7: 70, None: -1}).alias("v")).collect()] == [70, 0, -1]
    assert [r.x_bin for r in fc.cut_by_edges(df, "x", [-3, 0, 3], ["lo", "hi"]).collect()] == ["hi", "lo", None]
    t = spark.createDataFrame([(datetime.datetime(2024, 1, 10, 13, 7, 9, 123456),)], "t timestamp_ntz")
    get = lambda c: t.select(c.alias("v")).first()["v"]
    assert get(dt.floor("t", "1w")) == datetime.datetime(2024, 1, 8) and get(dt.ceil("t", "1h")) == datetime.datetime(2024, 1, 10, 14) and get(dt.round_half_up("t", "15m")) == datetime.datetime(2024, 1, 10, 13, 0)
    assert get(dt.millisecond("t")) == 123 and get(dt.microsecond("t")) == 456 and get(dt.day_of_week("t")) == 3 and get(dt.add_months("t", 1)) == datetime.datetime(2024, 2, 10, 13, 7, 9, 123456)
    assert dt.date_range(spark, "2024-01-01", "2024-01-03").count() == 3 and dt.date_range(spark, "2024-01-01", step="6h", periods=5).count() == 5
    with pytest.raises(ValueError):
        dt.width_micros("5x")


def test_plans_push_down(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 7 AS k", "id * 2 AS wide").write.parquet(str(tmp_path / "t"))
    plan = frame(spark.read.parquet(str(tmp_path / "t"))).eval("id > 990").select("id").df._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(id)" in plan and "ReadSchema: struct<id:bigint>" in plan
