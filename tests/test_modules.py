"""Sources, streaming, time series, text, geography and machine learning."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import geo, text
from millrace.ml import evaluation as ev
from millrace.ml import models
from millrace.ml import transformers as tr
from millrace.sources import files, jdbc, memory
from millrace.streaming.windows import event_windows, file_stream, json_events
from millrace.timeseries import features, numeric, series


def test_csv_and_auto(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,amount,big,flag,when,name\n1,"1,200",5000000000,true,2024-01-02 03:04:05,x\n2,NA,6,false,,"a ""q"""\n')
    df = files.load(spark, str(tmp_path / "a.csv"))
    assert [t for _, t in df.dtypes] == ["int", "int", "bigint", "boolean", "timestamp_ntz", "string"]
    r = df.orderBy("id").collect()
    assert r[0].amount == 1200 and r[1].amount is None and r[1].name == 'a "q"'
    for name in ("b.parquet", "b.orc", "b.jsonl", "c.csv"):
        files.save(df.select("id", "name"), str(tmp_path / name))
        assert files.load(spark, str(tmp_path / name)).count() == 2
    files.save(df.drop("when"), str(tmp_path / "d.xlsx"))
    x = files.load(spark, str(tmp_path / "d.xlsx"))
    assert x.orderBy("id").first()["name"] == "x" and dict(x.dtypes)["id"] == "int" and files.list_sheets(str(tmp_path / "d.xlsx")) == ["Sheet1"]
    files.save(df, str(tmp_path / "e.arrow"))
    assert files.load(spark, str(tmp_path / "e.arrow")).count() == 2
    (tmp_path / "f.json").write_text('{"a": [1, 2], "b": ["x", null]}')
    assert files.read_json(spark, str(tmp_path / "f.json"), orient="columns").count() == 2
    with pytest.raises(files.ConnectorMissing):
        files.read_avro(spark, str(tmp_path / "g.avro"))
    with pytest.raises(ValueError):
        files.load(spark, "x.unknown")
    assert files.cloud_uri("azure", "c", "k", "acc") == "abfss://c@acc.dfs.core.windows.net/k"


def test_partitioned_parquet(spark, tmp_path):
    files.write_parquet(spark.range(20).selectExpr("id", "id % 3 AS k"), str(tmp_path / "p"), ["k"])
    back = files.read_parquet(spark, str(tmp_path / "p"), ["id", "k"])
    assert back.where("k = 1").count() == 7


def test_html(spark):
    html = "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>x &amp; y</td></tr></table><table><tr><td>q</td></tr><tr><td>2.5</td></tr></table>"
    one, two = files.read_html(spark, html)
    assert one.first().asDict() == {"a": 1, "b": "x & y"} and two.first()["q"] == 2.5
    df = spark.createDataFrame([(1, html), (2, None)], "page int, h string")
    assert files.html_tables(df, "h", ["page"]).count() == 2


def test_memory_and_jdbc(spark):
    df = memory.from_dict(spark, {"a": [1, 2], "b": ["x", "y"]})
    assert memory.to_dict(df.orderBy("a"), "list") == {"a": [1, 2], "b": ["x", "y"]} and "| a | b |" in memory.to_markdown(df)
    assert memory.from_matrix(spark, np.eye(2)).count() == 2 and len(list(memory.iter_batches(df, 1))) == 2
    opts = jdbc.ConnectionBuilder("derby", database="memory:t1;create=true").options()
    jdbc.to_sql(df, opts, "things", mode="append")
    pool = jdbc.Pool(spark).register("d", opts)
    scan = pool.table("d", "things")
    plan = scan.scan(["a"], where=F.col("a") > 1)
    assert plan.count() == 1 and "PushedFilters" in plan._jdf.queryExecution().toString() and scan.count() == 2
    assert jdbc.read_sql(spark, opts, 'SELECT "b" FROM things WHERE "a" = 1').first()[0] == "x"


EVENTS = [(datetime.datetime(2024, 1, 1, 0, m), float(v), k) for m, v, k in ((0, 10, "a"), (1, 20, "a"), (2, 30, "b"), (5, 40, "a"), (7, 50, "b"), (10, 60, "a"))]


def test_streaming(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, "ts timestamp, value double, k string")
    plan = event_windows(df, "ts").tumbling("5 minutes").agg("value", "sum", "total").agg("value", "count", "n")
    want = [(60.0, 3), (90.0, 2), (60.0, 1)]
    assert [(r.total, r.n) for r in plan.frame().orderBy("window_start").collect()] == want
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = file_stream(spark, str(tmp_path / "in"), df.schema, max_files=1)
    live = event_windows(stream, "ts").tumbling("5 minutes").agg("value", "sum", "total").agg("value", "count", "n").watermark("2 minutes")
    got = live.collect_stream(str(tmp_path / "ck"))
    assert [(r.total, r.n) for r in got.orderBy("window_start").collect()] == want
    assert event_windows(df, "ts", ["k"]).session("2 minutes").frame().where("k = 'a'").count() == 3
    assert event_windows(df, "ts").sliding("10 minutes", "5 minutes").frame().count() == 4
    seen = []
    q = live.start(lambda b, i: seen.extend(b.collect()), str(tmp_path / "ck2"), available_now=True)
    q.awaitTermination()
    assert len(seen) <= 3
    raw = spark.createDataFrame([('{"t": "2024-01-01T00:00:00", "v": 1}',), ('{"t": 1704067200000, "v": 2}',), ("bad",)], "value string")
    assert json_events(raw, "t string, v int", "t").count() == 2


def test_late_events(spark, tmp_path):
    late = [*EVENTS, (datetime.datetime(2024, 1, 1, 0, 1), 1000.0, "a")]
    for i, e in enumerate(late):
        spark.createDataFrame([e], "ts timestamp, value double, k string").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    schema = spark.createDataFrame(EVENTS, "ts timestamp, value double, k string").schema
    stream = file_stream(spark, str(tmp_path / "in/*"), schema, max_files=1)
    seen = []
    plan = event_windows(stream, "ts").tumbling("5 minutes").agg("value", "sum", "total").watermark("2 minutes")
    plan.start(lambda b, i: seen.extend(b.collect()), str(tmp_path / "ck"), available_now=True).awaitTermination()
    assert 1060.0 not in [r.total for r in seen]


def test_numeric_series():
    rng = np.random.default_rng(0)
    y = np.arange(120) + 10 * np.sin(2 * np.pi * np.arange(120) / 12)
    trend, seasonal, residual = numeric.decompose(y, 12)
    assert abs(seasonal[:12].sum()) < 1e-9 and np.nanmax(np.abs(residual)) < 0.5 and trend[60] == pytest.approx(60, abs=0.5)
    assert numeric.dominant_frequencies(y - np.arange(120), 1)[0][0] == pytest.approx(1 / 12)
    noise = rng.normal(size=400)
    walk = np.cumsum(noise)
    assert numeric.adf(noise)["stationary"] and not numeric.adf(walk)["stationary"] and numeric.kpss(noise)["stationary"] and not numeric.kpss(walk)["stationary"]
    ar = np.zeros(2000)
    for t in range(1, 2000):
        ar[t] = 0.7 * ar[t - 1] + rng.normal()
    assert numeric.Arima(1, 0, 0).fit(ar).ar[0] == pytest.approx(0.7, abs=0.06)
    assert numeric.pacf(ar, 3)[1] == pytest.approx(0.7, abs=0.06) and abs(numeric.pacf(ar, 3)[2]) < 0.1
    assert numeric.ljung_box(ar, 5)[1] < 1e-6 < 0.001 < numeric.ljung_box(noise, 5)[1]
    assert numeric._chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and numeric._chi2_tail(18.307, 10) == pytest.approx(0.05, abs=1e-4)
    line = numeric.Arima(0, 1, 0).fit(np.arange(50.0)).forecast(3)
    assert line == pytest.approx([50, 51, 52])
    season = numeric.Arima(0, 0, 0, (0, 1, 0, 12)).fit(y).forecast(12)
    assert season == pytest.approx(y[-12:] + 12, abs=1e-6)
    hw = numeric.ExponentialSmoothing("triple", 0.3, 0.1, 0.3, 12).fit(y).forecast(12)
    assert np.abs(hw - (np.arange(120, 132) + 10 * np.sin(2 * np.pi * np.arange(120, 132) / 12))).max() < 3
    assert numeric.MovingAverage(3).fit(np.array([1.0, 2, 3])).forecast(1)[0] == 2
    steps = np.r_[np.zeros(40), np.full(40, 5.0), np.full(40, -3.0)] + rng.normal(size=120) * 0.3
    assert numeric.pelt(steps) == [40, 80]
    assert len(numeric.backtest(y, "smoothing", 6, 3, kind="double")) == 3
    assert numeric.auto_arima(ar[:300], 2, 0, 1).aic <= numeric.Arima(0, 0, 0).fit(ar[:300]).aic


def test_series_frames(spark):
    data = [(k, i, float(i + 10 * math.sin(2 * math.pi * i / 12))) for k in ("a", "b") for i in range(60)]
    df = spark.createDataFrame(data, "k string, i int, v double")
    assert series.seasonal_decompose(df, "v", 12, ["k"], ["i"]).count() == 120
    assert series.forecast(df, "v", 4, ["k"], ["i"], "smoothing", kind="double").count() == 8
    assert series.backtest(df, "v", 5, 2, ["k"], ["i"], "sma", window=3).count() == 4
    assert series.diagnostics(df, "v", 3, ["k"], ["i"]).count() == 2 and series.partial_autocorrelation(df, "v", 2, ["k"], ["i"]).count() == 6
    assert series.spectrum(df, "v", ["k"], ["i"], 2).count() == 4
    a = {(r.k, r.lag): r.acf for r in features.autocorrelation(df, "v", 3, ["i"], ["k"]).collect()}
    want = numeric.acf(np.array([v for k, _, v in data if k == "a"]), 3)
    assert [a["a", i] for i in range(4)] == pytest.approx(list(want))
    assert series.changepoints(df.limit(0), "v", ["k"], ["i"]).count() == 0


def test_text(spark):
    df = spark.createDataFrame([(1, "Hello <b>World</b>! See http://x.y/z or me@x.com. Dr. Smith came. He left 42 times"), (2, None), (3, "")], "id int, t string")
    one = lambda c: df.select(c.alias("v")).orderBy("id").first()["v"]
    assert one(text.clean("t")) == "hello world ! see or dr. smith came. he left 42 times"
    assert one(text.clean("t", numbers=True)).endswith("left times")
    assert one(text.sentences("t"))[-1] == "He left 42 times" and one(text.sentences("t"))[-2].endswith("Dr. Smith came.")
    assert one(text.remove_stop_words(F.lit("The cat IS on a mat"))) == "cat mat"
    assert one(text.ngrams(F.lit("a b c"), 1, 2)) == ["a", "b", "c", "a b", "b c"] and one(text.ngrams(F.lit("a"), 2)) == []
    assert [r.v for r in df.select("id", text.token_count("t").alias("v")).orderBy("id").collect()] == [13, 0, 0]
    for w, s in (("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("hoping", "hope"), ("troubled", "troubl"), ("happy", "happi"), ("generalization", "gener"), ("adjustment", "adjust"), ("controlling", "control")):
        assert text.stem(w) == s, w
    assert [text.lemma(w) for w in ("mice", "studies", "running", "boxes", "was")] == ["mouse", "study", "run", "box", "be"]
    assert text.jaro_winkler_value("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4) and text.jaro_winkler_value("", "") == 1 and text.jaro_winkler_value("a", "") == 0
    out = text.map_words(df, "t", text.stem, "s")
    assert out.where("id = 1").first()["s"].startswith("hello") and out.where("id = 2").first()["s"] is None
    wp = text.WordPiece(["[UNK]", "un", "##aff", "##able", "hello"])
    assert wp.encode("Unaffable hello xyz") == [1, 2, 3, 4, 0]
    bpe = text.Bpe([("l", "o"), ("lo", "w</w>")], ["?", "low</w>", "lo"])
    assert bpe.pieces("low") == ["low</w>"] and bpe.encode("low") == [1]
    padded = text.tokenize(df.where("id = 1"), "t", wp, max_length=20).first()
    assert len(padded.tokens) == 20 == len(padded.tokens_mask)
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "id int, v array<double>")
    got = text.semantic_search(v, "v", [1.0, 0.0], 3, ["id"]).collect()
    assert [r.id for r in got] == [1, 3, 2] and got[1].score == pytest.approx(0.7071, abs=1e-4) and got[2].score == 0


def test_geo(spark, tmp_path):
    c = spark.createDataFrame([("NYC", 40.7128, -74.006), ("LA", 34.0522, -118.2437), ("London", 51.5074, -0.1278), ("JFK", 40.6413, -73.7781), ("E", 0.0, 179.9), ("W", 0.0, -179.9)], "city string, lat double, lon double")
    km = {r.city: r.distance_km for r in geo.with_distance(c, "lat", "lon", 40.7128, -74.006).collect()}
    assert km["LA"] == pytest.approx(3944, abs=10) and km["London"] == pytest.approx(5570, abs=10)
    r = c.select(F.col("city").alias("c2"), F.col("lat").alias("la"), F.col("lon").alias("lo"))
    pairs = {(x.city, x.c2) for x in geo.within_join(c, r, ("lat", "lon"), ("la", "lo"), 50).collect()}
    assert pairs == {(x, x) for x in km} | {("NYC", "JFK"), ("JFK", "NYC"), ("E", "W"), ("W", "E")}
    rng = np.random.default_rng(3)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-90, 90, 300), rng.uniform(-180, 180, 300), strict=True))] + [(900, 89.9, 10.0), (901, 89.9, -170.0), (902, -89.95, 0.0), (903, -89.95, 180.0)]
    p = spark.createDataFrame(pts, "i int, lat double, lon double")
    q = p.toDF("j", "la", "lo")
    for radius in (80, 1500):
        got = {(x.i, x.j) for x in geo.within_join(p, q, ("lat", "lon"), ("la", "lo"), radius).collect()}
        assert got == {(a[0], b[0]) for a in pts for b in pts if geo.distance_km(a[1], a[2], b[1], b[2]) <= radius}
    near = {x.city: x.c2 for x in geo.nearest_join(c, r.where("c2 <> 'NYC'"), ("lat", "lon"), ("la", "lo"), 100, order="c2").collect()}
    assert near["NYC"] == "JFK" and near["LA"] == "LA" and len(near) == 6
    box = geo.Polygon([(40, -75), (41, -75), (41, -73), (40, -73), (40, -75)])
    assert {x.city for x in c.where(box.contains("lat", "lon")).collect()} == {"NYC", "JFK"}
    assert box.area_km2() == pytest.approx(2 * 111.32**2 * math.cos(math.radians(40.5)), rel=1e-6)
    x = c.where("city = 'NYC'").select(*[e.alias(n) for e, n in zip(geo.to_utm("lat", "lon", 18), "en", strict=True)]).first()
    assert x.e == pytest.approx(583960, abs=5) and x.n == pytest.approx(4507351, abs=5)
    m = c.select("lat", "lon", *[e.alias(n) for e, n in zip(geo.to_web_mercator("lat", "lon"), ("mx", "my"), strict=True)])
    back = m.select("lat", *[e.alias(n) for e, n in zip(geo.from_web_mercator("mx", "my"), ("la2", "lo2"), strict=True)]).first()
    assert back.la2 == pytest.approx(back.lat)
    geo.write_geoparquet(c, str(tmp_path / "g"), "lat", "lon")
    assert geo.read_geoparquet(spark, str(tmp_path / "g"), "la", "lo").where("abs(la - lat) > 1e-12").count() == 0
    lat2, lon2 = geo.destination("lat", "lon", F.lit(90.0), F.lit(100.0))
    assert c.select(geo.haversine("lat", "lon", lat2, lon2).alias("d")).first().d == pytest.approx(100, abs=1e-6)


def test_transformers(spark):
    df = spark.createDataFrame([(float(i), c, i % 2) for i, c in zip((10, 20, 30, 40, 50), "aabbc", strict=True)], "x double, c string, y int")
    assert [r.x for r in tr.StandardScaler("x").fit_transform(df).orderBy("x").collect()][2] == 0
    assert [r.x for r in tr.MinMaxScaler("x").fit_transform(df).orderBy("x").collect()] == [0, 0.25, 0.5, 0.75, 1]
    assert [r.x for r in tr.RobustScaler("x").fit_transform(df).orderBy("x").collect()] == [-1, -0.5, 0, 0.5, 1]
    pipe = tr.FeaturePipeline(tr.MinMaxScaler("x"), tr.OneHotEncoder("c", unknown="indicator")).fit(df)
    again = tr.FeaturePipeline.from_json(pipe.to_json()).transform(df)
    assert again.columns == ["x", "y", "c_a", "c_b", "c_c", "c_unknown"] and again.collect() == pipe.transform(df).collect()
    le = tr.LabelEncoder("c").fit(df)
    assert [r.c for r in le.inverse(le.transform(df)).orderBy("x").collect()] == list("aabbc")
    assert [r.x for r in tr.Discretizer("x", bins=2).fit_transform(df).orderBy("x").collect()] == [0, 0, 1, 1, 1]
    q = [r.x for r in tr.QuantileTransformer("x", quantiles=4).fit_transform(df).orderBy("x").collect()]
    assert q == pytest.approx([0, 0.25, 0.5, 0.75, 1])
    normal = [r.x for r in tr.QuantileTransformer("x", quantiles=4, output="normal").fit_transform(df).orderBy("x").collect()]
    assert normal[1:4] == pytest.approx([-0.6745, 0, 0.6745], abs=1e-3)
    skew = spark.createDataFrame([(math.exp(v),) for v in np.random.default_rng(0).normal(size=400).tolist()], "x double")
    assert abs(tr.PowerTransformer("x", method="box-cox").fit(skew).params["x"]) < 0.15
    holes = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    assert sorted(r.x for r in tr.Imputer("x", strategy="median").fit_transform(holes).collect()) == [1, 2, 3]
    t = spark.createDataFrame([("hello world hello",), ("world foo bar",)], "t string")
    v = tr.TextVectorizer("t", max_features=2).fit_transform(t)
    assert v.columns == ["t", "t_hello", "t_world"] and sorted((r.t_hello, r.t_world) for r in v.collect()) == [(0, 1), (2, 1)]


def test_splits_and_metrics(spark):
    df = spark.range(103).selectExpr("id", "id % 4 AS c")
    a, b = ev.train_test_split(df, ["id"], 0.2)
    assert (a.count(), b.count()) == (82, 21) and a.join(b, "id").count() == 0
    a, b = ev.train_test_split(df, ["id"], 0.1, stratify="c")
    assert a.count() + b.count() == 103 and b.select("c").distinct().count() == 4
    assert [p.count() for p in ev.train_val_test_split(df, ["id"], 0.1, 0.2)] == [72, 10, 21]
    assert sorted(r["count"] for r in ev.k_fold(df, ["id"], 5).groupBy("fold").count().collect()) == [20, 20, 21, 21, 21]
    assert [(x.count(), y.count()) for x, y in ev.time_series_split(df, ["id"], 3)] == [(28, 25), (53, 25), (78, 25)]
    m = spark.createDataFrame([(1, 1, 0.9), (0, 1, 0.8), (1, 0, 0.3), (0, 0, 0.1)], "y int, p int, s double")
    r = ev.classification_metrics(m, "y", "p").first()
    assert (r.accuracy, r.precision, r.recall, r.tp) == (0.5, 0.5, 0.5, 1) and ev.roc_auc(m, "y", "s") == 0.75
    assert {x["class"]: x.support for x in ev.multiclass_metrics(m, "y", "p").collect()} == {0: 2, 1: 2}
    k = spark.createDataFrame([(0, 0.0, 0.0), (0, 1.0, 0.0), (1, 10.0, 0.0), (1, 11.0, 0.0)], "c int, x double, y double")
    assert ev.cluster_metrics(k, "c", ["x", "y"])["davies_bouldin"] == pytest.approx(0.1)


def test_models(spark):
    rng = np.random.default_rng(0)
    data = [(i, *map(float, x), float(3 * x[0] - 2 * x[1] + 1), int(x[0] + x[1] > 0)) for i, x in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(data, "i int, a double, b double, y double, c int").cache()
    assert models.Model("linear_regression", ["a", "b"], "y").fit(df).score(df) > 0.999
    assert models.Model("logistic_regression", ["a", "b"], "c").fit(df).score(df) > 0.95
    assert models.Model("random_forest_classifier", ["a", "b"], "c", numTrees=5).fit(df).score(df) > 0.85
    knn = models.knn(df, df, ["a", "b"], "c", ["i"], 1).join(df, "i")
    assert knn.where("prediction <> c").count() == 0
    s, v = models.truncated_svd(df, ["a", "b"], 2)
    assert s == pytest.approx(np.linalg.svd(np.array([d[1:3] for d in data]))[1])
    assert len(models.KMeans(["a", "b"], 3).fit(df).centers()) == 3 and models.Pca(["a", "b"], 1).fit(df).transform(df).columns[-1] == "pc1"
    x = [[0, 0], [0, 1], [10, 10], [10, 11], [50, 50]]
    assert models.dbscan(x, 1.5, 2).tolist() == [0, 0, 1, 1, -1] and len(set(models.agglomerative(x, 3).tolist())) == 3


def test_similarity_of_more_than_a_thousand_documents(spark):
    rows = [(i, f"w{i // 3} v{i // 3} own{i}") for i in range(1200)]
    got = text.similarity_matrix(spark.createDataFrame(rows, "id int, body string"), "id", "body").collect()
    assert sorted((r.key_a, r.key_b) for r in got) == [(3 * g + a, 3 * g + b) for g in range(400) for a, b in ((0, 1), (0, 2), (1, 2))]
    shared, own = math.log(1200 / 3), math.log(1200)
    assert all(abs(r.similarity - 2 * shared**2 / (2 * shared**2 + own**2)) < 1e-9 for r in got)
