"""Queries whose answers are known from a definition or a published example, stated as SQL values or formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import geo, text
from ..ml import models as md
from ..ml import transformers as tr
from ..operators import missing
from ..sources import memory
from ..streaming.windows import event_windows, iso, json_events
from .registry import query, t

#: Fixed: examples of the published stemming algorithm.
STEMS = (
    ("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"),
    ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("filing", "file"),
    ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("rational", "ration"), ("formalize", "formal"), ("electrical", "electr"),
    ("hopefulness", "hope"), ("goodness", "good"), ("revival", "reviv"), ("allowance", "allow"), ("adjustment", "adjust"), ("adoption", "adopt"), ("roll", "roll"),
)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + x + "'" for x in r) + ")" for r in rows)


@query(f"SELECT word, stem FROM (VALUES {_values(STEMS)}) AS v(word, stem)")
def stems(spark, d):
    return text.map_words(spark.createDataFrame([(w,) for w, _ in STEMS], "word string"), "word", text.stem, "stem")


LEMMAS = (("was", "be"), ("children", "child"), ("cities", "city"), ("boxes", "box"), ("running", "run"), ("cats", "cat"), ("better", "good"), ("glass", "glass"))


@query(f"SELECT word, lemma FROM (VALUES {_values(LEMMAS)}) AS v(word, lemma)")
def lemmas(spark, d):
    return text.map_words(spark.createDataFrame([(w,) for w, _ in LEMMAS], "word string"), "word", text.lemma, "lemma")


@query("SELECT * FROM (VALUES (0, 'Dr. Smith met Mrs. Jones at 5 p.m. today.'), (1, 'They talked!'), (2, 'Was it e.g. useful?'), (3, 'Yes.')) AS v(i, sentence)")
def sentence_split(spark, d):
    df = spark.createDataFrame([("Dr. Smith met Mrs. Jones at 5 p.m. today. They talked! Was it e.g. useful? Yes.",)], "t string")
    return df.select(F.posexplode(text.sentences("t")).alias("i", "sentence"))


@query("SELECT * FROM (VALUES ('wordpiece', '1,2,3,0'), ('regex', '2,1,0'), ('bpe', '3,2')) AS v(kind, ids)")
def tokenizer_ids(spark, d):
    df = spark.createDataFrame([("wordpiece", "unwanted runs qq"), ("regex", "b a c"), ("bpe", "low lower")], "kind string, t string")
    made = {
        "wordpiece": text.WordPiece(["[UNK]", "un", "##wanted", "runs"]),
        "regex": text.RegexTokenizer(r"\w", ["a", "b"]),
        "bpe": text.Bpe([("l", "o"), ("lo", "w</w>"), ("lo", "w"), ("e", "r</w>"), ("low", "er</w>")], ["?", "low", "lower</w>", "low</w>"]),
    }
    out = None
    for kind, tokenizer in made.items():
        part = text.tokenize(df.where(F.col("kind") == kind), "t", tokenizer).select("kind", F.concat_ws(",", F.transform("tokens", lambda x: x.cast("string"))).alias("ids"))
        out = part if out is None else out.unionByName(part)
    return out


# geography ---------------------------------------------------------------------------

_PLACES = "SELECT c_custkey, ((c_custkey % 170) - 85)::DOUBLE AS lat, ((c_custkey * 7 % 360) - 180)::DOUBLE AS lon FROM customer"


def _places(spark, d):
    k = F.col("c_custkey")
    return t(spark, d, "customer").select(k, ((k % 170) - 85).cast("double").alias("lat"), ((k * 7 % 360) - 180).cast("double").alias("lon"))


@query(f"""WITH p AS ({_PLACES}), r AS (SELECT c_custkey, radians(lat) AS a, radians(lon) AS o, radians(48.0::DOUBLE) AS b, radians(11.0::DOUBLE) AS q FROM p)
SELECT c_custkey, round((degrees(atan2(sin(q - o) * cos(b), cos(a) * sin(b) - sin(a) * cos(b) * cos(q - o))) + 360) % 360, 5) AS bearing FROM r""")
def bearings(spark, d):
    return _places(spark, d).select("c_custkey", F.round(geo.bearing("lat", "lon", 48.0, 11.0), 5).alias("bearing"))


@query(f"SELECT c_custkey, true AS back FROM ({_PLACES})")
def destination_and_distance(spark, d):
    """A place 250 km away is 250 km away."""
    lat, lon = geo.destination("lat", "lon", F.lit(37.0), F.lit(250.0))
    p = _places(spark, d).select("c_custkey", "lat", "lon", lat.alias("lat2"), lon.alias("lon2"))
    return p.select("c_custkey", (F.abs(geo.haversine("lat", "lon", "lat2", "lon2") - 250.0) < 1e-6).alias("back"))


@query(f"SELECT c_custkey, 500000.0::DOUBLE AS east, lat >= 0 AS north_half FROM ({_PLACES})")
def utm_centre_line(spark, d):
    """On a zone's centre line the easting is 500 km; northings south of the equator count from 10,000 km."""
    east, north = geo.to_utm("lat", F.lit(9.0), 32)
    return _places(spark, d).select("c_custkey", F.round(east, 3).alias("east"), ((F.col("lat") >= 0) & (north >= 0) & (north < 9.5e6) | (F.col("lat") < 0) & (north > 0.5e6)).alias("both"), (F.col("lat") >= 0).alias("north_half")).where("both").drop("both")


@query("SELECT round(2 * pi() * 6371 / 4, 0) AS quarter, 0.0::DOUBLE AS lat, 45.0::DOUBLE AS lon, true AS box")
def line_and_box(spark, d):
    line = geo.LineString([(0, 0), (0, 30), (0, 90)])
    lat, lon = line.interpolate(0.5)
    s, w, n, e = geo.buffer_box(0.0, 0.0, 111.0)
    return spark.createDataFrame([(round(line.length_km(), 0), round(lat, 6) + 0.0, round(lon, 6), abs(n + s) < 1e-9 and abs(e + w) < 1e-9 and 0.99 < n < 1.01)], "quarter double, lat double, lon double, box boolean")


# series and learning -------------------------------------------------------------------

_SQUARES = "SELECT s_suppkey % 4 AS k, row_number() OVER (PARTITION BY s_suppkey % 4 ORDER BY s_suppkey) - 1 AS i FROM supplier"


def _squares(spark, d, f):
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy(F.col("s_suppkey") % 4).orderBy("s_suppkey")) - 1
    s = t(spark, d, "supplier").select((F.col("s_suppkey") % 4).alias("k"), i.cast("long").alias("i"))
    return s.withColumn("v", F.when(F.col("i") % 3 != 1, f(F.col("i").cast("double"))))


@query(f"SELECT k, i, (i * i)::DOUBLE AS v FROM ({_SQUARES})")
def interpolate_polynomial(spark, d):
    """Squares with gaps: the parabola through the three nearest points gives them back."""
    out = missing.interpolate_series(_squares(spark, d, lambda x: x * x), "v", "polynomial", ["i"], ["k"])
    return out.select("k", "i", F.round("v", 6).alias("v"))


@query(f"SELECT k, i, (3 * i + 1)::DOUBLE AS v FROM ({_SQUARES})")
def interpolate_spline(spark, d):
    """A straight line with gaps: its natural spline is the line."""
    out = missing.interpolate_series(_squares(spark, d, lambda x: 3 * x + 1), "v", "spline", ["i"], ["k"])
    return out.select("k", "i", F.round("v", 6).alias("v"))


@query("SELECT p_partkey, (p_size > 25)::INT::DOUBLE AS tree, (p_size > 25)::INT::DOUBLE AS forest, (p_size > 25)::INT::DOUBLE AS boosted FROM part")
def tree_models(spark, d):
    """A threshold that every tree model finds exactly."""
    p = t(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_size") > 25).cast("double").alias("y"))
    out = p
    for name, kind, params in (("tree", "decision_tree_classifier", {"maxBins": 64}), ("forest", "random_forest_classifier", {"numTrees": 3, "seed": 1, "maxBins": 64}), ("boosted", "gbt_classifier", {"maxIter": 2, "seed": 1, "maxBins": 64})):
        got = md.Model(kind, ["x"], "y", **params).fit(p).predict(p)
        out = out.join(got.select("p_partkey", F.col("prediction").alias(name)), "p_partkey")
    return out.drop("x", "y")


@query("SELECT count(*) FILTER (p_size <= 25) AS low, count(*) FILTER (p_size > 25) AS high FROM part")
def k_means(spark, d):
    """Two groups far apart."""
    p = t(spark, d, "part").select(F.when(F.col("p_size") > 25, F.col("p_size") + 10_000.0).otherwise(F.col("p_size").cast("double")).alias("x"))
    out = md.KMeans(["x"], 2, seed=3).fit(p).predict(p)
    sizes = out.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"))
    return sizes.agg(F.min_by("n", "m").alias("low"), F.max_by("n", "m").alias("high"))


@query("SELECT round(sqrt(sum(p_size * p_size)), 4) AS norm, 1.0::DOUBLE AS direction FROM part")
def singular_values(spark, d):
    values, vectors = md.truncated_svd(t(spark, d, "part"), ["p_size"], 1)
    return spark.createDataFrame([(round(float(values[0]), 4), abs(float(vectors[0, 0])))], "norm double, direction double")


@query("SELECT p_partkey, round(abs(p_size - (SELECT avg(p_size) FROM part)) * sqrt(2), 4) AS pc FROM part")
def principal_component(spark, d):
    """Two equal columns: the first component is their common distance from the mean times the square root of two."""
    p = t(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_size").cast("double").alias("b"))
    mean = p.agg(F.avg("a")).first()[0]
    out = md.Pca(["a", "b"], 1).fit(p).transform(p)
    return out.select("p_partkey", F.round(F.abs(F.abs(F.col("pc1")) - abs(mean) * 2**0.5), 4).alias("pc"))


@query("SELECT * FROM (VALUES (0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 1, 1), (4, 1, 1), (5, 1, 1), (6, -1, 2)) AS v(i, density, merged)")
def small_clusterings(spark, d):
    points = [(0.0, 0.0), (0.5, 0.0), (0.0, 0.5), (9.0, 9.0), (9.5, 9.0), (9.0, 9.5), (40.0, 0.0)]
    a, b = md.dbscan(points, 1.0, 2), md.agglomerative(points, 3)
    return spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "i int, density int, merged int")


@query("SELECT p_partkey, p_size::DOUBLE AS back, true AS rising FROM part")
def power_transform(spark, d):
    """The transform keeps the order, and its definition inverted gives the sizes back."""
    p = t(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"))
    fitted = tr.PowerTransformer("x", method="box-cox").fit(p)
    lam = fitted.params["x"]
    out = fitted.transform(p).withColumnRenamed("x", "y")
    back = F.exp("y") if abs(lam) < 1e-9 else F.pow(F.col("y") * lam + 1, F.lit(1 / lam))
    order = out.join(p, "p_partkey").agg(F.corr("x", "y")).first()[0]
    return out.select("p_partkey", F.round(back, 4).alias("back"), F.lit(bool(order > 0.9)).alias("rising"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def to_python_and_back(spark, d):
    n = t(spark, d, "nation").orderBy("n_nationkey")
    lists, records = memory.to_dict(n), memory.to_dict(n, "records")
    rows = [r for batch in memory.iter_batches(n, 7) for r in batch]
    assert lists["n_name"] == [r["n_name"] for r in records] == [r["n_name"] for r in rows] == [r["n_name"] for _, r in memory.iter_rows(n)]
    assert all(records[6]["n_name"].replace("_", "") in f(n).replace("\\_", "").replace("_", "") for f in (memory.to_markdown, memory.to_html, memory.to_latex))
    return memory.from_dict(spark, lists, "n_nationkey int, n_name string, n_regionkey int")


# streams ---------------------------------------------------------------------------------


@query("SELECT event_id, (regexp_extract(props, '[0-9]+'))::BIGINT AS k, ts FROM events WHERE regexp_matches(props, '[0-9]')")
def json_stream_rows(spark, d):
    """Events as JSON text, with times in milliseconds, parsed like the rows of a broker."""
    e = t(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "props")
    body = F.to_json(F.struct(F.floor(F.col("us") / 1000).alias("at"), F.get_json_object("props", "$.k").cast("long").alias("k")))
    parsed = json_events(e.select("event_id", "us", body.alias("value")), "at long, k long", "at").where("k IS NOT NULL")
    return parsed.select("event_id", "k", (F.col("ts").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.pmod("us", F.lit(1000)) / 1e6)).cast("timestamp_ntz").alias("ts"))


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%dT%H:%M:%S.000') AS window_start, count(*) AS event_count FROM events GROUP BY 1")
def windows_as_text(spark, d):
    out = event_windows(t(spark, d, "events"), "ts").tumbling("1 day").frame()
    return iso(out, "window_start").select("window_start", "event_count")
