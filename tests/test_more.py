"""Ordering at scale, exact quantiles, change points, retries, Flight tables and label indexes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import missing, sets, windows
from millrace.operators.quantiles import exact_quantiles
from millrace.ordering import find_borders, range_bucket, with_position
from millrace.sources.resilience import CircuitOpen, Resilience
from millrace.timeseries.numeric import pelt


def test_buckets_follow_all_keys(spark):
    rng = np.random.default_rng(0)
    rows = [(f"Customer#{i:09d}" if i % 50 else None, float(x) if i % 7 else float("nan"), bool(i % 2)) for i, x in enumerate(rng.normal(size=4000))]
    df = spark.createDataFrame(rows, "name string, v double, b boolean")
    for by, up in ((["name", "v"], True), (["b", "name"], [False, True]), (["v", "name"], [True, False]), (["b", "v", "name"], [True, False, False])):
        bucketed, borders = range_bucket(df, by, up, find_borders(df, by, up, buckets=16))
        sizes = [r["count"] for r in bucketed.groupBy("__bucket").count().collect()]
        assert len(sizes) >= 12 and max(sizes) <= 0.2 * len(rows), (by, sizes)
        at = [(r["__pos"], r["name"], r["v"], r["b"]) for r in with_position(df, by, up, "__pos", borders).collect()]
        flags = [up] * len(by) if isinstance(up, bool) else up
        want = list(range(len(rows)))
        value = {"name": [r[0] for r in rows], "v": [None if math.isnan(r[1]) else r[1] for r in rows], "b": [r[2] for r in rows]}
        for name, flag in reversed(list(zip(by, flags, strict=True))):
            known = sorted((i for i in want if value[name][i] is not None), key=lambda i: value[name][i], reverse=not flag)
            want = known + [i for i in want if value[name][i] is None]
        got = sorted(at, key=lambda r: r[0])
        for name, k in (("name", 1), ("b", 3)):
            if name == by[0]:
                assert [r[k] for r in got] == [value[name][i] for i in want]
        assert [r[0] for r in got] == list(range(len(rows)))
    assert find_borders(df.limit(0), ["name"]).values == ()
    with pytest.raises(ValueError, match="another order"):
        range_bucket(df, ["v"], borders=find_borders(df, ["name"]))


def test_expanding_std_with_an_offset(spark):
    values = [1e9 + i for i in range(200)] + [None, 1e9]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").repartition(4)
    got = [r.s for r in windows.expanding(df, "v", "std", ["i"], out="s").orderBy("i").collect()]
    for k, s in enumerate(got):
        known = [v for v in values[: k + 1] if v is not None]
        assert s is None if len(known) < 2 else s == pytest.approx(np.std(known, ddof=1), rel=1e-5)


def test_fills_in_both_directions(spark):
    rng = np.random.default_rng(3)
    values = [float(v) if rng.random() < 0.3 else None for v in rng.normal(size=300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").repartition(3)
    for forward in (True, False):
        got = [r.f for r in missing.fill_direction(df, "v", forward, ["i"], out="f").orderBy("i").collect()]
        want, last = [], None
        for v in values if forward else values[::-1]:
            last = v if v is not None else last
            want.append(last)
        assert got == (want if forward else want[::-1])


@pytest.mark.parametrize("direct", [5, 1000, 10**6])
def test_exact_quantiles(spark, direct):
    rng = np.random.default_rng(1)
    columns = {"a": rng.normal(size=5000), "b": rng.integers(0, 6, 5000).astype(float), "c": np.zeros(5000)}
    df = spark.createDataFrame([(*map(float, r), None) for r in zip(*columns.values(), strict=True)], "a double, b double, c double, d double")
    points = [0.0, 0.013, 0.25, 0.5, 0.999, 1.0]
    got = exact_quantiles(df, {c: F.col(c) for c in "abcd"}, points, direct)
    for c, v in columns.items():
        assert got[c] == pytest.approx(np.quantile(v, points).tolist(), abs=1e-12)
    assert got["d"] == [None] * len(points)


def test_change_points_are_the_least_cost():
    rng = np.random.default_rng(5)

    def cost(y):
        return float(((y - y.mean()) ** 2).sum())

    for _ in range(300):
        y = rng.integers(0, 4, rng.integers(2, 14)).astype(float)
        penalty, least = float(rng.random() * 3), int(rng.integers(1, 4))
        best = [-penalty, *[math.inf] * len(y)]
        for t in range(1, len(y) + 1):
            best[t] = min((best[a] + cost(y[a:t]) + penalty for a in range(t - least + 1) if t - a >= least), default=math.inf)
        cuts = [0, *pelt(y, penalty, least), len(y)]
        if math.isfinite(best[-1]):
            assert sum(cost(y[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)) + penalty * (len(cuts) - 2) == pytest.approx(best[-1], abs=1e-9)


def test_retries_and_the_circuit():
    now, pauses, calls = [0.0], [], []
    r = Resilience(attempts=3, base=1.0, jitter=0.0, failures=2, pause=10.0, retry_on=(OSError,), sleep=pauses.append, clock=lambda: now[0])

    def fails(times):
        calls.append(1)
        if len(calls) <= times:
            raise OSError
        return len(calls)

    assert r.call(fails, 2) == 3 and pauses == [1.0, 2.0]
    for _ in range(2):
        with pytest.raises(OSError):
            r.call(fails, 100)
    with pytest.raises(CircuitOpen):
        r.call(fails, 0)
    now[0] = 11.0
    assert r.call(fails, 0) == len(calls)
    with pytest.raises(KeyError):
        r.call({}.__getitem__, "x")


def test_flight_tables(spark):
    flight = pytest.importorskip("pyarrow.flight")
    import pyarrow as pa

    from millrace.sources.flight import FlightTables

    class Server(flight.FlightServerBase):
        tables: dict = {}

        def do_put(self, context, descriptor, reader, writer):
            self.tables[descriptor.path[0].decode()] = reader.read_all()

        def _info(self, name):
            table = self.tables[name]
            half = table.num_rows // 2
            ends = [flight.FlightEndpoint(f"{name}:{a}:{n}".encode(), []) for a, n in ((0, half), (half, table.num_rows - half))]
            return flight.FlightInfo(table.schema, flight.FlightDescriptor.for_path(name), ends, table.num_rows, -1)

        def list_flights(self, context, criteria):
            return iter([self._info(n) for n in self.tables])

        def get_flight_info(self, context, descriptor):
            return self._info(descriptor.path[0].decode())

        def do_get(self, context, ticket):
            name, a, n = ticket.ticket.decode().split(":")
            return flight.RecordBatchStream(self.tables[name].slice(int(a), int(n)))

    with Server("grpc://127.0.0.1:0") as server:
        store = FlightTables(f"grpc://127.0.0.1:{server.port}")
        df = spark.range(25_000).withColumn("s", F.concat(F.lit("r"), "id"))
        store.put(df, "numbers")
        store.put(df.limit(0), "nothing")
        assert store.list() == ["nothing", "numbers"]
        back = store.get(spark, "numbers")
        assert back.columns == ["id", "s"] and back.count() == 25_000 and back.agg(F.sum("id")).first()[0] == sum(range(25_000))
        assert store.get(spark, "nothing").count() == 0
        assert isinstance(server.tables["numbers"], pa.Table)


def test_label_index(spark):
    m = sets.MultiIndex.from_tuples(spark, [("a", 1), ("b", 1), ("a", 2), ("a", 1), ("a", None)], ["k", "n"])
    find = lambda *v: [r.position for r in m.locations(*v).orderBy("position").collect()]
    assert find("a", 1) == [0, 3] and find("a") == [0, 2, 3, 4] and find("a", None) == [4] and find("z") == []
    assert m.levels() == {"k": 2, "n": 2}
