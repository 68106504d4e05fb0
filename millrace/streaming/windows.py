"""Event-time windows over streams, and the same query over bounded tables.

``StreamFrame(df).tumbling('5 minutes').agg('value', 'sum', 'total').watermark('2 minutes')`` builds one plan;
``frame()`` is lazy and works on batch and streaming input, ``start`` runs it with a checkpoint, ``collect_stream`` drains a
bounded stream. A watermark only rises and late events are dropped; bounded tables flush all windows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..semantics import col

_AGGS: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}
#: Weeks start on Mondays, as time buckets from the year 1 do.
_WEEK_START = "4 days"


@dataclass(frozen=True)
class StreamFrame:
    df: DataFrame
    ts: str = "ts"
    keys: tuple[str, ...] = ()
    kind: tuple = ("tumbling", "1 minute")
    aggs: tuple[tuple[str, str, str], ...] = ()
    lateness: str | None = None

    def by(self, *keys: str) -> StreamFrame:
        return replace(self, keys=keys)

    def tumbling(self, size: str) -> StreamFrame:
        return replace(self, kind=("tumbling", size))

    def sliding(self, size: str, slide: str) -> StreamFrame:
        return replace(self, kind=("sliding", size, slide))

    def session(self, gap: str) -> StreamFrame:
        return replace(self, kind=("session", gap))

    def agg(self, column: str, how: str, out: str) -> StreamFrame:
        if how not in _AGGS:
            raise ValueError(how)
        return replace(self, aggs=(*self.aggs, (column, how, out)))

    def watermark(self, lateness: str) -> StreamFrame:
        return replace(self, lateness=lateness)

    def _window(self) -> Column:
        c = col(self.ts)
        if self.kind[0] == "session":
            return F.session_window(c, self.kind[1])
        size = self.kind[1]
        slide = self.kind[2] if self.kind[0] == "sliding" else size
        return F.window(c, size, slide, _WEEK_START if "week" in size or size in ("7 days",) else None)

    def frame(self) -> DataFrame:
        """window_start, window_end, keys and aggregates; without aggregates event_count."""
        df, plain = self.df, isinstance(self.df.schema[self.ts].dataType, T.TimestampNTZType)
        if self.lateness and df.isStreaming:  # watermarks are kept on timestamps with a zone
            df = (df.withColumn(self.ts, col(self.ts).cast("timestamp")) if plain else df).withWatermark(self.ts, self.lateness)
        value = lambda name: col(name).try_cast("double")
        made = [_AGGS[how](value(c)).alias(out) for c, how, out in self.aggs] or [F.count(F.lit(1)).alias("event_count")]
        grouped = df.groupBy(self._window().alias("__w"), *map(col, self.keys)).agg(*made)
        start, end = (F.col(f"__w.{c}").cast("timestamp_ntz") if plain else F.col(f"__w.{c}") for c in ("start", "end"))
        return grouped.select(start.alias("window_start"), end.alias("window_end"), *self.keys, *[o for _, _, o in self.aggs] or ["event_count"])

    def start(self, emit: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", available_now: bool = False):
        """Runs continuously (or over what is there); ``emit`` gets each micro-batch of finished windows."""
        writer = self.frame().writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(emit)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def collect_stream(self, checkpoint: str, name: str = "millrace_windows") -> DataFrame:
        """All windows of a bounded stream, open ones included."""
        q = self.frame().writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        return self.df.sparkSession.table(name)


def iso(df: DataFrame, *columns: str) -> DataFrame:
    """Window borders as ISO-8601 text."""
    return df.withColumns({c: F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss.SSS") for c in columns})


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int | None = None, **options: str) -> DataFrame:
    """New files of a folder as a stream; ``max_files`` a trigger bounds a batch."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def json_events(df: DataFrame, schema: str, ts_field: str | None = None, value: str = "value") -> DataFrame:
    """Rows of JSON text to typed events; malformed ones go. ``ts_field`` may be ISO text or epoch milliseconds."""
    parsed = df.withColumn("__e", F.from_json(col(value).cast("string"), schema)).where("__e IS NOT NULL").select(*[c for c in df.columns if c != value], "__e.*")
    if ts_field is None:
        return parsed
    t = col(ts_field).cast("string")
    made = F.coalesce(F.timestamp_millis(t.try_cast("bigint")), t.try_cast("timestamp"))
    return parsed.withColumn("ts", made).where("ts IS NOT NULL")


def kafka_source(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Raw records of a topic (needs the kafka connector)."""
    from ..sources.files import _connector

    return _connector(lambda: spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load(), "kafka")


def kafka_rows(df: DataFrame, key: str | None = None) -> DataFrame:
    """key and JSON value columns as the kafka sink takes them."""
    value = F.to_json(F.struct(*map(col, df.columns))).alias("value")
    return df.select(*([col(key).cast("string").alias("key")] if key else []), value)


def kafka_sink(df: DataFrame, servers: str, topic: str, checkpoint: str, key: str | None = None):
    from ..sources.files import _connector

    rows = kafka_rows(df, key)
    return _connector(lambda: rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start(), "kafka")


def sink_per_batch(df: DataFrame, write: Callable[[list[dict]], None], checkpoint: str, rows: int = 1000):
    """Sends each partition's rows as lists of dictionaries to ``write``, on the executors (for stores without a connector)."""

    def emit(batch: DataFrame, _: int) -> None:
        def send(it):
            part = []
            for r in it:
                part.append(r.asDict())
                if len(part) == rows:
                    write(part)
                    part = []
            if part:
                write(part)

        batch.foreachPartition(send)

    return df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(emit).start()


def redis_sink(df: DataFrame, host: str, stream: str, checkpoint: str, port: int = 6379):
    """Appends rows to a Redis stream (needs the redis package on the executors)."""

    def write(rows: list[dict]) -> None:
        import redis

        pipe = redis.Redis(host=host, port=port).pipeline()
        for r in rows:
            pipe.xadd(stream, {k: "" if v is None else str(v) for k, v in r.items()})
        pipe.execute()

    return sink_per_batch(df, write, checkpoint)


def register_socket_source(spark: SparkSession) -> None:
    """Registers 'json_socket': newline-separated JSON from a TCP server as a stream of value text."""
    from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

    class Reader(SimpleDataSourceStreamReader):
        def __init__(self, options):
            self.options = options

        def initialOffset(self):
            return {"n": 0}

        def read(self, start):
            import socket

            lines = []
            with socket.create_connection((self.options["host"], int(self.options["port"])), timeout=10) as s, s.makefile("r") as f:
                s.settimeout(float(self.options.get("wait", "1")))
                try:
                    lines.extend((line.rstrip("\n"),) for line in f)
                except TimeoutError:
                    pass
            return iter(lines), {"n": start["n"] + len(lines)}

        def readBetweenOffsets(self, start, end):
            return iter([])

    class Source(DataSource):
        @classmethod
        def name(cls):
            return "json_socket"

        def schema(self):
            return "value string"

        def simpleStreamReader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(Source)


def event_windows(df: DataFrame, ts: str, keys: Sequence[str] = ()) -> StreamFrame:
    return StreamFrame(df, ts, tuple(keys))
