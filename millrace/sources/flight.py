"""Tables to and from an Arrow Flight server; reads are distributed, one task for each endpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import from_arrow_schema


class FlightTables:
    """get, put and list of named tables at ``location`` (such as grpc://host:port)."""

    def __init__(self, location: str):
        self.location = location

    def _client(self):
        from pyarrow import flight

        return flight.connect(self.location)

    def list(self) -> list[str]:
        with self._client() as c:
            return sorted(i.descriptor.path[0].decode() for i in c.list_flights())

    def get(self, spark: SparkSession, name: str) -> DataFrame:
        """Every endpoint of the flight is read by a task of its own, batch by batch."""
        from pyarrow import flight

        with self._client() as c:
            info = c.get_flight_info(flight.FlightDescriptor.for_path(name))
        tickets = [(e.locations[0].uri.decode() if e.locations else self.location, bytearray(e.ticket.ticket)) for e in info.endpoints]
        schema = from_arrow_schema(info.schema)

        def run(batches):
            for batch in batches:
                for where, ticket in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    with flight.connect(where) as c:
                        for chunk in c.do_get(flight.Ticket(ticket)):
                            yield chunk.data

        return spark.createDataFrame(tickets, "location string, ticket binary").repartition(max(1, len(tickets))).mapInArrow(run, schema)

    def put(self, df: DataFrame, name: str) -> None:
        """One stream, fed a partition at a time."""
        import pyarrow as pa
        from pyarrow import flight
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(df.schema)
        with self._client() as c:
            writer, _ = c.do_put(flight.FlightDescriptor.for_path(name), schema)
            rows: list[dict] = []
            for row in df.toLocalIterator(prefetchPartitions=True):
                rows.append(row.asDict())
                if len(rows) == 10_000:
                    writer.write_batch(pa.RecordBatch.from_pylist(rows, schema))
                    rows = []
            if rows:
                writer.write_batch(pa.RecordBatch.from_pylist(rows, schema))
            writer.close()
