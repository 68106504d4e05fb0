"""Documents packed into compressed blocks in the shared folder, so that a later stage can meet what
other tasks found out about a block's hashes by a join on the block's number."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .common import materialize, slices, text_buffers

BLOCK_BYTES = 4 << 20
BLOCK_DOCS = 32_000


def write_blocks(docs: DataFrame, columns: list[str], text_col: str, block_bytes: int = BLOCK_BYTES, name: str = "blocks") -> DataFrame:
    """A stored table (block_id long, payload binary): runs of rows with ``columns`` and the text.

    A block holds at most ``block_bytes`` of text or one document, and at most BLOCK_DOCS rows. The
    table is written once and read by all later stages, so a block's number means the same to all.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            _, offsets = text_buffers(batch.column(batch.num_columns - 1))
            for i, j in slices(offsets, block_bytes, BLOCK_DOCS):
                piece = pa.RecordBatch.from_arrays(list(batch.slice(i, j - i).columns), names=batch.schema.names)
                yield pa.RecordBatch.from_arrays([pa.array([part << 32 | seq], pa.int64()), pa.array([pack(piece)], pa.binary())], names=["block_id", "payload"])
                seq += 1

    return materialize(docs.select(*columns, text_col).mapInArrow(run, "block_id long, payload binary"), name)


def pack(batch) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes):
    """The block as one Arrow record batch."""
    import pyarrow as pa

    table = pa.ipc.open_stream(payload).read_all().combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)
