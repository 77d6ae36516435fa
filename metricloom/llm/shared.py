"""Session helpers of the training-data operators: shared folder, chunks of documents, map functions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes a chunk of documents holds on average, and the least number of chunks.
CHUNK_BYTES, LEAST_CHUNKS = 4 << 20, 96


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only for a local session without it."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="metricloom-llm-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, kept in the shared checkpoint folder: later reads don't repeat the work."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in a new folder beside the checkpoints."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One Parquet table of a directory."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """The id (long) and text (null: empty) of documents under fixed names; rows without id are dropped.

    ``carry`` keeps the row beside them as the struct ``rest``, so no name can clash; a text that is a string is not in it
    a second time, and stays null where it is. :func:`whole` makes the row whole again.
    """
    text = F.col(text_col).cast("string")
    columns = [F.col(id_col).cast("long").alias("doc_id"), (text if carry else F.coalesce(text, F.lit(""))).alias("text")]
    if carry:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns if not _is_text(docs, c, text_col)]).alias("rest"))
    return docs.select(*columns).where(F.col("doc_id").isNotNull())


def whole(found: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``found`` with ``text`` and ``rest`` of :func:`texts`, where ``rest`` is again the struct of all columns of ``docs``."""
    row = F.struct(*[(F.col("text") if _is_text(docs, c, text_col) else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])
    return found.select(*[row.alias(c) if c == "rest" else F.col(c) for c in found.columns if c != "text"])


def _is_text(docs: DataFrame, column: str, text_col: str) -> bool:
    return column == text_col and len(docs.columns) > 1 and docs.schema[column].dataType == T.StringType()


def chunk_count(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> int:
    """Chunks that hold about ``chunk_bytes`` of text each."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(LEAST_CHUNKS, -(-total // chunk_bytes))


def chunked(docs: DataFrame, chunks: int, packs: int | None = None) -> DataFrame:
    """``chunk, docs``: documents dealt out by a hash of their id, whatever their text.

    Each batch of a scan is packed into one compressed Arrow stream per chunk before the shuffle; :func:`unpacked` reads
    the streams that meet in a chunk. ``packs``: several chunks meet under a number ``pack``, of so many.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batch):
        chunk = batch.column("chunk").to_numpy()
        order = np.argsort(chunk, kind="stable")
        rows = pa.Table.from_batches([batch]).drop_columns(["chunk"]).take(pa.array(order))
        borders = np.flatnonzero(np.diff(chunk[order], prepend=-1, append=-1))
        blobs = []
        for low, high in zip(borders[:-1], borders[1:]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(rows.slice(low, high - low))
            blobs.append(sink.getvalue().to_pybytes())
        return pa.record_batch([pa.array(chunk[order][borders[:-1]]), pa.array(blobs, pa.binary())], ["chunk", "docs"])

    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int"))
    packed = map_batches(dealt, pack, "chunk int, docs binary", rows=None)
    if packs is None:
        return packed.repartition(min(chunks, partitions), "chunk")
    return packed.withColumn("pack", F.col("chunk") % packs).repartition(min(packs, partitions), "pack")


def unpacked(table: pa.Table) -> pa.Table:
    """The documents of a chunk by id (equal ids by text), so every step sees them in one order."""
    parts = [pa.ipc.open_stream(blob.as_buffer()).read_all() for blob in table.column("docs")]
    return pa.concat_tables(parts).sort_by([("doc_id", "ascending"), ("text", "ascending")])


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema, rows: int | None = 1000) -> DataFrame:
    """``work`` on every Arrow batch of a partition, at most ``rows`` rows at a time; empty batches give nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, rows or max(1, batch.num_rows)):
                if (out := work(batch.slice(low, rows))) is not None:
                    yield out
    return df.mapInArrow(run, schema)
