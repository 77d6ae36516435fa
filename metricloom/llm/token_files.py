"""Token ids of documents in files of Simple-8b blocks, in ascending id order.

A dataset is a folder of files that Spark writes and reads, wherever that folder is; a row of a file is one block:
its part (ascending ranges of document ids) and place in it, the ids of its documents and their token counts (the
offsets that make a block decodable at once), the number of tokens before it in its part, the coded words and the
escaped integers. A document is never divided, and a block ends once it holds ``block_ids`` tokens, so a reader holds
one block and no more. The number of tokens before a part is a sum over one number per part.

Nulls are empty texts: only the end id. Equal document ids keep the order of their texts. An empty table gives an
empty dataset. Strings of special tokens inside texts become their ids, as the library has it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metricloom.llm.pretokens import encoder
from metricloom.llm.shared import map_batches, texts
from metricloom.llm.simple8b import decode, encode
from metricloom.llm.textarrays import U

_ROW = "part int, block int, before long, docs array<long>, counts array<long>, words binary, escapes binary"


def write_tokens(docs: DataFrame, path: str, target: str, end_id: int | None = 2, words: bool = False, id_col: str = "doc_id", text_col: str = "text",
                 block_ids: int = 1 << 18, batch_rows: int = 256) -> None:
    """Encode all texts with the vocabulary at ``path`` and write the dataset ``target`` (a new folder)."""
    docs = texts(docs, id_col, text_col)

    def blocks(batches):
        own, part = encoder(path, words), TaskContext.get().partitionId()
        block = before = 0
        held, held_docs = [], []                        # ids and document ids of the block that grows

        def flush():
            nonlocal block, before
            values = np.concatenate(held)
            coded, escapes = encode(values)
            row = [[part], [block], [before], [held_docs], [[len(x) for x in held]], [coded.tobytes()], [escapes.tobytes()]]
            block, before = block + 1, before + len(values)
            types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
            return pa.record_batch([pa.array(v, t) for v, t in zip(row, types)], ["part", "block", "before", "docs", "counts", "words", "escapes"])

        size = 0
        for batch in batches:
            for low in range(0, batch.num_rows, batch_rows):
                some = batch.slice(low, batch_rows)
                ids, offsets = own.ids(some.column("text").to_pylist())
                for doc, a, b in zip(some.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                    held.append(ids[a:b] if end_id is None else np.append(ids[a:b], end_id))
                    held_docs.append(doc)
                    size += len(held[-1])
                    if size >= block_ids:
                        yield flush()
                        held, held_docs, size = [], [], 0
        if held:
            yield flush()

    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")       # only ids are sampled
    ranged.mapInArrow(blocks, _ROW).write.option("compression", "none").parquet(target)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a dataset."""
    return spark.read.schema(_ROW).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start (ids of all documents before it), ids (array of long)`` of a dataset."""
    return _documents(spark, path, "ids array<long>", lambda ids, offsets: [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int64)))], ["ids"])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (crc32 of the ids as little-endian unsigned 32-bit integers) of a dataset."""
    def digest(ids, offsets):
        data = memoryview(ids.astype("<u4").tobytes())
        crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return [pa.array(np.diff(offsets)), pa.array(crc, pa.int64())]
    return _documents(spark, path, "n_tokens long, ids_crc32 long", digest, ["n_tokens", "ids_crc32"])


def _documents(spark, path, schema, columns, names):
    blocks = read_blocks(spark, path)
    # one number per part; the running sum over them is the only thing that one task sees
    sizes = blocks.select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))

    def work(batch):
        out = []
        for row in batch.to_pylist():
            counts = np.array(row["counts"], np.int64)
            offsets = np.concatenate(([0], np.cumsum(counts)))
            ids = decode(np.frombuffer(row["words"], U), np.frombuffer(row["escapes"], U), int(offsets[-1]))
            out.append(pa.record_batch([pa.array(row["docs"], pa.int64()), pa.array(offsets[:-1] + row["before"] + row["part_start"]), *columns(ids, offsets)], ["doc_id", "start", *names]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    located = blocks.join(F.broadcast(starts), "part")  # as many rows as parts
    return map_batches(located.select("before", "docs", "counts", "words", "escapes", "part_start"), work, f"doc_id long, start long, {schema}")
