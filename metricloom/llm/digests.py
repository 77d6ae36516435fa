"""Digest columns of the registered queries, from the outputs of operators."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from metricloom.llm.shared import map_batches
from metricloom.llm.word_table_bpe import joined


def id_lists(column: pa.ListArray) -> list[bytes]:
    """Every list of ids as little-endian unsigned 32-bit integers."""
    data = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).astype("<u4")).tobytes()
    offsets = 4 * np.concatenate(([0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
    return [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def of_tokens(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of rows with ``doc_id, ids``, decoded with the vocabulary at ``path``."""
    def work(batch):
        lengths, ids, texts = [], [], []
        for low in range(0, batch.num_rows, 256):       # the pieces of a whole batch would be many
            part = batch.column("ids").slice(low, 256)
            for one in id_lists(part):
                lengths.append(len(one) // 4)
                ids.append(hashlib.sha256(one).hexdigest())
            texts.extend(hashlib.sha256(memoryview(text.as_buffer() or b"")).hexdigest() for text in joined(part, path))
        return pa.record_batch([batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return map_batches(encoded, work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
