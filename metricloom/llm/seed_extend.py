"""Substring dedup by seed and extend, on words.

Documents are joined on winnowed anchors (:mod:`anchors`): the seeds. Around each seed that another document
has too, the match is extended both ways as far as ``window`` words reach: every window over the seed is looked
up by two hashes (96 bits), and the least document that holds it is found. Windows that a smaller document holds
make, united, the maximal repeated spans, and their words go.

Words are runs of all but blank and tab to carriage return, unchanged. Nulls and texts of fewer than ``window``
words keep everything. Windows are judged on the input. Of equal texts the one with the least id stays; rows
with equal ids are one document and never remove each other's words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from metricloom.llm import anchors
from metricloom.llm.shared import CHUNK_BYTES, chunk_count, chunked, texts, unpacked
from metricloom.llm.textarrays import NOT_SPACE, U, Spans, mix, runs, utf8, words

_ASK = "shard int, chunk int, keys binary, checks binary, docs binary"
_OUT = "doc_id long, n_words long, spans array<struct<first:long,last:long>>, kept string"


class _Chunk:
    """Words, blocks and candidate windows of the documents of a chunk."""

    def __init__(self, table: pa.Table, window: int, gram: int):
        table = unpacked(table)
        self.ids = table.column("doc_id").to_numpy()
        self.data, self.offsets = utf8(table.column("text"))
        self.starts, self.ends, self.units, self.before = words(self.data, self.offsets, NOT_SPACE)
        self.blocks = anchors.Blocks(self.units, self.before, window, gram)

    def windows(self, shared: np.ndarray, window: int):
        """Windows over shared seeds: first word, row, and for the distinct ones keys, checks and their least document."""
        b = self.blocks
        first, count = b.first[shared], b.count[shared]
        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        row = np.repeat(b.row[shared], count)
        key = b.spans.hash(at, at + window)
        check = (Spans(mix(self.units ^ U(0xA0761D6478BD642F))).hash(at, at + window) >> U(32)).astype(np.uint32)
        order = np.lexsort((check, key))                # stable: rows ascend among equals
        k, c = key[order], check[order]
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        group = np.empty(len(k), np.int64)
        group[order] = np.cumsum(fresh) - 1
        return at, row, group, k[fresh], c[fresh], self.ids[row[order][fresh]]


def _least(table: pa.Table) -> pa.Table:
    """For every window a chunk asks about: one bit, whether a smaller document than the chunk's least holds it."""
    keys = [np.frombuffer(k, U) for k in table.column("keys").to_pylist()]
    key, check = np.concatenate(keys), np.concatenate([np.frombuffer(c, np.uint32) for c in table.column("checks").to_pylist()])
    doc = np.concatenate([anchors.unpack(d) for d in table.column("docs").to_pylist()])
    order = np.lexsort((doc, check, key))
    k, c, d = key[order], check[order], doc[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    smaller = np.empty(len(k), bool)
    smaller[order] = d > d[fresh][np.cumsum(fresh) - 1]
    return anchors.reply(2, table, [np.packbits(part) for part in np.split(smaller, np.cumsum([len(x) for x in keys])[:-1])])


def repeated_spans(docs: DataFrame, window: int = 13, gram: int = 5, id_col: str = "doc_id", text_col: str = "text",
                   chunk_bytes: int = CHUNK_BYTES // 2) -> DataFrame:
    """``doc_id, n_words, spans (array of struct<first, last>: maximal runs of words to remove), kept (string)``."""
    docs = texts(docs, id_col, text_col)
    chunks = chunk_count(docs, chunk_bytes)
    bits = anchors.shard_bits(chunks)
    docs = chunked(docs, chunks)

    def seeds(key, table):
        return anchors.ask(key[0].as_py(), _Chunk(table, window, gram).blocks, bits)

    def extend(key, table, replies):
        chunk = _Chunk(table, window, gram)
        _, _, _, keys, checks, least = chunk.windows(anchors.shared_blocks(chunk.blocks, replies, bits), window)
        rows = [(s, key[0].as_py(), keys[a:b].tobytes(), checks[a:b].tobytes(), anchors.pack(least[a:b])) for s, a, b in anchors.by_shard(keys, bits)]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                                    ["shard", "chunk", "keys", "checks", "docs"])

    def finish(key, table, replies):
        chunk = _Chunk(table, window, gram)
        at, row, group, keys, _, least = chunk.windows(anchors.shared_blocks(chunk.blocks, replies, bits), window)
        sizes = [high - low for _, low, high in anchors.by_shard(keys, bits)]
        flags = [np.unpackbits(np.frombuffer(part, np.uint8), count=n) for part, n in zip(anchors.in_order(replies, 2), sizes, strict=True)]
        hit = (np.concatenate(flags).astype(bool)[group] | (chunk.ids[row] > least[group])) if flags else np.zeros(0, bool)
        return _cut(chunk, at[hit], window)

    first = docs.groupBy("chunk").applyInArrow(seeds, anchors.REQUEST).groupBy("shard").applyInArrow(anchors.answer, anchors.REPLY)
    asked = docs.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(extend, _ASK)
    second = asked.groupBy("shard").applyInArrow(_least, anchors.REPLY)
    return docs.groupBy("chunk").cogroup(first.unionByName(second).groupBy("chunk")).applyInArrow(finish, _OUT)


def covered(at: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` units lie in a window of ``length`` that starts at one of ``at``."""
    steps = np.bincount(at, minlength=n + 1)[:n + 1] - np.bincount(at + length, minlength=n + 1)[:n + 1]
    return np.cumsum(steps[:n]) > 0


def span_lists(removed: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """Maximal runs as a list for each row: first and last unit, counted from the row's start."""
    borders = np.searchsorted(starts, offsets)
    base = np.repeat(offsets[:-1], np.diff(borders))
    spans = pa.StructArray.from_arrays([pa.array(starts - base), pa.array(ends - 1 - base)], ["first", "last"])
    return pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), spans)


def _cut(chunk: _Chunk, at: np.ndarray, window: int) -> pa.Table:
    n = len(chunk.units)
    removed = covered(at, window, n)
    spans = span_lists(removed, chunk.before, *runs(removed, chunk.before))
    # the bytes of kept words, each with a blank after it but the last of its row
    keep = np.flatnonzero(~removed)
    row = np.searchsorted(chunk.before, keep, side="right") - 1
    final = np.ones(len(keep), bool)
    final[:-1] = row[1:] != row[:-1]
    size = chunk.ends[keep] - chunk.starts[keep]
    steps = np.zeros(len(chunk.data) + 1, np.int64)
    np.add.at(steps, chunk.starts[keep], 1)
    np.add.at(steps, chunk.ends[keep], -1)
    mask = np.cumsum(steps[:-1]) > 0
    data = chunk.data.copy()
    blanks = chunk.ends[keep[~final]]
    data[blanks] = 0x20
    mask[blanks] = True
    lengths = np.bincount(row, size + ~final, minlength=len(chunk.ids)).astype(np.int64)
    out = np.concatenate(([0], np.cumsum(lengths)))
    kept = pa.LargeStringArray.from_buffers(len(chunk.ids), pa.py_buffer(out), pa.py_buffer(data[mask].tobytes()))
    return pa.Table.from_arrays([pa.array(chunk.ids), pa.array(np.diff(chunk.before)), spans, kept.cast(pa.string())], ["doc_id", "n_words", "spans", "kept"])
