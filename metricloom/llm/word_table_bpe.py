"""BPE encoding by a table of distinct words, and decoding by an id-to-piece join.

Texts are split into words on Spark, a chunk of documents at a time. A chunk sends each distinct word once, packed
with the others that fall to the same shard; a shard meets every word of its share from all chunks, merges each
distinct one once, and sends the ids back in the order of the question. The chunk then joins ids to words by position.
However frequent a word is, a chunk asks for it once, so no key is hot, and nothing holds the whole word table.

Nulls are empty texts and have no ids. Repeated rows are each encoded. Strings of special tokens inside texts become
their ids, as the library has it. Decoding drops ids that the vocabulary lacks, and nulls decode to the empty text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from metricloom.llm import anchors
from metricloom.llm.pretokens import Pretokens, encoder, groups, placed, split
from metricloom.llm.shared import CHUNK_BYTES, chunk_count, chunked, map_batches, texts, unpacked
from metricloom.llm.textarrays import distinct

_ASK, _TOLD = "shard int, chunk int, words string", "chunk int, shard int, sizes binary, ids binary"


class _Words:
    """The words of the documents of a chunk; distinct ones by hash."""

    def __init__(self, table: pa.Table, path: str):
        table = unpacked(table)
        own, rows = encoder(path, True), table.column("text").to_pylist()
        self.ids = table.column("doc_id").combine_chunks()
        self.parts: list[Pretokens] = [split(rows[low:high], True, own.special) for low, high in groups(rows)]
        found, first, which = distinct(np.concatenate([p.hashes for p in self.parts]))
        order = np.argsort(found)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.keys, self.first, self.which = found[order], first[order], rank[which]
        self.borders = np.cumsum([0, *(len(p.hashes) for p in self.parts)])

    def strings(self) -> list[str]:
        """The distinct words, by hash."""
        out = [""] * len(self.keys)
        part = np.searchsorted(self.borders, self.first, side="right") - 1
        for k, p in enumerate(self.parts):
            mine = np.flatnonzero(part == k)
            at = self.first[mine] - self.borders[k]
            for i, start, end in zip(mine.tolist(), p.starts[at].tolist(), p.ends[at].tolist()):
                out[i] = p.text[start:end]
        return out


def _merge(table: pa.Table, path: str) -> pa.Table:
    """Ids of every word a shard is asked about; each distinct word is merged once."""
    own = encoder(path, True)
    asked = [words.split("\n") for words in table.column("words").to_pylist()]        # words hold no white space
    place: dict[str, int] = {}
    which = np.fromiter((place.setdefault(w, len(place)) for words in asked for w in words), np.int64, sum(map(len, asked)))
    merged = [own.merge(w) for w in place]
    n = np.fromiter(map(len, merged), np.int64, len(merged))
    flat = np.fromiter((i for ids in merged for i in ids), np.uint32, int(n.sum()))
    begins = np.cumsum(n) - n
    counts, ids = [], []
    for part in np.split(which, np.cumsum([len(words) for words in asked])[:-1]):
        size = n[part]
        total = np.cumsum(size)
        counts.append(anchors.pack(size))
        ids.append(anchors.pack(flat[np.repeat(begins[part] - total + size, size) + np.arange(total[-1])].astype(np.int64)))
    return pa.Table.from_arrays([table.column("chunk").combine_chunks(), table.column("shard").combine_chunks(), pa.array(counts, pa.binary()), pa.array(ids, pa.binary())],
                                ["chunk", "shard", "sizes", "ids"])


def encode(docs: DataFrame, path: str, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, ids (array of int)`` of every document under the word vocabulary at ``path``; ``decoded`` adds the ids' text."""
    docs = texts(docs, id_col, text_col)
    chunks = chunk_count(docs, chunk_bytes)
    bits = anchors.shard_bits(chunks)
    docs = chunked(docs, chunks)

    def ask(key, table):
        words = _Words(table, path)
        strings = words.strings()
        rows = [(s, key[0].as_py(), "\n".join(strings[a:b])) for s, a, b in anchors.by_shard(words.keys, bits)]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string()))], ["shard", "chunk", "words"])

    def join(key, table, told):
        words = _Words(table, path)
        told = told.sort_by("shard")
        sizes = [anchors.unpack(x) for x in told.column("sizes").to_pylist()]
        flat = [anchors.unpack(x) for x in told.column("ids").to_pylist()]
        sizes, flat = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (sizes, flat))
        out = [placed(p, words.which[a:b], sizes, flat) for p, a, b in zip(words.parts, words.borders[:-1], words.borders[1:])]
        counts = np.concatenate([np.diff(offsets) for _, offsets in out])
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
        ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([ids for ids, _ in out]).astype(np.int32)))
        table = pa.Table.from_arrays([words.ids, ids], ["doc_id", "ids"])
        return table.append_column("decoded", _in_parts(ids, path)) if decoded else table

    told = docs.groupBy("chunk").applyInArrow(ask, _ASK).groupBy("shard").applyInArrow(lambda table: _merge(table, path), _TOLD)
    return docs.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(join, "doc_id long, ids array<int>" + ", decoded string" * decoded)


@lru_cache
def pieces(path: str) -> pa.Array:
    """The piece of every id: the id-to-piece table, as long as the vocabulary."""
    vocabulary = encoder(path, True).tokenizer.get_vocab(with_added_tokens=True)
    out = [None] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        out[i] = piece
    return pa.array(out, pa.large_string())


def joined(ids: pa.ListArray, path: str) -> pa.Array:
    """Decoded texts of id lists: their pieces with blanks between, as the library has it for a vocabulary without a decoder."""
    table = pieces(path)
    values, offsets = ids.flatten(), np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))))
    known = pc.and_(pc.greater_equal(values, 0), pc.less(values, len(table)))
    found = table.take(pc.if_else(known, values, pa.scalar(None, values.type)))
    if found.null_count:
        here = found.is_valid().to_numpy(zero_copy_only=False)
        offsets = np.concatenate(([0], np.cumsum(here)))[offsets]
        found = found.drop_null()
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found), pa.scalar(" ", pa.large_string()))


def _in_parts(ids: pa.ListArray, path: str, rows: int = 256) -> pa.Array:
    """Decoded texts, a few rows at a time: the pieces of a whole batch would be many."""
    return pa.concat_arrays([joined(ids.slice(low, rows), path).cast(pa.string()) for low in range(0, len(ids), rows)])


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The rows of ``encoded`` with ``decoded`` (string); a column that had this name is replaced."""
    rest = encoded.drop("decoded")

    def work(batch):
        return batch.append_column("decoded", _in_parts(batch.column(ids_col), path))
    return map_batches(rest, work, T.StructType([*rest.schema.fields, T.StructField("decoded", T.StringType())]))
