"""Substring dedup by common-prefix intervals of enhanced suffix arrays, on the bytes of texts.

A byte goes if a ``length``-byte string over it also starts in a document with a smaller id. Long anchors are asked
about first, by their leading bits: short ones are shared by chance, the more so the larger the corpus, and every window
over such an anchor would have to be sent. Of the windows that are left, shared anchors
(:mod:`anchors`) bring equal strings to one shard; the shard sorts the suffixes of all distinct contexts of an
anchor, compares neighbours (common prefixes), and a stack scan over these lists the interval tree. Intervals at
least ``length`` deep whose suffixes have different bytes on the left are the maximal repeats; every occurrence
in such a group, not just neighbours, is compared with the group's least document.

An anchor with one context everywhere needs no sorting: its context is the interval. An anchor with very many
contexts is divided: each of its windows goes to a shard by its own hash, so no shard gathers a common phrase.

Nulls and texts of fewer than ``length`` bytes keep everything. Strings are judged on the input and never cross
documents. Of equal texts the one with the least id stays; rows with equal ids are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from metricloom.llm import anchors
from metricloom.llm.seed_extend import covered, span_lists
from metricloom.llm.shared import CHUNK_BYTES, LEAST_CHUNKS, chunk_count, chunked, texts, unpacked, whole
from metricloom.llm.textarrays import U, Spans, byte_units, runs, slices, utf8

_KINDS = "shard int, chunk int, keys binary, more binary, rows binary"
_ASK = "shard int, chunk int, keys binary, counts binary, data binary, docs binary"
#: Chunks that ask and are answered together, one row for each shard, at least and at most. As many as the root of the
#: number of chunks asks for: so rows, packs times shards, outgrow the text slowly, and small inputs stay evenly dealt out.
PACK, MOST = 2, 16
_ALL = U(0xFFFFFFFFFFFFFFFF)
#: Answers about an anchor: in one document, one context everywhere, several contexts, very many.
ALONE, SAME, SEVERAL, MANY = range(4)


def maximal_repeats(common: list[int], left: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """The maximal repeats of a suffix array: (length, first, last place), inner intervals before outer ones.

    ``common[i]``: common prefix of the suffixes at ``i - 1`` and ``i``. ``left[i]``: the unit before the suffix,
    negative where there is none, which counts as different from all others.
    """
    stack: list[list[int]] = []                         # open intervals: depth, first place, their one left unit or -1
    n = len(left)
    for i in range(1, n + 1):
        depth = common[i] if i < n else 0
        first, before = i - 1, left[i - 1]
        while stack and stack[-1][0] > depth:
            own, first, seen = stack.pop()
            before = seen if seen == before else -1
            if before < 0:
                yield own, first, i - 1
        if depth >= least:
            if stack and stack[-1][0] == depth:
                if stack[-1][2] != before:
                    stack[-1][2] = -1
            else:
                stack.append([depth, first, before])


def suffix_array(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the given suffixes (``sizes`` bytes from ``starts``) and the common prefix of each with the one before."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = int(sizes.max())
    shifted = np.concatenate((data + np.uint8(1), np.zeros(wide, np.uint8)))           # UTF-8 has no byte 255
    rows = np.lib.stride_tricks.sliding_window_view(shifted, wide)[starts]
    rows[np.arange(wide) >= sizes[:, None]] = 0
    order = np.argsort(rows.view(f"S{wide}").ravel(), kind="stable")
    rows, sizes = rows[order], sizes[order]
    common = np.zeros(len(rows), np.int64)
    differ = rows[1:] != rows[:-1]
    common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
    common[1:] = np.minimum(common[1:], np.minimum(sizes[1:], sizes[:-1]))
    return order, common


class _Chunk:
    """Bytes and blocks of the documents of a chunk."""

    def __init__(self, table: pa.Table, length: int, gram: int, shared: anchors.Answers | None = None):
        """``shared``: whether another document may have a long anchor too; ``blocks`` are made of the windows over those."""
        table = unpacked(table)
        self.rest = table.select(["text", "rest"]) if "rest" in table.column_names else None
        self.ids, self.length = table.column("doc_id").to_numpy(), length
        self.data, self.offsets = utf8(table.column("text"))
        self.long = anchors.Blocks(byte_units(self.data), self.offsets, length, (length + gram) // 2)
        if shared:
            windows = self.long.windows(shared.take(self.long.distinct))
            spans, self.long = self.long.spans, None
            self.blocks = anchors.Blocks(spans, self.offsets, length, gram, windows)

    def contexts(self) -> np.ndarray:
        """A hash of the one context of each distinct anchor, 0 where the chunk has several."""
        b = self.blocks
        context = (b.spans.hash(b.first, b.first + b.count + self.length - 1) >> U(32)).astype(np.uint32) | np.uint32(1)
        one = context[b.index]
        one[b.which[context != one[b.which]]] = 0
        return one

    def entries(self, codes: np.ndarray):
        """What to ask about: keys, window counts (0: the context is known to be the only one), first bytes, least documents;
        and for the blocks these stand for: first, row, count, entry."""
        b = self.blocks
        own = codes[b.which] if len(codes) else np.zeros(0, np.uint8)
        whole = (own == SAME) | (own == SEVERAL)
        many = own == MANY
        windows = np.repeat(b.first[many] - (np.cumsum(b.count[many]) - b.count[many]), b.count[many]) + np.arange(b.count[many].sum())
        first = np.concatenate((b.first[whole], windows))
        count = np.concatenate((b.count[whole], np.ones(len(windows), np.int64)))
        row = np.concatenate((b.row[whole], np.repeat(b.row[many], b.count[many])))
        content = b.spans.hash(first, first + count + self.length - 1)
        key = np.concatenate((b.anchor[whole], content[len(content) - len(windows):]))
        known = np.concatenate((own[whole] == SAME, np.zeros(len(windows), bool)))
        order = np.lexsort((row, content, key))
        k, c = key[order], content[order]
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        entry = np.empty(len(k), np.int64)
        entry[order] = np.cumsum(fresh) - 1
        lead = order[fresh]
        asked = np.where(known[lead], 0, count[lead])
        return k[fresh], asked, first[lead], self.ids[row[lead]], first, row, count, entry


def _answer(table: pa.Table, many: int) -> pa.Table:
    """For every anchor of a shard: which of the four cases it is."""
    keys = [np.frombuffer(k, U) for k in table.column("keys").to_pylist()]
    key = np.concatenate(keys)
    more = np.concatenate([np.frombuffer(m, np.uint32) for m in table.column("more").to_pylist()])
    flags = np.concatenate([anchors.from_flags(m)[:len(k)] for k, m in zip(keys, table.column("rows").to_pylist())])
    order = np.lexsort((more, key))
    k, context = key[order], more[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = k[1:] != k[:-1]
    group = np.cumsum(fresh) - 1
    other = fresh.copy()
    other[1:] |= context[1:] != context[:-1]
    n = group[-1] + 1
    holders = np.bincount(group, minlength=n) + np.bincount(group, flags[order], minlength=n)
    mixed = np.bincount(group, context == 0, minlength=n)
    kinds = np.bincount(group, other, minlength=n) + mixed
    code = np.where(holders <= 1, ALONE, np.where(kinds == 1, SAME, np.where(kinds > many, MANY, SEVERAL))).astype(np.uint8)
    out = np.empty(len(key), np.uint8)
    out[order] = code[group]
    return anchors.reply(1, table, [anchors.quarters(x) for x in np.split(out, np.cumsum([len(x) for x in keys])[:-1])])


def _squeezed(parts: list[np.ndarray]) -> bytes:
    data = anchors.joined(parts)
    return pa.compress(data, "zstd", asbytes=True) if data else data


def _least(table: pa.Table, length: int, suffixes: int = 1 << 15) -> pa.Table:
    """For every context a chunk asks about: a bit for each of its windows, whether a smaller document than the chunk's least holds it."""
    keys = [np.frombuffer(k, U) for k in table.column("keys").to_pylist()]
    key = np.concatenate(keys)
    count = np.concatenate([np.frombuffer(c, np.uint8) for c in table.column("counts").to_pylist()]).astype(np.int64)
    doc = np.concatenate([anchors.unpack(d) for d in table.column("docs").to_pylist()])
    size = np.where(count > 0, count + length - 1, 0)
    of_row = [int(s.sum()) for s in np.split(size, np.cumsum([len(k) for k in keys])[:-1])]
    data = np.frombuffer(b"".join(pa.decompress(d, n, "zstd", asbytes=True) for d, n in zip(table.column("data").to_pylist(), of_row) if n), np.uint8)
    start = np.cumsum(size) - size
    content = np.empty(len(size), U)
    borders = np.append(start, len(data))
    for low, high in slices(borders, 1 << 20):           # eight bytes of hash for each byte of a slice
        base = borders[low]
        content[low:high] = Spans(byte_units(data[base:borders[high]])).hash(start[low:high] - base, start[low:high] + size[low:high] - base)
    order = np.lexsort((doc, content, count == 0, key))
    k, c, bare = key[order], content[order], count[order] == 0
    new_key = np.ones(len(k), bool)
    new_key[1:] = (k[1:] != k[:-1]) | (bare[1:] != bare[:-1])
    fresh = new_key.copy()
    fresh[1:] |= c[1:] != c[:-1]
    context = np.empty(len(k), np.int64)
    context[order] = np.cumsum(fresh) - 1
    lead = order[fresh]                                 # the least document of every distinct context
    least = doc[lead]
    of_key = np.cumsum(new_key)[fresh] - 1
    masks = np.zeros(len(lead), U)
    sort = np.flatnonzero((np.bincount(of_key)[of_key] > 1) & (count[lead] > 0))
    # whole anchors at a time, so that the suffixes that are sorted together stay few
    part = np.cumsum(count[lead[sort]]) // suffixes
    same = of_key[sort]
    part = part[np.searchsorted(same, same)] if len(sort) else part
    for sort in np.split(sort, np.flatnonzero(np.diff(part)) + 1) if len(sort) else []:
        n = count[lead[sort]]
        which = np.repeat(sort, n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        places, sizes = start[lead[which]] + at, np.repeat(n, n) - at + length - 1
        left = np.where(at > 0, data[np.maximum(places - 1, 0)].astype(np.int64), -1)
        array, common = suffix_array(data, places, sizes)
        docs, deep = least[which[array]], np.zeros(len(array), np.int64)
        for depth, low, high in maximal_repeats(common.tolist(), left[array].tolist(), length):
            own = docs[low:high + 1]
            np.maximum(deep[low:high + 1], np.where(own > own.min(), depth, 0), out=deep[low:high + 1])
        hit = np.flatnonzero(deep)
        bits = (U(1) << (deep[hit] - length + 1).astype(U)) - U(1)
        np.bitwise_or.at(masks, which[array[hit]], bits << at[array[hit]].astype(U))
    out = np.where(doc > least[context], _ALL, masks[context])
    return anchors.reply(2, table, np.split(out, np.cumsum([len(x) for x in keys])[:-1]))


def repeated_bytes(docs: DataFrame, length: int = 50, gram: int = 16, whole_characters: bool = False, many: int = 512, carry: bool = False,
                   id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES // 4) -> DataFrame:
    """``doc_id, n_bytes, spans (array of struct<first, last>: maximal removed byte runs), kept (binary)``.

    ``whole_characters`` keeps a character of which a part would stay. ``carry`` adds the input row as struct ``rest``. ``many``: contexts of an anchor in one shard.
    ``length`` is at most 63 more than ``gram``.
    """
    if not gram < length <= gram + 63:
        raise ValueError("length must be over gram by 1 to 63")
    rows, docs = docs, texts(docs, id_col, text_col, carry)
    rest = docs.schema["rest"] if carry else None
    chunks = chunk_count(docs, chunk_bytes)
    packs = max(min(chunks, LEAST_CHUNKS), int(chunks / np.clip(PACK * (chunks / 1024) ** 0.5, PACK, MOST)))
    bits = max(8, int(np.log2(chunks)) - 4)             # of a shard: the anchors of 16 to 32 chunks
    docs = chunked(docs, chunks, packs)
    dealt = min(packs, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def each(work, table, replies=None):
        """``work`` on the chunks of a pack in order, with the answers to the steps so far; no chunk is held while the next one is divided."""
        steps = [(0, anchors.from_flags), (1, anchors.from_quarters), (2, lambda x: np.frombuffer(x, U))]
        told = [anchors.Answers(replies, step, bits, values) for step, values in steps] if replies is not None else None
        number = table.column("chunk").to_numpy()
        for n in np.unique(number):
            work(_Chunk(table.filter(pa.array(number == n)), length, gram, told and told[0]), told)

    def seeds(key, table):
        asked = anchors.Questions(bits)

        def ask(chunk, _):
            b = chunk.long
            several = b.in_several_rows()
            asked.add(b.distinct, lambda x, y: (b.distinct[x:y], several[x:y]))

        each(ask, table)
        return asked.table(key[0].as_py(), {"keys": anchors.steps, "more": anchors.flags})

    def kinds(key, table, replies):
        asked = anchors.Questions(bits)

        def ask(chunk, _):
            b = chunk.blocks
            several, contexts = b.in_several_rows(), chunk.contexts()
            asked.add(b.distinct, lambda x, y: (b.distinct[x:y], contexts[x:y], several[x:y]))

        each(ask, table, replies)
        return asked.table(key[0].as_py(), {"keys": anchors.joined, "more": anchors.joined, "rows": anchors.flags})

    def contexts(key, table, replies):
        asked = anchors.Questions(bits)

        def ask(chunk, told):
            keys, counts, first, least, *_ = chunk.entries(told[1].take(chunk.blocks.distinct))

            def part(x, y):
                size = np.where(counts[x:y] > 0, counts[x:y] + length - 1, 0)
                at = np.repeat(first[x:y] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                return keys[x:y], counts[x:y].astype(np.uint8), chunk.data[at], least[x:y]

            asked.add(keys, part)

        each(ask, table, replies)
        return asked.table(key[0].as_py(), {"keys": anchors.joined, "counts": anchors.joined, "data": _squeezed, "docs": lambda parts: anchors.pack(np.concatenate(parts))})

    def finish(key, table, replies):
        out = []

        def cut(chunk, told):
            keys, _, _, least, first, row, count, entry = chunk.entries(told[1].take(chunk.blocks.distinct))
            mask = np.where(chunk.ids[row] > least[entry], _ALL, told[2].take(keys)[entry])
            window = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            hit = (np.repeat(mask, count) >> window.astype(U)) & U(1) > 0
            found = _cut(chunk, (np.repeat(first, count) + window)[hit], whole_characters)
            out.append(found.append_column("text", chunk.rest["text"]).append_column("rest", chunk.rest["rest"]) if carry else found)

        each(cut, table, replies)
        return pa.concat_tables(out)

    schema = T.StructType.fromDDL("doc_id long, n_bytes long, spans array<struct<first:long,last:long>>, kept binary")
    if carry:
        schema = schema.add("text", T.StringType()).add(rest)
    packed = docs.groupBy("pack")

    def answered(asked, work):
        """Answers dealt out as the documents are, so that a later step reads them where they lie."""
        return asked.groupBy("shard").applyInArrow(work, anchors.REPLY).repartition(dealt, "chunk")

    first = answered(packed.applyInArrow(seeds, anchors.REQUEST), anchors.shared)
    second = answered(packed.cogroup(first.groupBy("chunk")).applyInArrow(kinds, _KINDS), lambda table: _answer(table, many))
    told = first.unionByName(second)
    third = answered(packed.cogroup(told.groupBy("chunk")).applyInArrow(contexts, _ASK), lambda table: _least(table, length))
    found = packed.cogroup(told.unionByName(third).groupBy("chunk")).applyInArrow(finish, schema)
    return whole(found, rows, text_col) if carry else found


def _cut(chunk: _Chunk, at: np.ndarray, whole_characters: bool) -> pa.Table:
    data, offsets = chunk.data, chunk.offsets
    removed = covered(at, chunk.length, len(data))
    if whole_characters and len(data):
        leads = np.flatnonzero((data & 0xC0) != 0x80)
        removed = np.repeat(np.logical_and.reduceat(removed, leads), np.diff(np.append(leads, len(data))))
    spans = span_lists(removed, offsets, *runs(removed, offsets))
    sums = np.concatenate(([0], np.cumsum(~removed)))
    kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(chunk.ids), [None, pa.py_buffer(sums[offsets]), pa.py_buffer(data[~removed].tobytes())])
    return pa.Table.from_arrays([pa.array(chunk.ids), pa.array(np.diff(offsets)), spans, kept.cast(pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])
