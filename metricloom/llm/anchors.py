"""Shared anchors of documents: the step before an exact search for repeated windows.

A window is ``length`` consecutive units (bytes or words) of one document. Its anchor is the least hash of the
``gram``-unit spans inside it (winnowing), so equal windows have equal anchors, and a window whose anchor lies
in one document only is not repeated. Consecutive windows with one anchor form a block.

Documents meet in chunks, dealt out by a hash of their id. A chunk asks about its distinct anchors, dealt out
by their leading bits to shards, one packed row for each chunk and shard; the shard answers with one bit for
each. So a frequent anchor costs one number a chunk, however many documents hold it, no pairs are formed, and
no key gathers rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from metricloom.llm.textarrays import U, Spans, inside, mix

REQUEST, REPLY = "shard int, chunk int, keys binary, more binary", "chunk int, step int, shard int, bits binary"
REPLY_SCHEMA = pa.schema([("chunk", pa.int32()), ("step", pa.int32()), ("shard", pa.int32()), ("bits", pa.binary())])


def pack(values: np.ndarray) -> bytes:
    """Integers in as few bytes each as their range needs."""
    base = int(values.min()) if len(values) else 0
    width = np.min_scalar_type(int(values.max()) - base if len(values) else 0)
    return np.array([base, width.itemsize], np.int64).tobytes() + (values - base).astype(width).tobytes()


def unpack(data: bytes) -> np.ndarray:
    base, width = np.frombuffer(data, np.int64, 2)
    return np.frombuffer(data, f"u{width}", offset=16).astype(np.int64) + base


class Blocks:
    """The blocks of the documents of one chunk: anchor, first window, number of windows, row.

    ``windows``: which windows to divide into blocks (all that lie in one document). ``units`` may be the :class:`Spans` of other blocks.
    """

    def __init__(self, units: np.ndarray | Spans, offsets: np.ndarray, length: int, gram: int, windows: np.ndarray | None = None):
        self.offsets, self.length, self.spans = offsets, length, units if isinstance(units, Spans) else Spans(units)
        values, span = self.spans.grams(gram), length - gram + 1
        width = 1
        while width < span and len(values):             # least of every window, by doubling
            step = min(width, span - width)
            values = np.minimum(values[:-step], values[step:]) if len(values) > step else values[:0]
            width += step
        valid = inside(offsets, length) if windows is None else windows
        values = values[:len(valid)]
        fresh = valid.copy()
        fresh[1:] &= ~valid[:-1] | (values[1:] != values[:-1])
        first = np.flatnonzero(fresh)
        last = valid.copy()
        last[:-1] &= ~valid[1:] | fresh[1:]
        count = np.flatnonzero(last) + 1 - first
        pieces = -(-count // span)                      # repetitive text: no block over ``span`` windows
        part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.first = np.repeat(first, pieces) + part * span
        self.count = np.minimum(np.repeat(count, pieces) - part * span, span)
        self.anchor = mix(values[self.first] ^ U(0xE7037ED1A0B428DB))       # least values are small; shards need them even
        self.row = np.searchsorted(offsets, self.first, side="right") - 1
        self.distinct, self.index, self.which = np.unique(self.anchor, return_index=True, return_inverse=True)

    def in_several_rows(self) -> np.ndarray:
        """Which distinct anchors stand in more than one row of the chunk."""
        last = np.empty(len(self.distinct), np.int64)
        last[self.which] = self.row                     # rows ascend: the last one stays
        return last > self.row[self.index]

    def windows(self, chosen: np.ndarray) -> np.ndarray:
        """Which windows lie in a block whose distinct anchor is chosen."""
        own = chosen[self.which] if len(chosen) else np.zeros(0, bool)
        steps = np.zeros(max(0, int(self.offsets[-1]) - self.length + 1) + 1, np.int8)
        steps[self.first[own]] += 1
        steps[(self.first + self.count)[own]] -= 1
        return np.cumsum(steps[:-1], dtype=np.int8) > 0


def by_shard(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """Shards of sorted keys by their leading bits: (shard, low, high)."""
    shards = (keys >> U(64 - bits)).astype(np.int64)
    borders = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1], [True]))) if len(keys) else []
    for low, high in zip(borders[:-1], borders[1:]):
        yield int(shards[low]), int(low), int(high)


def shard_bits(chunks: int) -> int:
    """Half as many shards as chunks or more, as a power of two, 256 at least."""
    return max(8, int(np.log2(chunks)))


class Questions:
    """What the chunks of a pack ask, one after the other: one row for each shard, however many chunks ask it."""

    def __init__(self, bits: int):
        self.bits, self.shards = bits, {}

    def add(self, keys: np.ndarray, part: Callable[[int, int], tuple]) -> None:
        """``part(low, high)``: what is asked about a range of the sorted keys, one value for each column."""
        for shard, low, high in by_shard(keys, self.bits):
            self.shards.setdefault(shard, []).append(part(low, high))

    def table(self, pack: int, columns: dict[str, Callable[[list], bytes]]) -> pa.Table:
        """``shard, chunk`` (the pack), and each column as bytes made of the values that the chunks gave."""
        shards = sorted(self.shards)
        found = {name: pa.array([work([part[i] for part in self.shards[s]]) for s in shards], pa.binary()) for i, (name, work) in enumerate(columns.items())}
        return pa.table({"shard": pa.array(shards, pa.int32()), "chunk": pa.array([pack] * len(shards), pa.int32())} | found)


class Answers:
    """The answers to one step, to be taken by the chunks of a pack in the order in which they asked."""

    def __init__(self, replies: pa.Table, step: int, bits: int, values: Callable[[bytes], np.ndarray]):
        own = replies.filter(pc.equal(replies.column("step"), step))
        self.bits, self.none = bits, values(b"")
        self.left = dict(zip(own.column("shard").to_pylist(), map(values, own.column("bits").to_pylist())))

    def take(self, keys: np.ndarray) -> np.ndarray:
        """The answers about the sorted keys of the next chunk."""
        out = [self.none]
        for shard, low, high in by_shard(keys, self.bits):
            out.append(self.left[shard][:high - low])
            self.left[shard] = self.left[shard][high - low:]
        return np.concatenate(out)


def joined(parts: list[np.ndarray]) -> bytes:
    return np.concatenate(parts).tobytes()


def flags(parts: list[np.ndarray] | np.ndarray) -> bytes:
    """Truth values, eight in a byte."""
    return np.packbits(np.concatenate(parts) if isinstance(parts, list) else parts).tobytes()


def from_flags(data: bytes) -> np.ndarray:
    """The values of :func:`flags`, and up to seven more."""
    return np.unpackbits(np.frombuffer(data, np.uint8)).astype(bool)


def quarters(values: np.ndarray) -> bytes:
    """Numbers under four, four in a byte."""
    padded = np.concatenate((values, np.zeros(-len(values) % 4, np.uint8))).reshape(-1, 4)
    return (padded << np.arange(0, 8, 2, dtype=np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()


def from_quarters(data: bytes) -> np.ndarray:
    """The numbers of :func:`quarters`, and up to three more."""
    return ((np.frombuffer(data, np.uint8)[:, None] >> np.arange(0, 8, 2, dtype=np.uint8)) & 3).ravel()


#: Leading bits of an anchor that the first question names, and the step between neighbours that stands for a gap without a key.
NAMED, GAP = 38, (1 << 24) - 1


def steps(parts: list[np.ndarray]) -> bytes:
    """Leading bits of sorted keys, chunk by chunk, as steps of three bytes from one to the next. Most keys take one step."""
    out = []
    for keys in parts:
        skip, step = np.divmod(np.diff(keys >> U(64 - NAMED), prepend=U(0)), U(GAP))
        skip[0], step[0] = 0, 0                         # the first stands before the steps
        coded = np.full(len(keys) + int(skip.sum()), GAP, np.uint32)
        coded[np.arange(len(keys)) + np.cumsum(skip.astype(np.int64))] = step
        head = np.array([len(coded), int(keys[0] >> U(64 - NAMED))], np.int64)
        out.append(head.tobytes() + coded.view(np.uint8).reshape(-1, 4)[:, :3].tobytes())
    return b"".join(out)


def from_steps(data: bytes) -> np.ndarray:
    """The leading bits of all keys of :func:`steps`."""
    out, at = [np.zeros(0, np.int64)], 0
    while at < len(data):
        n, first = np.frombuffer(data, np.int64, 2, at).tolist()
        coded = np.zeros((n, 4), np.uint8)
        coded[:, :3] = np.frombuffer(data, np.uint8, 3 * n, at + 16).reshape(n, 3)
        coded = coded.view(np.uint32).ravel()
        out.append(first + np.cumsum(coded, dtype=np.int64)[coded != GAP])
        at += 16 + 3 * n
    return np.concatenate(out)


def shared(table: pa.Table) -> pa.Table:
    """For every key of a shard that :func:`steps` names: one bit, whether more than one document may hold it."""
    keys = [from_steps(k) for k in table.column("keys").to_pylist()]
    more = [from_flags(m)[:len(k)] for k, m in zip(keys, table.column("more").to_pylist())]
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    found = np.bincount(which, minlength=len(distinct)) + np.bincount(which, np.concatenate(more), minlength=len(distinct)) > 1
    return reply(0, table, [flags(part) for part in np.split(found[which], np.cumsum([len(k) for k in keys])[:-1])])


def ask(chunk: int, blocks: Blocks, bits: int) -> pa.Table:
    """The packed questions of a chunk: is this anchor in another document?"""
    several = blocks.in_several_rows()
    rows = [(s, chunk, blocks.distinct[a:b].tobytes(), np.packbits(several[a:b]).tobytes()) for s, a, b in by_shard(blocks.distinct, bits)]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["shard", "chunk", "keys", "more"])


def reply(step: int, table: pa.Table, answers: list[np.ndarray | bytes]) -> pa.Table:
    """Answers of a shard to its chunks, in the order of the questions."""
    return pa.Table.from_arrays([table.column("chunk").combine_chunks(), pa.array([step] * table.num_rows, pa.int32()), table.column("shard").combine_chunks(),
                                 pa.array([a if isinstance(a, bytes) else a.tobytes() for a in answers], pa.binary())], schema=REPLY_SCHEMA)


def answer(table: pa.Table) -> pa.Table:
    """For every question of a shard: one bit, whether more than one document holds the anchor."""
    keys = [np.frombuffer(k, U) for k in table.column("keys").to_pylist()]
    more = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(k)) for k, m in zip(keys, table.column("more").to_pylist())]
    sizes = [len(k) for k in keys]
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    shared = np.bincount(which, minlength=len(distinct)) + np.bincount(which, np.concatenate(more), minlength=len(distinct)) > 1
    return reply(1, table, [np.packbits(part) for part in np.split(shared[which], np.cumsum(sizes)[:-1])])


def shared_blocks(blocks: Blocks, replies: pa.Table, bits: int) -> np.ndarray:
    """Which blocks have an anchor that another document has too, by the replies to :func:`ask`."""
    sizes = [high - low for _, low, high in by_shard(blocks.distinct, bits)]
    flags = [np.unpackbits(np.frombuffer(part, np.uint8), count=n) for part, n in zip(in_order(replies, 1), sizes, strict=True)]
    return np.concatenate(flags).astype(bool)[blocks.which] if flags else np.zeros(0, bool)


def in_order(replies: pa.Table, step: int) -> list[bytes]:
    """The answers to one step by shard."""
    steps, shards = replies.column("step").to_numpy(), replies.column("shard").to_numpy()
    rows = np.flatnonzero(steps == step)
    rows = rows[np.argsort(shards[rows])]
    return replies.column("bits").take(pa.array(rows)).to_pylist()
