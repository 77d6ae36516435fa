"""Alignment of two tokenizers on the same texts by coalescing intervals, and how often ids of both are linked.

Tokens of both sides are byte ranges of a text. All of a batch, moved apart by text, are sorted by start (lexsort, side A
before side B); the running maximum of their ends breaks them into groups wherever a start reaches it, so a group ends
where tokens of both sides end together. Inside a group the B tokens that overlap an A token are one run of B tokens;
these runs are expanded into links. ``links="end"`` keeps those links whose two tokens end at the same byte.

Counts of linked id pairs are summed per packed chunk of texts first, then on Spark; each chunk asks for its own distinct
pairs and gets their counts by a join, so no token and no link is shuffled by itself and nothing is sent to every task
unless the optimizer's own size check does it. The pairs of one B id are as many as the vocabulary of A at most.

Side A encodes a blank and the text with a byte-level vocabulary (its special strings are plain text), side B the text with
a sentencepiece model that adds the blank itself. Texts that are null, empty, or not given back byte by byte by both
sides have no tokens. Rows without id are dropped; repeated rows stay and count each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.pretokens import Encoder, byte_letters
from metricloom.llm.shared import stored, texts
from metricloom.llm.textarrays import slices, utf8

_CHUNK = ("chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, "
          "codes binary, a array<int>, b array<int>, n array<long>")


class Sides:
    """Both vocabularies: encoders, and the bytes and lengths of every id."""

    def __init__(self, path_a: str, path_b: str):
        self.a = Encoder(path_a, words=False)
        self.a.special = {}                             # their strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        back = {letter: byte for byte, letter in byte_letters().items()}
        own = self.a.tokenizer
        pieces = [own.id_to_token(i) or "" for i in range(own.get_vocab_size(with_added_tokens=True))]
        self.bytes_a = [bytes(back[c] for c in p) if all(c in back for c in p) else p.encode() for p in pieces]
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.length_a, self.length_b = (np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        self.names = np.array([f"{i}" for i in range(max(len(self.bytes_a), len(self.bytes_b)))], object)
        self.named = {mark: self.names + mark for mark in ",|;"}

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()


@lru_cache(1)
def sides(path_a: str, path_b: str) -> Sides:
    return Sides(path_a, path_b)


def intervals(both: Sides, rows: list[str]) -> tuple[np.ndarray, ...]:
    """Ids of all texts and their offsets, A and then B; texts that a side doesn't give back have none."""
    ids_a, offsets_a = both.a.ids([" " + t for t in rows])
    listed, other = ids_a.tolist(), both.b.encode(rows, out_type=int, num_threads=1)
    good = np.ones(len(rows), bool)
    for i, (text, low, high) in enumerate(zip(rows, offsets_a[:-1].tolist(), offsets_a[1:].tolist())):
        want = b" " + text.encode()
        if not text or b"".join(map(both.bytes_b.__getitem__, other[i])) != want or b"".join(map(both.bytes_a.__getitem__, listed[low:high])) != want:
            good[i], other[i] = False, []
    sizes = np.diff(offsets_a)
    ids_b = np.fromiter(chain.from_iterable(other), np.int64, sum(map(len, other)))
    borders = [np.concatenate(([0], np.cumsum(n))).astype(np.int64) for n in (sizes * good, [len(own) for own in other])]
    return ids_a[np.repeat(good, sizes)], borders[0], ids_b, borders[1]


def coalesced(start_a, end_a, start_b, end_b) -> tuple[np.ndarray, np.ndarray]:
    """The group of every A token and of every B token: groups break where a start reaches the greatest end so far."""
    start, end = np.concatenate((start_a, start_b)), np.concatenate((end_a, end_b))
    order = np.lexsort((np.arange(len(start)) >= len(start_a), start))
    reach = np.maximum.accumulate(end[order]) if len(start) else end
    group = np.empty(len(start), np.int64)
    group[order] = np.concatenate(([0], np.cumsum(start[order][1:] >= reach[:-1]))) if len(start) else 0
    return group[:len(start_a)], group[len(start_a):]


def expanded(start_a, end_a, start_b, end_b) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (place of an A token, place of a B token) whose ranges overlap; both sides ascend."""
    low, high = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
    count = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(start_a)), count)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)


def _written(both: Sides, ids_a, ids_b, group_a, group_b, offsets_a, offsets_b) -> list[str]:
    """Every text's groups as ``a1,a2|b1;a3|b2,b3``."""
    ids, group = np.concatenate((ids_a, ids_b)), np.concatenate((group_a, group_b))
    side = np.arange(len(ids)) >= len(ids_a)
    order = np.lexsort((side, group))
    ids, group, side = ids[order], group[order], side[order]
    parts, last = both.named[","][ids], np.zeros(len(ids), bool)
    if len(ids):
        new_group, new_side = group[1:] != group[:-1], side[1:] != side[:-1]
        where = np.flatnonzero(new_side & ~new_group)
        parts[where] = both.named["|"][ids[where]]
        where = np.flatnonzero(new_group)
        parts[where] = both.named[";"][ids[where]]
        borders = offsets_a + offsets_b
        last[borders[1:][borders[1:] > borders[:-1]] - 1] = True
        parts[last] = both.names[ids[last]]
    parts = parts.tolist()
    borders = (offsets_a + offsets_b).tolist()
    return ["".join(parts[x:y]) for x, y in zip(borders[:-1], borders[1:])]


def chunks(docs: DataFrame, path_a: str, path_b: str, links: str = "overlap", digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed chunks of aligned texts: per text its counts and written groups (``digest``: their sha256, '' without tokens);
    ``codes`` (the place of each link's pair among the chunk's distinct pairs), and those pairs ``a, b`` with their number of
    links ``n``."""
    if links not in ("overlap", "end"):
        raise ValueError(f"unknown links {links!r}")

    def align(batch):
        both, (_, offsets) = sides(path_a, path_b), utf8(batch.column("text"))
        for low, high in slices(offsets, 1 << 20):
            part = batch.slice(low, high - low)
            a, offsets_a, b, offsets_b = intervals(both, part.column("text").to_pylist())
            ends_a, ends_b = np.cumsum(both.length_a[a]), np.cumsum(both.length_b[b])      # both sides cover the same bytes: texts stay apart
            starts_a, starts_b = ends_a - both.length_a[a], ends_b - both.length_b[b]
            group_a, group_b = coalesced(starts_a, ends_a, starts_b, ends_b)
            x, y = expanded(starts_a, ends_a, starts_b, ends_b)
            if links == "end":
                same = ends_a[x] == ends_b[y]
                x, y = x[same], y[same]
            width = len(both.bytes_b)
            pairs, codes, counts = np.unique(a[x] * width + b[y], return_inverse=True, return_counts=True)
            firsts = np.zeros(len(a) + 1, np.int64)
            np.cumsum(np.diff(group_a, prepend=-1) > 0, out=firsts[1:])
            n_groups, n_links = np.diff(firsts[offsets_a]), np.diff(np.searchsorted(x, offsets_a))
            written = _written(both, a, b, group_a, group_b, offsets_a, offsets_b)
            if digest:
                written = [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in written]
            codes = codes.astype(np.min_scalar_type(max(len(pairs) - 1, 0)))
            row = {"doc_id": part.column("doc_id").to_pylist(), "n_a": np.diff(offsets_a), "n_b": np.diff(offsets_b), "n_groups": n_groups, "n_links": n_links,
                   "groups": written, "codes": codes.tobytes(), "a": (pairs // width).astype(np.int32), "b": (pairs % width).astype(np.int32), "n": counts}
            yield pa.record_batch([pa.array([v], t) for v, t in zip(row.values(), [pa.list_(pa.int64())] * 5 + [pa.list_(pa.string()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())])], list(row))

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                yield from align(batch.slice(low, 1000))
    found = texts(docs, id_col, text_col).mapInArrow(run, _CHUNK.removeprefix("chunk long, "))
    return found.withColumn("chunk", F.monotonically_increasing_id())


def pair_counts(packed: DataFrame) -> DataFrame:
    """``a, b, n`` (links of the pair in all texts) and ``best``: no other pair of the same B id has more."""
    pairs = packed.select(F.inline(F.arrays_zip("a", "b", "n"))).groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = stored(pairs, "pairs")
    return pairs.join(pairs.groupBy("b").agg(F.max("n").alias("most")), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, links: str = "overlap", digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best`` (links whose pair is the most frequent of its B id, ties included),
    ``count_sum`` (the pairs' counts, over links) and ``groups`` (``digest``: their sha256, '' without tokens)."""
    packed = stored(chunks(docs, path_a, path_b, links, digest, id_col, text_col), "aligned")
    asked = packed.select(F.col("chunk").alias("of"), F.posexplode(F.arrays_zip("a", "b")).alias("at", "p")).select("of", "at", "p.a", "p.b")
    replies = asked.join(pair_counts(packed), ["a", "b"]).select("of", "at", "n", "best")

    def fill(key, own, found):
        n, best = np.zeros(found.num_rows, np.int64), np.zeros(found.num_rows, np.int64)
        at = found.column("at").to_numpy()
        n[at], best[at] = found.column("n").to_numpy(), found.column("best").to_numpy(zero_copy_only=False)
        lists = {c: own.column(c).combine_chunks().flatten() for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")}
        borders = np.concatenate(([0], np.cumsum(lists["n_links"].to_numpy())))
        codes = np.frombuffer(own.column("codes")[0].as_py(), f"u{max(1, own.column('codes')[0].as_buffer().size // max(1, int(borders[-1])))}")
        for name, values in (("n_best", best), ("count_sum", n)):
            total = np.concatenate(([0], np.cumsum(values[codes])))
            lists[name] = pa.array(total[borders[1:]] - total[borders[:-1]])
        order = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
        return pa.Table.from_arrays([lists[c] for c in order], list(order))
    whole = packed.select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "codes")
    return whole.groupBy("chunk").cogroup(replies.groupBy("of")).applyInArrow(
        fill, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
