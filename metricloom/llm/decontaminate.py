"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

A-Z are lower-cased; words are runs of ASCII letters, digits and all characters above ASCII. The automaton
holds every run of words of every item. Documents stream through it: after each word it knows the longest
item passage that ends there. A document word is hit if it lies in an occurrence of ``window`` consecutive
item words, or of a whole item that has fewer. Only stretches of a document whose short word grams occur in
an item at all are streamed; all others cannot hold a window.

Items go in blocks of bounded size; each block has its own automaton and its own pass, one after the other,
and the passes are united, so nothing that a task, the driver or a broadcast holds grows with the benchmark.
Nulls have no words and are never hit. Empty items are ignored; equal items each count. Without items nothing
is hit. Repeated rows stay repeated at any size of the benchmark; rows without id are dropped.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.shared import map_batches, stored, texts
from metricloom.llm.textarrays import LOWER, WORD, Spans, inside, runs, slices, utf8, words


class Automaton:
    """Suffix automaton of several word sequences (64-bit word hashes), with the items that hold each window."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.windows: dict[tuple[int, int], set[str]] = {}
        items = [(name, item) for name, item in items if item]
        for _, item in items:
            last = 0
            for word in item:
                last = self._extend(last, word)
        self.sizes = sorted({min(window, len(item)) for _, item in items}, reverse=True)
        for name, item in items:
            size = min(window, len(item))
            state = matched = 0
            for word in item:
                state, matched = self.step(state, matched, word)
                if matched >= size:
                    self.windows.setdefault((self._of(state, size), size), set()).add(name)

    def _extend(self, last: int, word: int) -> int:
        """Add a word after the state ``last``; sequences share states."""
        known = self.next[last].get(word)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._copy(last, word, known)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, word, q)
        return new

    def _state(self, length: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1

    def _copy(self, p: int, word: int, q: int) -> int:
        """Split the passages of ``q`` no longer than those of ``p`` and ``word`` off into a state of their own."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def step(self, state: int, matched: int, word: int) -> tuple[int, int]:
        """State and length of the longest passage that ends with ``word``."""
        while word not in self.next[state]:
            state = self.link[state]
            if state < 0:
                return 0, 0
            matched = self.length[state]
        return self.next[state][word], matched + 1

    def _of(self, state: int, size: int) -> int:
        """The state that holds the last ``size`` words of a longer passage."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def found(self, state: int, matched: int):
        """The windows that end here: their sizes and items."""
        for size in self.sizes:
            if size <= matched and (items := self.windows.get((self._of(state, size), size))):
                yield size, items


def _scan(automaton: Automaton, grams: dict[int, np.ndarray], hashes: np.ndarray, offsets: np.ndarray):
    """Hit spans by row: (row, first word, one past the last, items) of every stretch of hit words."""
    candidates = np.zeros(len(hashes) + 1, np.int64)
    spans = Spans(hashes)
    for k, known in grams.items():                      # one entry: the shortest window
        own = spans.grams(k)
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        starts = np.flatnonzero((known[at] == own) & inside(offsets, k))
        np.add.at(candidates, starts, 1)
        np.add.at(candidates, starts + k, -1)
    stretch = np.cumsum(candidates[:-1]) > 0
    out = []
    for start, end in zip(*map(np.ndarray.tolist, runs(stretch, offsets))):
        state = matched = 0
        low, high, items = -1, -1, set()
        row = int(np.searchsorted(offsets, start, side="right")) - 1
        for i, word in enumerate(hashes[start:end].tolist(), start):
            state, matched = automaton.step(state, matched, word)
            for size, own in automaton.found(state, matched):
                first = i + 1 - size
                if first > high and high >= 0:
                    out.append((row, low, high, items))
                    low, items = first, set()
                low = first if high < 0 else min(low, first)
                high = i + 1
                items |= own
        if high >= 0:
            out.append((row, low, high, items))
    return out


def _blocks(items: DataFrame, block_words: int) -> list[DataFrame]:
    """Items in blocks of about ``block_words`` bytes of text at most."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_words)
    return [items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i) for i in range(n)] if n > 1 else [items]


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 2 << 20, carry: bool = False) -> DataFrame:
    """``doc_id, n_words, spans (array of struct<first, last>: hit word ranges), items (array of string)`` of every document,
    one row for each row of ``docs`` with an id; ``carry`` adds the text.

    ``block_bytes``: item text one automaton is built of. A larger benchmark is divided; its blocks are scanned one after
    the other over a written copy of the documents with a number for each row, and every pass is written, so that one
    automaton exists at a time and equal rows stay apart.
    """
    docs = texts(docs, id_col, text_col)
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("item_id is not null and text is not null")
    blocks = _blocks(items, block_bytes)
    if len(blocks) == 1:
        return _pass(docs, blocks[0], window, carry)
    docs = stored(docs.withColumn("row", F.monotonically_increasing_id()), "documents")
    united = reduce(DataFrame.unionByName, [stored(_pass(docs, block, window), "hits") for block in blocks])
    found = united.groupBy("row", "doc_id", "n_words").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return (found.join(docs.select("row", "text"), "row") if carry else found).drop("row")


def cleaned(docs: DataFrame, benchmark: DataFrame, least_words: int = 13, coverage: int = 20, **more) -> DataFrame:
    """``doc_id, text, n_removed`` of the documents that are kept, without their benchmark passages.

    Stretches of ``least_words`` hit words and more are cut, from the first byte of the first word to the last of the last
    one; overlapping spans, also of several blocks, are one stretch. A document of whose words one in ``coverage`` or more
    is hit is dropped. ``more`` goes to :func:`hits`.
    """
    found = hits(docs, benchmark, carry=True, **more)
    flags = judged(found.withColumn("kept", F.struct("text", "spans")), coverage, "kept").where("not contaminated")

    def work(batch):
        rows, removed = batch.column("kept").to_pylist(), []
        data, offsets = utf8(pa.array([r["text"] for r in rows], pa.string()))
        starts, ends, _, before = words(LOWER[data], offsets, WORD)
        texts_, whole = [], data.tobytes()
        for i, row in enumerate(rows):
            spans = []
            for span in sorted((x["first"], x["last"]) for x in row["spans"]):
                if spans and span[0] <= spans[-1][1] + 1:
                    spans[-1][1] = max(spans[-1][1], span[1])
                else:
                    spans.append(list(span))
            parts, at, n = [], int(offsets[i]), 0
            for first, last in spans:
                if last - first + 1 >= least_words:
                    parts.append(whole[at:int(starts[before[i] + first])])
                    at, n = int(ends[before[i] + last]), n + last - first + 1
            texts_.append(b"".join((*parts, whole[at:int(offsets[i + 1])])).decode())
            removed.append(n)
        return pa.record_batch([batch.column("doc_id"), pa.array(texts_, pa.string()), pa.array(removed, pa.int64())], ["doc_id", "text", "n_removed"])
    return map_batches(flags.select("doc_id", "kept"), work, "doc_id long, text string, n_removed long", rows=200)


def _pass(docs: DataFrame, block: DataFrame, window: int, carry: bool = False) -> DataFrame:
    rows = block.toArrow()                              # bounded by the block size
    data, offsets = utf8(rows.column("text"))
    _, _, hashes, before = words(LOWER[data], offsets, WORD)
    items = [(name, hashes[a:b].tolist()) for name, a, b in zip(rows.column("item_id").to_pylist(), before[:-1], before[1:])]
    automaton = Automaton(items, window)
    grams = {}
    if automaton.sizes:
        k = min(automaton.sizes)
        grams[k] = np.unique(Spans(hashes).grams(k)[inside(before, k)])

    def work(batch):
        data, offsets = utf8(batch.column("text"))
        n_words, spans, items = [], [[] for _ in range(batch.num_rows)], [set() for _ in range(batch.num_rows)]
        for low, high in slices(offsets):
            own = offsets[low:high + 1]
            _, _, hashes, before = words(LOWER[data[own[0]:own[-1]]], own - own[0], WORD)
            n_words.append(np.diff(before))
            if grams:
                for row, first, last, names in _scan(automaton, grams, hashes, before):
                    spans[low + row].append({"first": first - int(before[row]), "last": last - 1 - int(before[row])})
                    items[low + row] |= names
        first = ["row"] if "row" in batch.schema.names else []
        last = ["text"] if carry else []
        return pa.record_batch([*map(batch.column, first), batch.column("doc_id"), pa.array(np.concatenate(n_words)), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                                pa.array([sorted(i) for i in items], pa.list_(pa.string())), *map(batch.column, last)], [*first, "doc_id", "n_words", "spans", "items", *last])

    schema = ("row long, " * ("row" in docs.columns) + "doc_id long, n_words long, spans array<struct<first:long,last:long>>, items array<string>"
              + ", text string" * carry)
    return map_batches(docs, work, schema)


def judged(found: DataFrame, coverage: int = 20, *more: str) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` from the spans of :func:`hits`, and ``more`` of its columns.

    Overlapping spans of several blocks count each word once. Contaminated: at least one word in ``coverage`` is hit.
    """
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"))

    def add(so_far, span):
        new = F.greatest(F.lit(0).cast("long"), span["last"] - F.greatest(span["first"] - 1, so_far["end"]))
        return F.struct((so_far["n"] + new).alias("n"), F.greatest(so_far["end"], span["last"]).alias("end"))

    n_hit = F.aggregate(F.array_sort("spans"), nothing, add)["n"]
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), *more
                        ).withColumn("contaminated", (F.col("n_hit") > 0) & (coverage * F.col("n_hit") >= F.col("n_words")))
