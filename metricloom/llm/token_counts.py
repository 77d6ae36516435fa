"""Token counts of whole texts under a word vocabulary, without merging most words.

Offline, once per vocabulary, every vocabulary string is proven or not to be a pre-token that encodes alone
as one token. Pre-tokens that match a proven string count as one directly; only the rest is merged, each
distinct one once while a task remembers it.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted each. Texts of any length are
read in whole. Strings of special tokens inside texts count as one token, as the library has it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from metricloom.llm.pretokens import byte_letters, encoder, groups, split
from metricloom.llm.shared import map_batches, texts
from metricloom.llm.textarrays import U, distinct, utf8


@lru_cache
def proven(path: str) -> np.ndarray:
    """Sorted hashes of the vocabulary strings that are one pre-token and encode to one token."""
    own = encoder(path, True)
    byte_of = {c: b for b, c in byte_letters().items()}
    strings = []
    for piece in own.tokenizer.get_vocab(with_added_tokens=False):
        piece = piece.removesuffix("</w>")
        try:
            strings.append(bytes(byte_of[c] for c in piece).decode())
        except (KeyError, UnicodeDecodeError):
            continue                                    # part of a character: never a whole pre-token
    strings = [s for s in dict.fromkeys(strings) if s]
    p = split(strings, True, {})
    alone = np.flatnonzero(np.diff(p.offsets) == 1)
    at = p.offsets[alone]
    whole = [int(h) for s, a, h in zip(alone.tolist(), at.tolist(), p.hashes[at].tolist())
             if p.text[p.starts[a]:p.ends[a]] == strings[s] and len(own.merge(strings[s])) == 1]
    return np.sort(np.array(whole, U))


_merged: dict[str, dict[int, int]] = {}


def _counts(path: str, single: np.ndarray, rows: list[str], memory: int) -> np.ndarray:
    own, known = encoder(path, True), _merged.setdefault(path, {})
    out = []
    for low, high in groups(rows):
        p = split(rows[low:high], True, own.special)
        hashes, first, which = distinct(p.hashes)
        sizes = np.ones(len(hashes), np.int64)
        place = np.minimum(np.searchsorted(single, hashes), len(single) - 1)
        rest = np.flatnonzero(single[place] != hashes)
        if len(known) > memory:
            known.clear()
        for i, h, start, end in zip(rest.tolist(), hashes[rest].tolist(), p.starts[first[rest]].tolist(), p.ends[first[rest]].tolist()):
            n = known.get(h)
            if n is None:
                known[h] = n = len(own.model.tokenize(own.spell(p.text[start:end])))
            sizes[i] = n
        sums = np.concatenate(([0], np.cumsum(sizes[which])))
        counts = np.diff(sums[p.offsets])
        for row, _, _ in p.special:
            counts[row] += 1
        out.append(counts)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text",
                 memory: int = 1 << 21) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document; ``memory``: distinct merged words a process remembers."""
    single = proven(path)

    def work(batch):
        column = batch.column("text")
        _, offsets = utf8(column)
        n = _counts(path, single, column.to_pylist(), memory)
        return pa.record_batch([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(texts(docs, id_col, text_col), work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
