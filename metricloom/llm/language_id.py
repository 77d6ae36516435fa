"""Language identification by n-gram filters that answer with a bit mask of languages.

Every byte 4-gram of lower-cased text whose two middle bytes belong to letters is a feature. A bit-sliced
Bloom filter holds, at each of its slots, one bit per language; the AND over the slots of a 4-gram is the
set of all languages that contain it. The popcount of each language over a document, corrected for the
false-positive rate of that language's slice, decides.

Nulls, and texts without a letter, are ``und`` with score 0. Texts with letters but without a known
4-gram get the commonest language with score 0. Ties go to the commoner language, then by name. Without
any labelled row everything is ``und``. Repeated rows are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.llm.shared import map_batches
from metricloom.llm.textarrays import LOWER, U, byte_table, chosen, mix, slices, utf8

LETTER = byte_table((0x61, 0x7A), (0x80, 0xFF))
ASCII_LETTER = byte_table((0x61, 0x7A))
_SPACED = np.where(LETTER[LOWER], LOWER, 0x20).astype(np.uint8)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """4-grams of all rows as numbers, each row with a blank on either side, and the rows' offsets in them."""
    rows = len(offsets) - 1
    padded = np.full(len(data) + 2 * rows + 2, 0x20, np.uint8)
    at = np.arange(len(data)) + np.repeat(1 + 2 * np.arange(rows), np.diff(offsets))
    padded[at] = _SPACED[data]
    borders = offsets + 2 * np.arange(rows + 1)
    keep = np.zeros(int(borders[-1]), bool)
    n = len(keep) - 3
    if n > 0:
        letter = padded != 0x20
        keep[:n] = letter[1:n + 1] & letter[2:n + 2]
    wide = padded.astype(np.uint32)
    all_grams = wide[:-3] << 24
    all_grams |= wide[1:-2] << 16
    all_grams |= wide[2:-1] << 8
    all_grams |= wide[3:]
    found = np.flatnonzero(keep)
    return all_grams[found], np.searchsorted(found, borders)


@dataclass
class Model:
    """Languages, commonest first, slots with a bit per language in each 64-bit column, and each slice's false-positive rate."""
    languages: list[str]
    slots: np.ndarray
    hashes: int
    false_rate: np.ndarray


def _places(values: np.ndarray, size: int, hashes: int) -> list[np.ndarray]:
    h = mix(values.astype(U) * U(0x9E3779B97F4A7C15) + U(1))
    low, high = h & U(0xFFFFFFFF), (h >> U(32)) | U(1)
    return [((low + U(i) * high) & U(size - 1)).astype(np.int64) for i in range(hashes)]


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 3000,
        least_share: float = 4e-6, hashes: int = 3, order_col: str = "doc_id") -> Model:
    """Learn the filters from labelled rows.

    The sample is bounded by parameters: about ``docs_per_language`` rows of each language, chosen by a hash of
    ``order_col``, and the 4-grams that make up ``least_share`` of a language's at least, so 1 / ``least_share`` at most.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(order_col).alias("key"))
    rows = rows.where("text is not null and lang is not null and lang <> 'und'")
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()        # one row per language
    languages = [r["lang"] for r in sizes]
    if not languages:
        return Model([], np.zeros((1, 1), U), hashes, np.zeros(0))
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col("lang") == r["lang"], min(1.0, docs_per_language / r["count"])).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share * (1 << 30)).select("text", "lang")

    def count(batch):
        data, offsets = utf8(batch.column("text"))
        langs = np.array(batch.column("lang").to_pylist(), object)
        values, borders = grams(data, offsets)
        out = []
        for lang in dict.fromkeys(langs):
            own = np.repeat(langs == lang, np.diff(borders))
            found, n = np.unique(values[own], return_counts=True)
            out.append(pa.record_batch([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out and sum(len(b) for b in out) else None

    counts = map_batches(sample, count, "lang string, gram long, n long", rows=None).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = counts.join(F.broadcast(totals), "lang").where(F.col("n") >= F.col("total") * least_share)     # one total per language
    found = kept.select("lang", "gram").toArrow()        # at most 1 / least_share rows a language
    of, values = np.array(found.column("lang").to_pylist(), object), found.column("gram").to_numpy()
    best = {i: values[of == lang] for i, lang in enumerate(languages)}
    size = 1 << int(np.ceil(np.log2(max(1024, 12 * max(len(v) for v in best.values())))))
    slots = np.zeros((size, -(-len(languages) // 64)), U)
    for i, found in best.items():
        for place in _places(found, size, hashes):
            slots[place, i // 64] |= U(1 << (i % 64))
    filled = np.array([np.mean((slots[:, i // 64] >> U(i % 64)) & U(1)) for i in range(len(languages))])
    return Model(languages, slots, hashes, filled ** hashes)


def _judge(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, borders = grams(data, offsets)
    masks = None
    for place in _places(values, len(model.slots), model.hashes):
        masks = model.slots[place] if masks is None else masks & model.slots[place]
    n = np.diff(borders).astype(float)
    shares = np.zeros((len(n), len(model.languages)))
    for i in range(len(model.languages)):
        hits = chosen((masks[:, i // 64] >> U(i % 64)) & U(1), borders)
        wrong = model.false_rate[i]
        shares[:, i] = (hits - n * wrong) / np.maximum(n * (1 - wrong), 1e-9)
    return shares.argmax(axis=1), np.where(n > 0, np.clip(shares.max(axis=1), 0.0, 1.0), 0.0)


def identify(docs: DataFrame, model: Model, text_col: str = "text", unnamed: str | None = "und") -> DataFrame:
    """Documents with ``lang_pred`` (string) and ``score`` (the corrected share of 4-grams the language holds, 0 to 1).

    Columns that had these names are replaced. Texts with letters are ``unnamed`` if the model has no languages.
    """
    def predict(batch):
        column = batch.column(text_col)
        data, offsets = utf8(column)
        plain = chosen(ASCII_LETTER[LOWER[data]], offsets) > 0
        langs, scores = [], []
        for low, high in slices(offsets):
            own = offsets[low:high + 1]
            if model.languages:
                best, score = _judge(model, data[own[0]:own[-1]], own - own[0])
            else:
                best, score = np.zeros(high - low, int), np.zeros(high - low)
            for row, b, s in zip(range(low, high), best, score):
                letters = plain[row] or any(map(str.isalpha, bytes(data[offsets[row]:offsets[row + 1]]).decode()))
                known = letters and model.languages
                langs.append(model.languages[b] if known else unnamed if letters else "und")
                scores.append(float(s) if known else 0.0)
        return batch.append_column("lang_pred", pa.array(langs, pa.string())).append_column("score", pa.array(scores, pa.float64()))

    rest = docs.drop("lang_pred", "score")
    return map_batches(rest, predict, T.StructType([*rest.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
