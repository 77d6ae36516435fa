"""Document scores by masked pseudo-likelihood: every token is predicted from the tokens on both sides of it.

Tokens are words (runs of ASCII letters and digits and all characters above ASCII, A-Z lower-cased), each hashed to one
of ``buckets``. Corpus counts of the buckets, over all documents, cut the buckets into classes of about equal mass. A
window network with one hidden layer predicts from the neighbours of a token its class, and its bucket inside the class.
The word's share of its bucket comes from the counts of all distinct words; one count is left for words never counted.
So the words of a bucket share what the network knows of them, but not their frequency. The sum of the
log-probabilities of all tokens scores the document.

Distinct words, named by 64-bit hashes, are counted on Spark and kept as a table, packed by shards of hash values. To
score, documents meet in chunks by a hash of their id; a chunk asks each shard about its distinct words once.

The network is trained in numpy on every token of every document: each task starts from the same weights, runs through
its documents in mini-batches, and gives its weights and its number of tokens; their weighted mean is the next start.
The driver sees one set of weights and one count per bucket, whatever the corpus; the word counts stay on Spark.

Nulls and texts without words have 0 tokens, score 0 and no mean. Repeated rows are trained on and scored each. An empty
corpus leaves the weights as they start, and all buckets equally likely.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm import anchors
from metricloom.llm.shared import chunk_count, chunked, stored, texts, unpacked
from metricloom.llm.textarrays import LOWER, WORD, U, distinct, slices, utf8, words

#: Leading bits of a word's hash that name its shard, and tokens a task counts before it gives their words on.
SHARD_BITS, HELD = 10, 1 << 22
#: Text bytes, in whole rows, whose words are hashed at a time.
SPAN = 1 << 18


@dataclass
class Model:
    """Weights of the network and the corpus counts it scores with."""
    buckets: int
    window: int
    hidden: int
    class_of: np.ndarray
    inside: np.ndarray                                  # log share of every bucket in its class
    weights: np.ndarray
    place: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))        # buckets by class
    borders: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))      # of the classes in them
    seen: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))         # tokens of the counted words of every bucket
    counted: DataFrame | None = None                    # ``shard, keys, counts``: the distinct words, packed

    @property
    def classes(self) -> int:
        return int(self.class_of.max()) + 1

    def parts(self, flat: np.ndarray | None = None) -> list[np.ndarray]:
        """Views of the flat weights: contexts by position and bucket (the last: no token), hidden bias, output, output bias, output of the buckets by place."""
        flat = self.weights if flat is None else flat
        shapes = ((2 * self.window, self.buckets + 1, self.hidden), (self.hidden,), (self.hidden, self.classes), (self.classes,), (self.buckets, self.hidden))
        out, at = [], 0
        for shape in shapes:
            size = int(np.prod(shape))
            out.append(flat[at:at + size].reshape(shape))
            at += size
        return out


def tokens(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, and the rows' offsets in them."""
    hashes, before = hashed(data, offsets)
    return (hashes % U(buckets)).astype(np.int32), before


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the rows' offsets in them; ``SPAN`` bytes of text at a time, as hashing takes many times its text."""
    hashes, before, n = [np.zeros(0, U)], [np.zeros(1, np.int64)], 0
    for low, high in slices(offsets, SPAN):
        own = offsets[low:high + 1]
        _, _, found, ends = words(LOWER[data[own[0]:own[-1]]], own - own[0], WORD)
        hashes.append(found)
        before.append(ends[1:] + n)
        n += len(found)
    return np.concatenate(hashes), np.concatenate(before)


def contexts(ids: np.ndarray, before: np.ndarray, window: int, none: int) -> np.ndarray:
    """Neighbours of every token by position; ``none`` beyond its document."""
    n, out = len(ids), np.full((2 * window, len(ids)), none, np.int32)
    row = np.repeat(np.arange(len(before) - 1), np.diff(before))
    for k in range(1, window + 1):
        same = row[k:] == row[:-k] if n > k else np.zeros(0, bool)
        if n > k:
            out[window - k, k:] = np.where(same, ids[:-k], none)
            out[window + k - 1, :-k] = np.where(same, ids[k:], none)
    return out


#: Rows of a matrix of scores at a time: larger ones are given fresh memory by the system, whose clearing costs more than the work.
PART = 4096
#: Scores of a smaller amount have exponentials, and sums of them, well inside the range of 32-bit floats.
SAFE = 60.0


def _softmax(logits: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Turn scores into exponentials, in place and once; log-probabilities of the targets, and the sums of the rows."""
    if not (-SAFE < logits.min(initial=0) and logits.max(initial=0) < SAFE):       # else no exponential leaves the range of its type
        logits -= logits.max(axis=1, keepdims=True)
    chosen = logits[np.arange(len(target)), target]
    np.exp(logits, out=logits)
    sums = logits @ np.ones(logits.shape[1], logits.dtype)
    return chosen - np.log(sums), sums


def hidden_values(model: Model, around: np.ndarray, flat: np.ndarray | None = None) -> np.ndarray:
    table, bias, _, _, _ = model.parts(flat)
    hidden = np.take(table[0], around[0], axis=0)
    for k in range(1, len(around)):
        hidden += np.take(table[k], around[k], axis=0)
    hidden += bias
    return np.tanh(hidden, out=hidden)


def outer(model: Model, hidden: np.ndarray, target: np.ndarray, flat: np.ndarray | None = None) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """For a part of the tokens at a time: its slice, the exponentials of its classes' scores, their sums, and the
    log-probabilities of the target classes."""
    _, _, out, out_bias, _ = model.parts(flat)
    for low in range(0, len(hidden), PART):
        some = slice(low, low + PART)
        logits = hidden[some] @ out
        logits += out_bias
        chosen, sums = _softmax(logits, target[some])
        yield some, logits, sums, chosen


def by_class(model: Model, ids: np.ndarray) -> np.ndarray:
    """The order of tokens by class, so that those of a class are one slice."""
    return np.argsort(model.class_of[ids].astype(np.min_scalar_type(model.classes)), kind="stable")


def inner(model: Model, hidden: np.ndarray, ids: np.ndarray, flat: np.ndarray | None = None) -> Iterator[tuple[slice, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For tokens by class, and every class with several buckets: the slice of its tokens, its first and last place, and as
    in :func:`outer` the exponentials, sums and log-probabilities of its buckets.

    The sizes of classes weighed by their mass are about ``buckets / classes``, so this costs a token no more than its class.
    """
    out = model.parts(flat)[4]
    share = np.empty(model.buckets, out.dtype)
    share[model.place] = model.inside
    edges, places = np.searchsorted(model.class_of[ids], np.arange(model.classes + 1)), model.place[ids]
    for c in np.flatnonzero((np.diff(edges) > 0) & (np.diff(model.borders) > 1)):
        low, high = int(model.borders[c]), int(model.borders[c + 1])
        for at in range(edges[c], edges[c + 1], PART):
            some = slice(at, min(at + PART, edges[c + 1]))
            logits = hidden[some] @ out[low:high].T
            logits += share[low:high]
            chosen, sums = _softmax(logits, places[some] - low)
            yield some, low, high, logits, sums, chosen


def log_probabilities(model: Model, around: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Log-probability of the bucket of every token, by its neighbours."""
    order = by_class(model, ids)
    ids = ids[order]
    hidden, found = hidden_values(model, around[:, order]), np.empty(len(ids))
    for some, _, _, chosen in outer(model, hidden, model.class_of[ids]):
        found[some] = chosen
    for some, _, _, _, _, chosen in inner(model, hidden, ids):
        found[some] += chosen
    out = np.empty(len(ids))
    out[order] = found
    return out


def gradient(model: Model, around: np.ndarray, target: np.ndarray, flat: np.ndarray, ids: np.ndarray | None = None) -> np.ndarray:
    """Gradient of the mean negative log-probability of the target classes; with ``ids``, of these buckets."""
    grad, n = np.zeros_like(flat), len(target)
    table, bias, out, out_bias, places = model.parts(grad)
    weights = model.parts(flat)
    if ids is not None:
        order = by_class(model, ids)
        around, target, ids = around[:, order], target[order], ids[order]
    hidden = hidden_values(model, around, flat)
    back, rows = np.empty_like(hidden), np.arange(n)
    for some, error, sums, _ in outer(model, hidden, target, flat):
        error /= sums[:, None]
        error[rows[:len(error)], target[some]] -= 1
        out += hidden[some].T @ error
        out_bias += error.sum(axis=0)
        np.matmul(error, weights[2].T, out=back[some])
    for some, low, high, wrong, sums, _ in inner(model, hidden, ids, flat) if ids is not None else ():
        wrong /= sums[:, None]
        wrong[rows[:len(wrong)], model.place[ids[some]] - low] -= 1
        places[low:high] += wrong.T @ hidden[some]
        back[some] += wrong @ weights[4][low:high]
    hidden *= hidden
    back *= 1 - hidden
    bias[:] = back.sum(axis=0)
    columns = np.ascontiguousarray(back.T)
    for k in range(len(around)):
        for j in range(model.hidden):
            table[k, :, j] = np.bincount(around[k], columns[j], minlength=model.buckets + 1)
    grad /= n
    return grad


def _split(docs: DataFrame, buckets: int) -> DataFrame:
    """One pass over the texts: ``shard, keys, counts`` with the distinct words of some tokens and their counts; and with
    shard -1, the buckets of the tokens of some rows and the rows' offsets in them."""
    kind = np.min_scalar_type(buckets - 1)

    def run(batches):
        held, size = [], 0

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["shard", "keys", "counts"])

        def given():
            hashes = np.concatenate(held)
            keys, _, which = distinct(hashes)
            order = np.argsort(keys)
            keys, n = keys[order], np.bincount(which, minlength=len(keys))[order]
            return batch_of([(s, keys[a:b].tobytes(), anchors.pack(n[a:b])) for s, a, b in anchors.by_shard(keys, SHARD_BITS)])

        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for low, high in slices(offsets):
                own = offsets[low:high + 1]
                hashes, before = hashed(data[own[0]:own[-1]], own - own[0])
                held.append(hashes)
                size += len(hashes)
                if len(hashes):
                    yield batch_of([(-1, (hashes % U(buckets)).astype(kind).tobytes(), before.astype(np.int64).tobytes())])
                if size >= HELD:
                    yield given()
                    held, size = [], 0
        if size:
            yield given()
    return docs.select("text").mapInArrow(run, "shard int, keys binary, counts binary")


def _token_batches(batches, buckets):
    kind = np.min_scalar_type(buckets - 1)
    for batch in batches:
        for ids, before in zip(batch.column("keys"), batch.column("counts")):
            yield np.frombuffer(ids.as_buffer(), kind).astype(np.int32), np.frombuffer(before.as_buffer(), np.int64)


def corpus_counts(docs: DataFrame, buckets: int) -> np.ndarray:
    """Number of tokens of every bucket over all documents."""
    return bucket_counts(word_counts(_split(docs, buckets)), buckets)


def bucket_counts(counted: DataFrame, buckets: int) -> np.ndarray:
    """Number of tokens of every bucket, from the counts of all distinct words."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for keys, counts in zip(batch.column("keys"), batch.column("counts")):
                np.add.at(total, (np.frombuffer(keys.as_buffer(), U) % U(buckets)).astype(np.int64), anchors.unpack(counts.as_py()))
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found.astype(np.int32)), pa.array(total[found])], ["bucket", "n"])

    rows = counted.select("keys", "counts").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()     # at most ``buckets`` rows
    out = np.zeros(buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def word_counts(split: DataFrame) -> DataFrame:
    """The distinct words of all documents with their counts, packed: ``shard, keys, counts``."""
    def total(key, table):
        keys, n = _counted(table)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "keys": pa.array([keys.tobytes()], pa.binary()), "counts": pa.array([anchors.pack(n)], pa.binary())})

    return split.where("shard >= 0").groupBy("shard").applyInArrow(total, "shard int, keys binary, counts binary")


def _counted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of packed rows, sorted, and their total counts."""
    if not table.num_rows:
        return np.zeros(0, U), np.zeros(0, np.int64)
    keys = np.concatenate([np.frombuffer(k, U) for k in table.column("keys").to_pylist()])
    n = np.concatenate([anchors.unpack(c) for c in table.column("counts").to_pylist()])
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(keys[order]) != 0)))
    return keys[order][first], np.add.reduceat(n[order], first)


def start(counts: np.ndarray, classes: int, window: int, hidden: int, seed: int) -> Model:
    """An untrained model: classes of about equal mass, buckets by falling count."""
    order = np.argsort(-counts, kind="stable")
    mass = np.cumsum(counts[order] + 1.0)
    of = np.minimum((mass - (counts[order] + 1.0) / 2) / mass[-1] * classes, classes - 1).astype(np.int64)
    _, of = np.unique(of, return_inverse=True)
    class_of = np.empty(len(counts), np.int64)
    class_of[order] = of
    total = np.bincount(class_of, counts + 1.0)
    place = np.empty(len(counts), np.int64)
    place[order] = np.arange(len(counts))
    model = Model(len(counts), window, hidden, class_of, np.log((counts + 1.0) / total[class_of]), np.zeros(0, np.float32),
                  place, np.searchsorted(of, np.arange(len(total) + 1)), np.zeros(len(counts), np.int64))
    size = 2 * window * (len(counts) + 1) * hidden + hidden + hidden * model.classes + model.classes
    model.weights = np.concatenate((np.random.default_rng(seed).standard_normal(size) * 0.1, np.zeros(len(counts) * hidden))).astype(np.float32)
    model.parts()[3][:] = np.log(total / total.sum())
    return model


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", buckets: int = 4096, classes: int = 64, window: int = 2, hidden: int = 16,
        rounds: int = 2, batch: int = 16384, rate: float = 0.1, seed: int = 7) -> Model:
    """Train on all documents: ``rounds`` passes, with the weights averaged after each."""
    docs = texts(docs, id_col, text_col)
    split = stored(_split(docs, buckets), "split")
    counted = stored(word_counts(split), "words")
    counts = bucket_counts(counted, buckets)
    model = start(counts, classes, window, hidden, seed)
    split = split.where("shard < 0").select("keys", "counts")
    piece = 1 << 14

    for turn in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast(model)

        def train(batches):
            own = sent.value
            flat, power, seen = own.weights.copy(), np.full(len(own.weights), 1e-6, np.float32), 0
            held = np.empty_like(flat)                  # in place: fresh memory costs more than the work
            for ids, before in _token_batches(batches, buckets):
                around = contexts(ids, before, window, buckets)
                for low in range(0, len(ids), batch):
                    step = gradient(own, around[:, low:low + batch], own.class_of[ids[low:low + batch]], flat, ids[low:low + batch])
                    power += np.multiply(step, step, out=held)
                    step *= rate / (1 + turn)
                    step /= np.sqrt(power, out=held)
                    flat -= step
                seen += len(ids)
            if seen:
                part = TaskContext.get().partitionId()
                rows = range(0, len(flat), piece)
                yield pa.record_batch([pa.array([part] * len(rows), pa.int32()), pa.array([r // piece for r in rows], pa.int32()), pa.array([seen] * len(rows), pa.int64()),
                                       pa.array([flat[r:r + piece].tobytes() for r in rows], pa.binary())], ["part", "piece", "seen", "weights"])

        def mean(key, table):
            table = table.sort_by("of")
            seen = table.column("seen").to_numpy().astype(float)
            total = sum(n * np.frombuffer(w, np.float32).astype(float) for n, w in zip(seen, table.column("weights").to_pylist()))
            row = [key[0].as_py(), key[1].as_py(), int(seen.sum()), (total / seen.sum()).astype(np.float32).tobytes()]
            return pa.table([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["part", "piece", "seen", "weights"])

        rows = split.mapInArrow(train, "part int, piece int, seen long, weights binary")
        for _ in range(3):                              # 256 tasks at a time: no group grows with their number, up to 16 million
            rows = rows.withColumn("of", F.col("part")).withColumn("part", F.shiftright("part", 8)).groupBy("part", "piece").applyInArrow(
                mean, "part int, piece int, seen long, weights binary")
        rows = rows.toArrow().sort_by("piece")          # one set of weights
        if rows.num_rows:
            model.weights = np.frombuffer(b"".join(rows.column("weights").to_pylist()), np.float32).copy()
        sent.unpersist()
    return replace(model, seen=counts, counted=counted)


def score(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id", batch: int = 16384) -> DataFrame:
    """``doc_id, n_tokens, log_likelihood`` (sum over all tokens), ``mean_log_prob`` (null without tokens)."""
    docs = texts(docs, id_col, text_col)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(replace(model, counted=None))
    docs = chunked(docs, chunk_count(docs))
    counted = model.counted if model.counted is not None else spark.createDataFrame([], "shard int, keys binary, counts binary")

    def hashes_of(table):
        data, offsets = utf8(table.column("text"))
        return hashed(data, offsets)

    def ask(key, table):
        keys = np.sort(distinct(hashes_of(unpacked(table))[0])[0])
        rows = [(s, key[0].as_py(), keys[a:b].tobytes()) for s, a, b in anchors.by_shard(keys, SHARD_BITS)]
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["shard", "chunk", "keys"])

    def answer(asked, table):
        keys, n = _counted(table)
        out = []
        for blob in asked.column("keys").to_pylist():
            wanted, found = np.frombuffer(blob, U), np.zeros(len(blob) // 8, np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                found = np.where(keys[at] == wanted, n[at], 0)
            out.append(np.frombuffer(anchors.pack(found), np.uint8))
        return anchors.reply(1, asked, out) if out else anchors.REPLY_SCHEMA.empty_table()

    def finish(table, replies):
        own, table = sent.value, unpacked(table)
        hashes, before = hashes_of(table)
        keys, _, which = distinct(hashes)
        order = np.argsort(keys)                        # as they were asked
        n = np.concatenate([np.zeros(0, np.int64), *[anchors.unpack(part) for part in anchors.in_order(replies, 1)]])
        ids = (hashes % U(own.buckets)).astype(np.int32)
        own_log = np.empty(len(keys))
        own_log[order] = np.log(np.maximum(n, 1))
        logs = own_log[which] - np.log(own.seen + 1.0)[ids]     # share of the word in its bucket
        around = contexts(ids, before, own.window, own.buckets)
        for at in range(0, len(ids), batch):
            logs[at:at + batch] += log_probabilities(own, around[:, at:at + batch], ids[at:at + batch])
        rows = np.repeat(np.arange(len(before) - 1), np.diff(before))
        n, s = np.diff(before), np.bincount(rows, logs, minlength=len(before) - 1).astype(float)
        return pa.Table.from_arrays([table.column("doc_id").combine_chunks(), pa.array(n), pa.array(s), pa.array(s / np.maximum(n, 1), mask=n == 0)],
                                    ["doc_id", "n_tokens", "log_likelihood", "mean_log_prob"])

    asked = docs.groupBy("chunk").applyInArrow(ask, "shard int, chunk int, keys binary")
    replies = asked.groupBy("shard").cogroup(counted.groupBy("shard")).applyInArrow(answer, anchors.REPLY)
    return docs.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(finish, "doc_id long, n_tokens long, log_likelihood double, mean_log_prob double")
