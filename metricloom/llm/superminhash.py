"""Near-duplicate documents by SuperMinHash signatures, banding, verification and components.

Each shingle of a document walks through the signature slots in its own random permutation and leaves, at step j,
a rank between j and j + 1; a slot keeps the least. The ranks of a shingle exclude each other, which makes the
estimate less variable than independent hashes, and a shingle stops once no slot can be beaten any more: after a
few steps for all but the shortest texts.

Documents with the same shingle set are one class, represented by the least id. Classes whose signatures agree in
a band are candidates. In every bucket all members are compared with its least and its greatest; links that hold on
the full sets join classes into components. Only buckets that still hold several components are searched further, in
blocks of rows: pairs of different components that the signatures don't rule out stay packed by blocks of documents,
which meet once with their full sets and give only the links that join components. So no pair between different texts that meets in a bucket is lost, and no group is expanded into its pairs.

Words are runs of all but blank and tab to carriage return after A-Z are lower-cased. A text with fewer words than a
shingle is one shingle; a text without words, or null, is linked with nothing. Ties go to the smaller id. Repeated rows
with equal ids count as one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.components import components
from metricloom.llm.shared import cut, map_batches, stored, texts
from metricloom.llm.textarrays import LOWER, NOT_SPACE, U, Spans, distinct, inside, mix, slices, utf8, words

#: Slots of a signature, rows of a band. A pair at 0.8 misses all 32 bands once in 20 million.
SLOTS, ROWS = 128, 4
BANDS = SLOTS // ROWS
#: Text bytes that a task turns into shingles at a time: 30 MB of arrays instead of 110 MB for slices of 2 MB, and no slower.
SLICE = 1 << 19


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, rows ascending, and the rows' offsets in them."""
    _, _, units, before = words(LOWER[data], offsets, NOT_SPACE)
    spans, rows = Spans(units), len(offsets) - 1
    starts = np.flatnonzero(inside(before, size))
    row = np.searchsorted(before, starts, side="right") - 1
    few = np.flatnonzero((np.diff(before) > 0) & (np.diff(before) < size))
    values = np.concatenate((spans.hash(starts, starts + size), spans.hash(before[few], before[few + 1])))
    row = np.concatenate((row, few))
    _, first, _ = distinct(mix(values ^ (row.astype(U) + U(1)) * U(0x9E3779B97F4A7C15)))
    order = first[np.argsort(row[first], kind="stable")]
    return values[order], np.searchsorted(row[order], np.arange(rows + 1))


def signatures(values: np.ndarray, offsets: np.ndarray, part: int = 1 << 15) -> np.ndarray:
    """SuperMinHash of every row's set: ranks with 25 bits after the point. Empty sets keep the greatest number."""
    rows = len(offsets) - 1
    out = np.full((rows, SLOTS), 0xFFFFFFFF, np.uint32)
    flat = out.ravel()
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    for low in range(0, len(values), part):
        value, row = values[low:low + part], owner[low:low + part]
        slots = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(value), 1))
        for step in range(SLOTS):
            h = mix(value + U((step + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
            rank = (U(step) << U(25)) | (h >> U(39))
            other = step + (((h & U(0xFFFFFFFF)) * U(SLOTS - step)) >> U(32)).astype(np.int64)
            index = np.arange(len(value))
            slot = slots[index, other]
            slots[index, other] = slots[:, step]
            np.minimum.at(flat, row * SLOTS + slot, rank.astype(np.uint32))
            alive = (out[row[0]:row[-1] + 1].max(axis=1) >> 25 > step)[row - row[0]]
            if not alive.any():
                break
            if not alive.all():
                value, row, slots = value[alive], row[alive], slots[alive]
    return out


def _bands(signature: np.ndarray) -> np.ndarray:
    keys = signature.astype(U).reshape(len(signature), BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=U)[None, :] * U(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        h = mix(h ^ keys[:, :, i])
    return h.view(np.int64)


def signed(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b`` (a 128-bit name of the set), ``bands`` (array) and ``marks`` (one byte a slot)."""
    def work(batch):
        data, offsets = utf8(batch.column("text"))
        counts, names, bands, marks = [], [], [], []
        for low, high in slices(offsets, SLICE):
            own = offsets[low:high + 1]
            values, borders = shingles(data[own[0]:own[-1]], own - own[0], size)
            n = np.diff(borders)
            sums = [np.concatenate((np.zeros(1, U), np.cumsum(mix(values ^ U(salt))))) for salt in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
            signature = signatures(values, borders)
            keys = _bands(signature)
            counts.append(n)
            names.append([(s[borders[1:]] - s[borders[:-1]]).view(np.int64) for s in sums])
            bands.extend(k if c else [] for k, c in zip(keys, n))
            marks.extend(m.tobytes() for m in mix(signature.astype(U)).astype(np.uint8))
        return pa.record_batch([batch.column("doc_id"), pa.array(np.concatenate(counts)), *[pa.array(np.concatenate([x[i] for x in names])) for i in (0, 1)],
                                pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())], ["doc_id", "n_shingles", "set_a", "set_b", "bands", "marks"])
    return map_batches(docs, work, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, marks binary")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def work(batch):
        data, offsets = utf8(batch.column("text"))
        out = []
        for low, high in slices(offsets, SLICE):
            own = offsets[low:high + 1]
            values, borders = shingles(data[own[0]:own[-1]], own - own[0], size)
            out.append(pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(values.view(np.int64))))
        return pa.record_batch([batch.column("doc_id"), pa.concat_arrays(out)], ["doc_id", "items"])
    return map_batches(docs, work, "doc_id long, items array<long>")


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = stored(_sets(docs.join(ids, "doc_id", "left_semi"), size), "shingles")
    left, right = sets.toDF("a", "items_a"), sets.toDF("b", "items_b")
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("items_a", "items_b")))
    return both.where(100 * F.col("common") >= percent * (F.size("items_a") + F.size("items_b") - F.col("common"))).select("a", "b")


def _suspects(members: DataFrame, percent: int, blocks: int) -> DataFrame:
    """Pairs of different components inside buckets (``key, band, a, component, marks, blocks``) that signatures don't rule out.

    A bucket is divided into blocks by a hash of the id; every pair of blocks is a group of bounded size. With ``bands``,
    the keys of all buckets of a document, a pair comes from the first bucket its members share only; marks may agree in
    a band whose keys differ, so they don't decide that. A pair is ruled out if it agrees in fewer slots than six standard deviations
    under the threshold. The rest is packed by the blocks of the full search: ``low, high, pairs (binary), ids (array)``.
    """
    p = percent / 100
    least = SLOTS * p - 6 * (SLOTS * p * (1 - p)) ** 0.5
    full = "bands" in members.columns

    def compare(table):
        rows = table.sort_by("a")
        doc, component, block, home = (rows.column(c).to_numpy() for c in ("a", "component", "block", "home"))
        band, low, high = (rows.column(c)[0].as_py() for c in ("band", "low", "high"))
        marks = np.frombuffer(b"".join(rows.column("marks").to_pylist()), np.uint8).reshape(-1, SLOTS)
        keys = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS) if full else None
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(len(doc)):
            rest = slice(i + 1, None)
            fit = component[rest] != component[i]
            if low != high:
                fit &= block[rest] != block[i]
            where = np.flatnonzero(fit) + i + 1
            keep = where[(marks[where] == marks[i]).sum(axis=1) >= least]
            if full:
                keep = keep[(keys[keep] == keys[i]).argmax(axis=1) == band]
            left.append(np.full(len(keep), i))
            right.append(keep)
        left, right = np.concatenate(left), np.concatenate(right)
        x, y = np.minimum(home[left], home[right]), np.maximum(home[left], home[right])
        order = np.lexsort((y, x))
        left, right, x, y = left[order], right[order], x[order], y[order]
        borders = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]), [True]))) if len(x) else np.zeros(1, np.int64)
        out = []
        for start, end in zip(borders[:-1], borders[1:]):
            a, b = left[start:end], right[start:end]
            packed = np.stack((doc[a], doc[b], component[a], component[b]), axis=1).astype(np.int64)
            out.append((int(x[start]), int(y[start]), packed.tobytes()))
        return pa.Table.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["low", "high", "pairs"])

    def gather(key, table):
        pairs = b"".join(table.column("pairs").to_pylist())
        ids = np.unique(np.frombuffer(pairs, np.int64).reshape(-1, 4)[:, :2]).tolist()
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip((key[0].as_py(), key[1].as_py(), pairs, ids), (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())))], ["low", "high", "pairs", "ids"])

    dealt = members.withColumn("block", F.pmod(F.xxhash64("a", F.lit(7)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    dealt = dealt.withColumn("home", F.pmod(F.xxhash64("a", F.lit(11)), F.lit(blocks)).cast("int"))
    found = (dealt.select("key", "band", "a", "component", "marks", *["bands"] * full, "block", "home", "low", "high").groupBy("key", "low", "high")
             .applyInArrow(compare, "low int, high int, pairs binary"))
    return found.groupBy("low", "high").applyInArrow(gather, "low int, high int, pairs binary, ids array<long>")


def _forest(suspects: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` between components, by the full sets of packed pairs: of each group as many as its components need.

    A group holds the sets of two blocks of documents, each once, and compares its pairs in place.
    """
    def confirm(key, packed, found):
        ids = found.column("doc_id").to_numpy()
        order = np.argsort(ids)
        items = found.column("items").combine_chunks().take(pa.array(order))
        _, codes = np.unique(items.flatten().to_numpy(), return_inverse=True)
        borders = np.concatenate(([0], np.cumsum(items.value_lengths().to_numpy())))
        rows = np.concatenate([np.frombuffer(x, np.int64) for x in packed.column("pairs").to_pylist()]).reshape(-1, 4)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        left, right = np.searchsorted(ids[order], rows[:, 0]), np.searchsorted(ids[order], rows[:, 1])
        parent: dict[int, int] = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        out, marked, last = [], np.zeros(len(codes) + 1, bool), -1
        for (a, b), (x, y) in zip(rows[:, 2:].tolist(), zip(left.tolist(), right.tolist())):
            if root(a) == root(b):
                continue
            if x != last:
                marked[:] = False
                marked[codes[borders[x]:borders[x + 1]]] = True
                last = x
            common = int(marked[codes[borders[y]:borders[y + 1]]].sum())
            if 100 * common >= percent * (int(borders[x + 1] - borders[x] + borders[y + 1] - borders[y]) - common):
                out.append((a, b))
                parent[root(a)] = root(b)
        return pa.Table.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    wanted = suspects.select(F.col("low").alias("x"), F.col("high").alias("y"), F.explode("ids").alias("doc_id")).distinct()
    placed = wanted.join(sets, "doc_id").select("x", "y", "doc_id", "items")
    return suspects.select("low", "high", "pairs").groupBy("low", "high").cogroup(placed.groupBy("x", "y")).applyInArrow(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 256) -> DataFrame:
    """``doc_id, n_shingles, class_id`` (least id with the same shingle set), ``component_id`` (least id reachable by links)."""
    docs = texts(docs, id_col, text_col)
    marked = stored(signed(docs, size), "signatures")
    classes = cut(marked.where("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("class_id")))
    heads = marked.join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    heads = stored(heads.select(F.col("doc_id").alias("a"), "bands", "marks"), "heads")
    slots = heads.select("a", F.posexplode("bands").alias("band", "key"))
    buckets = cut(slots.groupBy("key").agg(F.min("a").alias("low"), F.max("a").alias("high"), F.count("*").alias("n")).where("n > 1"))
    members = slots.join(buckets, "key")
    star = members.select(F.explode(F.array(F.struct(F.col("low").alias("a"), F.col("a").alias("b")), F.struct(F.col("a"), F.col("high").alias("b")))).alias("pair")).select("pair.*")
    links = cut(_confirmed(cut(star.where("a < b").distinct()), docs, size, percent))
    labels = components(links)
    # buckets of three and more that still hold several components
    of = lambda df: df.join(labels.withColumnRenamed("node", "a"), "a", "left").withColumn("component", F.coalesce("component", "a"))      # noqa: E731
    large = cut(of(slots.join(buckets.where("n > 2").select("key", "n"), "key")))
    mixed = cut(large.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key"))
    rest = large.join(mixed, "key").join(heads.select("a", "marks", "bands"), "a").withColumn("blocks", F.ceil(F.col("n") / block_rows))
    rest = cut(rest)
    blocks = max(1, -(-rest.select("a").distinct().count() // block_rows))
    suspects = cut(_suspects(rest, percent, blocks))
    ids = suspects.select(F.explode("ids").alias("doc_id")).distinct()
    sets = stored(_sets(docs.join(ids, "doc_id", "left_semi"), size).dropDuplicates(["doc_id"]), "shingles")
    joined = components(_forest(suspects, sets, percent))
    final = labels.join(joined.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    new = joined.join(labels, "node", "left_anti")      # classes that only the second search linked
    final = cut(final.unionByName(new.select("node", "component")))
    classes = cut(classes.join(final.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("component_id", F.coalesce("component", "class_id")).drop("component"))
    out = marked.select("doc_id", "n_shingles", "set_a", "set_b").join(classes, ["set_a", "set_b", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))
