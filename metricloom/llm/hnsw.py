"""Nearest neighbours by cosine: a hierarchical navigable small-world graph per shard, results merged.

Equal vectors are one point that carries its smallest ids; more than a query can return are never needed, so a vector
that a third of all rows share costs one point. Points are dealt out to shards of bounded size by a hash; a task builds
the graph of a shard by insertion and stores it as flat arrays: for every layer the points in it and a fixed-width
matrix of neighbours. Queries stay on Spark: they are packed, dealt out to blocks of bounded size, and one shuffle brings
a block and a group of shards together, the block first. A task holds the block and one shard at a time, merges what
the shards of its group find, and returns the best of every query; a last window keeps the best over the groups.

Scores are cosines of the original vectors in double precision. Every vector is scaled by a power of two first, which
changes no bit of a cosine but keeps tiny and huge components from under- and overflow.

Vectors that are null, empty, zero or hold null or non-finite components take no part, neither as candidates nor as
queries. Vectors of different lengths never meet. Ties go to the smaller id. A query never finds its own id, but finds
equal vectors of other ids. Rows that share an id are one candidate, at its best score, and one query, for all of its
vectors. Without candidates a query returns nothing.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.shared import cut, map_batches, stored


class Graph:
    """Small-world graph over unit vectors. ``m``: neighbours a point keeps (twice as many in the lowest layer)."""

    def __init__(self, vectors: np.ndarray, m: int, ef: int, levels: np.ndarray | None = None, layers: list[np.ndarray] | None = None, entry: int = 0):
        self.vectors, self.m, self.ef, self.entry = vectors, m, ef, entry
        n = len(vectors)
        if layers is not None:
            self.levels, self.layers = levels, layers
            return
        drawn = np.random.default_rng(n).random(n)
        self.levels = np.minimum((-np.log(np.maximum(drawn, 1e-12)) / np.log(m)).astype(np.int64), 8)
        self.layers = [np.full((n, 2 * m if level == 0 else m), -1, np.int32) for level in range(int(self.levels.max()) + 1)]
        self.entry = 0
        for point in range(1, n):
            self._insert(point)

    def _insert(self, point: int) -> None:
        query, level, top = self.vectors[point], int(self.levels[point]), int(self.levels[self.entry])
        near = [(float(self.vectors[self.entry] @ query), self.entry)]
        for layer in range(top, -1, -1):
            near = self._search(query, near, self.ef if layer <= level else 1, layer)
            if layer <= level:
                chosen = self._diverse(near, self.m)
                self.layers[layer][point, :len(chosen)] = chosen
                for other in chosen:
                    self._connect(other, point, layer)
        if level > top:
            self.entry = point

    def _connect(self, point: int, new: int, layer: int) -> None:
        row = self.layers[layer][point]
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = new
            return
        every = np.append(row, new)
        scores = self.vectors[every] @ self.vectors[point]
        chosen = self._diverse(sorted(zip(scores.tolist(), every.tolist()), key=lambda x: (-x[0], x[1])), len(row))
        row[:] = -1
        row[:len(chosen)] = chosen

    def _diverse(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """The nearest points, first those that are nearer to the query than to a point already chosen."""
        ids = [i for _, i in near]
        own = self.vectors[ids]
        between = own @ own.T
        chosen, spare = [], []
        for k, (score, _) in enumerate(near):
            if len(chosen) == most:
                break
            (chosen if not chosen or between[k, chosen].max() < score else spare).append(k)
        return [ids[k] for k in chosen + spare[:most - len(chosen)]]

    def _search(self, query: np.ndarray, entries: list[tuple[float, int]], ef: int, layer: int) -> list[tuple[float, int]]:
        """The ``ef`` nearest that a greedy walk finds, nearest first."""
        links, vectors = self.layers[layer], self.vectors
        seen = {i for _, i in entries}
        best = list(entries)
        heapq.heapify(best)
        todo = [(-s, i) for s, i in entries]
        heapq.heapify(todo)
        while todo:
            score, point = heapq.heappop(todo)
            if len(best) >= ef and -score < best[0][0]:
                break
            new = [i for i in links[point].tolist() if i >= 0 and i not in seen]
            if not new:
                continue
            seen.update(new)
            for s, i in zip((vectors[new] @ query).tolist(), new):
                if len(best) < ef:
                    heapq.heappush(best, (s, i))
                    heapq.heappush(todo, (-s, i))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, i))
                    heapq.heappush(todo, (-s, i))
        return sorted(best, key=lambda x: (-x[0], x[1]))

    def nearest(self, query: np.ndarray, ef: int) -> list[int]:
        near = [(float(self.vectors[self.entry] @ query), self.entry)]
        for layer in range(int(self.levels[self.entry]), 0, -1):
            near = self._search(query, near, 1, layer)
        return [i for _, i in self._search(query, near, ef, 0)]


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Every row times the power of two that brings its largest component to between a half and one."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _norms(scaled: np.ndarray) -> np.ndarray:
    return np.sqrt((scaled * scaled).sum(axis=1))


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = _scaled(vectors)
    return (scaled / _norms(scaled)[:, None]).astype(np.float32)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vector (array of double)`` of the rows that take part."""
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vec_id is not null and size(vector) > 0")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(fine).where(F.exists("vector", lambda x: x != 0))


def points(rows: DataFrame, keep: int) -> DataFrame:
    """``vector, ids`` (the ``keep`` smallest ids) of the distinct vectors; each batch is reduced before the shuffle."""
    def reduce(batch):
        vectors, ids = batch.column("vector"), batch.column("vec_id").to_numpy()
        found: dict[bytes, list[int]] = {}
        for i, (vector, own) in enumerate(zip(vectors.to_pylist(), ids.tolist())):
            found.setdefault(np.array(vector, np.float64).tobytes(), []).append(own)
        return pa.record_batch([pa.array([np.frombuffer(k, np.float64) for k in found], pa.list_(pa.float64())), pa.array([sorted(set(v))[:keep] for v in found.values()], pa.list_(pa.int64()))], ["vector", "ids"])

    parts = map_batches(rows, reduce, "vector array<double>, ids array<long>", rows=None)
    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    return parts.groupBy("vector").agg(smallest.alias("ids"))


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def build(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: int = 6, shard_points: int = 8192, m: int = 16, ef: int = 64) -> DataFrame:
    """The index: one row per shard with its vectors, ids and flat neighbour arrays, stored in the shared folder.

    ``keep``: ids an equal vector carries, one more than the results a query wants.
    """
    found = cut(points(usable(rows, id_col, vector_col), keep).withColumn("dim", F.size("vector")))
    shards = max(1, -(-found.count() // shard_points))
    tasks = min(4 * shards, max(shards, _partitions(rows)))         # more than shards, so that few of them share one
    dealt = found.withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("int")).repartition(tasks, "dim", "shard")

    def make(key, table):
        table = table.append_column("first", pa.array([i[0] for i in table.column("ids").to_pylist()], pa.int64())).sort_by("first")
        vectors = np.array(table.column("vector").to_pylist(), np.float64)
        graph = Graph(_unit(vectors), m, ef)
        ids = table.column("ids").to_pylist()
        row = [key[0].as_py(), key[1].as_py(), vectors.tobytes(), ids, graph.entry, graph.levels.tobytes(), [x[graph.levels >= k].tobytes() for k, x in enumerate(graph.layers)]]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.list_(pa.int64())), pa.int32(), pa.binary(), pa.list_(pa.binary())))],
                                    ["dim", "shard", "vectors", "ids", "entry", "levels", "layers"])

    index = dealt.groupBy("dim", "shard").applyInArrow(make, "dim int, shard int, vectors binary, ids array<array<long>>, entry int, levels binary, layers array<binary>")
    return stored(index, "hnsw")


def _graph(row: dict, m: int, ef: int) -> tuple[Graph, np.ndarray]:
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
    levels, layers = np.frombuffer(row["levels"], np.int64), []
    for k, data in enumerate(row["layers"]):
        links = np.full((len(vectors), 2 * m if k == 0 else m), -1, np.int32)
        links[levels >= k] = np.frombuffer(data, np.int32).reshape(-1, links.shape[1])
        layers.append(links)
    return Graph(_unit(vectors), m, ef, levels, layers, row["entry"]), vectors


_KEY = ("block", "part", "kind", "dim", "shard")
_STREAM = (*_KEY, "vectors", "ids", "entry", "levels", "layers")


def _packed(queries: DataFrame, blocks: int) -> DataFrame:
    """``block, dim, vectors, ids``: the queries of a batch that go to one block, in one row."""
    def pack(batch):
        keys = np.stack([batch.column(c).to_numpy() for c in ("block", "dim")])
        order = np.lexsort(keys[::-1])
        ids, vectors, out = batch.column("vec_id").to_pylist(), batch.column("vector").to_pylist(), []
        borders = np.flatnonzero(np.concatenate(([True], (np.diff(keys[:, order]) != 0).any(axis=0), [True]))) if len(order) else []
        for low, high in zip(borders[:-1], borders[1:]):
            own = order[low:high].tolist()
            out.append((*keys[:, own[0]].tolist(), np.array([vectors[i] for i in own], np.float64).tobytes(), [[ids[i] for i in own]]))
        return pa.record_batch([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.list_(pa.int64()))))],
                               ["block", "dim", "vectors", "ids"])

    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("dim", F.size("vector"))
    return map_batches(dealt, pack, "block int, dim int, vectors binary, ids array<array<long>>")


class _Block:
    """The queries of a block and the ``k`` best found for each so far."""

    def __init__(self, k: int, ef: int):
        self.k, self.ef, self.queries, self.best = k, ef, {}, {}

    def add(self, row: dict) -> None:
        scaled = _scaled(np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"]))
        self.queries.setdefault(row["dim"], []).extend(zip(row["ids"][0], scaled, _norms(scaled), _unit(scaled)))

    def visit(self, row: dict, m: int) -> None:
        graph, vectors = _graph(row, m, self.ef)
        scaled = _scaled(vectors)
        norms, ids = _norms(scaled), row["ids"]
        for query, vector, norm, unit in self.queries.get(row["dim"], ()):
            near = graph.nearest(unit, self.ef)
            scores = (scaled[near] * vector).sum(axis=1) / (norms[near] * norm)
            found = [(-s, i) for s, p in zip(scores.tolist(), near) for i in ids[p] if i != query]
            nearest = {}
            for score, i in sorted(found + self.best.get(query, [])):
                if i not in nearest:
                    nearest[i] = score
                    if len(nearest) == self.k:
                        break
            self.best[query] = [(s, i) for i, s in nearest.items()]

    def rows(self) -> pa.RecordBatch:
        out = [(q, i, -s) for q, own in self.best.items() for s, i in own]
        return pa.record_batch([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])


def search(index: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", m: int = 16, ef: int = 128, block_bytes: int = 16 << 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for every query row. ``m`` as in :func:`build`.

    ``block_bytes``: vectors of the queries a task holds. The index is copied once for each block of queries, the queries
    once for each group of shards; there are as many groups as shuffle partitions at most.
    """
    asked = usable(queries, id_col, vector_col)
    blocks = max(1, -(-(asked.agg(F.sum(F.size("vector").cast("long") * 8)).first()[0] or 0) // block_bytes))
    parts = max(1, min((index.agg(F.max("shard")).first()[0] or 0) + 1, _partitions(queries)))
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sought = _packed(asked, blocks).withColumn("part", copies(parts)).withColumn("kind", F.lit(0))
    shards = index.withColumn("part", F.col("shard") % parts).withColumn("block", copies(blocks)).withColumn("kind", F.lit(1))
    stream = sought.unionByName(shards, allowMissingColumns=True).select(*_STREAM)

    def work(batches):
        key, block = None, _Block(k, ef)
        for batch in batches:
            for at in range(batch.num_rows):                        # one graph at a time
                row = batch.slice(at, 1).to_pylist()[0]
                if key != (row["block"], row["part"]):
                    if block.best:
                        yield block.rows()
                    key, block = (row["block"], row["part"]), _Block(k, ef)
                if row["kind"] == 0:
                    block.add(row)
                else:
                    block.visit(row, m)
        yield block.rows()

    met = stream.repartitionById(blocks * parts, F.col("block") * parts + F.col("part")).sortWithinPartitions(*_KEY)
    found = met.mapInArrow(work, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
