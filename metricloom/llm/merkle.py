"""Merkle manifest of a dataset: a tree of digests for each group, one root over all groups, proofs and their folding.

A leaf is the sha256 (lowercase hex) of a row's columns; a node is the sha256 of its children's hex digests, ``FANOUT``
consecutive ones each, the last run shorter; a level of one node ends the tree. The roots of the groups, in the order of
the groups, are the leaves of the tree whose root stands for the dataset.

Leaves are sorted and written once, by group, id and digest, and get their place from the rows before them (one number
for each range and group). ``height`` levels of the tree are a block: an aligned subtree that one task builds, whatever
group it belongs to. The roots of all blocks are the leaves of the next tree, which is cut into blocks alike, until every
group has one block; so no task holds more than a block, and what a round works on is 1 / FANOUT^height of the last one.

Inside a block the digests lie in van Emde Boas order: the upper half of the levels first, then each subtree below it,
every one of them cut again the same way. ``addresses`` computes the place of every node; building and the search for
siblings both go through it, and a path from a leaf to its block's root touches few neighbourhoods of the array at any
page size. A last block with few leaves is as high as these need; the lone nodes above its top are hashed without siblings.

Edges: a null column is ``-`` in a leaf, null groups come first, null ids come first in their group; rows with equal ids
are ordered by their digest, so equal rows are neighbours in any order. A group of one row has its leaf as root. An empty
table gives no rows. Further columns, whatever their names, take no part.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.shared import cut, map_batches, stored

FANOUT, HEIGHT = 3, 6
_HEX = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), np.uint16)


def leaf(*columns: Column) -> Column:
    """Digest (hex) of values: null as ``-``, others as their UTF-8 byte count, ``:`` and themselves."""
    def part(c):
        text = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
    return F.sha2(F.concat(*[part(c) for c in columns]), 256)


@lru_cache
def addresses(levels: int) -> tuple[np.ndarray, ...]:
    """Places of the nodes of a complete tree of that many levels, by depth from the root, in van Emde Boas order."""
    if levels == 1:
        return (np.zeros(1, np.int64),)
    top, below = addresses(levels // 2), addresses(levels - levels // 2)
    size, step = sum(map(len, top)), sum(map(len, below))
    start = size + step * np.arange(len(top[-1]) * FANOUT)
    return (*top, *[(start[:, None] + depth[None, :]).ravel() for depth in below])


def _hex(digests: np.ndarray) -> np.ndarray:
    """Rows of 32 bytes as rows of 64 hex digits."""
    return _HEX[digests].view(np.uint8).reshape(*digests.shape[:-1], 64)


def _hash_rows(digits: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """sha256 of the first ``lengths`` bytes of every row."""
    flat, width = np.ascontiguousarray(digits).reshape(-1).data, digits.shape[1]
    return np.frombuffer(b"".join(hashlib.sha256(flat[i * width:i * width + n]).digest() for i, n in enumerate(lengths.tolist())), np.uint8).reshape(-1, 32)


def _up(digests: np.ndarray) -> np.ndarray:
    """The level above: digests of runs."""
    n = len(digests)
    runs = -(-n // FANOUT)
    digits = np.zeros((runs * FANOUT, 64), np.uint8)
    digits[:n] = _hex(digests)
    return _hash_rows(digits.reshape(runs, FANOUT * 64), 64 * np.minimum(FANOUT, n - FANOUT * np.arange(runs)))


class Block:
    """The digests of an aligned subtree of ``n`` leaves; ``data`` holds them in van Emde Boas order."""

    def __init__(self, n: int, data: np.ndarray):
        self.n, self.data = n, data
        self.sizes = [n]
        while self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // FANOUT))
        self.places = addresses(len(self.sizes))[::-1]      # by level from the leaves

    @classmethod
    def of(cls, leaves: np.ndarray) -> Block:
        out = cls(len(leaves), np.zeros((0, 32), np.uint8))
        out.data = np.zeros((sum(map(len, out.places)), 32), np.uint8)
        for level, size in enumerate(out.sizes):
            out.data[out.places[level][:size]] = leaves
            if size > 1:
                leaves = _up(leaves)
        return out

    def level(self, level: int) -> np.ndarray:
        return self.data[self.places[level][:self.sizes[level]]]

    def runs(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every leaf at ``level``: hex digits of its run (absent nodes empty), the run's size, and its slot in it."""
        at = np.arange(self.n) // FANOUT ** level
        first, size = at // FANOUT * FANOUT, self.sizes[level]
        nodes = np.minimum(first[:, None] + np.arange(FANOUT), size - 1)
        return _hex(self.data[self.places[level][nodes]]), np.minimum(FANOUT, size - first), at - first


def _lone(digest: bytes, times: int) -> bytes:
    """A node without siblings, hashed up some levels."""
    for _ in range(times):
        digest = hashlib.sha256(digest.hex().encode()).digest()
    return digest


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` sorted and written once, with ``place`` in their group from 0, and ``total`` of the group (both long).

    Ranges are ranges of (group, order), so a large group has many. Its rows before a range are a sum over one number for
    each range; those numbers are as many as ranges and groups together.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group, *order, "_tie").sortWithinPartitions(*group, *order, "_tie")
    ranged = ranged.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    held = stored(ranged.drop("_tie"), "ranged")
    sizes = held.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before, whole = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*group)
    starts = sizes.select(*group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("total"))
    same = [F.col(f"h.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group] + [F.col("h._part") == F.col("s._part")]
    joined = held.alias("h").join(starts.alias("s"), same)
    return joined.select(*[f"h.{c}" for c in rows.columns], (F.col("_row") + F.col("_shift")).alias("place"), F.col("s.total"))


_BLOCK = "tree long, block long, n int, total long, digest binary, nodes binary, {payload}"


def _blocks(nodes: DataFrame, payload: dict[str, pa.DataType], height: int) -> DataFrame:
    """Blocks of ``tree, place, total, digest`` (binary) and further columns, kept packed: one row for each aligned subtree."""
    width = FANOUT ** height

    def build(key, table):
        table = table.sort_by("place")
        digests = np.frombuffer(b"".join(table.column("digest").to_pylist()), np.uint8).reshape(-1, 32)
        block, total = Block.of(digests), table.column("total")[0].as_py()
        above = len(_stem(block, total, height)) // 2
        root = _lone(block.level(len(block.sizes) - 1)[0].tobytes(), above)
        row = [[key[0].as_py()], [key[1].as_py()], [len(digests)], [total], [root], [block.data.tobytes()], *[[table.column(c).to_pylist()] for c in payload]]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), *map(pa.list_, payload.values())]
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(row, types)], ["tree", "block", "n", "total", "digest", "nodes", *payload])

    names = {pa.int64(): "long", pa.binary(): "binary"}
    schema = _BLOCK.format(payload=", ".join(f"{c} array<{names[t]}>" for c, t in payload.items())).rstrip(", ")
    dealt = nodes.withColumn("block", F.floor(F.col("place") / F.lit(width)).cast("long"))
    return stored(dealt.select("tree", "block", "place", "total", "digest", *payload).groupBy("tree", "block").applyInArrow(build, schema), "blocks")


def _paths(blocks: DataFrame, height: int) -> DataFrame:
    """``tree, block, path`` (binary) and ``root``: what leads from every block of a tree to the tree's root."""
    width = FANOUT ** height
    single = blocks.where(f"total <= {width}").select("tree", "block", F.lit(b"").alias("path"), F.col("digest").alias("root"))
    several = blocks.where(f"total > {width}")
    if several.isEmpty():
        return single
    roots = several.select("tree", F.col("block").alias("place"), F.ceil(F.col("total") / F.lit(width)).cast("long").alias("total"), "digest")
    up = climbed(_blocks(roots, {}, height), height)
    return single.union(up.select("tree", F.col("place").alias("block"), "path", "root"))


def climbed(blocks: DataFrame, height: int) -> DataFrame:
    """``tree, place, path, root`` for every leaf of the blocks: a path is, level by level, a byte for the size of the
    run, one for the slot in it, and the siblings' digests, left to right."""
    joined = blocks.join(_paths(blocks, height).withColumnsRenamed({"path": "up", "root": "top"}), ["tree", "block"])

    def work(batch):
        out = {"tree": [], "place": [], "path": [], "root": []}
        for row in batch.to_pylist():
            block, paths = Block(row["n"], np.frombuffer(row["nodes"], np.uint8).reshape(-1, 32)), [[] for _ in range(row["n"])]
            for level in range(len(block.sizes) - 1):
                at = np.arange(block.n) // FANOUT ** level
                nodes = block.level(level)
                for i, (own, path) in enumerate(zip(at.tolist(), paths)):
                    first = own - own % FANOUT
                    run = range(first, min(first + FANOUT, len(nodes)))
                    path.append(bytes((len(run), own - first)) + b"".join(nodes[k].tobytes() for k in run if k != own))
            tail = _stem(block, row["total"], height) + row["up"]
            out["tree"] += [row["tree"]] * block.n
            out["place"] += [row["block"] * FANOUT ** height + i for i in range(block.n)]
            out["path"] += [b"".join(p) + tail for p in paths]
            out["root"] += [row["top"]] * block.n
        return pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], list(out))
    return cut(map_batches(joined.select("tree", "block", "n", "total", "nodes", "up", "top"), work, "tree long, place long, path binary, root binary", rows=64))


def _stem(block: Block, total: int, height: int) -> bytes:
    """The steps of the lone nodes between a block's top and the height of a full block, if the tree has several."""
    return bytes((1, 0)) * (height - len(block.sizes) + 1 if total > FANOUT ** height else 0)


def steps(path: bytes) -> list[tuple[int, int, bytes]]:
    """The levels of a path: run size, slot, siblings' digests."""
    out, at = [], 0
    while at < len(path):
        size, slot = path[at], path[at + 1]
        out.append((size, slot, path[at + 2:at + 2 + 32 * (size - 1)]))
        at += 2 + 32 * (size - 1)
    return out


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf's digest and a path lead to."""
    for _, slot, others in steps(path):
        digest = hashlib.sha256((others[:32 * slot] + digest + others[32 * slot:]).hex().encode()).digest()
    return digest


def manifest(rows: DataFrame, digest: Column, by: str, id_col: str, claim: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """Blocks of all rows with what leads from them to the root of the dataset; a stored table.

    ``tree`` (place of the group in the order of groups), ``block, n, total, digest, nodes`` (van Emde Boas order), ``ids``
    and ``claims`` (packed by place; a claim is a digest that :func:`verified` folds in place of the leaf, null: the leaf),
    ``up`` (path from the block's root to the dataset's), ``subroot``, ``root`` and ``height`` (levels of a full block).
    """
    claim = F.lit(None).cast("string") if claim is None else claim
    leaves = rows.select(F.col(by).cast("string").alias("grp"), F.col(id_col).cast("long").alias("id"), F.unhex(digest).alias("digest"), F.unhex(claim).alias("claim"))
    placed = numbered(leaves, ["grp"], ["id", "digest"])
    groups = cut(numbered(placed.select("grp").distinct(), [], ["grp"]).select("grp", F.col("place").alias("tree")))
    named = placed.join(groups.withColumnRenamed("grp", "g"), F.col("grp").eqNullSafe(F.col("g"))).drop("g", "grp")
    blocks = _blocks(named.withColumnsRenamed({"id": "ids", "claim": "claims"}), {"ids": pa.int64(), "claims": pa.binary()}, height)
    inside = cut(_paths(blocks, height))
    subroots = inside.where("block = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("root").alias("digest"))
    counted = subroots.withColumn("total", F.lit(groups.count()).cast("long"))
    over = climbed(_blocks(counted, {}, height), height).select(F.col("place").alias("tree"), F.col("path").alias("over"), F.col("root").alias("whole"))
    ways = inside.withColumnRenamed("root", "subroot").join(over, "tree").select("tree", "block", "subroot", F.concat("path", "over").alias("up"), F.col("whole").alias("root"))
    return stored(blocks.join(ways, ["tree", "block"]).withColumn("height", F.lit(height)), "manifest")


def verified(blocks: DataFrame) -> DataFrame:
    """``id, leaf, subroot, root, proof_sha256, folded_root`` (hex) for every row of a manifest, and ``verified``.

    The proof is the siblings of all levels to the root; ``folded_root`` is the root that the claim (or the leaf) and they give.
    """
    def work(batch):
        out = {c: [] for c in ("id", "leaf", "subroot", "root", "proof_sha256", "folded_root")}
        for row in batch.to_pylist():
            block = Block(row["n"], np.frombuffer(row["nodes"], np.uint8).reshape(-1, 32))
            n, up = block.n, _stem(block, row["total"], row["height"]) + row["up"]
            leaves = block.level(0)
            folded = leaves.copy()
            for i, claim in enumerate(row["claims"]):
                if claim is not None:
                    folded[i] = np.frombuffer(claim, np.uint8)
            proofs = []                                     # hex digits and which of them count, level by level
            for level in range(len(block.sizes) - 1):
                digits, size, slot = block.runs(level)
                proofs.append((digits, (np.arange(FANOUT) < size[:, None]) & (np.arange(FANOUT) != slot[:, None])))
                digits = digits.copy()
                digits[np.arange(n), slot] = _hex(folded)
                folded = _hash_rows(digits.reshape(n, FANOUT * 64), 64 * size)
            after = b"".join(others for _, _, others in steps(up)).hex().encode()
            digits = np.concatenate([d for d, _ in proofs], axis=1) if proofs else np.zeros((n, 0, 64), np.uint8)
            counts = np.concatenate([c for _, c in proofs], axis=1) if proofs else np.zeros((n, 0), bool)
            out["proof_sha256"] += [hashlib.sha256(digits[i][counts[i]].tobytes() + after).hexdigest() for i in range(n)]
            seen = {}                                       # equal digests at a block's top fold alike
            for top in map(bytes, folded):
                if top not in seen:
                    seen[top] = fold(top, up).hex()
                out["folded_root"].append(seen[top])
            out["id"] += row["ids"]
            out["leaf"] += [x.tobytes().decode() for x in _hex(leaves)]
            out["subroot"] += [row["subroot"].hex()] * n
            out["root"] += [row["root"].hex()] * n
        return pa.record_batch([pa.array(v, pa.int64() if c == "id" else pa.string()) for c, v in out.items()], list(out))
    found = map_batches(blocks, work, "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string", rows=16)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
