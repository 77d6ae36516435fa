import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def grown(leaves):
    """All levels of a tree."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def climb(levels, i):
    """(run, slot) from a leaf to the root."""
    out = []
    for level in levels[:-1]:
        out.append((level[i // 3 * 3:i // 3 * 3 + 3], i % 3))
        i //= 3
    return out


def brute(rows, tampered):
    """(id, leaf) -> subroot, root, proof, folded root"""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [grown([x[2] for x in sorted(groups[n], key=lambda x: x[:3])]) for n in names]
    top, out = grown([t[-1][0] for t in trees]), {}
    for k, (n, tree) in enumerate(zip(names, trees)):
        for i, (_, _, h, row) in enumerate(sorted(groups[n], key=lambda x: x[:3])):
            way = climb(tree, i) + climb(top, k)
            folded = leaf((*row[:2], row[2].replace("\n", "") if row[2] else row[2])) if tampered(row[0]) else h
            for run, slot in way:
                folded = sha(*run[:slot], folded, *run[slot + 1:])
            out[row[0], h] = (tree[-1][0], top[-1][0], sha(*[x for run, slot in way for j, x in enumerate(run) if j != slot]), folded)
    return out


def found(spark, rows, height=6):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, text string, block int, leaf string").repartition(5)
    bare = merkle.leaf(F.col("doc_id"), F.col("source"), F.translate("text", "\n", ""))
    claim = F.when(F.col("doc_id") % 2 == 0, bare)
    blocks = merkle.manifest(frame, merkle.leaf(F.col("doc_id"), F.col("source"), F.col("text")), "source", "doc_id", claim, height)
    return [tuple(r) for r in merkle.verified(blocks).collect()]


@pytest.mark.parametrize("height", [1, 2, 6])
def test_against_a_plain_tree(spark, height):
    """Low blocks make several rounds of block roots, and groups of one row, of full and of ragged blocks."""
    rnd = random.Random(3)
    sizes = {"hot": 100, None: 28, "é": 27, "z": 10, "": 9, "a\nb": 1, "b": 2, "c": 3, "d": 4}
    rows = [(rnd.randrange(10**6) * 100 + j, s, rnd.choice([None, "", "x\ny", "é" * 5 + "\n", "plain"])) for s, n in sizes.items() for j in range(n)]
    rows.append((None, "b", "no id\n"))
    want = brute(rows, lambda i: i is not None and i % 2 == 0)
    got = found(spark, rows, height)
    assert len(got) == len(rows)
    assert {(r[0], r[1]): r[2:6] for r in got} == want
    assert all(r[6] == (r[5] == r[3]) for r in got) and {r[6] for r in got} == {True, False}


def test_repeated_rows_ties_and_empty_tables(spark):
    rows = [(2, "a", "x\n")] * 4 + [(2, "a", "y"), (1, "a", None), (1, "a", "")]
    got = found(spark, rows)
    levels = grown([h for _, h in sorted((r[0], leaf(r)) for r in rows)])
    assert len(got) == 7 and {r[2] for r in got} == {r[3] for r in got} == {levels[-1][0]}
    assert sorted(r[1] for r in got) == sorted(leaf(r) for r in rows)
    assert all(r[6] == (r[1] != leaf((2, "a", "x\n"))) for r in got)
    one = found(spark, [(5, None, "only")])
    assert one[0][1] == one[0][2] == one[0][3] and one[0][4] == sha() and one[0][6]
    frame = spark.createDataFrame([], "doc_id long, source string, text string")
    assert merkle.verified(merkle.manifest(frame, merkle.leaf(F.col("text")), "source", "doc_id")).collect() == []


@pytest.mark.parametrize("levels", range(1, 9))
def test_van_emde_boas_order(levels):
    places = merkle.addresses(levels)
    assert sorted(np.concatenate(places).tolist()) == list(range((3**levels - 1) // 2))
    if levels > 1:
        top = levels // 2
        assert np.concatenate(places[:top]).max() == (3**top - 1) // 2 - 1        # the upper half comes first
        below, size = places[top:], (3**(levels - top) - 1) // 2
        for j in range(3**top):                                                    # every subtree below is one stretch
            own = np.concatenate([d[j * 3**k:(j + 1) * 3**k] for k, d in enumerate(below)])
            assert own.max() - own.min() == size - 1


def test_path_folds_to_the_root():
    leaves = np.frombuffer(b"".join(hashlib.sha256(bytes([i])).digest() for i in range(20)), np.uint8).reshape(-1, 32)
    block = merkle.Block.of(leaves)
    assert block.level(len(block.sizes) - 1)[0].tobytes().hex() == grown([x.tobytes().hex() for x in leaves])[-1][0]
