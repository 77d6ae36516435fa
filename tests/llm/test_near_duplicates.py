import random
import time

import brute
import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F

from metricloom.llm import components as steps
from metricloom.llm import superminhash
from metricloom.llm.components import components


def found(docs, **more):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in superminhash.near_duplicates(docs, **more).collect()}


def test_edges_match_brute_force(edge_docs, edge_texts):
    assert found(edge_docs) == brute.near_duplicates(edge_texts, 5)       # five words unless told otherwise


def test_no_documents(no_docs):
    assert found(no_docs) == {}


def edited(words, share, rnd):
    return " ".join(f"w{rnd.random()}" if rnd.random() < share else w for w in words)


def test_large_groups_and_chains_keep_every_link(spark):
    rnd, rows = random.Random(5), []
    base = prose(1, 200).split()
    rows += [(i, edited(base, rnd.choice([0, 0.01, 0.02, 0.03, 0.05]), rnd)) for i in range(120)]       # some pairs are linked, some aren't
    text = prose(2, 150).split()
    for i in range(25):                                                                                 # a chain: only neighbours are linked
        text = text[4:] + [f"n{i}.{k}" for k in range(4)]
        rows.append((1000 - i, " ".join(text)))
    rows += [(2000 + i, "same words in all of these rows") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute.near_duplicates(rows, 4)
    assert len({c for _, c in want.values()}) < len(rows) - 60
    assert found(docs, size=4, block_rows=8) == want


def test_search_in_blocks_compares_each_pair_once(spark):
    """Pairs of different components in one bucket, unless the signatures rule them out."""
    marks = np.random.default_rng(0).integers(0, 256, superminhash.SLOTS, dtype=np.uint8)
    near = marks.copy()
    near[-20:] ^= 1
    far = marks.copy()
    far[superminhash.ROWS:] ^= 1
    rows = [(9, 0, i, c, bytearray(m.tobytes())) for i, c, m in [(1, 1, marks), (2, 2, near), (3, 3, far), (4, 1, marks), (5, 5, near)]]
    for blocks in (1, 3):
        members = spark.createDataFrame([(*r, blocks) for r in rows], "key long, band int, a long, component long, marks binary, blocks long")
        found = [np.frombuffer(r["pairs"], np.int64).reshape(-1, 4) for r in superminhash._suspects(members, 80, 4).collect()]
        assert sorted(tuple(sorted(p[:2])) for rows_ in found for p in rows_.tolist()) == [(1, 2), (1, 5), (2, 4), (2, 5), (4, 5)]


def test_search_keeps_pairs_whose_marks_collide_in_an_earlier_band(spark):
    """Equal marks of band 0 in documents of different buckets there: the pair comes from band 1, which both share, and only once."""
    marks = bytearray(np.random.default_rng(0).integers(0, 256, superminhash.SLOTS, dtype=np.uint8).tobytes())
    keys = {i: [100 * i, *range(1, superminhash.BANDS)] for i in (1, 2)}
    rows = [(keys[i][band], band, i, i, marks, keys[i], 1) for i in (1, 2) for band in (0, 1, 5)]
    members = spark.createDataFrame(rows, "key long, band int, a long, component long, marks binary, bands array<long>, blocks long")
    found = [np.frombuffer(r["pairs"], np.int64).reshape(-1, 4) for r in superminhash._suspects(members, 80, 4).collect()]
    assert [tuple(sorted(p[:2])) for rows_ in found for p in rows_.tolist()] == [(1, 2)]


def test_forest_joins_components_by_full_sets(spark):
    pairs = np.array([[1, 2, 1, 2], [1, 3, 1, 3], [2, 3, 2, 3], [3, 4, 3, 4]], np.int64)
    suspects = spark.createDataFrame([(0, 1, bytearray(pairs.tobytes()), [1, 2, 3, 4])], "low int, high int, pairs binary, ids array<long>")
    sets = spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (2, [1, 2, 3, 4]), (3, [2, 3, 4, 5, 1]), (4, [9])], "doc_id long, items array<long>")
    assert sorted(map(tuple, superminhash._forest(suspects, sets, 80).collect())) == [(1, 2), (1, 3)]


def test_signatures_estimate_similarity_with_less_variance():
    rng, errors = np.random.default_rng(1), []
    for _ in range(200):
        values = rng.integers(0, 2**63, 150, dtype=np.uint64)
        a, b = values[:100], values[50:]                # 50 of 150 in common
        signature = superminhash.signatures(np.concatenate((a, b)), np.array([0, 100, 200]))
        errors.append((signature[0] == signature[1]).mean() - 1 / 3)
    assert abs(np.mean(errors)) < 0.01
    assert np.var(errors) < (1 / 3) * (2 / 3) / superminhash.SLOTS


def test_signature_ignores_order_and_parts():
    values = np.random.default_rng(2).integers(0, 2**63, 300, dtype=np.uint64)
    whole = superminhash.signatures(values, np.array([0, 300]))
    assert (whole == superminhash.signatures(values[::-1].copy(), np.array([0, 300]), part=37)).all()


def test_components(spark):
    rnd = random.Random(1)
    parts = [[(1, 1)], [(2, 1), (3, 2), (9, 7)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)] + [(80, 79)], [(60 - i, (37 * i) % 61) for i in range(61)],
             [(rnd.randrange(60), rnd.randrange(60)) for _ in range(35)]]
    links = [(1000 * k + a, 1000 * k + b) for k, part in enumerate(parts) for a, b in part]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in links:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    frame = spark.createDataFrame(links, "a long, b long")
    assert dict(map(tuple, components(frame).collect())) == {x: root(x) for x in list(parent)}
    assert components(frame.filter("a = b")).collect() == []


@pytest.mark.parametrize("links, most", [
    ([(i, i + 1) for i in range(60)], 12),
    ([(i, i + 1) for i in range(100_000)], 18),
    ([(5, 9), (9, 1), (1, 7), (7, 4), (4, 8), (8, 2), (2, 6), (6, 3)], 20)], ids=["short chain", "long chain", "valleys"])
def test_rounds_of_components_grow_with_the_logarithm(spark, monkeypatch, links, most):
    times, real = [], steps.stored

    def counted(df, name):
        start = time.time()
        out = real(df, name)
        times.append(time.time() - start)
        return out
    monkeypatch.setattr(steps, "stored", counted)
    found = steps.components(spark.createDataFrame(links, "a long, b long"))
    assert found.agg(F.min("component"), F.max("component"), F.count("*")).first() == (min(min(x) for x in links), min(min(x) for x in links), len({n for x in links for n in x}))
    assert len(times) <= most
    assert max(times[-3:]) < 5 + 3 * times[0]


def test_components_of_random_trees(spark):
    rnd = random.Random(7)
    names = rnd.sample(range(10**12), 3000)
    links = [(names[i], names[max(0, i - rnd.randrange(1, 4))]) for i in range(1, 1500)] + [(names[i], names[i - 1]) for i in range(1501, 3000)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert set(got.values()) == {min(names[:1500]), min(names[1500:])}
    assert {got[n] for n in names[:1500]} == {min(names[:1500])}
