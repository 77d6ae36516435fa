import random
import tracemalloc

import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F

from metricloom.llm import hnsw, language_id, masked_scoring


# language identification

SAMPLES = {"aa": "tonde kari mosu pela vindo ", "bb": "schrak glimpf strenz bolg ", "cc": "éàoui lèua mieux çaire "}


def sample(lang, n, seed):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(SAMPLES[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, sample(lang, 40, i), lang) for lang, n in (("aa", 30), ("bb", 20), ("cc", 10)) for i in range(n)]
    rows += [(90, None, "aa"), (91, "text", None), (92, "", "bb")]
    return language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_languages_commonest_first(model):
    assert model.languages == ["aa", "bb", "cc"] and (model.false_rate < 0.05).all()


def test_held_out_texts_and_edges(spark, model):
    rows = [(i, sample(lang, 30, 1000 + i), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 10)]
    rows += [(100, None, "und"), (101, "", "und"), (102, "123 !? 4", "und"), (103, "q", "aa"), (104, "日本語日本語", "aa"), (105, "١٢٣", "und"), (106, sample("bb", 30000, 5), "bb")]
    docs = spark.createDataFrame([(*r, "old", None) for r in rows], "doc_id long, text string, truth string, lang_pred string, score string").repartition(3)
    got = language_id.identify(docs, model).collect()
    assert [(r["doc_id"], r["lang_pred"]) for r in got if r["lang_pred"] != r["truth"]] == []
    assert all(0 <= r["score"] <= 1 for r in got) and {r["score"] for r in got if r["doc_id"] in (100, 101, 102, 103, 104)} == {0.0}


def test_without_labels(spark, no_docs):
    empty = language_id.fit(no_docs)
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    assert [(r["lang_pred"], r["score"]) for r in language_id.identify(docs, empty).collect()] == [("und", 0.0)] * 2
    assert language_id.identify(no_docs, empty).collect() == []


def test_filters_name_every_language_of_a_gram(spark):
    langs = [f"l{i:02}" for i in range(70)]             # more than one word of bits
    rows = [(i, f"shared {'abcdefghij'[i % 10] * 2}{'klmnopqrst'[i // 10] * 3}x", lang) for i, lang in enumerate(langs)]
    many = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    values, _ = language_id.grams(np.frombuffer(b"shared", np.uint8), np.array([0, 6]))
    masks = np.bitwise_and.reduce([many.slots[p] for p in language_id._places(values, len(many.slots), many.hashes)])
    assert masks.shape[1] == 2 and all(bin(int(a)).count("1") + bin(int(b)).count("1") == 70 for a, b in masks)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    assert [r["lang_pred"] for r in language_id.identify(docs, many).orderBy("doc_id").collect()] == langs


# masked scoring

def small():
    counts = np.random.default_rng(0).integers(0, 50, 40)
    return masked_scoring.start(counts, 5, 2, 3, 1)


def class_logs(model, around, target, flat=None):
    return np.concatenate([chosen for *_, chosen in masked_scoring.outer(model, masked_scoring.hidden_values(model, around, flat), target, flat)])


def plain_logs(model, around, ids):
    """Log-probabilities by the definition, one token and one class at a time."""
    table, bias, out, out_bias, places = model.parts()
    result = []
    for i, b in enumerate(ids):
        hidden = np.tanh(sum(table[k][around[k][i]] for k in range(len(around))) + bias)
        scores = hidden @ out + out_bias
        c = model.class_of[b]
        members = [x for x in range(model.buckets) if model.class_of[x] == c]
        inside = {x: hidden @ places[model.place[x]] + model.inside[x] for x in members}
        result.append(scores[c] - np.log(np.exp(scores).sum()) + (inside[b] - np.log(sum(np.exp(list(inside.values())))) if len(members) > 1 else 0))
    return np.array(result)


@pytest.mark.parametrize("part", [4, 4096])
def test_scores_match_the_definition(monkeypatch, part):
    monkeypatch.setattr(masked_scoring, "PART", part)
    model, rng = small(), np.random.default_rng(9)
    model = masked_scoring.replace(model, weights=model.weights + rng.standard_normal(len(model.weights)) * 0.5)
    around, ids = rng.integers(0, 41, (4, 50)), rng.integers(0, 40, 50)
    assert np.allclose(masked_scoring.log_probabilities(model, around, ids), plain_logs(model, around, ids))


def test_gradient_is_the_derivative():
    model, rng = small(), np.random.default_rng(1)
    flat = model.weights.astype(np.float64)
    around, target = rng.integers(0, 41, (4, 30)), rng.integers(0, model.classes, 30)
    loss = lambda w: -class_logs(model, around, target, w).mean()     # noqa: E731
    grad = masked_scoring.gradient(model, around, target, flat)
    for i in rng.integers(0, len(flat), 40):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        assert abs((loss(flat + step) - loss(flat - step)) / 2e-6 - grad[i]) < 1e-6


def test_probabilities_of_all_buckets_sum_to_one():
    model = small()
    around = np.random.default_rng(2).integers(0, 41, (4, 6))
    logs = np.stack([class_logs(model, around, np.full(6, c)) for c in range(model.classes)], axis=1)
    total = sum(np.exp(logs[:, model.class_of[b]] + model.inside[b]) for b in range(40))
    assert np.allclose(total, 1, atol=1e-5)


def test_contexts_stay_inside_documents():
    around = masked_scoring.contexts(np.array([1, 2, 3, 4, 5]), np.array([0, 3, 3, 5]), 2, 9)
    assert around.tolist() == [[9, 9, 1, 9, 9], [9, 1, 2, 9, 4], [2, 3, 9, 5, 9], [3, 9, 9, 9, 9]]


def test_training_learns_word_order(spark):
    rnd = random.Random(0)
    chain = {w: [f"w{rnd.randrange(60)}" for _ in range(2)] for w in [f"w{i}" for i in range(60)]}

    def walk(n):
        out = ["w0"]
        while len(out) < n:
            out.append(rnd.choice(chain[out[-1]]))
        return out
    docs = spark.createDataFrame([(i, " ".join(walk(100))) for i in range(300)], "doc_id long, text string").repartition(3)
    model = masked_scoring.fit(docs, buckets=512, classes=16, rounds=3, batch=512)
    plain = masked_scoring.start(masked_scoring.corpus_counts(docs, 512), 16, 2, 16, 7)
    real = [walk(100) for _ in range(20)]
    mixed = [rnd.sample(x, len(x)) for x in real]
    frame = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(real + mixed)], "doc_id long, text string")
    mean = lambda m: [np.mean([r["mean_log_prob"] for r in masked_scoring.score(frame, m).collect() if r["doc_id"] // 20 == k]) for k in (0, 1)]      # noqa: E731
    (good, bad), (before, _) = mean(model), mean(plain)
    assert good > before + 0.3 and good > bad + 0.3


def test_scores_of_edges(spark, edge_docs, edge_texts, no_docs):
    model = masked_scoring.fit(edge_docs, buckets=256, classes=8, rounds=1)
    rows = {r["doc_id"]: r for r in masked_scoring.score(edge_docs, model).collect()}
    assert set(rows) == {i for i, _ in edge_texts}
    for i in (9, 10, 11):
        assert (rows[i]["n_tokens"], rows[i]["log_likelihood"], rows[i]["mean_log_prob"]) == (0, 0.0, None)
    assert rows[3]["log_likelihood"] == pytest.approx(rows[5]["log_likelihood"]) and rows[40]["n_tokens"] > 5000
    assert masked_scoring.score(no_docs, masked_scoring.fit(no_docs, buckets=64, classes=4)).collect() == []


def test_rare_words_do_not_share_the_probability_of_their_bucket(spark):
    rows = [(i, w) for i, w in enumerate(["common"] * 30 + ["garbage", "rare", "odd"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = masked_scoring.fit(docs, buckets=1, classes=1, rounds=1)            # one bucket: only the words' own counts are left
    asked = spark.createDataFrame([(1, "common"), (2, "garbage"), (3, "unseen"), (4, "common rare"), (4, "common rare")], "doc_id long, text string")
    got = sorted((r["doc_id"], round(float(np.exp(r["log_likelihood"])), 6)) for r in masked_scoring.score(asked, model).collect())
    both = round(30 / 34 * 1 / 34, 6)
    assert got == [(1, round(30 / 34, 6)), (2, round(1 / 34, 6)), (3, round(1 / 34, 6)), (4, both), (4, both)]


def test_gradient_inside_classes_is_the_derivative():
    model, rng = small(), np.random.default_rng(4)
    flat = model.weights + rng.standard_normal(len(model.weights)) * 0.3
    around, ids = rng.integers(0, 41, (4, 30)), rng.integers(0, 40, 30)
    loss = lambda w: -masked_scoring.log_probabilities(masked_scoring.replace(model, weights=w), around, ids).mean()     # noqa: E731
    grad = masked_scoring.gradient(model, around, model.class_of[ids], flat, ids)
    for i in [*rng.integers(0, len(flat), 40), *rng.integers(len(flat) - 120, len(flat), 20)]:
        step = np.zeros_like(flat)
        step[i] = 1e-6
        assert abs((loss(flat + step) - loss(flat - step)) / 2e-6 - grad[i]) < 1e-6
    total = sum(np.exp(masked_scoring.log_probabilities(masked_scoring.replace(model, weights=flat), around, np.full(30, b))) for b in range(40))
    assert np.allclose(total, 1)


def test_words_of_one_class_depend_on_their_neighbours(spark):
    docs = spark.createDataFrame([(i, "a b " * 50 if i % 2 else "c d " * 50) for i in range(60)], "doc_id long, text string").repartition(2)
    model = masked_scoring.fit(docs, buckets=64, classes=1, batch=256)
    frame = spark.createDataFrame([(1, "a b a b a b"), (2, "a d a d a d")], "doc_id long, text string")
    good, bad = (r["mean_log_prob"] for r in masked_scoring.score(frame, model).orderBy("doc_id").collect())
    assert good > bad + 0.5


# nearest neighbours

def exact(rows, k):
    usable = {}
    for i, v in rows:
        if v and None not in v and np.isfinite(v).all() and any(v):
            usable[i] = np.array(v, float)
    out = {}
    for q, a in usable.items():
        near = sorted((-(a * b).sum() / (np.sqrt((b * b).sum()) * np.sqrt((a * a).sum())), i) for i, b in usable.items() if i != q and len(a) == len(b))
        out[q] = [(i, -s) for s, i in near[:k]]
    return out


def near(spark, rows, **more):
    docs = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, shard int").repartition(3)
    out = {}
    for r in hnsw.search(hnsw.build(docs, **more), docs, k=5).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall_over_several_shards(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((8, 16))
    vectors = (centres[rng.integers(0, 8, 900)] + 0.5 * rng.standard_normal((900, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    got, want = near(spark, rows, shard_points=250), exact(rows, 5)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / (5 * len(want)) >= 0.97
    assert all(s == sorted(s, reverse=True) for s in ([x for _, x in v] for v in got.values()))


def test_common_vectors_ties_and_bad_rows(spark):
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(0, 60, 2)] + [(1, [2.0, 1.0, 0.0]), (3, [0.0, 1.0, 0.0]), (5, [0.0, 0.0, 0.0]), (7, None), (9, []), (11, [1.0, None, 2.0]),
            (13, [float("nan"), 1.0, 1.0]), (15, [float("inf"), 0.0, 0.0]), (17, [1.0, 2.0]), (19, [2.0, 1.0]), (21, [5.0])]
    got, want = near(spark, rows), exact(rows, 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items() if v}
    assert all(got[q][k][1] == pytest.approx(want[q][k][1], abs=1e-15) for q in got for k in range(len(got[q])))


def test_recall_of_a_whole_shard_at_default_settings(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 64))
    clustered = centres[rng.integers(0, 60, 4000)] + 0.4 * rng.standard_normal((4000, 64))
    vectors = np.vstack([clustered, rng.standard_normal((4000, 64))]).astype(np.float32)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = {}
    for r in hnsw.search(hnsw.build(docs), docs.where("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 8000, 50):
        scores = unit @ unit[q]
        scores[q] = -2
        hits += len(got[q] & set(np.argsort(-scores)[:5].tolist()))
    assert set(got) == set(range(0, 8000, 50)) and hits / (5 * len(got)) >= 0.9


def test_blocks_of_queries_and_groups_of_shards_change_nothing(spark):
    rng = np.random.default_rng(4)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 8)))], "vec_id long, embedding array<double>").repartition(5)
    index = hnsw.build(docs, shard_points=40)
    whole = hnsw.search(index, docs).orderBy("query_id", "rank").collect()
    assert len(whole) == 1500 and hnsw.search(index, docs, block_bytes=1000).orderBy("query_id", "rank").collect() == whole
    assert whole == hnsw.search(hnsw.build(docs, shard_points=1000), docs).orderBy("query_id", "rank").collect()


def test_extreme_magnitudes_and_ids_with_several_vectors(spark):
    big = [(1, [1e-200, 2e-200]), (2, [1e200, 2.1e200]), (3, [1e-300, -1e-300]), (4, [5e-324, 0.0])]
    docs = spark.createDataFrame(big + [(9, [1.0, 2.0]), (9, [1.0, -1.0])], "vec_id long, embedding array<double>")
    got = {}
    for r in hnsw.search(hnsw.build(docs), docs).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert [i for i, _ in got[1]] == [9, 2, 4, 3] and got[1][0][1] == pytest.approx(1, abs=1e-15)
    assert got[3][0] == (9, pytest.approx(1, abs=1e-15)) and len(got[9]) == len({i for i, _ in got[9]}) == 4


def test_no_vectors(spark):
    assert near(spark, []) == {} and near(spark, [(1, [1.0, 2.0])]) == {}


def test_training_reads_the_texts_once(spark, monkeypatch):
    # before: one pass for the counts of buckets, one for those of words and one for every round
    read = spark.sparkContext.accumulator(0)
    texts = spark.createDataFrame([(i, f"red green blue w{i % 7}") for i in range(40)], "doc_id long, text string").repartition(3).localCheckpoint()

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text
    model = masked_scoring.fit(texts.select("doc_id", seen("text").alias("text")), buckets=64, classes=4, rounds=3)
    assert read.value == 40
    assert model.seen.sum() == 160
    assert np.array_equal(model.seen, masked_scoring.corpus_counts(texts, 64))


@pytest.mark.parametrize("span", [1, 40, 1 << 18])
def test_words_have_one_hash_however_texts_are_cut(monkeypatch, span):
    rows = ["", "Red green", "x" * 100, "", "red  GREEN blue, red", ""]
    data, offsets = np.frombuffer("".join(rows).encode(), np.uint8), np.cumsum([0, *map(len, rows)])
    monkeypatch.setattr(masked_scoring, "SPAN", span, raising=False)
    for low, high in ((0, 6), (3, 6), (0, 0), (0, 1)):
        own = offsets[low:high + 1]
        hashes, before = masked_scoring.hashed(data[own[0]:own[-1]], own - own[0])
        found = [w for row in rows[low:high] for w in row.lower().replace(",", " ").split()]
        assert before.tolist() == np.cumsum([0, *[len(r.replace(",", " ").split()) for r in rows[low:high]]]).tolist()
        assert [[a == b for b in found] for a in found] == (hashes[:, None] == hashes).tolist()


def test_hashing_words_takes_a_few_times_the_memory_of_their_text():
    # before: 29 times
    text = b"some words of a text " * 1000
    data, offsets = np.frombuffer(text * 100, np.uint8), np.arange(101) * len(text)
    masked_scoring.hashed(data, offsets)
    tracemalloc.start()
    try:
        masked_scoring.hashed(data, offsets)
        assert tracemalloc.get_traced_memory()[1] < 10 * len(data)
    finally:
        tracemalloc.stop()


def test_scores_of_any_size_have_finite_probabilities():
    rng = np.random.default_rng(3)
    target = np.array([0, 1, 2, 3])
    for size in (1.0, 50.0, 500.0):
        logits = (rng.standard_normal((4, 9)) * size).astype(np.float32)
        wide = logits.astype(float)
        want = wide[np.arange(4), target] - wide.max(1) - np.log(np.exp(wide - wide.max(1, keepdims=True)).sum(1))
        assert np.allclose(masked_scoring._softmax(logits, target)[0], want, rtol=1e-4, atol=1e-4)
