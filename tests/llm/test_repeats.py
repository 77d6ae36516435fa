import random
from pathlib import Path

import brute
import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F

from metricloom.llm import anchors, seed_extend, suffix_repeats
from metricloom.llm.queries import _span_sum

WORDS = ("n_words", "n_removed", "kept_sha256")
BYTES = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def by_words(docs, **more):
    found = seed_extend.repeated_spans(docs, **more).withColumn("n_removed", _span_sum()).withColumn("kept_sha256", F.sha2("kept", 256))
    return {r["doc_id"]: tuple(r[c] for c in WORDS) for r in found.collect()}


def by_bytes(docs, **more):
    found = suffix_repeats.repeated_bytes(docs, **more).withColumn("n_removed", _span_sum()).withColumn("n_spans", F.size("spans")).withColumn("kept_sha256", F.sha2("kept", 256))
    return {r["doc_id"]: tuple(r[c] for c in BYTES) for r in found.collect()}


def test_words_match_brute_force(edge_docs, edge_texts):
    assert by_words(edge_docs, chunk_bytes=2000) == brute.repeated_words(edge_texts)


def test_bytes_match_brute_force(edge_docs, edge_texts):
    assert by_bytes(edge_docs, chunk_bytes=2000) == brute.repeated_bytes(edge_texts)


def test_anchors_with_many_contexts_are_divided_without_loss(edge_docs, edge_texts):
    assert by_bytes(edge_docs, many=1) == brute.repeated_bytes(edge_texts)


@pytest.mark.parametrize("of", [by_words, by_bytes])
def test_empty_table(no_docs, of):
    assert of(no_docs) == {}


def test_rows_with_equal_ids_are_one_document(spark):
    text = prose(1, 60)
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r["doc_id"], len(r["kept"]) > 0) for r in suffix_repeats.repeated_bytes(docs).collect()) == [(1, True), (1, True), (2, False)]
    assert sorted((r["doc_id"], len(r["kept"]) > 0) for r in seed_extend.repeated_spans(docs).collect()) == [(1, True), (1, True), (2, False)]


def test_hot_passage_between_different_neighbours(spark):
    line = "this very common line stands in every third document of the corpus, whatever surrounds it"
    rows = [(i, f"{prose(i, 30)} {line if i % 3 == 0 else ''} {prose(1000 + i, 30)}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_words(docs) == brute.repeated_words(rows)
    assert by_bytes(docs) == brute.repeated_bytes(rows)
    assert by_bytes(docs, many=8) == brute.repeated_bytes(rows)


def test_whole_characters_and_carried_rows(spark):
    shared = "é" * 40
    docs = spark.createDataFrame([(1, "a" + shared + "b", 5), (2, "x" + shared + "y", 6)], "doc_id long, text string, kept int")
    rows = {r["doc_id"]: r for r in suffix_repeats.repeated_bytes(docs, whole_characters=True, carry=True).collect()}
    assert rows[2]["kept"].decode() == "xy" and rows[2]["rest"]["kept"] == 6 and rows[1]["rest"]["text"] == "a" + shared + "b"


def test_carried_rows_keep_nulls_and_texts_of_other_types(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "abc", None), (None, "abc", 7)], "doc_id long, text string, rest int")
    found = suffix_repeats.repeated_bytes(docs, carry=True)
    assert found.schema["rest"].dataType.simpleString() == "struct<doc_id:bigint,text:string,rest:int>"
    assert sorted(tuple(r["rest"]) + (bytes(r["kept"]),) for r in found.collect()) == [(1, None, 5, b""), (2, "", 6, b""), (3, "abc", None, b"abc")]
    numbers = docs.select("doc_id", (F.col("doc_id") * 7).alias("text"))
    assert sorted(tuple(r["rest"]) + (bytes(r["kept"]),) for r in suffix_repeats.repeated_bytes(numbers, carry=True).collect()) == [(i, 7 * i, b"%d" % (7 * i)) for i in (1, 2, 3)]


def test_chunks_that_ask_together_get_their_own_answers(edge_docs, edge_texts):
    assert sum(len((t or "").encode()) for _, t in edge_texts) / 60 > 8 * 96        # 96 packs of eight chunks and more
    assert by_bytes(edge_docs, chunk_bytes=60) == brute.repeated_bytes(edge_texts)


def test_disk_of_shared_phrases_and_many_chunks(spark):
    """Texts of few words share short anchors by chance; 400 chunks ask. Written: the text once, and questions of less than its size."""
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(7)) for _ in range(40)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(1500))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    size = sum(len(t) for _, t in rows)
    folders = [Path(d.getPath()) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    there = {f for d in folders for f in d.rglob("shuffle_*.data")}
    found = suffix_repeats.repeated_bytes(docs, carry=True, chunk_bytes=-(-size // 400))
    assert found.count() == len(rows)
    written = sum(f.stat().st_size for d in folders for f in d.rglob("shuffle_*.data") if f not in there)
    assert written < 2.5 * size


def test_steps_name_the_leading_bits_of_sorted_keys():
    rnd = np.random.default_rng(0)
    cut = np.uint64(64 - anchors.NAMED)
    top = np.array([0, 1, 2**24 - 1, 2**24, 2**37, 2**anchors.NAMED - 1], np.uint64) << cut
    parts = [np.sort(rnd.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)) for n in (1, 5, 3000)] + [top, top[:1], np.repeat(top, 2)]
    assert anchors.from_steps(anchors.steps(parts)).tolist() == (np.concatenate(parts) >> cut).tolist()
    assert anchors.from_steps(b"").tolist() == []
    for n in range(9):
        values = rnd.integers(0, 4, n).astype(np.uint8)
        assert anchors.from_quarters(anchors.quarters(values))[:n].tolist() == values.tolist()


def test_maximal_repeats_against_every_substring():
    rnd = random.Random(3)
    for _ in range(30):
        data = np.array([rnd.choice(b"ab") for _ in range(40)], np.uint8)
        starts, sizes = np.arange(40), 40 - np.arange(40)
        order, common = suffix_repeats.suffix_array(data, starts, sizes)
        assert [bytes(data[i:]) for i in order] == sorted(bytes(data[i:]) for i in range(40))
        left = [int(data[i - 1]) if i else -1 for i in order]
        got = {(bytes(data[order[a]:order[a] + d]), tuple(sorted(order[a:b + 1].tolist()))) for d, a, b in suffix_repeats.maximal_repeats(common.tolist(), left, 3)}
        want, text = set(), bytes(data)
        for d in range(3, 40):
            for s in {text[i:i + d] for i in range(41 - d)}:
                at = [i for i in range(41 - d) if text[i:i + d] == s]
                lefts, rights = [text[i - 1] if i else -1 for i in at], [text[i + d] if i + d < 40 else -1 for i in at]
                if len(at) > 1 and (len(set(lefts)) > 1 or -1 in lefts) and (len(set(rights)) > 1 or -1 in rights):
                    want.add((s, tuple(at)))
        assert got == want
