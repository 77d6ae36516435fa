import brute
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import prose

import corpus_pipeline
from metricloom.llm import pretokens


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Clean documents, near copies, shared passages, a benchmark passage, and documents without a language."""
    path = tmp_path_factory.mktemp("sf")
    passage, item = prose(500, 60), prose(501, 30)
    rows = [(i, prose(600 + i, 80), "aa") for i in range(12)]
    rows += [(20, rows[3][1] + " tail", "aa"), (21, rows[3][1], "aa"), (30, prose(700, 60) + passage + prose(701, 60), "aa"), (31, prose(702, 60) + passage + prose(703, 60), None),
             (40, prose(704, 20) + item + prose(705, 20), "aa"), (50, None, "aa"), (51, "", "aa"), (52, "123 456 ...", "aa")]
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "lang": [r[2] for r in rows], "source": ["s"] * len(rows),
                      "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64()), "score": [1.0] * len(rows), "chunk": ["x"] * len(rows), "rest": [None] * len(rows)})
    table = table.set_column(7, "rest", pa.array([None] * len(rows), pa.string()))
    pq.write_table(table, path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1], pa.int64()), "text": [item]}), path / "benchmark.parquet")
    return str(path), rows, passage


def test_every_stage_takes_effect(spark, folder):
    path, rows, passage = folder
    docs, texts = spark.read.parquet(f"{path}/documents.parquet"), {r[0]: r[1] for r in rows}
    columns = docs.dtypes
    kept = set(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, path), name)
        assert docs.dtypes == columns, name
        got = {r["doc_id"]: r for r in docs.collect()}
        if name == "language_id":
            kept -= {50, 51, 52}
            assert got[31]["lang"] == "aa" and got[0]["lang"] == "aa"
        elif name == "near_duplicates":
            want = brute.near_duplicates([(i, texts[i]) for i in kept], 5)
            kept = {i for i in kept if want[i][1] == i}
            assert {20, 21}.isdisjoint(kept)
        elif name == "repeated_passages":
            assert passage in got[30]["text"] and passage[10:-10] not in got[31]["text"] and got[31]["n_chars"] == len(got[31]["text"])
            assert all(got[i]["text"] == texts[i] for i in kept - {31})
        else:
            kept -= {40}
        assert set(got) == kept, name
    library = pretokens.library(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    final = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()}
    want = {r["doc_id"]: library.encode(r["text"], add_special_tokens=False).ids for r in docs.collect()}
    assert {i: r["ids"] for i, r in final.items()} == want and all(r["n_tokens"] == len(r["ids"]) for r in final.values())
    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, path).collect()} == want


def test_empty_documents(spark, folder, tmp_path):
    path = folder[0]
    empty = pq.read_table(f"{path}/documents.parquet").slice(0, 0)
    pq.write_table(empty, tmp_path / "documents.parquet")
    pq.write_table(pq.read_table(f"{path}/benchmark.parquet"), tmp_path / "benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("lang", [None, "und", "missing"])
def test_language_stage_without_labels_rejects_only_texts_without_letters(spark, lang):
    rows = [(1, "some words", lang), (2, None, lang), (3, "", lang), (4, "12 ?!", lang), (5, "é", lang)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = docs.drop("lang") if lang == "missing" else docs
    got = corpus_pipeline.identify_language(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [r[:len(docs.columns)] for r in rows if r[0] in (1, 5)]
