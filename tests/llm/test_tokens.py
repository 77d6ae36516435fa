import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from metricloom.llm import pretokens, simple8b, token_counts, token_files, word_table_bpe
from metricloom.llm.shared import shared_folder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", " a  b\n\nc \t d's 're 'll'sam don't I've !'s ''s 's", "x  ", "  x", "ΟΔΟΣ Σ ΑΣ", "İstanbul ǅ ﬁ é", "éa 12345 ½ ²", "日本語 テスト 😀😀 👩‍👩‍👧",
       "'S 'T DON'T", "a' s", "\r\n\r\nfoo", "''re", "a're 're're", "<|endoftext|>  <|startoftext|>b <|endoftext|>\n", "<|endoftext", "  x  y"]


@pytest.mark.parametrize("path, words", [(BYTES, False), (WORDS, True)])
def test_splits_and_merges_are_the_librarys(path, words):
    own = pretokens.Encoder(path, words)
    every = [chr(c) for c in (*range(1, 0x3000), *range(0xA640, 0xA800), *range(0xF900, 0x10000, 3), *range(0x10000, 0x20000, 7))]
    rows = ODD + ["a" + c + "a" for c in every] + ["9" + c + "!'s" for c in every] + [" ".join(every)]
    ids, offsets = own.ids(rows)
    want = [x.ids for x in own.tokenizer.encode_batch(rows, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_any_text(rows):
    for path, words in ((BYTES, False), (WORDS, True)):
        own = pretokens.encoder(path, words)
        ids, offsets = own.ids(rows)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [own.tokenizer.encode(x, add_special_tokens=False).ids for x in rows]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 70000), st.integers(0, 2**64 - 1), st.just(0)), max_size=300))
def test_simple8b_round_trip(values):
    words, escapes = simple8b.encode(np.array(values, np.uint64))
    assert simple8b.decode(words, escapes, len(values)).tolist() == values
    assert len(escapes) == sum(v >= 2**60 for v in values)


def test_simple8b_packs():
    assert len(simple8b.encode(np.zeros(240, np.uint64))[0]) == 2
    assert len(simple8b.encode(np.full(60, 7, np.uint64))[0]) == 3
    assert len(simple8b.encode(np.full(40, 32767, np.uint64))[0]) == 10


def test_token_files(spark, edge_docs, edge_texts):
    target = f"{shared_folder(spark)}/tokens"
    token_files.write_tokens(edge_docs, BYTES, target, block_ids=300)
    library, start, want, lists = pretokens.library(BYTES), 0, {}, {}
    for doc, text in sorted(edge_texts, key=lambda x: x[0]):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want[doc] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        lists[doc] = ids
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_digests(spark, target).collect()} == want
    assert {r["doc_id"]: r["ids"] for r in token_files.read_tokens(spark, target).collect()} == lists
    blocks = token_files.read_blocks(spark, target).orderBy("part", "block").collect()
    assert [d for b in blocks for d in b["docs"]] == sorted(lists) and len(blocks) > 10


def test_token_files_of_nothing(spark, no_docs):
    target = f"{shared_folder(spark)}/no-tokens"
    token_files.write_tokens(no_docs, BYTES, target)
    assert token_files.read_digests(spark, target).collect() == []


def test_proven_strings_encode_alone():
    own = pretokens.encoder(WORDS, True)
    proven = token_counts.proven(WORDS)
    assert 30_000 < len(proven) < 49_408
    p = pretokens.split(["the", "qzxv", "token"], True, {})
    assert np.isin(p.hashes, proven).tolist() == [len(own.merge(w)) == 1 for w in ("the", "qzxv", "token")]


def test_token_counts(edge_docs, edge_texts):
    library = pretokens.library(WORDS)
    want = {}
    for doc, text in edge_texts:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want[doc] = (len((text or "").encode()), n, n > 100)
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(edge_docs, WORDS, limit=100).collect()} == want


def test_counts_of_nothing(no_docs):
    assert token_counts.count_tokens(no_docs, WORDS).collect() == []


def test_word_table(edge_docs, edge_texts):
    library = pretokens.library(WORDS)
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in word_table_bpe.decode(word_table_bpe.encode(edge_docs, WORDS, chunk_bytes=2000), WORDS).collect()}
    want = {}
    for doc, text in edge_texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[doc] = (ids, library.decode(ids, skip_special_tokens=False))
    assert got == want
    assert {r["doc_id"]: (r["ids"], r["decoded"]) for r in word_table_bpe.encode(edge_docs, WORDS, decoded=True).collect()} == want


def test_decoding_drops_unknown_ids_and_reads_nulls(spark):
    rows = spark.createDataFrame([(1, [320, 99999, -1, 49407]), (2, None), (3, [])], "doc_id long, ids array<int>")
    library = pretokens.library(WORDS)
    assert {r["doc_id"]: r["decoded"] or "" for r in word_table_bpe.decode(rows, WORDS).collect()} == {1: library.decode([320, 49407], skip_special_tokens=False), 2: "", 3: ""}


def test_digests(spark):
    from metricloom.llm.digests import of_tokens
    rows = of_tokens(spark.createDataFrame([(1, [320, 1]), (2, []), (3, None)], "doc_id long, ids array<int>"), WORDS).orderBy("doc_id").collect()
    text = pretokens.library(WORDS).decode([320, 1], skip_special_tokens=False)
    assert rows[0]["ids_sha256"] == hashlib.sha256(b"\x40\1\0\0\1\0\0\0").hexdigest() and rows[0]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert all(r["n_tokens"] == 0 and r["ids_sha256"] == r["decoded_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows[1:])


def test_remembered_pretokens_take_little_memory():
    # a dictionary of tuples took some 300 bytes of each, and a lookup of its own
    own = pretokens.Encoder(BYTES, False)
    texts = [" ".join(f"w{i * 7919 % 100_003}x" for i in range(low, low + 5000)) for low in range(0, 40_000, 5000)]
    ids, offsets = own.ids(texts)
    assert len(own.known) >= 40_000
    held = sum(own.known.__dict__[k].nbytes for k in ("keys", "begins", "sizes", "flat"))
    assert held < 100 * len(own.known)
    again, same = own.ids(texts)
    assert np.array_equal(ids, again) and np.array_equal(offsets, same)
    small = pretokens.Encoder(BYTES, False, memory=100)                 # forgets between batches
    assert np.array_equal(np.concatenate([small.ids([t])[0] for t in texts]), ids)
    assert ids[offsets[3]:offsets[4]].tolist() == own.tokenizer.encode(texts[3], add_special_tokens=False).ids
