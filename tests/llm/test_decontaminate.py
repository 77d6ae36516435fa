import random

import brute
import pytest
from conftest import prose

from metricloom.llm.decontaminate import Automaton, cleaned, hits, judged

COLUMNS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.fixture(scope="module")
def items():
    long = prose(7, 60)
    return [(1, long), (2, long), (3, "Short Item, of six words!"), (4, None), (5, ""), (6, " ,;"), (7, "word"), (8, prose(8, 13)), (9, "a a a a a a a a a a a a a a a a"), (10, prose(1, 20))]


@pytest.fixture(scope="module")
def texts(items):
    long = items[0][1]
    return [(1, None), (2, ""), (3, "!?"), (4, "x " * 50 + long + " y" * 30), (5, "x " * 900 + long[:200]), (6, "an short item of SIX words here"), (7, "Word word"), (8, "a " * 40), (9, prose(3, 400)),
            (10, "<p>" + items[7][1].replace(" ", "\x00") + "</p>"), (11, prose(1, 300)), (12, prose(30, 30) * 400 + long)]


def found(spark, texts, items, **more):
    docs = spark.createDataFrame([(*t, 0, "c") for t in texts], "doc_id long, text string, n_hit int, spans string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in judged(hits(docs, bench, **more)).collect()}


def test_matches_brute_force(spark, texts, items):
    assert found(spark, texts, items) == brute.contamination(texts, items)


def test_blocks_of_items_agree(spark, texts, items):
    assert found(spark, texts, items, block_bytes=300) == brute.contamination(texts, items)


@pytest.mark.parametrize("block_bytes", [60, 1 << 20])
def test_repeated_rows_stay_over_blocks(spark, texts, items, block_bytes):
    docs = spark.createDataFrame([*texts, *texts, texts[0]], "doc_id long, text string").repartition(4)
    got = judged(hits(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)).collect()
    want = brute.contamination(texts, items)
    assert len(got) == 2 * len(texts) + 1
    assert all(tuple(r[c] for c in COLUMNS) == want[r["doc_id"]] for r in got)


@pytest.mark.parametrize("block_bytes", [80, 1 << 20])
def test_passages_are_cut_and_covered_documents_dropped(spark, block_bytes):
    item, short = " ".join(f"w{i}" for i in range(20)), "tiny item here"
    plain = " ".join(f"p{i}" for i in range(600))
    rows = [(1, f"{plain} ({item.upper()})! é {plain}"), (2, item), (3, plain), (4, None), (5, f"{plain}\n{short}, {plain}"), (6, f"{plain} {item} x {item}")]
    bench = spark.createDataFrame([(1, item), (2, short)], "item_id long, text string")
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string").repartition(2)
    got = sorted(tuple(r) for r in cleaned(docs, bench, block_bytes=block_bytes).collect())
    cut = (1, f"{plain} ()! é {plain}", 20)
    assert got == [cut, cut, (3, plain, 0), (4, "", 0), (5, rows[4][1], 0)]
    got = {r[0]: r[2] for r in cleaned(docs, bench, least_words=3, coverage=5, block_bytes=block_bytes).collect()}
    assert got == {1: 20, 3: 0, 4: 0, 5: 3, 6: 40}


def test_without_items_or_documents(spark, texts, items):
    assert all(v[1:3] == (0, 0) and not v[4] for v in found(spark, texts, []).values())
    assert found(spark, [], items) == {}


def test_automaton_finds_longest_matches():
    rnd = random.Random(4)
    for _ in range(40):
        items = [[rnd.randrange(3) for _ in range(rnd.randrange(1, 12))] for _ in range(4)]
        automaton = Automaton([(str(i), x) for i, x in enumerate(items)], 3)
        factors = {tuple(x[i:j]) for x in items for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        stream, state, matched = [rnd.randrange(4) for _ in range(40)], 0, 0
        for n, word in enumerate(stream, 1):
            state, matched = automaton.step(state, matched, word)
            assert matched == max(k for k in range(n + 1) if k == 0 or tuple(stream[n - k:n]) in factors)
