import re
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from metricloom.llm import quality_rules as q

SPACED = brute.SPACED


def measured(text):
    text = text or ""
    words, lines = SPACED.findall(text), [x for x in text.split("\n") if SPACED.search(x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {p for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for p in range(i, i + 3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines),
            sum(c.isalpha() for c in text), len(re.findall("[A-Z]", text)))


@pytest.fixture(scope="module")
def rows(edge_texts):
    texts = [t for _, t in edge_texts] + ["a b c a b c", "a a a", "a a a a", "a b c d a b c", "x\nx\n\n \nx\t\nx", "#*$%&|<> #", "ÄÖ ÉÀ ß 🙂 雪", "A  B\vC\fD\rE\x85F G", "SHOUT " * 60,
                                          " lead and trail ", "a b\n" * 70, "a b ca b c", "a bc a b c"]
    return list(enumerate(texts))


def test_measurements_match_brute_force(spark, rows):
    frame = spark.createDataFrame([(i, t, 7, True) for i, t in rows], "doc_id long, text string, failed int, n_words boolean").repartition(4)
    got = {r[0]: tuple(r)[1:] for r in q.ledger(frame).collect()}
    assert {i: g[:8] for i, g in got.items()} == {i: measured(t) for i, t in rows}
    for i, (n, chars, symbols, dup, repeat, lines, letters, capitals, failed) in got.items():
        fails = [n < 50, 2 * repeat > n, chars < 3 * n, chars > 10 * n, 10 * symbols > n, 10 * dup > 3 * lines, 10 * letters < 7 * chars, 2 * capitals > chars]
        assert failed == sum(1 << k for k, f in enumerate(fails) if f), i


def test_equal_hashes_are_compared_as_words(spark, monkeypatch):
    monkeypatch.setattr(q.F, "xxhash64", lambda *c: F.lit(1).cast("long"))      # every window looks like every other
    texts = [(0, "a b c d e a b c"), (1, "a b c d e"), (2, "a b")]
    got = {r["doc_id"]: r["n_repeat_words"] for r in q.ledger(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {0: 6, 1: 0, 2: 0}


def test_policies_and_ablations_read_the_bits(spark):
    rules = (q.Rule("short", "n_words < 3"), q.Rule("symbols", "n_symbols > 0"), q.Rule("lines", "n_dup_lines > 0"))
    policies = (q.Policy("p", 1, ("short",)), q.Policy("p", 2, ("short", "symbols")), q.Policy("all", 1, ("short", "symbols", "lines")))
    texts = [("x", "a b c"), ("x", "a"), ("x", "a #"), ("y", "a b c #"), ("y", "a\na\na"), ("y", None), (None, "a b c d")]
    frame = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)] + [(None, "x", "")], "doc_id long, source string, text string")
    rows = q.ledger(frame, rules, by="source").cache()
    assert sorted(r["failed"] for r in rows.collect()) == [0, 0, 1, 1, 1, 2, 3, 4]
    judged = q.judged(rows, policies, rules).agg(*[F.sum(F.col(c).cast("int")) for c in ("kept_p_v1", "kept_p_v2", "kept_all_v1")]).first()
    assert tuple(judged) == (4, 3, 2)
    got = {(r["policy"], r["version"], r["rule"]): tuple(r)[3:] for r in q.ablations(rows, policies, rules).collect()}
    assert got["p", 1, "short"] == (8, 4, 4, 4, 8, 7, 0)
    assert got["p", 2, "short"] == (8, 4, 3, 3, 6, 7, 0) and got["p", 2, "symbols"] == (8, 2, 1, 3, 4, 7, 0)
    assert got["all", 1, "lines"] == (8, 1, 1, 2, 3, 7, 0) and len(got) == 6
    split = {(r["group"], r["rule"]): (r["n_docs"], r["n_failed"], r["any_bits"]) for r in q.ablations(rows, policies[:1], rules, by="group").collect()}
    assert split == {("x", "short"): (4, 3, 3), ("y", "short"): (3, 1, 7), (None, "short"): (1, 0, 0)}


def test_no_documents(no_docs):
    assert q.ledger(no_docs).collect() == [] and q.ablations(q.ledger(no_docs)).collect() == []


def test_plan_has_no_python(spark, no_docs):
    plan = q.judged(q.ledger(no_docs))._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Exchange" not in plan
