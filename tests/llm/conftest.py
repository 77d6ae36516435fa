import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, vocabulary=400):
    """Words of a small invented vocabulary; some are followed by odd blanks and marks."""
    rnd = random.Random(seed)
    parts = ["ta", "ri", "on", "the", "èl", "ñu", "ST", "o'", "42", "ß"]
    words = ["".join(rnd2.choice(parts) for _ in range(1 + i % 4)) + str(i % 7) * (i % 3 == 0) for i in range(vocabulary) for rnd2 in [random.Random(i)]]
    return "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\n", ", ", "\t"]) for _ in range(n))


@pytest.fixture(scope="session")
def edge_texts():
    """Texts with nulls, blanks, copies, near copies, shared passages, very long and repetitive ones; ids have gaps."""
    base = [prose(i, 120) for i in range(12)]
    passage = prose(99, 40)
    rows = [(3, base[0]), (5, base[0]), (8, base[0].upper()), (9, None), (10, ""), (11, " \n\t "), (12, "one two"), (13, "one two"), (14, "é"),
            (20, base[1] + passage + base[2]), (21, base[3] + passage + base[4]), (22, passage), (23, base[5][:300] + "x" + base[5][300:]), (24, base[5]),
            (30, "ab " * 400), (31, "ab " * 300), (32, "a" * 500), (33, "a" * 49), (34, "a" * 50), (40, "".join(prose(i, 500) for i in range(20, 40))),
            (41, base[6] + " " + base[7]), (42, base[7] + " " + base[6]), (43, "<|endoftext|> x <|startoftext|><|endoftext|>"), (2**40, base[8] + passage[:150])]
    rows += [(100 + i, base[9][:40 * i] + prose(200 + i, 3) + base[9][40 * i:]) for i in range(12)]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_texts):
    """The edge texts as documents, over several partitions, with columns whose names operators use themselves."""
    rows = [(i, t, None, "s", len(t) if t else None, 1.5, "x", 7) for i, t in edge_texts]
    return spark.createDataFrame(rows, SCHEMA + ", score double, lang_pred string, chunk int").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
