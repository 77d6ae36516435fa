import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import prose
from tokenizers import Tokenizer

from metricloom.llm import alignment
from metricloom.llm.pretokens import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows, links="end"):
    """doc -> (n_a, n_b, n_groups, n_links, n_best, count_sum, groups), by trying every pair of tokens."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = {v: k for k, v in byte_letters().items()}
    linked, out = {}, {}
    for doc, text in rows:
        want = b" " + (text or "").encode()
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "", out_type=int)
        bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            linked[doc], out[doc] = [], (0, 0, 0, 0, 0, 0, "")
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, low = [], 0
        for cut in cuts:
            groups.append(",".join(str(i) for i, e in zip(ids_a, ends_a) if low < e <= cut) + "|" + ",".join(str(i) for i, e in zip(ids_b, ends_b) if low < e <= cut))
            low = cut
        pairs = []
        for x, (i, e) in enumerate(zip(ids_a, ends_a)):
            for y, (j, f) in enumerate(zip(ids_b, ends_b)):
                s, t = ([0] + ends_a)[x], ([0] + ends_b)[y]
                if (e == f) if links == "end" else (s < f and t < e):
                    pairs.append((i, j))
        linked[doc], out[doc] = pairs, (len(ids_a), len(ids_b), len(cuts), len(pairs), 0, 0, ";".join(groups))
    count = Counter(p for pairs in linked.values() for p in pairs)
    most = defaultdict(int)
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    return {d: (*o[:4], sum(count[p] == most[p[1]] for p in linked[d]), sum(count[p] for p in linked[d]), o[6]) for d, o in out.items()}


@pytest.fixture(scope="module")
def rows():
    texts = [prose(i, 25) for i in range(8)] + [None, "", " ", "a", "naïve  café\n\n\tзима 雪 🙂", "▁ given as itself", "<|endoftext|> and </s> are text", "<0x41>", "x" * 300, "\n" * 40, "0\0 1"]
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("links", ["end", "overlap"])
def test_against_every_pair_of_tokens(spark, rows, links):
    frame = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, chunk int, n_a int, groups string").repartition(3)
    found = {r[0]: tuple(r)[1:] for r in alignment.align(frame, A, B, links).collect()}
    assert found == brute(rows, links)
    assert found[8 * 3] == found[13 * 3] == (0, 0, 0, 0, 0, 0, "") and found[11 * 3][0] > 0


def test_digest_repeated_rows_and_empty_table(spark, rows):
    frame = spark.createDataFrame(rows + rows + [(None, "x")], "doc_id long, text string")
    found = sorted(tuple(r) for r in alignment.align(frame, A, B, "end", digest=True).collect())
    assert found[::2] == found[1::2] and len(found) == 2 * len(rows)
    once = brute(rows)
    assert {r[0]: r[6:] for r in found} == {d: (2 * o[5], hashlib.sha256(o[6].encode()).hexdigest() if o[6] else "") for d, o in once.items()}
    assert alignment.align(frame.limit(0), A, B).collect() == []


def test_groups_break_where_a_start_reaches_the_greatest_end():
    a, b = np.array([0, 2, 5, 6]), np.array([0, 4, 5])
    ends_a, ends_b = np.array([2, 5, 6, 9]), np.array([4, 5, 9])
    group_a, group_b = alignment.coalesced(a, ends_a, b, ends_b)
    assert group_a.tolist() == [0, 0, 1, 1] and group_b.tolist() == [0, 0, 1]
    x, y = alignment.expanded(a, ends_a, b, ends_b)
    assert list(zip(x.tolist(), y.tolist())) == [(0, 0), (1, 0), (1, 1), (2, 2), (3, 2)]
