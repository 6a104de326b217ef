import random

import pytest

from lodestone.llm import bpe
from lodestone.llm.bpe import decode, encode, join
from lodestone.llm.tokens import Encoder


@pytest.fixture(scope="module")
def enc():
    return Encoder()


def test_join_is_exact_wherever_the_cuts_are(enc):
    rng = random.Random(5)
    bits = ["a", "foo", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "l", "e", "r", "1", "23", ".", "!?", "é", "ß", "日本", " bar", " ", "don't", " 'v", "e's"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 30)))
        cuts = sorted(rng.sample(range(1, len(text)), min(len(text) - 1, rng.randint(0, 6)))) if len(text) > 1 else []
        parts = [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)])]
        assert join([(p, enc.bpe.encode_ordinary(p)) for p in parts], enc) == enc.bpe.encode_ordinary(text), parts


def test_chunks_are_cut_by_content(spark):
    import pyarrow as pa

    rng = random.Random(1)
    body = " ".join(rng.choice(["über", "wort", "none", "日本", "x9"]) + str(rng.randint(0, 999)) for _ in range(4000))
    a, b = ([*x] for x in bpe.chunked(pa.array([body, "other start " + body])))
    assert b"".join(a).decode() == body and len(a) > 10
    assert len(set(a) & set(b)) >= len(a) - 2
    for c in a:
        c.decode()


def test_same_as_encoding_whole_and_back(spark, enc):
    rng = random.Random(2)
    words = ["über", "alpha", "beta's", "\n", "  ", "x1", "日本", "...", "don't"]
    passage = " ".join(rng.choice(words) for _ in range(900))
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 300))) + (passage if i % 3 == 0 else "")) for i in range(60)]
    rows += [(None, passage), (1, None), (2, ""), (7, rows[3][1]), (3, rows[3][1]), (100, passage * 30), (101, "a" * 30000), (102, " ")]
    df = spark.createDataFrame([(a, b, "z", 1) for a, b in rows], "doc_id long, text string, ids string, owner int").repartition(3)
    out = encode(df)
    got = sorted(((r.doc_id, r.n_tokens, r.ids) for r in out.collect()), key=repr)
    want = sorted(((d, len(x), x) for d, t in rows for x in [enc.bpe.encode_ordinary(t or "")]), key=repr)
    assert got == want
    back = sorted(map(tuple, decode(out).collect()), key=repr)
    assert back == sorted(((d, t or "") for d, t in rows), key=repr)


def test_round_trip_column(spark):
    rows = [(1, "some über text " * 500), (2, "other " + "some über text " * 500), (None, None), (3, "")]
    out = encode(spark.createDataFrame(rows, "doc_id long, text string"), verify=True).collect()
    assert len(out) == 4 and all(r.round_trip is True for r in out)


def test_decoding_odd_rows(spark, enc):
    rows = [(1, [1, 2]), (1, [1, 2]), (None, [1]), (2, None), (3, []), (4, [10**6]), (5, [-1]), (6, [1, None]), (7, [5] * 50_000)]
    df = spark.createDataFrame([(a, b, "clash") for a, b in rows], "doc_id long, ids array<int>, text string")
    want = sorted(((a, None if b is None or any(x is None or not 0 <= x < enc.size for x in b) else enc.bpe.decode(b)) for a, b in rows), key=repr)
    assert sorted(map(tuple, decode(df).collect()), key=repr) == want and decode(df.limit(0)).collect() == []


def test_no_rows(spark):
    assert encode(spark.createDataFrame([], "doc_id long, text string")).collect() == []
