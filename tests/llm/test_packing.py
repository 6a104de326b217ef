import numpy as np
import pytest

from lodestone.llm.packing import END, pack
from lodestone.llm.tokens import Encoder


@pytest.fixture(scope="module")
def enc():
    return Encoder()


def brute(enc, rows, window):
    whole, owner = [], []
    for d, t in sorted(((d, t) for d, t in rows if t), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*enc.bpe.encode_ordinary(t), END]
        whole += ids
        owner += [(d, i) for i in range(len(ids))]
    return [(whole[i : i + window], owner[i : i + window]) for i in range(0, len(whole), window)]


@pytest.mark.parametrize("window", [1, 7, 64, 5000])
def test_same_as_brute_force(spark, enc, window):
    rng = np.random.default_rng(window)
    words = ["the", "dog's", "naïve", "x1y2", "Ärger,\n", "...", "日本語", "\n\n", "don't"]
    rows = [(int(i), " ".join(rng.choice(words, rng.integers(0, 60)))) for i in rng.permutation(80)]
    rows += [(None, "no id"), (3, None), (4, ""), (5, "same id"), (5, "same id"), (6, "a  b   c \n "), (7, "w " * 3000)]
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], "doc_id long, text string, ids string, window_id string").repartition(5)
    got = sorted(pack(df, window).collect(), key=lambda r: r.window_id)
    want = brute(enc, rows, window)
    assert [r.window_id for r in got] == list(range(len(want)))
    for r, (ids, owner) in zip(got, want):
        assert r.ids == ids and r.n_tokens == len(ids)
        there = [(s.doc_id, s.doc_start + k) for s in r.segments for k in range(s.n)]
        assert there == owner
        assert [s.start for s in r.segments] == np.cumsum([0, *(s.n for s in r.segments)])[:-1].tolist()


def test_rows_of_one_or_no_id(spark, enc):
    rows = [(None, f"text {i % 17} of none") for i in range(60)] + [(5, f"text {i} of five") for i in range(40)]
    got = sorted(pack(spark.createDataFrame(rows, "doc_id int, text string").repartition(4), 50).collect(), key=lambda r: r.window_id)
    assert [(r.ids, [(s.doc_id, s.doc_start + k) for s in r.segments for k in range(s.n)]) for r in got] == brute(enc, rows, 50)
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pack(df).collect() == []
    assert pack(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("text", ["", " ", "  ", "a b", "a  b", "a   b", " a", "a ", "a \n", "a\n ", "a\n\n b", "\t a", "a  b", "it's  we'll", "a \n b", "\n a"])
def test_encoder_is_exact(enc, text):
    ids, n = enc.encode([text, "x", text])
    one = enc.bpe.encode_ordinary(text)
    assert n.tolist() == [len(one), 1, len(one)] and ids.tolist() == [*one, *enc.bpe.encode_ordinary("x"), *one]
