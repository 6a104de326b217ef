import base64
import time
from itertools import chain

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from lodestone.llm import lm
from lodestone.llm.tokens import FOLDER, PATTERN, VOCABULARY, Encoder


def slow_score(p, t, ids):
    """Token by token: the context of a place is what its scoring window holds up to it."""
    total, before = 0.0, [lm.END, *ids[:-1]]
    for i, own in enumerate(ids):
        first = max(0, i // lm.STRIDE * lm.STRIDE - (lm.WINDOW - lm.STRIDE))
        x = np.array([p["emb"][t.row[b]] for b in before[first : i + 1]])
        q = x[-1] @ p["q"]
        s = np.array([q @ (y @ p["k"]) / np.sqrt(lm.WIDTH) + p["far"][len(x) - 1 - j] for j, y in enumerate(x)])
        w = np.exp(s - s.max())
        w /= w.sum()
        z = np.concatenate([x[-1], w @ (x @ p["v"])]) @ p["o"] + p["b"]
        total += np.log(np.exp(z - z.max()).sum()) + z.max() - z[t.cls[own]] + t.within[own]
    return total


def small_model():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 100, lm.IDS)
    t = lm.tables(counts)
    p = lm.fresh(t, counts)
    p["far"] = rng.normal(0, 1, lm.WINDOW).astype(np.float32)
    return p, t, rng


@pytest.mark.parametrize("large", [1, 30])
def test_windows_score_each_token_once_as_the_slow_way(monkeypatch, large):
    p, t, rng = small_model()
    p = {k: v * np.float32(large) if k in "qk" else v for k, v in p.items()}  # logits that need the maximum
    ids = [rng.integers(0, lm.IDS, n) for n in (0, 1, 5, 15, 16, 17, 0, 33, 100, 0)]
    monkeypatch.setattr(lm, "AT_ONCE", 3)
    got = lm.score(p, t, ids)
    want = [slow_score(p, t, list(x)) for x in ids]
    np.testing.assert_allclose(got, want, rtol=2e-4 * large)


def test_probabilities_sum_to_one():
    p, t, _ = small_model()
    z = np.array([lm.score(p, t, [np.array([5, k])])[0] for k in range(0, lm.IDS, 1000)])
    assert (z > 0).all()
    for c in range(lm.CLASSES):
        if (t.cls == c).any():
            assert abs(np.exp(-t.within[t.cls == c].astype(float)).sum() - 1) < 1e-3


def test_gradient_is_that_of_differences():
    p, t, rng = small_model()
    p = {k: v.astype(np.float64) for k, v in p.items()}
    rows = rng.integers(0, 50, (2, lm.WINDOW))
    target = rng.integers(-1, lm.CLASSES, rows.shape)
    _, g, used = lm.step(p, rows, target)
    np.testing.assert_array_equal(used, np.unique(rows))
    for k in p:
        at = tuple(rng.integers(0, n) for n in p[k].shape) if k != "emb" else (rows[0, 3], 2)
        e = 1e-4
        up, down = ({**p, k: p[k].copy()} for _ in range(2))
        up[k][at] += e
        down[k][at] -= e
        want = (lm.step(up, rows, target)[0] - lm.step(down, rows, target)[0]) / (2 * e)
        got = g[k][at] if k != "emb" else g[k][np.searchsorted(used, at[0]), at[1]]
        assert abs(want - got) < 2e-3 * max(1.0, abs(want)) + 2e-5, k


def test_pieces_and_windows_hold_each_token_once():
    _, t, rng = small_model()
    for n in (0, 1, 31, 32, 33, lm.PIECE, lm.PIECE + 1, 3 * lm.PIECE + 77):
        ids = rng.integers(0, lm.IDS, n).astype(np.uint16)
        got = [np.frombuffer(x, np.uint16) for _, x in lm._pieces(7, ids)]
        made = [lm._windows(x, t) for x in got]
        target = np.concatenate([np.zeros(0, int), *(y.ravel() for _, y in made)])
        rows = np.concatenate([np.zeros(0, int), *(x.ravel() for x, _ in made)])
        np.testing.assert_array_equal(target[target >= 0], t.cls[ids])
        np.testing.assert_array_equal(rows[target >= 0], t.row[np.concatenate([[lm.END], ids[:-1]])] if n else [])
    one, two, three = (sorted(h for h, _ in lm._pieces(*x)) for x in ((7, ids), (8, ids), (None, ids)))
    assert len({*one, *two, *three}) == 12


def test_a_shard_longer_than_memory_goes_on(monkeypatch):
    _, t, rng = small_model()
    p = lm.fresh(t, np.zeros(lm.IDS))
    pieces = [(0, rng.integers(0, lm.IDS, 101).astype(np.uint16)) for _ in range(8)]
    whole, n = lm._sums(p, t, 0, iter(pieces))
    monkeypatch.setattr(lm, "SHARD", 100)
    parts, m = lm._sums(p, t, 0, iter(pieces))
    assert n == m == 8 * 4 and any((whole[k] != parts[k]).any() for k in whole)
    two, k = lm._sums(p, t, 0, iter(pieces + [(1, pieces[0][1])]))
    one, j = lm._sums(p, t, 0, iter([(1, pieces[0][1])]))
    assert k == m + j and all((two[x] == parts[x] + one[x]).all() for x in two)


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 20_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = ({r.doc_id: r.nll for r in lm.score_documents(d).collect()} for d in (docs.repartition(2), docs.orderBy("text").repartition(8)))
    assert a == b and len(a) == docs.count()


def test_better_than_counts_on_texts_it_has_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tokens = lm.tokenised(docs.filter("doc_id % 5 <> 0")).cache()
    p, t = lm.fit(tokens)
    held = [np.frombuffer(r.ids, np.uint16) for r in lm.tokenised(docs.filter("doc_id % 5 = 0")).collect()]
    counts = np.ones(lm.IDS)
    for r in tokens.collect():
        counts += np.bincount(np.frombuffer(r.ids, np.uint16), minlength=lm.IDS)
    n = sum(map(len, held))
    model = lm.score(p, t, held).sum() / n
    unigram = -sum(np.log(counts / counts.sum())[x].sum() for x in held) / n
    print("held-out nats a token: model", model, "counts", unigram)
    assert model < unigram - 0.6


def test_odd_rows(spark):
    rows = [(1, "some words here"), (None, "some words here"), (2, None), (3, ""), (1, "some words here"), (4, "long " * 20000)]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in rows], "doc_id long, text string, nll double")
    out = lm.score_documents(df).collect()
    assert len(out) == 6
    same = {r.nll for r in out if r.n_tokens and r.n_tokens < 10}
    assert len(same) == 1 and all((r.nll is None) == (r.n_tokens == 0) for r in out)
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_ids_are_counted_by_batch_and_not_by_row(monkeypatch):
    rows = [np.array([k, k, lm.END - 1], np.uint16) for k in range(1000)] + [np.zeros(0, np.uint16)]
    calls, count = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **k: calls.append(1) or count(*a, **k))
    b = pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in rows], pa.binary())], names=["ids"])
    (out,) = lm._counted(iter([b, b.slice(0, 0)]))
    assert len(calls) <= 10
    got = dict(zip(out.column("id").to_pylist(), out.column("n").to_pylist()))
    assert got == {k: 2 for k in range(1000)} | {lm.END - 1: 1000}


def test_texts_are_encoded_as_the_pattern_says_and_sooner():
    enc = Encoder()
    with open(f"{FOLDER}/{VOCABULARY}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    odd = ["<|end|> x <|endoftext|>", "half \ud800 pair", "\n", " \n\t x  y   ", "don't'll 'S", "a   b\r\n\r\n", "١٢ éé \U0001f600!?", " " * 5000 + "z"]
    rng = np.random.default_rng(0)
    odd += ["".join(rng.choice(list(" \n\ta'sé1! "), 40)) for _ in range(500)]
    ids, n = enc.encode([*odd, None, ""])
    want = [plain(x) for x in odd]
    assert n.tolist() == [*map(len, want), 0, 0] and ids.dtype == np.int32 and ids.tolist() == sum(want, [])
    texts = ["thon er kalimo, drasentu; velopi 1234 " * 500 + str(i) for i in range(20)]
    took = {"new": [], "old": []}
    for _ in range(7):
        for name, way in (("new", lambda: enc.encode(texts)), ("old", lambda: np.fromiter(chain.from_iterable([plain(x) for x in texts]), np.int32))):
            began = time.thread_time()
            way()
            took[name].append(time.thread_time() - began)
    print("encoding, of the time by lists and PATTERN:", min(took["new"]) / min(took["old"]))
    assert min(took["new"]) < 0.9 * min(took["old"])
