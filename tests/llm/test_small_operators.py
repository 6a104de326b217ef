"""Chat, toxicity, language ID and fingerprints on odd rows, and against slow versions."""

import os
import random
import time

import numpy as np
import pytest

from lodestone.llm import chat, fingerprints, langid, toxicity
from lodestone.llm.common import gram_sets, take

ODD = [(1, "plain words here"), (1, "plain words here"), (None, "no id"), (2, None), (3, ""), (4, "..."), (5, "w " * 50_000), (6, "plain words here")]


def frame(spark, rows, extra="score double, text_ string, TOXIC boolean"):
    return spark.createDataFrame([(a, b, 0.5, "x", True) for a, b in rows], f"doc_id long, text string, {extra}")


# ---- chat


def test_chats(spark):
    rows = [
        (1, 0, "user", "a"), (1, 2, "assistant", "c"), (1, 1, "user", "b"), (1, 1, "user", "b"), (1, 3, "assistant", ""), (1, 4, "assistant", None), (1, 5, "assistant", "<|im_end|>"),
        (2, None, None, "x"), (2, 0, None, "y"), (None, 0, "user", "z"), (3, 0, "user", None), (4, 0, "user", "t" * 100_000),
    ]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, chat string, n_turns int")
    got = {r.conv_id: (r.chat, r.n_turns, r.n_messages) for r in chat.format_chats(df).collect()}
    assert got[1] == ("<|im_start|>user\na\nb<|im_end|>\n<|im_start|>assistant\nc\n<| im_end|><|im_end|>\n".replace("<| im_end|>", "<| im_end|>"), 6, 2)
    assert got[2] == ("<|im_start|>unknown\nx\ny<|im_end|>\n", 2, 1) and got[3] == ("", 1, 0) and got[None][2] == 1 and len(got[4][0]) > 100_000
    assert chat.format_chats(df.limit(0)).collect() == []


def test_chats_against_plain_python(spark):
    rng = random.Random(0)
    rows = [(rng.randint(0, 20), rng.randint(0, 9), rng.choice(["user", "assistant", "system"]), rng.choice(["", "hi", "there", "you"])) for _ in range(400)]
    want = {}
    for c in {r[0] for r in rows}:
        ms = []
        for _, role, text in sorted({r[1:] for r in rows if r[0] == c}):
            if text:
                ms = [*ms[:-1], (role, ms[-1][1] + "\n" + text)] if ms and ms[-1][0] == role else [*ms, (role, text)]
        want[c] = "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in ms)
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.conv_id: r.chat for r in got} == want


# ---- toxicity


@pytest.mark.parametrize(
    "text,weight",
    [
        ("you idiot", 1.0), ("IDIOT!", 1.0), ("1d10t", 1.0), ("ιdіоt", 1.0), ("$cum and l0ser", 1.9), ("idiotic", 0.0), ("xidiot", 0.0), ("the trash can", 0.0), ("trash. can", 0.8), ("trash", 0.8),
        ("ＩＤＩＯＴ", 1.0), ("c1own, c|own", 1.6), ("", 0.0), ("idiot idiot", 2.0), ("scum,scum", 2.0), ("stüpid", 0.9), ("a clown fish clown", 0.8),
    ],
)
def test_weights(text, weight):
    assert toxicity.weigh(text, toxicity.automaton(toxicity.LEXICON, toxicity.EXCEPTIONS))[0] == pytest.approx(weight)


def slow_weight(text, lexicon, exceptions):
    """Each term at each place."""
    low, total = toxicity.fold(text), 0.0
    border = lambda i, j: not (i and text[i - 1].isalnum()) and not (j < len(text) and text[j].isalnum())
    places = lambda w: [(i, i + len(w)) for i in range(len(low)) if low.startswith(toxicity.fold(w), i) and border(i, i + len(w))]
    spans = [x for e in exceptions for x in places(e)]
    for term, weight in lexicon.items():
        total += sum(weight for i, j in places(term) if not any(a <= i and j <= b for a, b in spans))
    return total


def test_matcher_against_slow_version():
    lexicon, exceptions = {"ab": 1.0, "ab cd": 2.0, "cd": 0.5, "e1f": 0.25}, ("cd ab", "ab cd ab", "x cd", "e1f e1f")
    a, rng = toxicity.automaton(lexicon, exceptions), random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choice(["ab", "cd", "x", "e1f", "eif", " ", " ", " ", ".", "AB", "а", "c d"]) for _ in range(rng.randint(0, 25)))
        assert toxicity.weigh(text, a)[0] == pytest.approx(slow_weight(text, lexicon, exceptions)), text


def test_long_texts_of_many_exceptions_take_little_time():
    a = toxicity.automaton(toxicity.LEXICON, toxicity.EXCEPTIONS)
    text = "trash can idiot " * 65536
    began = time.process_time()
    assert toxicity.weigh(text, a) == (65536.0, 65536)
    assert time.process_time() - began < 3  # some tenths of a second where nothing else runs


def test_labels_that_conflict_and_repeat(spark):
    rng = random.Random(1)
    rows = [(i, " ".join([rng.choice(["alpha", "beta", "gamma"]) for _ in range(20)] + ([f"zork{x}" for x in rng.sample("abcdefgh", 4)] if i % 5 == 0 else []))) for i in range(300)]
    labels = [(i, int(i % 5 == 0)) for i, _ in rows]
    d = frame(spark, rows)
    once = toxicity.learn(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    both = toxicity.learn(d.repartition(5), spark.createDataFrame([*labels, *labels, (0, 0), (5, 0), (None, 1), (7, None)], "doc_id long, toxic int"))
    assert dict(once) == dict(both) and len(once) > len(toxicity.LEXICON)


def test_toxicity_rows(spark):
    rows = [*ODD, (7, "idiot scum"), (8, "idiot"), (9, "idiot scum " + "fine words " * 5000)]
    out = toxicity.score_toxicity(frame(spark, rows)).collect()
    assert len(out) == len(rows) and {r.doc_id for r in out if r.toxic} == {7}
    kept = toxicity.drop_toxic(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "score", "text_", "TOXIC"] and kept.count() == len(rows) - 1
    assert toxicity.score_toxicity(frame(spark, [])).collect() == [] and toxicity.drop_toxic(frame(spark, [])).collect() == []


def test_labels_of_a_small_table(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r.toxic for r in toxicity.score_toxicity(d, toxicity.learn(d, labels)).collect()}
    toxic = [got[r.doc_id] for r in labels.filter("toxic = 1").collect()]
    clean = [got[r.doc_id] for r in labels.filter("toxic = 0").collect()]
    print(sum(toxic), len(toxic), sum(clean), len(clean))
    assert sum(toxic) >= 0.65 * len(toxic) and sum(clean) <= 0.01 * len(clean)


@pytest.mark.parametrize("sf,least", [("sf0.1", 0.95), ("check_s", 0.995)])
def test_toxic_labels_that_nothing_was_learned_from(spark, sf, least):
    if not os.path.exists(f"/root/testdata/{sf}"):
        pytest.skip("no such tables here")
    d, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    used = labels.orderBy("doc_id").limit(labels.count() // 2)
    held = {r.doc_id: r.toxic for r in labels.join(used, "doc_id", "left_anti").collect()}
    terms = toxicity.learn(d, used)
    got = {r.doc_id: r.toxic for r in toxicity.score_toxicity(d, terms).collect()}
    right = sum(bool(held[i]) == got[i] for i in held)
    wrong = sum(got[i] and not held[i] for i in held)
    print(sf, len(terms), right / len(held), wrong)
    assert right >= least * len(held) and wrong <= 0.001 * len(held)


def test_recall_of_toxic_texts_by_language(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    used = labels.orderBy("doc_id").limit(labels.count() // 2)
    got = toxicity.score_toxicity(d, toxicity.learn(d, used)).withColumnRenamed("toxic", "got").join(labels.join(used, "doc_id", "left_anti").filter("toxic = 1"), "doc_id").join(d.select("doc_id", "lang"), "doc_id")
    recall = {r.lang: r.recall for r in got.selectExpr("lang", "double(got) got").groupBy("lang").avg("got").toDF("lang", "recall").collect()}
    print(recall)
    assert recall["de"] > 0.9 and recall["es"] > 0.75 and recall["fr"] > 0.3 and recall["en"] > 0.9


def test_terms_that_a_few_clean_texts_have(spark):
    rows, labels = [], []
    for i in range(600):
        bad, rng = i % 6 == 0, random.Random(i)
        extra = [f"zork{x}" for x in rng.sample("abcdefgh", 4 if bad else 1 if i % 20 == 1 else 0)]
        rows.append((i, " ".join([rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(20)] + extra)))
        labels.append((i, int(bad)))
    d = frame(spark, rows)
    terms = toxicity.learn(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {r.doc_id for r in toxicity.score_toxicity(d, terms).filter("toxic").collect()} == {i for i, bad in labels if bad}
    assert toxicity.verdict("zorka zorka zorka zorka", toxicity.automaton(terms, ()))[1] == 1


def test_learned_terms(spark):
    rng = random.Random(0)
    clean = ["alpha", "beta", "gamma", "delta"]
    rows, labels = [], []
    for i in range(300):
        bad = i % 10 == 0
        rows.append((i, " ".join(rng.choice(clean) for _ in range(20)) + (f" zork{rng.choice(['a', 'b', 'c', 'd', 'ee'])}" if bad else "")))
        labels.append((i, int(bad)))
    d, lab = frame(spark, rows), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.learn(d, lab)
    assert set(got) - set(toxicity.LEXICON) == {"zor*"} or set(got) - set(toxicity.LEXICON) == {"zork*"}
    assert toxicity.learn(d, lab.limit(0)) == toxicity.LEXICON and toxicity.learn(d.limit(0), lab) == toxicity.LEXICON


# ---- language ID


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_languages_held_out(spark, model):
    assert model.accuracy > 0.97
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id > 5000")
    rows = langid.identify_languages(d, model).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.best == r.lang for r in rows) > 0.98 * len(rows)
    assert sum(r.accepted for r in rows) > 0.99 * len(rows)


def test_languages_against_slow_version(spark, model):
    texts = ["The thing and of it", "été la que", "ab", "", "Üb", "x" * 30]
    for t in texts:
        b = t.lower().encode()
        hs = []
        for n in langid.GRAMS:
            for i in range(len(b) - n + 1):
                h = n
                for c in b[i : i + n]:
                    h = (h * 257 + c) % 2**64
                hs.append((h * 0x9E3779B97F4A7C15 % 2**64 >> 46) & (langid.BUCKETS - 1))
        import pyarrow as pa

        best, conf = langid.identify(pa.array([t.lower(), "other text", t.lower()]), model)
        if not hs:
            assert best[0] == -1 and conf[0] == 0
            continue
        *z, known = model.logits[hs].astype(float).mean(0)
        p = np.exp(z - np.max(z)) / np.exp(z - np.max(z)).sum() * known + (1 - known) / len(z)
        assert best[0] == best[2] == p.argmax() and conf[0] == pytest.approx(p.max(), abs=1e-9)


def test_no_language_is_lost_to_the_bound(spark, monkeypatch):
    words = {"en": "the house stands on the hill", "de": "das haus steht auf dem berg", "fr": "la maison est sur la colline", "es": "la casa esta en la colina"}
    chosen = []
    monkeypatch.setattr(langid, "train", lambda texts, langs: chosen.append((texts, langs)))
    rows = [(None, f"{words[g]} {i}", g) for g, n in (("en", 3000), ("de", 40), ("fr", 3)) for i in range(n)] + [(1, words["es"], "es")] * 2000 + [(1, None, "it"), (2, "x", None)]
    for df in (spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(7, *r[1:]) for r in rows], "doc_id long, text string, lang string").repartition(7)):
        langid.fit(df, 200)
    (a, b), (c, d) = chosen
    assert (a, b) == (c, d) and {g: b.count(g) for g in set(b)} == {"en": 50, "de": 40, "fr": 3, "es": 1} and len(set(a)) == 94
    assert langid.fit(df.limit(0)) is None


def test_other_scripts_are_rejected(spark, model):
    rows = [(1, "这是一个完全不同的语言的文本，没有任何字母。" * 5), (2, "Это совсем другой язык и другие буквы. " * 5), (3, "The of and onen thorreou ndernt " * 5)]
    got = {r.doc_id: r.accepted for r in langid.identify_languages(frame(spark, rows), model).collect()}
    assert got == {1: False, 2: False, 3: True}


def test_language_rows(spark, model):
    out = langid.identify_languages(frame(spark, ODD), model).collect()
    assert len(out) == len(ODD) and all(r.lang_id is None and not r.accepted and r.confidence == 0 for r in out if r.doc_id in (2, 3))
    assert langid.keep_identified(frame(spark, ODD), model).columns == ["doc_id", "text", "score", "text_", "TOXIC"]
    assert langid.identify_languages(frame(spark, []), model).collect() == []
    none = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r.accepted for r in langid.identify_languages(none).collect()] == [False]


# ---- fingerprints


def slow_grams(text, n):
    import pyarrow as pa

    return next(gram_sets(pa.array([text.lower() + "\n"]), n))


def test_grams_against_slow_version():
    import pyarrow as pa

    texts = ["a b c a b c", "one", "", "x, y. z!", "ä ö ü ß", "same same same same", "w " * 300_000]
    many = list(gram_sets(pa.array([t.lower() + "\n" for t in texts]), 3))
    for t, got in zip(texts, many):
        words = "".join(c if c.isalnum() else " " for c in t).split()
        want = len({tuple(words[i : i + 3]) for i in range(len(words) - 2)}) if len(words) >= 3 else int(bool(words))
        assert len(got) == want and (np.diff(got.astype(object)) > 0).all()
        np.testing.assert_array_equal(got, slow_grams(t, 3))
    np.testing.assert_array_equal(many[0], slow_grams("A-B c... a b\nC", 3))


def test_sketch_is_least_of_each_bin_and_densified():
    rng = np.random.default_rng(0)
    edges, donors = fingerprints._edges(64), fingerprints._donors(64, 4)
    for n in (1, 3, 40, 1000):
        g = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        v, empty = fingerprints.sketch(g, edges, donors)
        bins = [[int(x) for x in g if int(x) * 64 >> 64 == b] for b in range(64)]
        assert empty == sum(not b for b in bins)
        for b, xs in enumerate(bins):
            assert int(v[b]) == min(xs) if xs else int(v[b]) in {min(x) for x in bins if x}


def test_estimates_are_near_and_without_bias():
    rng = np.random.default_rng(1)
    edges, donors = fingerprints._edges(fingerprints.BINS), fingerprints._donors(fingerprints.BINS, 48)
    for j in (0.0, 0.3, 0.8, 1.0):
        for n in (60, 2000):
            errors = []
            for _ in range(40):
                pool = rng.integers(0, 2**64, 2 * n, dtype=np.uint64)
                k = round(2 * n * j / (1 + j))
                a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:k], pool[n : 2 * n - k]]))
                real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
                est = fingerprints.jaccard(*(fingerprints.pack(fingerprints.sketch(x, edges, donors)[0], fingerprints.BITS) for x in (a, b)))
                errors.append(est - real)
            assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.12


def test_fingerprint_rows(spark):
    out = fingerprints.fingerprints(frame(spark, ODD)).collect()
    assert len(out) == len(ODD)
    assert all((r.fingerprint is None) == (r.n_shingles == 0) for r in out) and len({r.fingerprint for r in out if r.doc_id in (1, 6)}) == 1
    assert all(len(r.fingerprint) == fingerprints.BINS * fingerprints.BITS // 8 for r in out if r.fingerprint)
    assert fingerprints.fingerprints(frame(spark, [])).collect() == []


def test_query_of_fingerprints_against_slow_version(spark):
    """Packed column, bands and estimates of the whole small table, bin by bin."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    extra = [(10_000 + i, t + " and some more", "x", "y", 1) for i, t in enumerate(r.text for r in docs.limit(20).collect())]
    docs = docs.union(spark.createDataFrame([*extra, (None, extra[0][1], "x", "y", 1), (-5, extra[1][1], "x", "y", 1)], docs.schema))
    out = fingerprints.near_estimates(fingerprints.fingerprints(docs.withColumn("estimate", docs.n_chars).withColumn("near_id", docs.lang))).collect()
    edges, want = [(i << 64) // fingerprints.BINS for i in range(fingerprints.BINS + 1)], {}
    import pyarrow as pa

    for r in docs.collect():
        grams = next(iter(gram_sets(pa.array([(r.text or "").lower() + "\n"]), fingerprints.SHINGLE))).tolist()
        if not grams:
            want[r.doc_id, r.text] = None
            continue
        bins = [min((g for g in grams if lo <= g < hi), default=None) for lo, hi in zip(edges, edges[1:])]
        filled = list(bins)
        for b, v in enumerate(bins):
            k = 0
            while v is None:
                v = bins[fingerprints._donors(fingerprints.BINS, 1, k)[b, 0]]
                k += 1
            filled[b] = v
        low = [int(fingerprints.mix(np.array([v], np.uint64))[0]) & 15 for v in filled]
        want[r.doc_id, r.text] = "".join(f"{x:x}" for x in low)
    prints = sorted((k[0] is not None, k[0] or 0, v) for k, v in want.items() if v)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.fingerprint.hex()) for r in out if r.fingerprint) == prints
    heads = {}
    for known, i, p in prints:
        if known:
            heads.setdefault(p[: 2 * fingerprints.BAND], (i, p))
    for r in out:
        i, p = heads.get(r.fingerprint.hex()[: 2 * fingerprints.BAND], (None, None)) if r.fingerprint else (None, None)
        if i is None or i == r.doc_id:
            assert r.near_id is None and r.estimate is None
        else:
            share = sum(a == b for a, b in zip(r.fingerprint.hex(), p)) / fingerprints.BINS
            assert r.near_id == i and r.estimate == pytest.approx(max(0, (share - 1 / 16) / (15 / 16)), abs=1e-6)
    assert sum(r.near_id is not None for r in out) > 15
    assert fingerprints.near_estimates(fingerprints.fingerprints(docs.limit(0))).collect() == []


def test_columns_of_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", 2, "b")], ["doc_id", "text", "DOC_ID", "Text"])
    assert take(df, "doc_id", "text").first() == (1, "a")
    with pytest.raises(ValueError):
        take(df, "missing")
    assert len(toxicity.drop_toxic(df).columns) == 4
