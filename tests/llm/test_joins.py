"""The Jaccard join, licences, embeddings and the pipeline against slow versions, on odd rows."""

import random
import re
import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pytest

from lodestone.llm import embeddings, jaccard, licenses
from lodestone.llm.common import components

ROOT = Path(__file__).parents[2]
WORDS = [f"w{i}" for i in range(40)]


def word_sets(rows, n):
    out = {}
    for d, t in rows:
        w = [x for x in re.split("[^0-9a-z\x80-\U0010ffff]+", (t or "").lower()) if x]
        if d is not None and w:
            out[d, t] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])
    return out


def slow_pairs(rows, n, t):
    sets = word_sets(rows, n)
    by = {}
    for (d, _), s in sets.items():
        by.setdefault(s, set()).add(d)
    rep = {s: min(ds) for s, ds in by.items()}
    want = {(r, d): 1.0 for s, r in rep.items() for d in by[s] if d != r}
    items = list(rep.items())
    for i, (a, x) in enumerate(items):
        for b, y in items[i + 1 :]:
            o = len(a & b)
            if x != y and o >= t * (len(a) + len(b)) / (1 + t) - 1e-9:
                want[min(x, y), max(x, y)] = round(o / (len(a) + len(b) - o), 6)
    return want


def corpus(seed, n=120):
    rng = random.Random(seed)
    passage = " ".join(rng.choice(WORDS) for _ in range(60))
    rows = []
    for i in range(n):
        if i % 3 and rows:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
        else:
            w = [rng.choice(WORDS) for _ in range(rng.choice([1, 2, 3, 5, 30, 80, 200]))]
        rows.append((i * 3 % 1000, " ".join(w) + (" " + passage if i % 10 == 0 else "")))
    return rows


ODD = [(None, "w1 w2 w3"), (2000, None), (2001, ""), (2002, "..."), (2003, "w1 w2 w3"), (2003, "w1 w2 w3"), (2004, "W1, w2! w3"), (2005, "x " * 30000), (2006, "same"), (2007, "same")]


@pytest.mark.parametrize("t,n", [(0.6, 3), (0.8, 2), (1.0, 1)])
def test_join_is_exact(spark, t, n):
    rows = corpus(n) + ODD
    df = spark.createDataFrame([(a, b, 1, "q") for a, b in rows], "doc_id long, text string, overlap int, Jaccard string").repartition(3)
    got = {(r.doc_id_a, r.doc_id_b): r.jaccard for r in jaccard.jaccard_join(df, n, t).collect()}
    want = slow_pairs(rows, n, t)
    assert got == want and len(got) > 20


def slow_classes(rows, n, t):
    """doc_id: class_id, copies, links, from all pairs of sets."""
    sets = word_sets(rows, n)
    by = {}
    for (d, _), x in sets.items():
        by.setdefault(x, set()).add(d)
    ids = {d for d, _ in rows if d is not None}
    root, copies, links = {d: d for d in ids}, dict.fromkeys(ids, 0), dict.fromkeys(ids, 0)
    near = [(a, b) for a in by for b in by if a != b and len(a & b) >= t * (len(a) + len(b)) / (1 + t) - 1e-9]
    for x, ds in by.items():
        for d in ds:
            copies[d] += len(ds) - 1
            links[d] += sum(a == x for a, _ in near)
    edges = [(min(ds), d) for ds in by.values() for d in ds] + [(min(by[a]), min(by[b])) for a, b in near]
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= (root[a], root[b]) != (low, low)
            root[a] = root[b] = low
    return {d: (root[d], copies[d], links[d]) for d in ids}


@pytest.mark.parametrize("t,n,tile", [(0.6, 3, 1024), (0.8, 2, 1024), (1.0, 1, 1024), (0.6, 3, 3)])
def test_classes_are_exact(spark, monkeypatch, t, n, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    rows = corpus(n + 5) + ODD + [(2008, "w1 w2 w3"), (2008, " ".join(WORDS)), (2009, " ".join(WORDS) + " w1"), (-7, "w1 w2 w3")]
    df = spark.createDataFrame([(a, b, 1, "q") for a, b in rows], "doc_id long, text string, links int, Class_id string").repartition(3)
    got = {r.doc_id: (r.class_id, r.copies, r.links) for r in jaccard.jaccard_classes(df, n, t).collect()}
    assert got == slow_classes(rows, n, t)
    assert sum(c != d for d, (c, _, _) in got.items()) > 20


def test_a_group_of_many_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 16)
    rng = random.Random(5)
    base = [rng.choice(WORDS) for _ in range(120)]
    rows = [(i, " ".join(base[:k] + [rng.choice(WORDS)] + base[k + 1 :])) for i, k in enumerate(rng.choice(range(120)) for _ in range(150))] + [(i, " ".join(base)) for i in range(500, 600)]
    got = {r.doc_id: (r.class_id, r.copies, r.links) for r in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == slow_classes(rows, 3, 0.6) and got[500][1] >= 99 and got[599][2] > 100


@pytest.mark.parametrize("seed,t,n", [(6, 0.6, 3), (7, 0.8, 2), (8, 0.6, 1)])
def test_classes_and_pairs_are_exact_among_crowds(spark, monkeypatch, seed, t, n):
    for name, value in {"CROWD": 3, "TILE": 4, "WEIGHT": 1000, "AT_ONCE": 50, "CROWDED": 60}.items():
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(seed)
    rows = corpus(seed, 60) + ODD
    for k in range(4):  # of which two are near each other
        base = [rng.choice(WORDS) for _ in range(100)] if k != 1 else base[:75] + [rng.choice(WORDS) for _ in range(25)]
        rows += [(5000 + 100 * k + i, " ".join(rng.choice(WORDS) if rng.random() < 0.02 else w for w in base)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert jaccard._crowds(jaccard._reps(jaccard._sets(df, n))).count() > 20
    assert {r.doc_id: (r.class_id, r.copies, r.links) for r in jaccard.jaccard_classes(df, n, t).collect()} == slow_classes(rows, n, t)
    assert {(r.doc_id_a, r.doc_id_b): r.jaccard for r in jaccard.jaccard_join(df, n, t).collect()} == slow_pairs(rows, n, t)


def test_near_copies_by_thousands_are_not_listed_as_pairs(spark, monkeypatch):
    stored, rows = jaccard.stored, []
    monkeypatch.setattr(jaccard, "stored", lambda df, *a: (out := stored(df, *a), rows.append(out.count()))[0])
    rng = random.Random(9)
    base = [f"x{i}" for i in range(200)]
    texts = [" ".join(f"y{rng.randrange(10**6)}" if rng.random() < 0.02 else w for w in base) for _ in range(2000)]
    got = jaccard.jaccard_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0}
    sets = [*word_sets([(0, x) for x in texts], 3).values()]
    for r in rng.sample([r for r in got if not r.copies], 20):
        own = next(iter(word_sets([(0, texts[r.doc_id])], 3).values()))
        assert r.links == sum(len(own & x) >= 0.375 * (len(own) + len(x)) - 1e-9 for x in sets) - 1
    assert max(rows) < 60_000  # there are two million pairs


def test_the_pipeline_keeps_one_of_a_large_cluster_without_its_pairs(spark, monkeypatch):
    import corpus_pipeline

    stored, rows = jaccard.stored, []
    monkeypatch.setattr(jaccard, "stored", lambda df, *a: (out := stored(df, *a), rows.append(out.count()))[0])
    rng = random.Random(12)
    texts = [" ".join(f"y{rng.randrange(10**6)}" if rng.random() < 0.02 else f"x{i}" for i in range(200)) for _ in range(700)]
    other = [(1000 + k, " ".join(f"z{k}x{i}" for i in range(50)), 0) for k in range(30)]
    docs = spark.createDataFrame([(i, x, i) for i, x in enumerate(texts)] + other + [(None, texts[0], -1)], "doc_id long, text string, unit int")
    kept = corpus_pipeline.near_copies(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["None", "0", *(str(d) for d, _, _ in other)])
    assert max(rows) < 20_000  # there are 244,650 pairs


def test_arrays_of_a_block_and_of_a_group_are_bounded():
    """Two workers have what the JVM leaves of an executor: pieces of a block, and ranges of hashes of a group, are held at a time."""
    rng = np.random.default_rng(3)
    n, k = 200_000, 1_000_000
    gram = rng.integers(0, 1 << 32, k).astype(np.uint32)
    gram[: k // 2] = gram[rng.integers(k // 2, k, k // 2)]
    doc, size, crowd = rng.integers(0, n, k), rng.integers(5, 500, n), np.where(rng.random(n) < 0.01, 0, -1)
    base = rng.integers(0, 1 << 63, 900).astype(np.uint64) * np.uint64(2)
    sets = [np.unique(np.where(rng.random(900) < 0.1, rng.integers(0, 1 << 63, 900).astype(np.uint64), base)) for _ in range(1200)]
    tracemalloc.start()
    pairs = sum(int(c.sum()) for _, _, c in jaccard._multiply(gram, doc, size, 0.6, crowd, 64, jaccard.AT_ONCE) if c is not None)
    block = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    shared = jaccard._product(sets, 600, 600)
    group = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print("MB:", block / 1e6, group / 1e6)
    assert pairs > 100_000 and block < 60e6 and group < 50e6
    for i, j in ((0, 0), (599, 599), (17, 400)):
        assert shared[i, j] == len(np.intersect1d(sets[i], sets[600 + j]))


def test_a_worker_gives_back_what_it_freed():
    """The third stage runs in workers that earlier stages used; what those took at most would be kept. In a process of its own, as the allocator's state counts."""
    code = """
import os, re
import numpy as np
from lodestone.llm.common import tidy
rss = lambda: int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
def run(batches):
    global pin
    held = [np.ones(8000) for _ in range(4000)]
    pin = held[-1]
    del held
    yield from batches
start = rss()
print(list(tidy(run)(iter([1, 2]))), rss() - start)
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=60)
    assert out.stdout.startswith("[1, 2] "), out.stderr
    assert float(out.stdout.split()[-1]) < 60, out.stdout  # it took 256 MB


def groups(nodes, pairs):
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_one_of_each_group_stays(spark):
    rows = corpus(4, 60) + ODD
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(rows)], "doc_id long, text string, node int")
    root = groups({a for a, _ in rows if a is not None}, slow_pairs(rows, 3, 0.6))
    kept = jaccard.drop_near_copies(df).collect()
    want = sorted({(a, b) for a, b in rows if a is None or root[a] == a}, key=repr)
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == want


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_join(none).collect() == [] and jaccard.jaccard_classes(none).collect() == [] and jaccard.drop_near_copies(none).collect() == []


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7), (50, 60), (60, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "x long, y long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 60: 50}


# ---- licences


def test_licences(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, "/a/LICENSE", mit), (2, "/a/b/x.py", "no header at all here"), (3, "/a/b/LICENSE", gpl), (4, "/a/b/c/y.py", "plain"), (5, "/a/z.py", "# " + gpl + "\n" + "code " * 200), (6, "/other/q", "plain"),
        (7, None, mit), (8, "/a/n", None), (9, "/a/e", ""), (None, "/a/m", "plain"), (10, "/ab/k", "plain"), (11, "/a/long", "word " * 50000 + ". Licensed under CC BY-NC 4.0."), (2, "/a/b/x.py", "no header at all here"),
    ]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, path string, text string, license string")
    got = {}
    out = licenses.scan_licenses(df).collect()
    for r in out:
        got[r.doc_id] = (r.license, r.how, r.licensed_by)
    assert len(out) == len(rows)
    assert got[1] == ("MIT", "own", 1) and got[2] == ("GPL-3.0", "inherited", 3) and got[4] == ("GPL-3.0", "inherited", 3) and got[5] == ("GPL-3.0", "own", 5)
    assert got[6] == (None, None, None) and got[7] == ("MIT", "own", 7) and got[8][0] == got[9][0] == got[None][0] == "MIT" and got[10] == (None, None, None) and got[11][:2] == ("CC-BY-NC-4.0", "own")
    assert licenses.scan_licenses(df.limit(0)).collect() == []


def test_headers_and_licence_files(spark):
    """Headers that once went wrong, over lines too, and whole files."""
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n\nimport os\n"
    body = "def f(x):\n    return x\n" * 5
    want = {
        1: ("SPDX-License-Identifier: EPL-2.0", "EPL-2.0"), 2: ("// SPDX-License-Identifier: BSD-2-Clause\n" + body, "BSD-2-Clause"), 3: ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only"), 4: (gpl + body, "GPL-3.0"),
        5: ("This file is licensed under the terms of the MIT license", "MIT"), 6: (gpl.replace("version 3", "version 2").replace("software:", "software;"), "GPL-2.0"), 7: (body, None),
        8: (body + "We were permitted to take the source of the stream under the bridge. The public may use it in any general version of the terms.", None),
        9: ("SPDX-License-Identifier: MIT.", "MIT"),
    }
    rows = [(i, f"/h{i}/x", t) for i, (t, _) in want.items()]
    for k, (name, text) in enumerate(licenses.FILES.items()):
        rows += [(100 + k, f"/{name}/LICENSE", "Copyright (c) 2020 The authors of this work\n" + text), (200 + k, f"/{name}/src/a", body)]
    # what most texts say weighs little, however many there are
    rows += [(1000 + i, None, f"text number {i} of the file and the project, see details {i % 7}") for i in range(300)]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert {i: got[i].license for i in want} == {i: x for i, (_, x) in want.items()}
    for k, name in enumerate(licenses.FILES):
        assert (got[100 + k].license, got[200 + k].license, got[200 + k].how, got[200 + k].licensed_by) == (name, name, "inherited", 100 + k)
    assert not any(got[1000 + i].license for i in range(300))


def test_bounds_lose_no_match(spark, monkeypatch):
    """The same matches where everything is compared."""
    rng = random.Random(8)
    parts = [w for *_, c in licenses.COUNTED[:40] for w in c]
    rows = [(i, f"/{i}", " ".join(rng.choice(parts) for _ in range(rng.randint(3, 12))) + ". " + rng.choice([t for ts in licenses.TEMPLATES.values() for t in ts])[rng.randint(0, 12) :]) for i in range(150)]
    rows += [(1000 + i, "/f", " ".join(w for w in t.split() if rng.random() < keep)) for i, t in enumerate(licenses.FILES.values()) for keep in (0.5, 0.8)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {tuple(r) for r in licenses.matches(df).collect()}
    monkeypatch.setattr(licenses, "keys", lambda idf, kind, cosine: (licenses.VOCABULARY, 0))
    assert got == {tuple(r) for r in licenses.matches(df).collect()} and len(got) > 60


# ---- embeddings


def vectors(n=600, d=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for i in range(0, n, 4):
        x[i + 1] = x[i] + rng.normal(size=d) * 0.1
    x[10] = x[2]
    x[11] = x[2]
    return [(int(i), [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]


def true_links(rows, cosine=embeddings.COSINE):
    """vec_id: links of its vector to different ones, from all pairs."""
    x = np.array([np.float32(r[1]) for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    first = {tuple(v): i for i, v in reversed(list(enumerate(x)))}
    reps = sorted(first.values())
    near = x @ x[reps].T >= cosine
    return {rows[i][0]: int(near[i].sum()) - 1 for i in range(len(rows))}


def test_links_recall_and_precision(spark):
    rows = vectors()
    df = spark.createDataFrame([(a, b, 1.0) for a, b in rows], "vec_id long, embedding array<float>, copies double").repartition(3)
    want = true_links(rows)
    got = {r.vec_id: r for r in embeddings.near_classes(df).collect()}
    assert got.keys() == want.keys() and all(r.links <= want[i] for i, r in got.items())
    assert sum(r.links for r in got.values()) >= 0.9 * sum(want.values()) > 200
    assert {i for i, r in got.items() if r.copies} == {2, 10, 11} and got[10].copies == 2 and got[11].class_id == got[10].class_id == 2
    full = embeddings.near_classes(df, probes=10_000).collect()
    assert {r.vec_id: r.links for r in full} == want
    root = groups([i for i, _ in rows], [(i, i + 1) for i in range(0, 600, 4) if want[i]] + [(2, 10), (2, 11)])
    assert sum(r.class_id == root[r.vec_id] for r in full) >= 590


def test_a_dense_group_in_cells(spark, monkeypatch):
    """A third of all vectors is one group of near ones; lists are cut, and each link counts once."""
    monkeypatch.setattr(embeddings, "CELL", 20)
    monkeypatch.setattr(embeddings, "BLOCK", 500)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(450, 16))
    x[:150] = x[0] + rng.normal(size=(150, 16)) * 0.03
    rows = [(int(i), [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    got = {r.vec_id: r for r in embeddings.near_classes(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    want = true_links(rows)
    assert all(r.links <= want[i] for i, r in got.items()) and sum(r.links for r in got.values()) >= 0.9 * sum(want.values())
    assert {got[i].class_id for i in range(150)} == {0}


def test_enough_probes_reach_what_lies_at_the_threshold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    used = [embeddings.probes_of(x[:2000], x[-k:], 0.95) for k in (50, 100, 200, 400)]
    assert max(used) < 40 and embeddings.probes_of(x[:2000], x[-1:], 0.95) == 1


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.001]), (3, None), (4, []), (5, [nan, 1.0]), (6, [0.0, 0.0]), (7, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0]), (8, [1.0, None]), (9, [-1.0, 0.0]), (10, [1.0, -0.0]), (11, [-1.0, 0.0]), (11, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.class_id, r.copies, r.links) for r in embeddings.near_classes(df).collect()}
    alone = {i: (i, 0, 0) for i in (3, 4, 5, 6, 7, 8)}
    assert got == alone | {1: (1, 2, 1), 2: (1, 0, 1), 10: (1, 2, 1), 9: (1, 1, 0), 11: (1, 3, 1)}
    assert embeddings.near_classes(df.limit(0)).collect() == []
    assert [tuple(r) for r in embeddings.near_classes(df.filter("vec_id = 1")).collect()] == [(1, 1, 0, 0)]


# ---- the pipeline


def test_pipeline_against_slow_version(spark, tmp_path):
    import corpus_pipeline
    from lodestone.llm import langid, toxicity
    from lodestone.llm.packing import END
    from lodestone.llm.tokens import Encoder

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = docs.collect()
    a = toxicity.automaton(toxicity.learn(docs, labels), toxicity.EXCEPTIONS)
    rows = [r for r in rows if not toxicity.verdict(r.text, a)[4]]
    kept = docs.filter(docs.doc_id.isin([r.doc_id for r in rows]))
    known = {r.doc_id for r in langid.identify_languages(kept, langid.fit(kept)).collect() if r.accepted}
    rows = [r for r in rows if r.doc_id in known]
    root = groups({r.doc_id for r in rows}, slow_pairs([(r.doc_id, r.text) for r in rows], jaccard.GRAM, jaccard.THRESHOLD))
    rows = [r for r in rows if root[r.doc_id] == r.doc_id]
    enc, flat = Encoder(), []
    for r in sorted(rows, key=lambda r: r.doc_id):
        flat += [*enc.bpe.encode_ordinary(r.text), END]
    out = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r.window_id)
    assert [i for r in out for i in r.ids] == flat
    assert list(dict.fromkeys(s.doc_id for r in out for s in r.segments)) == sorted(r.doc_id for r in rows)


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    some = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]
    plain = [r for r in some if r[1]]
    long = (10_001, " ".join(r[1] for r in plain) + " and more of it" * 50, "en")
    odd = [(None, plain[0][1], "en"), (None, plain[0][1], "en"), (10_002, None, "en"), (10_003, "", None), plain[1], plain[1], (10_004, plain[2][1], plain[2][2]), long, (10_005, "you idiot moron scum " * 3, "en"), (10_006, "жжж щщщ ыыы", None)]
    form = "doc_id long, text string, lang string, source string, TEXT2 string, toxic int, n_tokens string"
    df = spark.createDataFrame([(*r, "s", "x", 1, "y") for r in some + odd], form)
    df.write.parquet(f"{tmp_path}/a/documents.parquet")
    labels = spark.createDataFrame([(i, 1, None if i == 3 else 0) for i in [*range(20), None]], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/a/labels.parquet")
    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{tmp_path}/a")
        assert docs.columns == df.columns, name
        docs = spark.createDataFrame(docs.collect(), df.schema)
    ids = [r.doc_id for r in docs.collect()]
    assert ids.count(None) == 2 and 10_001 in ids and len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    assert sorted({10_002, 10_003, 10_004, 10_005, 10_006} & set(ids)) == []
    got = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert {s.doc_id for r in got for s in r.segments} == set(ids)
    df.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/b/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").collect() == []
