"""Exact n-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix.

Passes over the texts, each vectorised and without a shuffle of text:

1. sets:     a fingerprint and the size of each document's set of word n-grams. Documents of equal sets are one column
             from here on, so a group of copies costs as much as one document.
2. crowds:   large groups of sets of like min-hashes are named, so that near copies by thousands aren't listed as pairs.
3. order:    a counting sketch over all n-grams of all documents (fixed size) orders n-grams from rare to common.
4. prefixes: two sets of Jaccard >= t share an n-gram among the first |x| - ceil(t |x|) + 1 of each in any one order.
             These n-grams are cut into blocks; each block's product accumulates overlap counts of pairs whose sizes
             allow t. Rare-first order keeps passages that many documents share out of the prefixes. For an n-gram of many sets
             the crowds, not their members, are paired: with each other and with the sets of no crowd.
5. bounds:   a pair whose summed overlap and what lies beyond both prefixes can't reach t is discarded.
6. product:  the pairs left are verified in full: each set goes once to its group, where tiles of the incidence matrix
             are multiplied; of a crowd, tiles of all its members to those of each crowd or set paired with it, and to its own. A group adds up the links of its sets; pairs are sent on only by jaccard_join.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bloom_filter, components, gram_sets, gram_text, least_labels, may_hold, mix, numbered, position, stored, table, take, tidy

#: Words in an n-gram and the least Jaccard similarity.
GRAM, THRESHOLD = 3, 0.6
#: Buckets of the counting sketch; postings in a block; sets in a tile of a verified group.
SKETCH, BLOCK, TILE = 1 << 22, 1_000_000, 1024
#: An n-gram in the prefixes of more sets than this pairs crowds; sets of equal min-hashes that are more than this are one. n-grams in
#: a tile of a crowd. Sets in crowds at most (the largest crowds; any others are paired one by one, so this is no limit on the result).
CROWD, WEIGHT, CROWDED = 64, 1 << 20, 1 << 20
#: Pairs that a block counts, and postings or n-grams that a task has in arrays, at a time: two workers share what the JVM leaves of an executor.
AT_ONCE, HELD = 1 << 18, 1 << 18
_PARTS = 16
_U = np.uint64
_SIGNS = ("s0", "s1", "s2")
_ODD = np.random.default_rng(11).integers(0, 1 << 63, (3 * len(_SIGNS), 1)).astype(_U) * _U(2) + _U(1)


def need(t: float, a, b):
    """The least overlap of sets of sizes a and b of Jaccard >= t."""
    return np.ceil(t / (1 + t) * (a + b) - 1e-9).astype(np.int64)


def prefix(t: float, n):
    """How many n-grams of a set of n the index holds."""
    return n - np.ceil(t * n - 1e-9).astype(np.int64) + 1


def _fp(s: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(s.tobytes()), _U).view(np.int64))


def _base(docs: DataFrame) -> DataFrame:
    return take(docs, "doc_id", "text").filter("doc_id is not null").select("doc_id", gram_text().alias("text"))


def _signs(low: list[np.ndarray]) -> np.ndarray:
    """Three hashes for each set, each of three of its nine min-hashes: sets of Jaccard j share one with a chance of j ** 3."""
    x = np.array(low, _U).reshape(len(low), len(_SIGNS), 3)
    return mix(mix(mix(x[:, :, 0]) + x[:, :, 1]) + x[:, :, 2]).view(np.int64)


def _sets(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, fps, low = [], [], []
            for s in gram_sets(b.column("text"), n):
                sizes.append(len(s))
                fps.append(_fp(s))
                low.append((s * _ODD).min(1, initial=_U((1 << 64) - 1)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), *map(pa.array, _signs(low).T)], names=["doc_id", "fp", "size", *_SIGNS])

    return _base(docs).mapInArrow(tidy(run), "doc_id long, fp long, size long, " + ", ".join(f"{s} long" for s in _SIGNS)).filter("size > 0")


def _reps(meta: DataFrame) -> DataFrame:
    """A row for each set: its fingerprint, least doc_id, size and signs, and how many rows of meta have it besides one."""
    return meta.groupBy("fp").agg(F.min("doc_id").alias("rep"), (F.count("*") - 1).alias("copies"), *[F.min(c).alias(c) for c in ("size", *_SIGNS)])


def _crowds(reps: DataFrame) -> DataFrame:
    """fp, unit (the least fp of the crowd, or another number of its own), size of the sets that are in crowds."""
    rows = reps.select("fp", "size", *_SIGNS, F.lit(None).cast("long").alias("unit"))
    for s in _SIGNS:
        # sets that equal members of a crowd in another sign join it
        many = rows.groupBy(s).agg(F.count("*").alias("n"), F.coalesce(F.min("unit"), F.min("fp")).alias("of")).filter(F.col("n") > CROWD).drop("n")
        rows = stored(rows.join(many, s, "left").select("fp", "size", *_SIGNS, F.coalesce("unit", "of").alias("unit")))
    rows = rows.filter("unit is not null").select("fp", "unit", "size")
    sizes = rows.groupBy("unit").agg(F.count("*").alias("n"))
    least, room = 0, CROWDED
    for r in sizes.groupBy("n").agg(F.sum("n").alias("sets")).orderBy(F.desc("n")).toLocalIterator():
        room -= r.sets
        if room < 0:
            least = r.n + 1
            break
    return stored(rows.join(sizes.filter(F.col("n") >= least), "unit").select("fp", "unit", "size"))


class _Units:
    """The crowds, for the blocks: of each fingerprint the place of its crowd, or -1; names and sizes of the crowds."""

    def __init__(self, crowds: DataFrame):
        t = crowds.select("fp", "unit", "size").toArrow()
        fp, unit, size = (t.column(c).to_numpy() for c in ("fp", "unit", "size"))
        order = np.argsort(fp)
        self.fp = fp[order]
        self.names, place = np.unique(unit[order], return_inverse=True)
        self.place = place.astype(np.int32)
        self.least, self.most = np.full(len(self.names), np.iinfo(np.int64).max), np.zeros(len(self.names), np.int64)
        np.minimum.at(self.least, self.place, size[order])
        np.maximum.at(self.most, self.place, size[order])

    def of(self, fp: np.ndarray) -> np.ndarray:
        if not len(self.fp):
            return np.full(len(fp), -1)
        at = np.minimum(np.searchsorted(self.fp, fp), len(self.fp) - 1)
        return np.where(self.fp[at] == fp, self.place[at], -1).astype(np.int64)


def _ranks(docs: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """For each bucket of n-gram hashes a byte that grows with the logarithm of its count over all documents; the total."""
    width = SKETCH // _PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, held, k = np.zeros(SKETCH, np.uint32), [], 0
        for b in batches:
            for s in gram_sets(b.column("text"), n):
                held.append(s)
                k += len(s)
                if k > HELD:
                    np.add.at(c, (np.concatenate(held) >> _U(42)).astype(np.int64), np.uint32(1))
                    held, k = [], 0
        if k:
            np.add.at(c, (np.concatenate(held) >> _U(42)).astype(np.int64), np.uint32(1))
        if c.any():
            yield _packed(c.reshape(_PARTS, width))

    def _packed(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([zlib.compress(r.tobytes(), 1) for r in rows], pa.binary())], names=["part", "data"])

    def total(t: pa.Table) -> pa.Table:
        c = np.zeros(width, np.uint64)
        for x in t.column("data"):
            c += np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
        rank = np.minimum(255, np.floor(6 * np.log2(np.maximum(c, 1).astype(float)))).astype(np.uint8)
        return pa.table({"part": t.column("part")[:1], "data": pa.array([zlib.compress(rank.tobytes(), 1)], pa.binary()), "n": pa.array([int(c.sum())], pa.int64())})

    parts = _base(docs).mapInArrow(tidy(count), "part int, data binary").groupBy("part").applyInArrow(total, "part int, data binary, n long").collect()
    ranks = np.zeros(SKETCH, np.uint8)
    for p in parts:
        ranks[p.part * width : (p.part + 1) * width] = np.frombuffer(zlib.decompress(p.data), np.uint8)
    return ranks, sum(p.n for p in parts)


def _block(held: list) -> tuple[np.ndarray, ...]:
    """Of a block's messages: its different fingerprints and their sizes; n-grams, and the place of the fingerprint, of its postings."""
    fps, sizes, grams, docs_, base = [], [], [], [], 0
    for x in held:
        m, k = (int(v) for v in np.frombuffer(x, np.int64, 2))
        fps.append(np.frombuffer(x, np.int64, m, 16))
        sizes.append(np.frombuffer(x, np.int32, m, 16 + 8 * m))
        grams.append(np.frombuffer(x, np.uint32, k, 16 + 12 * m))
        docs_.append(np.frombuffer(x, np.uint32, k, 16 + 12 * m + 4 * k) + np.uint32(base))
        base += m
    gram, doc = np.concatenate(grams), np.concatenate(docs_)
    del docs_
    every = np.concatenate(fps)
    order = np.argsort(every, kind="stable")
    every = every[order]
    new = np.diff(every, prepend=every[:1]) != 0
    new[:1] = True
    same = np.empty(len(order), np.int32)
    same[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return every[new], np.concatenate(sizes)[order[new]].astype(np.int64), gram, same[doc]


def _multiply(gram: np.ndarray, doc: np.ndarray, size: np.ndarray, t: float, crowd: np.ndarray, many: int, at_once: int) -> Iterator[tuple]:
    """Of documents in a block: 0, pairs (as doc_i * n + doc_j, i < j) and how many n-grams they share here, a pair perhaps in several
    parts; and 1, pairs of units that share an n-gram of more than `many` documents (as unit_i * m + unit_j, i < j; a unit
    is a document of no crowd, or n + its place for a crowd; m is the number of both), and None. Those of one crowd aren't in pairs."""
    n = len(size)
    order = np.argsort(gram, kind="stable")
    keys, counts, held, k = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def fold(keys, counts, held):
        x = np.concatenate([keys, *held])
        held.clear()
        w = np.concatenate([counts, np.ones(len(x) - len(keys), np.int64)])
        u, at = np.unique(x, return_inverse=True)
        return u, np.bincount(at, weights=w, minlength=len(u)).astype(np.int64)

    lo = 0
    while lo < len(order):  # whole n-grams, about HELD postings
        hi = int(np.searchsorted(gram, gram[order[min(lo + HELD, len(order)) - 1]], "right", sorter=order))
        at, lo = order[lo:hi], hi
        g, d = gram[at], doc[at]
        z = size[d]
        at = np.lexsort((d, z, g))
        g, d, z = g[at], d[at], z[at]
        fresh = np.ones(len(g), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])  # copies give the same postings
        g, d, z = g[fresh], d[fresh], z[fresh]
        cuts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
        c = crowd[d]
        common = np.repeat(np.diff(cuts) > many, np.diff(cuts)) & (c >= 0)
        if common.any():
            yield from _units(cuts, common, d, crowd, n, at_once)
            g, d, z, c = (x[~common] for x in (g, d, z, c))
        first = np.arange(len(g))
        step = 1
        while True:
            first = first[first + step < len(g)]
            # sizes grow within an n-gram: where one partner is too large, so are all after it
            first = first[(g[first] == g[first + step]) & (z[first] >= t * z[first + step] - 1e-9)]
            if not len(first):
                break
            at = first[(c[first] < 0) | (c[first] != c[first + step])]
            i, j = d[at].astype(np.int64), d[at + step].astype(np.int64)
            held.append(np.minimum(i, j) * n + np.maximum(i, j))
            k += len(at)
            if k > at_once:
                keys, counts = fold(keys, counts, held)
                k = 0
                if len(keys) > at_once:
                    yield 0, keys, counts
                    keys, counts = keys[:0], counts[:0]
            step += 1
    if held:
        keys, counts = fold(keys, counts, held)
    if len(keys):
        yield 0, keys, counts


def _units(cuts: np.ndarray, common: np.ndarray, d: np.ndarray, crowd: np.ndarray, n: int, at_once: int) -> Iterator[tuple]:
    m = n + int(crowd.max()) + 1
    found, k = [], 0
    for x, y in zip(cuts[:-1], cuts[1:]):
        if not common[x:y].any():
            continue
        crowds = np.unique(crowd[d[x:y][common[x:y]]]) + n
        alone = d[x:y][~common[x:y]]
        for i, u in enumerate(crowds):
            v = np.concatenate([alone, crowds[:i]])
            found.append(np.minimum(u, v) * m + np.maximum(u, v))
            k += len(v)
            if k > at_once:
                found, k = [np.unique(np.concatenate(found))], 0
                if len(found[0]) > at_once:
                    yield 1, found.pop(), None
    if found and len(keys := np.unique(np.concatenate(found))):
        yield 1, keys, None


def _candidates(docs: DataFrame, n: int, t: float, crowds: DataFrame) -> DataFrame:
    """Pairs a < b: of fingerprints of sets whose prefixes share enough (kind 0), or of units, a crowd one of them at least, that share an
    n-gram of many sets (kind 1). Two sets that are linked, not of one crowd, are in a pair of kind 0 or their units in one of kind 1."""
    ranks, total = _ranks(docs, n)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)
    units = spark.sparkContext.broadcast(_Units(crowds))
    many, at_once = CROWD, AT_ONCE
    blocks = max(4, math.ceil(total * (1 - t) / BLOCK))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, held, k = shared.value, [], 0
        for b in batches:
            for s in gram_sets(b.column("text"), n):
                if not len(s):
                    continue
                p = int(prefix(t, np.array(len(s))))
                key = (rank[(s >> _U(42)).astype(np.int64)].astype(_U) << _U(56)) | (s >> _U(8))
                held.append((_fp(s), len(s), s[np.argsort(key, kind="stable")[:p]]))
                k += p
                if k > HELD:
                    yield _postings(held)
                    held, k = [], 0
        if held:
            yield _postings(held)

    def _postings(held: list) -> pa.RecordBatch:
        gram = mix(np.concatenate([h[2] for h in held]))
        doc = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
        block = ((gram >> _U(32)) % _U(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        gram, doc, block = (gram[order] & _U(0xFFFFFFFF)).astype(np.uint32), doc[order], block[order]
        fp, size = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int32)
        ids, data = [], []
        cuts = np.flatnonzero(np.diff(block, prepend=-1, append=blocks + 1))
        for i, j in zip(cuts[:-1], cuts[1:]):
            used, local = np.unique(doc[i:j], return_inverse=True)
            ids.append(int(block[i]))
            data.append(np.array([len(used), j - i], np.int64).tobytes() + fp[used].tobytes() + size[used].tobytes() + gram[i:j].tobytes() + local.astype(np.uint32).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], names=["block", "data"])

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for block, data in zip(b.column("block").to_pylist(), b.column("data")):
                if block != now and held:
                    yield from _pairs(held)
                now = block
                held.append(data.as_buffer())
        if held:
            yield from _pairs(held)

    def _pairs(held: list[pa.Buffer]) -> Iterator[pa.RecordBatch]:
        fp, size, gram, doc = _block(held)
        held.clear()
        crowd = units.value.of(fp)
        for kind, keys, counts in _multiply(gram, doc, size, t, crowd, many, at_once):
            yield _packed_units(keys, fp, size) if kind else _packed_pairs(keys, counts, fp, size)

    def _parts(low: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        part = (mix(low.view(_U)) % _U(blocks)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order], prepend=-1, append=blocks + 1))
        for x, y in zip(cuts[:-1], cuts[1:]):
            yield int(part[order[x]]), order[x:y]

    def _packed_units(keys: np.ndarray, fp: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        u = units.value
        name, least, most = (np.concatenate(x) for x in ((fp, u.names), (size, u.least), (size, u.most)))
        m = len(fp) + int(u.of(fp).max()) + 1
        i, j = keys // m, keys % m
        ok = (most[i] >= t * least[j] - 1e-9) & (most[j] >= t * least[i] - 1e-9)
        a, b = np.minimum(name[i[ok]], name[j[ok]]), np.maximum(name[i[ok]], name[j[ok]])
        ids, data = [], []
        for part, at in _parts(a):
            ids.append(part)
            data.append(b"u" + zlib.compress(a[at].tobytes() + b[at].tobytes(), 1))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], names=["block", "data"])

    def _packed_pairs(keys: np.ndarray, counts: np.ndarray, fp: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        i, j = keys // len(fp), keys % len(fp)
        ids, data = [], []
        for part, at in _parts(fp[i]):
            used, local = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
            ids.append(part)
            cols = (np.array([len(used), len(at)], np.int64), fp[used], size[used].astype(np.int32), local.astype(np.uint32), counts[at].astype(np.uint32))
            data.append(b"p" + zlib.compress(b"".join(c.tobytes() for c in cols), 1))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], names=["block", "data"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for part, data in zip(b.column("block").to_pylist(), b.column("data")):
                if part != now and held:
                    yield from _sum(held)
                now = part
                held.append(data.as_py())
        if held:
            yield from _sum(held)

    def _sum(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        """The pairs of units; the pairs whose overlap in the prefixes, and all n-grams beyond them, could make t."""
        fps, sizes, first, second, counts, base = [], [], [], [], [], 0
        both = [np.frombuffer(zlib.decompress(x[1:]), np.int64).reshape(2, -1) for x in held if x[:1] == b"u"]
        if both:
            a, b = np.unique(np.concatenate(both, 1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.ones(len(a), np.int32))], names=["a", "b", "kind"])
        pairs = [x for x in held if x[:1] == b"p"]
        held.clear()
        if not pairs:
            return
        for x in (zlib.decompress(x[1:]) for x in pairs):
            m, k = (int(v) for v in np.frombuffer(x, np.int64, 2))
            fps.append(np.frombuffer(x, np.int64, m, 16))
            sizes.append(np.frombuffer(x, np.int32, m, 16 + 8 * m))
            both = np.frombuffer(x, np.uint32, 2 * k, 16 + 12 * m).astype(np.int64) + base
            first.append(both[:k]), second.append(both[k:])
            counts.append(np.frombuffer(x, np.uint32, k, 16 + 12 * m + 8 * k))
            base += m
        fp, at, same = np.unique(np.concatenate(fps), return_index=True, return_inverse=True)
        size = np.concatenate(sizes)[at].astype(np.int64)
        i, j = same[np.concatenate(first)], same[np.concatenate(second)]
        key, where = np.unique(np.minimum(i, j) * len(fp) + np.maximum(i, j), return_inverse=True)
        c = np.bincount(where, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)
        i, j = key // len(fp), key % len(fp)
        beyond = size - prefix(t, size)
        ok = c + np.maximum(beyond[i], beyond[j]) >= need(t, size[i], size[j])
        yield pa.RecordBatch.from_arrays([pa.array(fp[i[ok]]), pa.array(fp[j[ok]]), pa.array(np.zeros(int(ok.sum()), np.int32))], names=["a", "b", "kind"])

    packed = "block long, data binary"
    own = F.col("block").cast("int")  # one block a task, however many there are
    blocked = _base(docs).mapInArrow(tidy(index), packed).repartitionById(blocks, own).mapInArrow(tidy(product), packed)
    return blocked.repartitionById(blocks, own).mapInArrow(tidy(total), "a long, b long, kind int")


def _grouped(cand: DataFrame) -> DataFrame:
    """Adds a group key (k1, k2, k3) to each pair. Members of a dense group get one label in two rounds of least neighbours, so
    that a set is sent to one place; pairs across labels have a group of their own labels; large groups are cut into tiles."""
    both = cand.select(F.col("a").alias("x"), F.col("b").alias("y")).union(cand.select("b", "a"))
    one = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("l"))
    two = both.join(one.select(F.col("x").alias("y"), "l"), "y").groupBy("x").agg(F.min("l").alias("l"))
    # the least neighbour's label, so that all of a near-clique agree
    sized = two.join(two.groupBy("l").agg(F.ceil(F.count("*") / TILE).alias("tiles")), "l").select("x", "l", F.pmod(F.xxhash64("x"), "tiles").alias("tile"))
    sized = stored(sized)
    a = sized.select(F.col("x").alias("a"), F.col("l").alias("la"), F.col("tile").alias("ta"))
    b = sized.select(F.col("x").alias("b"), F.col("l").alias("lb"), F.col("tile").alias("tb"))
    return cand.join(a, "a").join(b, "b").select(
        "a",
        "b",
        F.least("la", "lb").alias("k1"),
        F.greatest("la", "lb").alias("k2"),
        (F.least("ta", "tb") * (1 << 31) + F.greatest("ta", "tb")).alias("k3"),
    )


def _crossings(crowds: DataFrame, between: DataFrame, t: float) -> DataFrame:
    """k1, k2, k3, fp, kind: groups in which each set of kind 2 is to be held against each of kind 3, or, if there are none, against each
    other: tiles of each crowd with one another, and with those of the crowds and sets that pairs of units name."""
    tiles = lambda n, most: F.ceil(n * F.greatest(F.lit(1 / TILE), most / WEIGHT))
    size = stored(crowds.groupBy("unit").agg(F.count("*").alias("n"), F.max("size").alias("most")).select("unit", "most", tiles(F.col("n"), F.col("most")).alias("tiles")))
    own = stored(crowds.join(size, "unit").select("unit", "fp", F.pmod(F.xxhash64("fp"), "tiles").alias("tile")))
    name = lambda c: size.select(F.col("unit").alias(c), F.col("most").alias(f"{c}_most"), F.col("tiles").alias(f"{c}_tiles"))
    known = stored(between.select("a", "b").join(name("a"), "a", "left").join(name("b"), "b", "left"))
    both = known.filter("a_tiles is not null and b_tiles is not null").select("a", "b", "a_tiles", "b_tiles")
    both = both.union(size.select("unit", "unit", "tiles", "tiles"))
    both = both.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("a_tiles") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("b_tiles") - 1))).filter("a <> b or i <= j")
    both = both.select(F.col("a").alias("k1"), F.col("b").alias("k2"), (-1 - F.col("i") * (1 << 31) - F.col("j")).alias("k3"), "i", "j")
    sides = both.select("k1", "k2", "k3", F.col("k1").alias("unit"), F.col("i").alias("tile"), F.lit(2).alias("kind")).union(
        both.filter("k1 <> k2 or i <> j").select("k1", "k2", "k3", "k2", "j", F.lit(3))
    )
    # sets of no crowd: some of them at a time against a tile
    one = known.filter("a_tiles is null or b_tiles is null").select(
        F.when(F.col("a_tiles").isNull(), F.col("b")).otherwise(F.col("a")).alias("unit"), F.when(F.col("a_tiles").isNull(), F.col("a")).otherwise(F.col("b")).alias("fp")
    )
    chunks = one.groupBy("unit").agg(F.count("*").alias("n")).join(size, "unit").select("unit", "tiles", tiles(F.col("n"), F.col("most") / t).alias("chunks"))
    key = (F.col("unit").alias("k1"), F.col("chunk").alias("k2"), (F.col("tile") - (1 << 62)).alias("k3"))
    some = one.join(chunks, "unit").select("unit", "fp", F.pmod(F.xxhash64("fp"), "chunks").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    against = some.select("unit", "chunk", "tile").distinct().join(own, ["unit", "tile"]).select(*key, "fp", F.lit(2).alias("kind"))
    return sides.join(own, ["unit", "tile"]).select("k1", "k2", "k3", "fp", "kind").union(against).union(some.select(*key, "fp", F.lit(3)))


def _verified(docs: DataFrame, n: int, t: float, cand: DataFrame, reps: DataFrame, crowds: DataFrame, pairs_out: bool) -> DataFrame:
    """What is linked among the pairs of fingerprints: document pairs of Jaccard >= t; or for each group and set in it fp, rep,
    root (a document that the links join to rep) and links, which add up."""
    spark = docs.sparkSession
    between, cand = cand.filter("kind = 1"), cand.filter("kind = 0").select("a", "b")
    some = not crowds.isEmpty()
    if some:  # what is in a pair of units isn't counted twice
        name = lambda c: crowds.select(F.col("fp").alias(c), F.col("unit").alias(f"u{c}"))
        of = cand.join(name("a"), "a", "left").join(name("b"), "b", "left").select("a", "b", F.coalesce("ua", "a").alias("ua"), F.coalesce("ub", "b").alias("ub"))
        cand = stored(of.join(between.select(F.col("a").alias("x"), F.col("b").alias("y")), (F.least("ua", "ub") == F.col("x")) & (F.greatest("ua", "ub") == F.col("y")), "left_anti").select("a", "b"))
    pairs = stored(_grouped(cand))
    ends = pairs.select("k1", "k2", "k3", F.col("a").alias("fp")).union(pairs.select("k1", "k2", "k3", "b")).distinct().withColumn("kind", F.lit(0))
    if some:
        ends = ends.union(_crossings(crowds, between, t))
    members = stored(ends.join(reps.select("fp", "rep"), "fp"))
    bloom = spark.sparkContext.broadcast(bloom_filter(members.select("fp")))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sets that are in a group (and the few that the filter lets pass)."""
        bits = bloom.value
        for b in batches:
            ids, fps, data, room = [], [], [], 0
            for i, s in zip(b.column("doc_id").to_pylist(), gram_sets(b.column("text"), n)):
                if len(s):
                    f = _fp(s)
                    if may_hold(bits, f):
                        ids.append(i), fps.append(f), data.append(s.tobytes())
                        room += 8 * len(s)
                if room > 8 * HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps, pa.int64()), pa.array(data, pa.binary())], names=["rep", "fp", "grams"])
                    ids, fps, data, room = [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps, pa.int64()), pa.array(data, pa.binary())], names=["rep", "fp", "grams"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets, sides, todo = None, {}, ([], []), []

        def close():
            if todo:
                yield _overlaps(sets, todo, t, pairs_out)
            elif sides[0]:
                yield _crossed(sets, *sides, t, pairs_out)

        for b in batches:
            k = np.stack([b.column(c).to_numpy() for c in ("k1", "k2", "k3", "kind")])
            a, rep = b.column("a").to_numpy(), b.column("rep").to_numpy()
            cuts = [*np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1, b.num_rows]
            i = 0
            for j in cuts:
                if tuple(k[:3, i]) != now:
                    yield from close()
                    now, sets, sides, todo = tuple(k[:3, i]), {}, ([], []), []
                if k[3, i] == 1:
                    todo.append((a[i:j], rep[i:j]))
                else:
                    for r in range(i, j):
                        sets[int(a[r])] = (int(rep[r]), np.frombuffer(b.column("grams")[r].as_py(), _U))
                    if k[3, i]:
                        sides[k[3, i] - 2].append(a[i:j])
                i = j
        yield from close()

    grams = _base(docs).mapInArrow(tidy(wanted), "rep long, fp long, grams binary").join(members.hint("merge"), ["fp", "rep"])
    rows = grams.select("k1", "k2", "k3", "kind", F.col("fp").alias("a"), "rep", "grams").unionByName(
        pairs.select("k1", "k2", "k3", F.lit(1).alias("kind"), "a", F.col("b").alias("rep"), F.lit(None).cast("binary").alias("grams"))
    )
    out = "doc_id_a long, doc_id_b long, overlap long, jaccard double" if pairs_out else "fp long, rep long, root long, links long"
    return rows.repartition("k1", "k2", "k3").sortWithinPartitions("k1", "k2", "k3", "kind").mapInArrow(tidy(check), out)


def _overlaps(sets: dict, todo: list, t: float, pairs_out: bool) -> pa.RecordBatch:
    """Overlaps by tiles of the group's incidence matrix; n-grams of one set only are left out."""
    fps = np.array(sorted(sets), np.int64)
    names = fps.tolist()
    size = np.array([len(sets[f][1]) for f in names], np.int64)
    i, j = (np.searchsorted(fps, np.concatenate(x)) for x in zip(*todo))
    if len(i) < 4 or len(names) > 4 * TILE:
        overlap = np.array([len(np.intersect1d(sets[names[a]][1], sets[names[b]][1], assume_unique=True)) for a, b in zip(i, j)])
    else:
        overlap = _product([sets[f][1] for f in names], len(names), 0)[i, j].astype(np.int64)
    rep = np.array([sets[f][0] for f in names], np.int64)
    ok = overlap >= need(t, size[i], size[j])
    return _links(fps, rep, size, i[ok], j[ok], overlap[ok], pairs_out)


def _crossed(sets: dict, one: list, two: list, t: float, pairs_out: bool) -> pa.RecordBatch:
    """As _overlaps, of each set of one with each of two, or, if that is empty, with each other one."""
    one, two = (np.unique(np.concatenate([np.zeros(0, np.int64), *x])) for x in (one, two))
    fps = np.concatenate([one, two])
    mine = [sets[f] for f in fps.tolist()]
    size, rep = np.array([len(m[1]) for m in mine], np.int64), np.array([m[0] for m in mine], np.int64)
    start = len(one) if len(two) else 0
    acc = _product([m[1] for m in mine], len(one), start)
    ok = acc >= need(t, size[: len(one), None], size[None, start:])
    i, j = np.nonzero(ok if start else np.triu(ok, 1))
    return _links(fps, rep, size, i, j + start, acc[i, j].astype(np.int64), pairs_out)


def _product(sets: list[np.ndarray], rows: int, start: int) -> np.ndarray:
    """How many n-grams each of the first `rows` sets shares with each of those from `start` on."""
    n = len(sets)
    acc = np.zeros((rows, n - start), np.float32)
    width = max(64, min(4096, (1 << 22) // n))
    parts = max(1, sum(map(len, sets)) // HELD)  # ranges of hashes, which spread evenly
    edges = np.array([(k << 64) // parts for k in range(1, parts)], _U)
    cuts = [(0, *np.searchsorted(s, edges).tolist(), len(s)) for s in sets]
    for k in range(parts):
        some = [s[c[k] : c[k + 1]] for s, c in zip(sets, cuts)]
        gram, col = np.unique(np.concatenate(some), return_inverse=True)
        row = np.repeat(np.arange(n), [len(s) for s in some])
        often = np.bincount(col) > 1
        new = np.cumsum(often) - 1
        keep = often[col]
        row, col = row[keep], new[col[keep]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for lo in range(0, int(often.sum()), width):
            x, y = np.searchsorted(col, (lo, lo + width))
            tile = np.zeros((n, width), np.float32)
            tile[row[x:y], col[x:y] - lo] = 1
            acc += tile[:rows] @ tile[start:].T
    return acc


def _links(fps: np.ndarray, rep: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, overlap: np.ndarray, pairs_out: bool) -> pa.RecordBatch:
    """What is written of the linked pairs i, j."""
    if not pairs_out:
        links, root = np.bincount(np.concatenate([i, j]), minlength=len(fps)), least_labels(rep, i, j)
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (fps, rep, root, links)], names=["fp", "rep", "root", "links"])
    jac = overlap / (size[i] + size[j] - overlap)
    lo, hi = np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])
    ok = lo != hi
    return pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (lo, hi, overlap.astype(np.int64), np.round(jac, 6))], names=["doc_id_a", "doc_id_b", "overlap", "jaccard"])


def jaccard_join(docs: DataFrame, n: int = GRAM, t: float = THRESHOLD) -> DataFrame:
    """Pairs of documents whose sets of word n-grams have Jaccard >= t: doc_id_a < doc_id_b, overlap, jaccard.

    Words are runs of letters and digits in lower case. Documents of equal sets are one set, named by the least doc_id:
    each of the others is paired with that one alone (jaccard 1), and that one with the documents of other sets; so
    a thousand copies give 999 rows and no pair is lost. Exact, for every document against every other.

    Needs doc_id (integer) and text; extra columns are dropped. Rows with a null doc_id, and texts without a word, are in
    no pair. A text of fewer than n words is one n-gram. A repeated row counts once; texts that share a doc_id are
    not paired with each other. Pairs at exactly t are in. No rows give no rows.
    """
    meta = stored(_sets(docs, n))
    reps = stored(_reps(meta))
    crowds = _crowds(reps)
    cand = stored(_candidates(docs, n, t, crowds))
    copies = (
        meta.select("doc_id", "fp", "size").join(reps.select("fp", "rep"), "fp").filter("doc_id <> rep").select(F.col("rep").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b"), F.col("size").alias("overlap"), F.lit(1.0).alias("jaccard")).distinct()
    )
    near = _verified(docs, n, t, cand, reps, crowds, True).groupBy("doc_id_a", "doc_id_b").agg(F.max("overlap").alias("overlap"), F.max("jaccard").alias("jaccard"))
    return copies.unionByName(near)


def jaccard_classes(docs: DataFrame, n: int = GRAM, t: float = THRESHOLD) -> DataFrame:
    """One row for each doc_id: doc_id, class_id, copies, links.

    Two different sets of word n-grams are linked if their Jaccard similarity is t or more. links says to how many sets that
    of the document is; copies, how many other doc_ids have an equal set. class_id is the least doc_id of all that are joined by
    links and equality. Exact, for every document against every other; words and sets are those of jaccard_join. As a
    set's links are added up, rows don't grow with the pairs of a group.

    Needs doc_id (integer) and text; extra columns are dropped. Rows with a null doc_id are left out. A null text, or one
    without a word, has no link and no copy. A text of fewer than n words is one n-gram. A repeated row counts once; a
    doc_id of several texts is one row with the sums of their copies and links, in one class. Pairs at exactly t are
    linked. No rows give no rows.
    """
    meta = stored(_sets(docs, n).distinct())
    reps = stored(_reps(meta))
    crowds = _crowds(reps)
    cand = stored(_candidates(docs, n, t, crowds))
    found = stored(_verified(docs, n, t, cand, reps, crowds, False))
    links = found.groupBy("fp").agg(F.sum("links").alias("links"))
    own = meta.select("doc_id", "fp").join(reps.select("fp", "rep", "copies"), "fp")
    several = meta.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    root = components(found.select(F.col("rep").alias("x"), F.col("root").alias("y")).union(own.join(several, "doc_id", "left_semi").select("doc_id", "rep")))
    rows = own.join(links, "fp", "left").join(root.withColumnRenamed("node", "rep"), "rep", "left")
    by = rows.groupBy("doc_id").agg(F.min(F.coalesce("root", "rep")).alias("class_id"), F.sum("copies").alias("copies"), F.sum(F.coalesce("links", F.lit(0))).alias("links"))
    ids = take(docs, "doc_id").filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return ids.join(by, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copies", F.lit(0)).cast("long").alias("copies"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def drop_near_copies(docs: DataFrame, n: int = GRAM, t: float = THRESHOLD) -> DataFrame:
    """docs, all columns, with one document of each class of jaccard_classes: that of least doc_id.

    Rows with a null doc_id and texts without a word stay. Of rows that repeat both doc_id and text one stays; a doc_id of
    several texts stays with all of them or none.
    """
    gone = jaccard_classes(docs, n, t).filter("class_id <> doc_id").select(F.col("doc_id").alias("_gone"))
    key, text = f"_c{position(docs, 'doc_id')}", f"_c{position(docs, 'text')}"
    kept = numbered(docs).join(gone, F.col(key) == F.col("_gone"), "left_anti")
    ids = take(docs, "doc_id").filter("doc_id is not null")
    if not ids.groupBy("doc_id").count().filter("count > 1").isEmpty():
        once = F.row_number().over(Window.partitionBy(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).orderBy(key))
        kept = kept.withColumn("_n", once).filter((F.col("_n") == 1) | F.col(key).isNull()).drop("_n")
    return kept.toDF(*docs.columns)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


_WORD = r"[^0-9a-z\x{80}-\x{10FFFF}]+"
SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{_WORD}'), lambda x: x <> '') AS w
           FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= {GRAM}
        THEN list_transform(range(1, len(w) - {GRAM} + 2), lambda i: array_to_string(w[i:i + {GRAM} - 1], ' '))
        ELSE [array_to_string(w, ' ')] END)) AS s FROM w WHERE len(w) > 0),
r AS (SELECT row_number() OVER () AS k, * FROM (SELECT s, min(doc_id) AS rep, count(*) - 1 AS copies FROM s GROUP BY s)),
m AS (SELECT s.doc_id, r.k, r.rep, r.copies FROM s JOIN r USING (s)),
g AS (SELECT k, len(s) AS n, unnest(s) AS g FROM r),
p AS (SELECT x.k AS a, y.k AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS o FROM g x JOIN g y ON x.g = y.g AND x.k < y.k GROUP BY x.k, y.k),
near AS (SELECT a, b FROM p WHERE o >= ceil({THRESHOLD} / (1 + {THRESHOLD}) * (na + nb) - 1e-9)),
e AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
l AS (SELECT a AS k, count(*) AS links FROM e GROUP BY a),
edges AS (SELECT x.rep AS x, y.rep AS y FROM e JOIN r x ON x.k = e.a JOIN r y ON y.k = e.b UNION SELECT doc_id, rep FROM m UNION SELECT rep, doc_id FROM m),
reach(id, r) AS (SELECT doc_id, doc_id FROM m UNION SELECT reach.id, edges.y FROM reach JOIN edges ON reach.r = edges.x),
c AS (SELECT id, min(r) AS class_id FROM reach GROUP BY id),
d AS (SELECT doc_id, sum(copies) AS copies, sum(coalesce(links, 0)) AS links FROM m LEFT JOIN l USING (k) GROUP BY doc_id)
SELECT i.doc_id, coalesce(class_id, i.doc_id) AS class_id, coalesce(copies, 0)::BIGINT AS copies, coalesce(links, 0)::BIGINT AS links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) i LEFT JOIN c ON c.id = i.doc_id LEFT JOIN d ON d.doc_id = i.doc_id
"""
