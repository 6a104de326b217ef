"""Embedding near-dedup by product quantisation over inverted lists."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, least_labels, stored, table, take

#: Least cosine; subspaces, codes in each, and rounds of k-means (each over all vectors).
COSINE, SUBSPACES, CODES, ROUNDS = 0.95, 8, 64, 3
#: Vectors on which the number of probes is measured, and the share of partners at the least cosine that must be reached.
MEASURED, REACHED = 2000, 0.985
#: Vectors in one cell (a list, or a part of a long one), and numbers in one block of distances.
CELL, BLOCK = 16_384, 1 << 21


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _units(col: pa.Array) -> np.ndarray:
    return _unit(np.asarray(col.flatten()).reshape(len(col), -1)) if len(col) else np.zeros((0, 1))


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * x @ c.T).argmin(1)


def _vectors(df: DataFrame) -> DataFrame:
    """vec_id, v: of the commonest length (of equals the least), with finite numbers and a length above 0."""
    d = take(df, "vec_id", "embedding").filter("vec_id is not null and embedding is not null and size(embedding) > 0")
    d = d.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    d = d.filter(~bad & F.exists("v", lambda x: x != 0))
    size = d.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    # + 0 makes -0 and 0 one
    return d.filter(F.size("v") == (size.n if size else 0)).select("vec_id", F.transform("v", lambda x: x + F.lit(0).cast("float")).alias("v"))


def _means(d: DataFrame, group, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """k-means over all rows, and how many rows the last round gave each centre. group(x, centres): for each of some parts the centre of each row and its vector."""
    sc, centres = d.sparkSession.sparkContext, start
    sizes = np.zeros(start.shape[:2], np.int64)
    for _ in range(ROUNDS):
        shared = sc.broadcast(centres)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            total, count = np.zeros(c.shape), np.zeros(c.shape[:2], np.int64)
            for b in batches:
                for s, (at, x) in enumerate(group(_units(b.column("v")), c)):
                    np.add.at(total[s], at, x)
                    count[s] += np.bincount(at, minlength=c.shape[1])
            s, k = np.nonzero(count)
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(k), pa.array(count[s, k]), pa.array(list(total[s, k]), pa.list_(pa.float64()))], names=["s", "k", "n", "x"])

        width = centres.shape[2]
        got = d.select("v").mapInArrow(sums, "s long, k long, n long, x array<double>").groupBy("s", "k").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("x")[i]) for i in range(width)]).alias("x"))
        centres, sizes = centres.copy(), np.zeros(start.shape[:2], np.int64)
        for r in got.collect():
            centres[r.s, r.k] = np.array(r.x) / r.n
            sizes[r.s, r.k] = r.n
    return centres, sizes


def probes_of(sample: np.ndarray, coarse: np.ndarray, cosine: float, share: float = REACHED) -> int:
    """The fewest lists to look into, so that of vectors at exactly `cosine`, in a random direction from each sampled one, this
    share is met: one of the two looks into the other's list. Nearer partners are met more often."""
    rng = np.random.default_rng(3)
    r = rng.normal(size=sample.shape)
    r -= (r * sample).sum(1, keepdims=True) * sample
    r /= np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-12)
    other = cosine * sample + math.sqrt(max(0.0, 1 - cosine * cosine)) * r
    rank = []
    for x, y in ((sample, other), (other, sample)):
        dx, home = (coarse * coarse).sum(1) - 2 * x @ coarse.T, _nearest(y, coarse)
        rank.append((dx < dx[np.arange(len(x)), home][:, None]).sum(1) + 1)
    return int(min(len(coarse), np.ceil(np.quantile(np.minimum(*rank), share))))


def near_classes(vectors: DataFrame, cosine: float = COSINE, probes: int | None = None) -> DataFrame:
    """One row for each vec_id: vec_id, class_id, copies, links.

    Two different vectors are linked if their cosine is at least `cosine`; links says to how many a vector is, copies how
    many other vec_ids have an equal one. class_id is the least vec_id of all that are joined by links and equality.
    Equal vectors are searched as one. Every vector looks into the lists of its nearest centres (as many as a measurement
    shows to be enough, see probes_of, or `probes`), where distances to quantised residuals come from a table; what the
    table and the known error of quantisation leave possible is computed exactly. So only a link of which neither end looks
    into the other's list is missed, and none is made up. A vector is sent to its own list and those it looks into, whatever
    the number of vectors; long lists are cut into cells, and a cell adds up links instead of sending pairs.

    Needs vec_id (integer) and embedding; extra columns are dropped. Rows with a null vec_id are left out. Null or empty
    embeddings, those with a null, NaN or infinite number or of length 0, and those of another dimension than most have no
    link and no copy. A repeated row counts once; a vec_id of several vectors is one row with the sums of their copies and
    links, in one class. No rows give no rows.
    """
    ids = take(vectors, "vec_id").filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    d = _vectors(vectors).withColumn("h", F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b")))
    members = stored(d.select("vec_id", "h").distinct())
    reps = members.groupBy("h").agg(F.min("vec_id").alias("rep"), (F.count("*") - 1).alias("copies"))
    one = stored(d.groupBy("h").agg(F.min("vec_id").alias("rep"), F.first("v").alias("v")).select(F.xxhash64("h").alias("node"), "rep", "v"))
    found = stored(_linked(one, cosine, probes))
    own = members.join(reps, "h").withColumn("node", F.xxhash64("h"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    several = members.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").select("vec_id")
    edges = found.select(F.col("rep").alias("x"), F.col("root").alias("y")).union(own.join(several, "vec_id", "left_semi").select("vec_id", "rep"))
    root = components(edges)
    rows = own.join(links, "node", "left").join(root.withColumnRenamed("node", "rep"), "rep", "left")
    by = rows.groupBy("vec_id").agg(F.min(F.coalesce("root", "rep")).alias("class_id"), F.sum("copies").alias("copies"), F.sum(F.coalesce("links", F.lit(0))).cast("long").alias("links"))
    return ids.join(by, "vec_id", "left").select("vec_id", F.coalesce("class_id", "vec_id").alias("class_id"), F.coalesce("copies", F.lit(0)).cast("long").alias("copies"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def _linked(one: DataFrame, cosine: float, probes: int | None) -> DataFrame:
    """From node, rep, v of different vectors: node, rep, root, links, some rows a node. links add up; rep and root are in one class."""
    sc = one.sparkSession.sparkContext
    n = one.count()
    lists = max(1, math.ceil(math.sqrt(n)))
    sample = one.orderBy(F.xxhash64("node"), "node").limit(max(lists, CODES, MEASURED)).select("v").toPandas()["v"]
    if not len(sample):
        return one.select("node", "rep", F.col("rep").alias("root"), F.lit(0).cast("long").alias("links"))
    seed = _unit(np.array(list(sample)))
    dim = seed.shape[1]
    m = max(k for k in range(1, SUBSPACES + 1) if dim % k == 0)
    sub = dim // m
    coarse, sizes = _means(one, lambda x, c: [(_nearest(x, c[0]), x)], seed[None, :lists])
    coarse = coarse[0]
    left = seed - coarse[_nearest(seed, coarse)]
    start = np.stack([np.resize(left[:, s * sub : (s + 1) * sub], (CODES, sub)) for s in range(m)])

    def residual(x, c):
        r = x - coarse[_nearest(x, coarse)]
        return [(_nearest(r[:, s * sub : (s + 1) * sub], c[s]), r[:, s * sub : (s + 1) * sub]) for s in range(m)]

    books, _ = _means(one, residual, start)
    p = min(lists, probes or probes_of(seed[:MEASURED], coarse, cosine))
    # the last round's sizes are those of the centres before, near enough to cut long lists by
    cells = np.maximum(1, -(-sizes[0] // CELL))
    first = np.cumsum(cells) - cells
    model = sc.broadcast((coarse, books, cells, first))
    names = ["cell", "kind", "node", "rep", "home", "codes", "seen", "x"]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, book, cells_, first_ = model.value
        for whole in batches:
            for lo in range(0, whole.num_rows, max(1, BLOCK // (2 * len(c)))):
                b = whole.slice(lo, max(1, BLOCK // (2 * len(c))))
                x, node, rep = _units(b.column("v")), b.column("node").to_numpy(), b.column("rep").to_numpy()
                dist = (c * c).sum(1) - 2 * x @ c.T
                home = dist.argmin(1)
                near = np.argpartition(dist, p - 1, axis=1)[:, :p] if p < len(c) else np.broadcast_to(np.arange(len(c)), (len(x), len(c)))
                codes = np.stack([_nearest((x - c[home])[:, s * sub : (s + 1) * sub], book[s]) for s in range(m)], 1).astype(np.uint8)
                raw = np.ascontiguousarray(np.asarray(b.column("v").flatten(), np.float32).reshape(len(x), -1))
                who, lst = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
                many = cells_[lst]  # a query goes to all cells of a list
                who, lst = np.repeat(who, many), np.repeat(lst, many)
                part = np.arange(len(lst)) - np.repeat(np.cumsum(many) - many, many)
                cell = np.concatenate([first_[home] + node % cells_[home], first_[lst] + part])
                at = np.concatenate([np.arange(len(x)), who])
                base = np.arange(len(at)) < len(x)
                bytes_ = [r.tobytes() for r in raw]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cell.astype(np.int64)), pa.array((~base).astype(np.int32)), pa.array(node[at]), pa.array(rep[at]), pa.array(home[at].astype(np.int64)),
                        pa.array([codes[i].tobytes() if k else None for i, k in zip(at, base)], pa.binary()),
                        pa.array([near[i].astype(np.int32).tobytes() if k else None for i, k in zip(at, base)], pa.binary()),
                        pa.array([bytes_[i] for i in at], pa.binary()),
                    ],
                    names=names,
                )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, book, _, first_ = model.value
        now, base = None, None
        for b in batches:
            cell, kind = b.column("cell").to_numpy(), b.column("kind").to_numpy()
            node, rep, home = (b.column(k).to_numpy() for k in ("node", "rep", "home"))
            x = _unit(np.frombuffer(b"".join(v.as_py() for v in b.column("x")), np.float32).reshape(-1, dim))
            cuts = np.flatnonzero(np.diff(cell * 2 + kind, prepend=-1, append=-1))
            for i, j in zip(cuts[:-1], cuts[1:]):
                if cell[i] != now:
                    now, base = cell[i], None
                if not kind[i]:
                    text = lambda k, t: np.frombuffer(b"".join(v.as_py() for v in b.column(k).slice(i, j - i)), t).reshape(j - i, -1)  # noqa: B023, E731
                    own = (node[i:j], rep[i:j], x[i:j], text("codes", np.uint8), text("seen", np.int32))
                    base = own if base is None else tuple(np.concatenate(t) for t in zip(base, own))
                elif base is not None:
                    centre = c[np.searchsorted(first_, now, "right") - 1]
                    step = max(1, BLOCK // len(base[0]))
                    for k in range(i, j, step):
                        at = slice(k, min(j, k + step))
                        yield from _asymmetric((node[at], rep[at], x[at], home[at]), base, centre, book)

    def _asymmetric(query, base, centre, book):
        """Links of queries to the vectors of a cell, each link on one side only: that of the lesser node, if it looks here at all."""
        reach = math.sqrt(max(0.0, 2 - 2 * cosine))
        (name, rep, x, home), (names_, reps_, y, codes, seen) = query, base
        r = x - centre
        error = np.linalg.norm(y - centre - np.concatenate([book[s][codes[:, s]] for s in range(m)], 1), axis=1)
        d2 = np.zeros((len(x), len(y)))
        for s in range(m):
            q, w = r[:, s * sub : (s + 1) * sub], book[s]
            d2 += ((q * q).sum(1)[:, None] + (w * w).sum(1) - 2 * q @ w.T)[:, codes[:, s]]
        i, j = np.nonzero(d2 <= (reach + error + 1e-9) ** 2)
        far = name[i] > names_[j]
        far[far] = (seen[j[far]] == home[i[far]][:, None]).any(1)  # found from the other side
        ok = (name[i] != names_[j]) & ~far
        i, j = i[ok], j[ok]
        exact = np.concatenate([np.zeros(0)] + [(x[i[k : k + 65536]] * y[j[k : k + 65536]]).sum(1) for k in range(0, len(i), 65536)])
        i, j = i[exact >= cosine], j[exact >= cosine]
        if len(i):
            root = least_labels(np.concatenate([rep, reps_]), i, j + len(x))
            n = np.bincount(np.concatenate([i, j + len(x)]), minlength=len(root))
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(t)[k]) for t in ((name, names_), (rep, reps_))] + [pa.array(root[k]), pa.array(n[k])], names=["node", "rep", "root", "links"])

    parts = max(1, math.ceil(n * (p + 1) / 200_000), sc.defaultParallelism)
    return (
        one.mapInArrow(index, "cell long, kind int, node long, rep long, home long, codes binary, seen binary, x binary")
        .repartition(parts, "cell")
        .sortWithinPartitions("cell", "kind")
        .mapInArrow(search, "node long, rep long, root long, links long")
    )


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE v AS (SELECT embedding::DOUBLE[] AS v, min(vec_id) AS id, count(DISTINCT vec_id) - 1 AS copies FROM embeddings
                     WHERE vec_id IS NOT NULL AND len(embedding) > 0 GROUP BY embedding),
n AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM v),
p AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.id < b.id WHERE list_dot_product(a.v, b.v) >= {COSINE}),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach(id, r) AS (SELECT id, id FROM v UNION SELECT reach.id, e.b FROM reach JOIN e ON reach.r = e.a),
c AS (SELECT id, min(r) AS class_id FROM reach GROUP BY id),
l AS (SELECT a AS id, count(*) AS links FROM e GROUP BY a)
SELECT m.vec_id, coalesce(c.class_id, m.vec_id) AS class_id, coalesce(v.copies, 0)::BIGINT AS copies, coalesce(l.links, 0)::BIGINT AS links
FROM (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL) m
LEFT JOIN v USING (v) LEFT JOIN c USING (id) LEFT JOIN l USING (id)
"""
