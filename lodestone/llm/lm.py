"""Language-model scores: a causal self-attention model over subword ids, trained and run in numpy.

The model has one attention layer with a learned bias for each distance. Its output is factored: a softmax over classes of ids
(cut from the ids by frequency, of about equal mass) and the share of the id within its class, from counts over all
documents. Rare ids share rows of the embedding.

Training goes over every id of every document once. Texts are cut into pieces, which a hash gives to rounds and to shards of
about SHARD ids, whatever the partitions of the table; all shards of a round start from the same parameters, and their
means, as whole numbers that add up alike in any order, are the next round's start. So scores don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import stored, table, take
from .tokens import END, FOLDER, Encoder

#: Ids, rows of the embedding, width, classes.
IDS, ROWS, WIDTH, CLASSES = END + 1, 4096, 16, 64
#: Tokens in a window, and how many of them are scored; the others are context.
WINDOW, STRIDE = 32, 16
#: Rounds, each over its share of the pieces; windows in a step; rate; ids of a shard and of a piece (whole windows).
ROUNDS, BATCH, RATE, SHARD, PIECE = 2, 64, 0.02, 1_000_000, 4096
#: Parameters are added up as whole numbers of this many a unit; numbers of one message.
UNIT, MESSAGE = 1 << 20, 16_384
#: Length of the output layer's inner products: embedding, context, 1 for the bias, and zeros, as multiples of 4 are quicker.
INNER = 2 * WIDTH + 4
#: Blocks of STRIDE places that are scored at a time, so that all of it stays near the core.
AT_ONCE = 128


@dataclass
class Tables:
    row: np.ndarray  # id to row of the embedding
    cls: np.ndarray  # id to class
    within: np.ndarray  # id to -ln of its share of its class


def tables(counts: np.ndarray) -> Tables:
    """From the number of times each id occurs; an id that doesn't counts as one time."""
    c = np.maximum(counts, 0).astype(np.float64) + 1
    order = np.argsort(-c, kind="stable")
    rank = np.empty(len(c), np.int64)
    rank[order] = np.arange(len(c))
    half = ROWS // 2
    row = np.where(rank < half, rank, half + rank % half)
    cum = np.cumsum(c[order])
    cls = np.empty(len(c), np.int64)
    cls[order] = np.minimum(CLASSES - 1, ((cum - c[order]) * CLASSES / cum[-1]).astype(np.int64))
    mass = np.bincount(cls, weights=c, minlength=CLASSES)
    return Tables(row.astype(np.int32), cls.astype(np.int32), np.log(mass[cls] / c).astype(np.float32))


def fresh(t: Tables, counts: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    n = lambda *s: rng.normal(0, 1, s).astype(np.float32)
    mass = np.bincount(t.cls, weights=counts + 1.0, minlength=CLASSES)
    return {
        "emb": n(ROWS, WIDTH) * 0.3, "q": n(WIDTH, WIDTH) * 0.25, "k": n(WIDTH, WIDTH) * 0.25, "v": n(WIDTH, WIDTH) * 0.25,
        "far": np.zeros(WINDOW, np.float32), "o": n(2 * WIDTH, CLASSES) * 0.1, "b": np.log(np.maximum(mass, 0.5) / mass.sum()).astype(np.float32),
    }


_D = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]
_PAST = np.flatnonzero(_D >= 0)
_HOW_FAR = _D.ravel()[_PAST]
_LATER = np.where(_D >= 0, 0, -1e9)
_D = np.maximum(_D, 0)


def _bias(far: np.ndarray, stride: int) -> np.ndarray:
    """For the last `stride` places of a window and all places: the bias of the distance, or -1e9 for what comes later."""
    return far.take(_D[-stride:]) + _LATER[-stride:].astype(far.dtype)


def _exp(a: np.ndarray) -> np.ndarray:
    """In place; numbers above 80 count as 80, which spares taking the greatest off. The reciprocal of the sums over the last axis."""
    if not a.max(initial=0) <= 80:  # rare; looking for it is far cheaper than np.minimum
        np.minimum(a, a.dtype.type(80), out=a)
    np.exp(a, out=a)
    return 1 / (a @ np.ones(a.shape[-1], a.dtype) + a.dtype.type(1e-30))


def _out(p: dict) -> np.ndarray:
    """The output layer with its bias as INNER rows."""
    return np.concatenate([p["o"], p["b"][None], np.zeros((INNER - 2 * WIDTH - 1, CLASSES), p["o"].dtype)])


def step(p: dict, rows: np.ndarray, target: np.ndarray, want_loss: bool = True) -> tuple[float | None, dict, np.ndarray]:
    """Mean loss over the windows' places if wanted, its gradient, and the rows of the embedding that g["emb"] is for. rows: of the input at
    each place; target: class of the id after it, -1 where there is none."""
    flat = lambda t: t.reshape(-1, t.shape[-1])
    at_rows = rows.ravel()
    x = p["emb"].take(at_rows, 0)
    kind = x.dtype.type
    wq = p["q"] * kind(WIDTH**-0.5)
    q, k, v = ((x @ w).reshape(*rows.shape, WIDTH) for w in (wq, p["k"], p["v"]))
    a = q @ k.transpose(0, 2, 1)
    a += _bias(p["far"], WINDOW)
    a *= _exp(a)[..., None]
    c = a @ v
    ends = np.zeros((len(x), INNER - 2 * WIDTH), x.dtype)
    ends[:, 0] = 1
    h, out = np.concatenate([x, flat(c), ends], 1), _out(p)
    z = h @ out
    over = _exp(z)
    to = target.ravel()
    at = np.flatnonzero(to >= 0)
    n = max(1, len(at))
    place = at * z.shape[1] + to[at]
    loss = float(-np.log(np.maximum(z.ravel().take(place) * over[at], 1e-12)).sum() / n) if want_loss else None
    if len(at) < len(to):
        over[to < 0] = 0
    z *= (over * kind(1 / n))[:, None]
    z.ravel()[place] -= kind(1 / n)
    both = h.T @ z
    g = {"o": both[: 2 * WIDTH], "b": both[2 * WIDTH]}
    dh = z @ p["o"].T
    dc = np.ascontiguousarray(dh[:, WIDTH:]).reshape(c.shape)
    da = dc @ v.transpose(0, 2, 1)
    dv = flat(a.transpose(0, 2, 1) @ dc)
    da -= np.einsum("wik,wik->wi", dc, c)[..., None]  # the mean of da under a
    da *= a
    g["far"] = np.bincount(_HOW_FAR, weights=da.sum(0).ravel().take(_PAST), minlength=WINDOW).astype(x.dtype)
    d = np.concatenate([flat(da @ k), flat(da.transpose(0, 2, 1) @ q), dv], 1)
    g["q"], g["k"], g["v"] = np.split(x.T @ d, 3, axis=1)
    g["q"] = g["q"] * kind(WIDTH**-0.5)
    dx = d @ np.concatenate([wq, p["k"], p["v"]], 1).T
    dx += dh[:, :WIDTH]
    order = np.argsort(at_rows, kind="stable")
    sorted_ = at_rows.take(order)
    new = np.ones(len(order), bool)
    np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:])
    first = np.flatnonzero(new)
    pairs = np.result_type(dx, np.complex64)  # as complex numbers, two are added at a time
    g["emb"] = np.add.reduceat(dx.view(pairs).take(order, 0), first, axis=0).view(dx.dtype)
    return loss, g, sorted_.take(first)


def _adam(m: np.ndarray, s: np.ndarray, g: np.ndarray, t: int) -> np.ndarray:
    """What to take off the parameters; m, s: their means and squares, which go on in place."""
    m += np.float32(0.1) * (g - m)
    s += np.float32(0.01) * (g * g - s)
    return np.float32(RATE / (1 - 0.9**t)) * m / (np.sqrt(s * np.float32(1 / (1 - 0.99**t))) + np.float32(1e-6))


def train(p: dict, rows: np.ndarray, target: np.ndarray, seed: int) -> dict:
    """Adam, once over the windows in a fixed random order; of the embedding only the rows that a step has."""
    names = [k for k in p if k != "emb"]
    cuts = np.cumsum([0] + [p[k].size for k in names])
    dense = np.concatenate([p[k].ravel() for k in names])
    now = {k: dense[i:j].reshape(p[k].shape) for k, i, j in zip(names, cuts[:-1], cuts[1:])} | {"emb": p["emb"].copy()}
    ms, ms_emb = np.zeros((2, dense.size), dense.dtype), np.zeros((2, ROWS, WIDTH), dense.dtype)
    order = np.random.default_rng(seed).permutation(len(rows))
    for t, i in enumerate(range(0, len(order), BATCH), 1):
        at = order[i : i + BATCH]
        _, g, used = step(now, rows[at], target[at], want_loss=False)
        dense -= _adam(*ms, np.concatenate([g[k].ravel() for k in names]), t)
        m, s = (x.take(used, 0) for x in ms_emb)
        now["emb"][used] -= _adam(m, s, g["emb"], t)
        ms_emb[0][used], ms_emb[1][used] = m, s
    return {k: now[k] for k in p}


def before(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and what stands before each of them (the model's input at its place): END or the id before."""
    n = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)
    last = np.empty_like(flat)
    last[1:] = flat[:-1]
    last[(np.cumsum(n) - n)[n > 0]] = END
    return flat, last


def score(p: dict, t: Tables, ids: list[np.ndarray]) -> np.ndarray:
    """Summed -ln of the probability of each text's ids. Each id is scored once, in the window whose last places hold it.

    All texts are one row of blocks of STRIDE places: before each text are empty blocks, a window's context, and its last
    block is filled up. A window is the blocks up to its last one, so keys and values are made once and windows are views.
    """
    lead = WINDOW // STRIDE - 1
    n = np.array([len(x) for x in ids], np.int64)
    blocks = np.where(n > 0, -(-n // STRIDE) + lead, 0)
    start = np.cumsum(blocks) - blocks
    flat, last = before(ids)
    total = np.zeros(len(ids))
    if not len(flat):
        return total
    place = np.arange(len(flat)) + np.repeat((start + lead) * STRIDE - (np.cumsum(n) - n), n)
    rows = np.full(int(blocks.sum()) * STRIDE, ROWS, np.int32)
    rows[place] = t.row[last]
    own = np.zeros(len(rows), np.int32)
    own[place] = flat
    # one column more masks empty keys: it is 1 in queries
    pad = lambda x, fill: np.concatenate([np.concatenate([x, np.zeros((ROWS, 1), np.float32)], 1), np.array([[0.0] * x.shape[1] + [fill]], np.float32)])
    key, value = pad(p["emb"] @ p["k"], -1e9), np.concatenate([p["emb"] @ p["v"], np.zeros((1, WIDTH), np.float32)])
    query = pad(p["emb"] @ p["q"] * np.float32(WIDTH**-0.5), 0)
    query[:, WIDTH] = 1
    emb = np.concatenate([p["emb"], np.zeros((1, WIDTH), np.float32)])
    out = _out(p)
    bias = _bias(p["far"], STRIDE)
    # exp can't overflow below these bounds, so that no maximum is needed
    safe = float(np.linalg.norm(query[:, :WIDTH], axis=1).max() * np.linalg.norm(key[:-1], axis=1).max() + np.abs(p["far"]).max()) < 80
    wide = float(np.linalg.norm(np.concatenate([emb, value], 1), axis=1).max() * 2)
    safe = safe and wide * float(np.linalg.norm(p["o"], axis=0).max()) + float(np.abs(p["b"]).max()) < 80
    cls = t.cls.take(own)
    sums, picked = np.ones(len(rows), np.float32), np.zeros(len(rows), np.float32)
    h, room = np.zeros((AT_ONCE * STRIDE, INNER), np.float32), np.empty((AT_ONCE * STRIDE, CLASSES), np.float32)
    h[:, 2 * WIDTH] = 1
    ones = np.ones(CLASSES, np.float32)
    line = np.arange(AT_ONCE * STRIDE) * CLASSES
    for lo in range(lead, len(rows) // STRIDE, AT_ONCE):
        hi = min(lo + AT_ONCE, len(rows) // STRIDE)
        all_, new = rows[(lo - lead) * STRIDE : hi * STRIDE], rows[lo * STRIDE : hi * STRIDE]
        k, v = key.take(all_, 0), value.take(all_, 0)
        view = lambda x: as_strided(x, (hi - lo, WINDOW, x.shape[1]), (STRIDE * x.strides[0], *x.strides))  # noqa: B023, E731
        a = query.take(new, 0).reshape(hi - lo, STRIDE, -1) @ view(k).transpose(0, 2, 1)
        a += bias
        if not safe:
            a -= a.max(2, keepdims=True)
        np.exp(a, out=a)
        c = a @ view(v)
        x, z = h[: len(new)], room[: len(new)]
        x[:, :WIDTH] = emb.take(new, 0)
        np.multiply(c, (1 / (a @ ones[:WINDOW] + np.float32(1e-30)))[:, :, None], out=x.reshape(hi - lo, STRIDE, INNER)[:, :, WIDTH : 2 * WIDTH])
        np.matmul(x, out, out=z)
        if not safe:
            z -= z.max(1, keepdims=True)
        here = slice(lo * STRIDE, hi * STRIDE)
        picked[here] = z.ravel().take(line[: len(new)] + cls[here])
        np.exp(z, out=z)
        np.matmul(z, ones, out=sums[here])
    nll = np.log(sums) - picked + t.within.take(own)
    return np.bincount(np.repeat(np.arange(len(ids)), n), weights=nll[place], minlength=len(ids)).astype(np.float64)


def _ids(b: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint16) for x in b.column("ids")]


def _pieces(doc_id, ids: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A hash, and the ids with the one before them, for each PIECE of a text."""
    seed = xxhash.xxh3_64_intdigest(ids.tobytes(), xxhash.xxh3_64_intdigest(str(doc_id)))
    last = np.concatenate([np.array([END], np.uint16), ids])
    for k, lo in enumerate(range(0, len(ids), PIECE)):
        yield xxhash.xxh3_64_intdigest(k.to_bytes(8, "little"), seed) >> 1, last[lo : lo + PIECE + 1].tobytes()


def _windows(piece: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Inputs' rows and next ids' classes of the windows that tile a piece; each of its ids is learned from once."""
    n = len(piece) - 1
    w = -(-n // WINDOW)
    rows, target = np.zeros(w * WINDOW, np.int16), np.full(w * WINDOW, -1, np.int16)
    rows[:n], target[:n] = t.row[piece[:-1]], t.cls[piece[1:]]
    return rows.reshape(w, WINDOW), target.reshape(w, WINDOW)


def _sums(start: dict, t: Tables, seed: int, pieces: Iterator[tuple[int, np.ndarray]]) -> tuple[dict, int]:
    """Trains on shards, each from `start`; the summed parameters, as whole numbers times windows, and the windows."""
    total, count = {k: np.zeros(v.size, np.int64) for k, v in start.items()}, 0
    now, p, held, size, n = None, start, [], 0, 0

    def learn():
        nonlocal p, held, size, n
        rows, target = (np.concatenate(x) for x in zip(*held))
        p, n = train(p, rows, target, seed + n), n + len(rows)
        held, size = [], 0

    def close():
        nonlocal count, p, n
        if held:
            learn()
        for k, v in p.items():
            total[k] += np.rint(v.ravel().astype(np.float64) * UNIT).astype(np.int64) * n
        count, p, n = count + n, start, 0

    for shard, piece in pieces:
        if shard != now:
            if now is not None:
                close()
            now = shard
        held.append(_windows(piece, t))
        size += len(piece) - 1
        if size >= 2 * SHARD:  # a shard of many equal rows; the rest of it goes on from here
            learn()
    if now is not None:
        close()
    return total, count


def fit(tokens: DataFrame) -> tuple[dict, Tables]:
    """Counts over all ids; then ROUNDS rounds of training. What goes to the driver has the size of the model."""
    sc = tokens.sparkSession.sparkContext
    counts = np.zeros(IDS, np.int64)
    got = tokens.select("ids").mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts[got["id"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    t = tables(counts)
    p = fresh(t, counts)
    shards = max(1, round(int(counts.sum()) / ROUNDS / SHARD))
    names, shapes = list(p), [v.shape for v in p.values()]
    for r in range(ROUNDS):
        shared = sc.broadcast((p, t))

        def cut(batches: Iterator[pa.RecordBatch], r=r) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo in range(0, whole.num_rows, 500):
                    b = whole.slice(lo, 500)
                    got = [(h, x) for i, ids in zip(b.column("doc_id").to_pylist(), _ids(b)) for h, x in _pieces(i, ids) if h % ROUNDS == r]
                    h = np.array([g[0] for g in got], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array((h // ROUNDS % shards).astype(np.int32)), pa.array(h), pa.array([g[1] for g in got], pa.binary())], names=["shard", "h", "ids"])

        def local(batches: Iterator[pa.RecordBatch], r=r) -> Iterator[pa.RecordBatch]:
            start, t_ = shared.value
            total, n = _sums(start, t_, r, ((k, x) for b in batches for k, x in zip(b.column("shard").to_pylist(), _ids(b))))
            if n:
                flat = np.concatenate([total[k] for k in names])
                cuts = range(0, len(flat), MESSAGE)
                salt = int(n) % 32
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(cuts)), pa.int32()), pa.array([salt] * len(cuts), pa.int32()), pa.array([n] * len(cuts)), pa.array([flat[c : c + MESSAGE].tobytes() for c in cuts], pa.binary())],
                    names=["part", "salt", "n", "data"],
                )

        def add(g: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_py(), np.int64) for x in g.column("data"))
            return pa.table({"part": g.column("part")[:1], "salt": pa.array([0], pa.int32()), "n": pa.array([sum(g.column("n").to_pylist())]), "data": pa.array([total.tobytes()], pa.binary())})

        form = "part int, salt int, n long, data binary"
        tasks = min(shards, 4096)
        sums = (
            tokens.mapInArrow(cut, "shard int, h long, ids binary").repartitionById(tasks, F.pmod("shard", F.lit(tasks))).sortWithinPartitions("shard", "h", "ids")
            .mapInArrow(local, form).groupBy("part", "salt").applyInArrow(add, form).groupBy("part").applyInArrow(add, form).orderBy("part").collect()
        )
        if sums:
            flat = np.concatenate([np.frombuffer(x.data, np.int64) for x in sums]) / (UNIT * sums[0].n)
            cuts = np.cumsum([0] + [int(np.prod(s)) for s in shapes])
            p = {k: flat[i:j].astype(np.float32).reshape(s) for k, s, i, j in zip(names, shapes, cuts[:-1], cuts[1:])}
    return p, t


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c = np.zeros(IDS, np.int64)
    for whole in batches:
        for lo in range(0, whole.num_rows, 200):  # not by row, as each count goes over all ids
            c += np.bincount(np.concatenate(_ids(whole.slice(lo, 200))), minlength=IDS)
    some = np.flatnonzero(c)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(c[some])], names=["id", "n"])


def tokenised(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """doc_id, ids (unsigned 16 bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(folder)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                ids, n = enc.encode(b.column("text").to_pylist())
                cuts = np.concatenate(([0], np.cumsum(n)))
                data = ids.astype(np.uint16)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([data[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])], pa.binary())], names=["doc_id", "ids"])

    d = take(docs, "doc_id", "text")
    return d.mapInArrow(run, StructType().add("doc_id", d.schema["doc_id"].dataType).add("ids", "binary"))


def score_documents(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, nll (mean -ln probability of a token), perplexity.

    The model is trained on all tokens of all documents and its counts are over all of them, so what is gathered grows
    with the corpus; what is collected has the size of the model. A text is scored whole, in overlapping windows that
    score each token once. Scores don't depend on the order or the partitions of the rows. A null or empty text has no
    tokens, and null nll and perplexity. Null doc_ids and repeated rows stay; extra columns are dropped. No rows give no rows.
    """
    tokens = stored(tokenised(docs, folder))
    shared = tokens.sparkSession.sparkContext.broadcast(fit(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, t = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 200):
                b = whole.slice(lo, 200)
                ids = _ids(b)
                n = np.array([len(x) for x in ids], np.int64)
                nll = score(p, t, ids) / np.maximum(n, 1)
                null = n == 0
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(n), pa.array(np.round(nll, 5), mask=null), pa.array(np.round(np.exp(np.minimum(nll, 50)), 3), mask=null)], names=["doc_id", "n_tokens", "nll", "perplexity"]
                )

    schema = StructType().add("doc_id", tokens.schema["doc_id"].dataType).add("n_tokens", "long").add("nll", "double").add("perplexity", "double")
    return tokens.mapInArrow(run, schema)


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
