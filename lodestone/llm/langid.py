"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import buffers, give_back, keep_where, mix, slices, table, take

#: Hash buckets, embedding width, byte n-grams, passes and step of the training.
BUCKETS, WIDTH, GRAMS, EPOCHS, RATE = 1 << 18, 8, (3, 4), 3, 2.0
#: The bound on labelled rows that the classifier is fitted on; a fifth of them is held out for the calibration.
TRAIN_ROWS = 6000
#: Share of held-out rows whose confidence may lie below the rejection threshold.
REJECTED = 0.001
_U = np.uint64


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # bucket x language: the embedding times the output layer, over the temperature; then 1 for a bucket that was trained
    threshold: float
    accuracy: float  # on the held-out rows


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size the bucket of each position of the slice, and (start, end) of each row in it."""
    b = data[offsets[0] : offsets[-1]].astype(_U)
    o = offsets - offsets[0]
    for n in GRAMS:
        m = len(b) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, _U)
        for k in range(n):
            h = h * _U(257) + b[k : k + m]
        h = ((h * _U(0x9E3779B97F4A7C15)) >> _U(46)).astype(np.int64) & (BUCKETS - 1)
        yield h, np.stack([o[:-1], np.maximum(o[1:] - n + 1, o[:-1])])


def probabilities(z: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Softmax over languages for the share of a text's n-grams that training saw, and no preference for the rest."""
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return known[:, None] * p + (1 - known[:, None]) / p.shape[1]


def train(texts: list[str], langs: list[str], seed: int = 0) -> Model:
    """Every fifth row is held out; the rest is gone through EPOCHS times in a fixed random order."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    rows = []
    for t in texts:
        d = np.frombuffer(t.lower().encode(), np.uint8)
        hs = [h for h, _ in features(d, np.array([0, len(d)]))]
        idx, count = np.unique(np.concatenate(hs), return_counts=True) if hs else (np.zeros(0), np.zeros(0))
        rows.append((idx.astype(np.int32), count.astype(np.int32)))
    rng = np.random.default_rng(seed)
    emb = np.zeros((BUCKETS, WIDTH), np.float32)
    out = rng.normal(0, 0.5, (WIDTH, len(names))).astype(np.float32)
    held = np.arange(len(rows)) % 5 == 4
    fit = [i for i in np.flatnonzero(~held) if len(rows[i][0])]
    total, step = max(1, EPOCHS * len(fit)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            idx, count = rows[i]
            share = (count / count.sum()).astype(np.float32)
            v = share @ emb[idx]
            z = v @ out
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            rate = RATE * (1 - step / total)
            down = out @ p
            out -= 0.1 * rate * np.outer(v, p)
            emb[idx] -= rate * np.sqrt(len(idx)) * share[:, None] * down
            step += 1
    logits = emb @ out
    test = [i for i in np.flatnonzero(held) if len(rows[i][0])] or fit
    z = np.array([(rows[i][1] / rows[i][1].sum()) @ logits[rows[i][0]] for i in test]).reshape(len(test), len(names))
    best, temperature = np.inf, 1.0
    for t in np.geomspace(0.02, 20, 60):  # temperature scaling: least held-out log loss
        q = z / t
        loss = float((np.log(np.exp(q - q.max(1, keepdims=True)).sum(1)) + q.max(1) - q[np.arange(len(test)), y[test]]).mean()) if len(test) else 0.0
        if loss < best:
            best, temperature = loss, float(t)
    known = (logits != 0).any(1)
    share = np.array([rows[i][1][known[rows[i][0]]].sum() / rows[i][1].sum() for i in test])
    q = probabilities(z / temperature, share) if len(test) else z
    # never below what a text of unknown n-grams gets, never so high that plain text goes
    low = 1 / max(1, len(names)) + 0.05
    threshold = float(np.clip(np.quantile(q.max(1), REJECTED), low, 0.6)) if len(test) else 1.0
    return Model(names, np.concatenate([logits / temperature, known[:, None]], 1).astype(np.float32), threshold, float((z.argmax(1) == y[test]).mean()) if len(test) else 0.0)


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """A model from at most `rows` different texts, as many of each lang as there are and as its equal share allows: those of least
    hash of text and lang. So doc_ids, null or not, have no say, a text that repeats is one, and no language is lost (of more
    languages than `rows` each has one text). Rows without a text or a lang are left out; None where no row is left."""
    d = take(docs, "lang", "text").filter("lang is not null and text is not null")
    d = d.select(F.col("lang").cast("string").alias("lang"), "text").withColumn("h", F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 30)))
    sizes = d.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()
    if not sizes:
        return None
    quota = max(1, rows // len(sizes))
    # twice what is needed, so that texts which can't be chosen aren't sorted
    limits = docs.sparkSession.createDataFrame([(r.lang, int((1 << 30) * min(1.0, (2 * quota + 20) / max(1, r.n)))) for r in sizes], "lang string, most long")
    got = d.join(F.broadcast(limits), "lang").filter("h < most").groupBy("lang", "h").agg(F.min("text").alias("text"))
    got = got.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("k") <= quota)
    chosen = got.orderBy("h", "lang").select("text", "lang").toPandas()
    return train(list(chosen["text"]), list(chosen["lang"]))


def identify(col: pa.Array, model: Model | None) -> tuple[np.ndarray, np.ndarray]:
    """Index of the likeliest language of each row (-1: a text too short to tell) and its calibrated probability."""
    n = len(col)
    if model is None:
        return np.full(n, -1), np.zeros(n)
    offsets, data = buffers(col)
    c = len(model.langs)
    best, conf = np.full(n, -1), np.zeros(n)
    for i, j in slices(offsets):
        total, seen = np.zeros((j - i, c + 1)), np.zeros(j - i)
        for h, (s, e) in features(data, offsets[i : j + 1]):
            some = np.flatnonzero(e > s)
            if not len(some):
                continue
            cuts = np.stack([s[some], e[some]], 1).ravel()
            t = np.zeros((len(h) + 1, c + 1), np.float32)
            np.take(model.logits, h, axis=0, out=t[:-1])
            total[some] += np.add.reduceat(t, cuts, axis=0, dtype=np.float64)[::2]
            seen[some] += (e - s)[some]
        mean = total / np.maximum(seen, 1)[:, None]
        p = probabilities(mean[:, :c], mean[:, c])
        best[i:j] = np.where(seen > 0, p.argmax(1), -1)
        conf[i:j] = np.where(seen > 0, p.max(1), 0.0)
    return best, conf


def _lower(text):
    return F.lower(F.coalesce(text, F.lit("")))


def identify_languages(docs: DataFrame, model: Model | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, lang_id (null where rejected), best (the likeliest), confidence, accepted.

    Needs doc_id and text, and lang to fit a model on unless one is given (see fit). A null or empty text, or one of
    fewer than three bytes, is rejected with confidence 0; so is everything where no row is labelled. Null doc_ids
    and repeated rows stay; extra columns are dropped. No rows give no rows.
    """
    model = model or fit(docs, train_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*(m.langs if m else []), None], dtype=object)
        for b in batches:
            best, conf = identify(b.column("text"), m)
            ok = (best >= 0) & (conf >= (m.threshold if m else 1.0))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(names[np.where(ok, best, -1)], pa.string()), pa.array(names[best], pa.string()), pa.array(np.round(conf, 6)), pa.array(ok)],
                names=["doc_id", "lang_id", "best", "confidence", "accepted"],
            )

    d = take(docs, "doc_id", "text").select("doc_id", _lower(F.col("text")).alias("text"))
    schema = StructType().add("doc_id", d.schema["doc_id"].dataType).add("lang_id", "string").add("best", "string").add("confidence", "double").add("accepted", "boolean")
    return d.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs, all columns, without the rows whose language is rejected.

    Needs text, and lang to fit a model on unless one is given. Null and empty texts go, as identify_languages rejects them, and
    where no row is labelled all do. Null doc_ids and repeated rows are judged like others, texts of any length are read whole, a
    confidence at exactly the threshold is enough. Extra columns, whatever their names, stay as they are. No rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    @F.arrow_udf("boolean")
    def known(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        give_back()
        for b in batches:
            best, conf = identify(b, m)
            yield pa.array((best >= 0) & (conf >= (m.threshold if m else 1.0)))
        give_back()

    return keep_where(docs, lambda text: known(_lower(text)), "text")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))
