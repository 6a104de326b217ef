"""Document fingerprints by one-permutation MinHash with optimal densification and packed low-order bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import gram_sets, gram_text, mix, stored, table, take

#: Words in a shingle, bins, and bits kept for each bin.
SHINGLE, BINS, BITS = 3, 256, 4
#: Leading bytes of the fingerprint that documents of one band share.
BAND = 8
_TRIES = 48
_U = np.uint64


def _edges(bins: int) -> np.ndarray:
    """Bin b has the hashes from b * 2**64 / bins on."""
    return np.array([(i << 64) // bins for i in range(bins)], dtype=_U)


def _donors(bins: int, tries: int, first: int = 0) -> np.ndarray:
    """For each bin the bins it asks in turn: one row for each bin, from a hash of (bin, attempt)."""
    i, j = np.meshgrid(np.arange(bins, dtype=_U), np.arange(first, first + tries, dtype=_U), indexing="ij")
    return (mix(i * _U(0x9E3779B97F4A7C15) + mix(j + _U(1))) % _U(bins)).astype(np.int64)


def densify(values: np.ndarray, filled: np.ndarray, donors: np.ndarray) -> np.ndarray:
    """An empty bin takes the value of the first filled bin among those its own sequence of hashes names."""
    empty = np.flatnonzero(~filled)
    values, first, table_ = values.copy(), 0, donors
    while len(empty):
        asked = table_[empty]
        ok = filled[asked]
        got = ok.any(1)
        pick = asked[np.arange(len(empty)), ok.argmax(1)]
        values[empty[got]] = values[pick[got]]
        empty, first = empty[~got], first + table_.shape[1]
        if len(empty):
            table_ = _donors(len(filled), _TRIES, first)
    return values


def sketch(grams: np.ndarray, edges: np.ndarray, donors: np.ndarray) -> tuple[np.ndarray, int]:
    """Densified minima of sorted distinct gram hashes by bin, and the number of bins that were empty. grams isn't empty."""
    at = np.searchsorted(grams, edges)
    end = np.append(at[1:], len(grams))
    filled = at < end
    values = np.where(filled, grams[np.minimum(at, len(grams) - 1)], _U(0))
    return densify(values, filled, donors), int((~filled).sum())


def pack(values: np.ndarray, bits: int) -> bytes:
    """The low-order bits of the mixed values, most significant bit first."""
    low = (mix(values) & _U((1 << bits) - 1)).astype(np.uint8)
    return np.packbits(((low[:, None] >> np.arange(bits - 1, -1, -1)) & 1).astype(np.uint8)).tobytes()


def unpack(print_: bytes, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    x = np.unpackbits(np.frombuffer(print_, np.uint8))[: bins * bits].reshape(bins, bits)
    return x @ (1 << np.arange(bits - 1, -1, -1))


def jaccard(a: bytes, b: bytes, bins: int = BINS, bits: int = BITS) -> float:
    """The estimated Jaccard similarity: the share of equal bins less what equal low-order bits give by chance."""
    chance = 2.0**-bits
    same = float((unpack(a, bins, bits) == unpack(b, bins, bits)).mean())
    return max(0.0, (same - chance) / (1 - chance))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (binary of bins * bits / 8 bytes), n_shingles, n_empty.

    Needs doc_id and text; extra columns are dropped. A text without a word (null, empty, only punctuation) has a null
    fingerprint, 0 shingles and all bins empty; a text of fewer words than a shingle has one shingle of all of them.
    Equal texts have equal fingerprints. Null doc_ids and repeated rows stay. No rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, donors = _edges(bins), _donors(bins, _TRIES)
        for b in batches:
            prints, n, empty = [], [], []
            for g in gram_sets(b.column("text"), shingle):
                if len(g):
                    v, e = sketch(g, edges, donors)
                    prints.append(pack(v, bits))
                else:
                    e = bins
                    prints.append(None)
                n.append(len(g))
                empty.append(e)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(prints, pa.binary()), pa.array(n, pa.int64()), pa.array(empty, pa.int64())],
                names=["doc_id", "fingerprint", "n_shingles", "n_empty"],
            )

    d = take(docs, "doc_id", "text").select("doc_id", gram_text().alias("text"))
    schema = StructType().add("doc_id", d.schema["doc_id"].dataType).add("fingerprint", "binary").add("n_shingles", "long").add("n_empty", "long")
    return d.mapInArrow(run, schema)


def with_estimates(pairs: DataFrame, a: str = "a", b: str = "b", bins: int = BINS, bits: int = BITS) -> DataFrame:
    """pairs, all columns, and last estimate: the bias-corrected Jaccard similarity of the fingerprints in columns a and b.

    Null where one of them is null. Rows stay as they are, repeated ones too; no rows give no rows. A column of pairs that is
    called estimate stays where it is, and the new one is the last."""
    names = [f"_c{i}" for i in range(len(pairs.columns))]
    x, y = (names[pairs.columns.index(c)] for c in (a, b))
    chance = 2.0**-bits

    @F.pandas_udf("double")
    def same(p: pd.Series, q: pd.Series) -> pd.Series:
        ok = (p.notna() & q.notna()).to_numpy()
        out = np.full(len(p), np.nan)
        if ok.any():
            u, v = (np.unpackbits(np.frombuffer(b"".join(c[ok]), np.uint8).reshape(int(ok.sum()), -1), axis=1)[:, : bins * bits].reshape(-1, bins, bits) for c in (p, q))
            out[ok] = np.maximum(0.0, ((u == v).all(2).mean(1) - chance) / (1 - chance)).round(6)
        return pd.Series(out).where(ok, None)

    return pairs.toDF(*names).select("*", same(F.col(x), F.col(y))).toDF(*pairs.columns, "estimate")


def near_estimates(prints: DataFrame, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """fingerprints() and for each row near_id, the least other doc_id whose fingerprint begins with the same BAND bytes, and
    estimate, the Jaccard similarity to it by both fingerprints. Null where there is none: for the least doc_id of a band itself,
    null doc_ids (which are near_id of no one) and null fingerprints. A band, however many share it, sends on one row."""
    band = F.substring("fingerprint", 1, BAND)
    heads = prints.filter("fingerprint is not null and doc_id is not null").groupBy(band.alias("band")).agg(F.min(F.struct("doc_id", "fingerprint")).alias("head"))
    d = prints.withColumn("band", band).join(heads, "band", "left").withColumn("head", F.when(~F.col("doc_id").eqNullSafe(F.col("head.doc_id")), F.col("head")))
    d = d.select("doc_id", "fingerprint", "n_shingles", "n_empty", F.col("head.doc_id").alias("near_id"), F.col("head.fingerprint").alias("_other"))
    return with_estimates(d, "fingerprint", "_other", bins, bits).drop("_other")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_estimates(stored(fingerprints(table(spark, sf_dir, "documents"))))
