"""What the operators share: picking columns, reading tables, walking texts in Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import functools
import math
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised passes hold at a time; a longer text is a slice of its own.
SLICE = 1 << 19
_U = np.uint64


def position(df: DataFrame, name: str) -> int:
    """Where the column is: by exact name first, then whatever the case."""
    at = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not at:
        raise ValueError(f"no column {name}; there are {df.columns}")
    return at[0]


def numbered(df: DataFrame) -> DataFrame:
    """The columns as _c0, _c1, ..., so that no two names clash."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def take(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns; extra columns, case variants and repeated names do no harm."""
    return numbered(df).select(*[F.col(f"_c{position(df, n)}").alias(n) for n in names])


def keep_where(df: DataFrame, test, *names: str) -> DataFrame:
    """The rows, with all their columns, for which test(*columns) holds."""
    return numbered(df).filter(test(*[F.col(f"_c{position(df, n)}") for n in names])).toDF(*df.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, one in the temporary folder if all of Spark is
    this machine (tests), else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "lodestone-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


_written: dict[str, SparkSession] = {}


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df written to the shared folder and read again: lineage is cut and the work is done once. Deleted by discard(), or by sweep() when Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    _written[path] = spark
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _delete(path: str) -> None:
    spark = _written.pop(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more."""
    _delete(df.stored_at)


@atexit.register
def sweep() -> None:
    """Deletes all tables that stored() wrote and discard() left. What was made from them can't be read after this."""
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the session is gone
            _written.pop(path, None)


def give_back() -> None:
    """Returns memory that this process has freed to the system. Spark uses a Python worker again for later tasks, also those of other
    stages, and the allocator would keep what an earlier one took at most."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(run: Callable) -> Callable:
    """A function over batches that gives back memory before its first and after its last batch."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        give_back()
        yield from run(batches)
        give_back()

    return wrapped


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse mod 2**64."""
    if len(_powers.get("p", ())) < n:
        for k, b in (("p", _P), ("i", _PINV)):
            x = np.full(n, b, _U)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers["p"][:n], _powers["i"][:n]


_WORD = np.zeros(256, bool)
for _b in (*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)):
    _WORD[_b] = True


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    big = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if len(col) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    o = np.frombuffer(offsets, np.int64 if big else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return o, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most SLICE bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (a run of ASCII letters and digits and all non-ASCII bytes), and its row. Each row must end in a separator."""
    b = data[offsets[0] : offsets[-1]]
    if not len(b):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    w = _WORD[b]
    edge = np.flatnonzero(w[1:] != w[:-1]) + 1
    if w[0]:
        edge = np.concatenate(([0], edge))
    if len(edge) % 2:
        edge = np.append(edge, len(b))
    s, e = edge[::2], edge[1::2]
    p, inv = powers(len(b) + 1)
    c = np.zeros(len(b) + 1, _U)
    np.cumsum((b.astype(_U) + _U(1)) * p[: len(b)], out=c[1:])
    h = mix((c[e] - c[s]) * inv[s] + (e - s).astype(_U))
    return h, np.searchsorted(offsets[1:] - offsets[0], s, "right")


def gram_sets(col: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its word n-grams. A row of fewer words, but one at least, has one gram of all its words; a null or wordless row none. Rows are lower-cased and end in a line feed."""
    offsets, data = buffers(col)
    a = _U(0xD6E8FEB86659FD93)
    for i, j in slices(offsets):
        h, row = word_hashes(data, offsets[i : j + 1])
        count = np.bincount(row, minlength=j - i)
        at = np.concatenate(([0], np.cumsum(count)))
        g = h.copy()
        for k in range(1, n):
            g = mix(g[: len(g) - 1] * a + h[k:]) if len(g) > 1 else g[:0]
        for r in range(j - i):
            x, m = at[r], count[r]
            if m >= n:
                yield np.unique(g[x : x + m - n + 1])
            elif m:
                one = h[x : x + 1]
                for k in range(1, m):
                    one = mix(one * a + h[x + k])
                yield one
            else:
                yield h[:0]


def gram_text(text: str = "text"):
    """The column gram_sets reads."""
    return F.concat(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("\n"))


#: Bits of the largest filter (32 MB). If that is too small, more than needed passes it, and the join behind it drops that.
FILTER = 1 << 28
_M = (1 << 64) - 1


def _mix1(h: int) -> int:
    """mix() of one number."""
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & _M
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & _M
    return h ^ h >> 31


def bloom_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter, 16 bits a key, over the one long column of keys."""
    keys = keys.toDF("key").distinct()
    bits = min(FILTER, 1 << max(16, math.ceil(math.log2(16 * max(1, keys.count())))))
    width = min(bits, 1 << 20)

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = mix(b.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(_U))
            at = np.unique(np.concatenate([h & _U(bits - 1), (h >> _U(32)) & _U(bits - 1)])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // width), pa.array(at % width)], names=["part", "at"])

    def fill(t: pa.Table) -> pa.Table:
        x = np.zeros(width, bool)
        x[t.column("at").to_numpy()] = True
        return pa.table({"part": t.column("part")[:1], "data": pa.array([np.packbits(x).tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    for r in keys.mapInArrow(spots, "part long, at long").groupBy("part").applyInArrow(fill, "part long, data binary").collect():
        out[r.part * width // 8 : (r.part + 1) * width // 8] = np.frombuffer(r.data, np.uint8)
    return out


def may_hold(bits: np.ndarray, key: int) -> bool:
    h, top = _mix1(key & _M), 8 * len(bits) - 1
    a, b = h & top, h >> 32 & top
    return bool(bits[a >> 3] >> (7 - (a & 7)) & 1 and bits[b >> 3] >> (7 - (b & 7)) & 1)


def least_labels(names: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each place the least name of those that links i, j of places join to it."""
    label = names.copy()
    while True:
        low = np.minimum(label[i], label[j])
        if (low == label[i]).all() and (low == label[j]).all():
            return label
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)


def components(pairs: DataFrame) -> DataFrame:
    """node, root: the least node of the connected component of each node that is in a pair (x, y). Alternating large and small
    stars, written to the shared folder in each round, until nothing changes."""
    edges = stored(pairs.filter("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        before, edges = edges, stored(small.distinct())
        discard(before)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).distinct()
        state = now
