"""Concatenate and cut: documents end to end, cut into windows of a fixed number of tokens, with a record of each boundary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import stored, table, take
from .tokens import END, FOLDER, Encoder

#: Tokens in a window; rows encoded at once.
WINDOW, ROWS = 2048, 1000
_SEGMENT = "array<struct<doc_id:long,doc_start:long,start:int,n:int>>"


def _tokenised(docs: DataFrame, folder: str) -> DataFrame:
    """pid, at (tokens before this document in its partition), doc_id, n, ids (unsigned 16 bit), in order of doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pid, at = Encoder(folder), TaskContext.get().partitionId(), 0
        if enc.size > END:
            raise ValueError("ids of more than 16 bits")
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                b = whole.slice(lo, ROWS)
                ids, n = enc.encode(b.column("text").to_pylist())
                some = np.flatnonzero(n)
                cuts = np.concatenate(([0], np.cumsum(n)))
                end = np.array([END], np.uint16).tobytes()
                data = [ids[cuts[i] : cuts[i + 1]].astype(np.uint16).tobytes() + end for i in some]
                size = n[some] + 1
                start = at + np.cumsum(size) - size
                at += int(size.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), pid, np.int32)), pa.array(start), b.column("doc_id").take(pa.array(some)), pa.array(size), pa.array(data, pa.binary())],
                    names=["pid", "at", "doc_id", "n", "ids"],
                )

    d = take(docs, "doc_id", "text")
    if not isinstance(d.schema["doc_id"].dataType, IntegralType):
        raise ValueError("doc_id must be an integer")
    d = d.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # texts, by how they begin, part the rows of one doc_id (or of none) in the order that they are sorted in
    by = F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 32).asc_nulls_first()
    return d.repartitionByRange(parts, *by).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(run, "pid int, at long, doc_id long, n long, ids binary")


class _Cutter:
    """Cuts runs of tokens whose place in the whole is known. A run's ends that don't fill a window are its parts."""

    def __init__(self, window: int, whole: bool):
        self.window, self.whole = window, whole
        self.begin = self.next = 0
        self.ids, self.starts, self.docs = [], [], []

    def add(self, begin: int, ids: np.ndarray, starts: np.ndarray, docs: list) -> Iterator[pa.RecordBatch]:
        """Tokens from `begin` on, in which documents start at `starts`."""
        if begin != self.next:
            yield from self.flush()
            self.begin = begin
        self.next = begin + len(ids)
        self.ids.append(ids), self.starts.append(starts), self.docs.extend(docs)
        if self.next // self.window > self.begin // self.window:
            yield from self._cut(self.next // self.window * self.window)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.next > self.begin:
            yield from self._cut(self.next)

    def _cut(self, to: int) -> Iterator[pa.RecordBatch]:
        w, begin = self.window, self.begin
        ids, starts, docs = np.concatenate(self.ids), np.concatenate(self.starts), self.docs
        edges = np.arange(-(-begin // w) * w, to, w)
        points = np.unique(np.concatenate([starts[(starts > begin) & (starts < to)], edges, [begin]]))
        doc = np.searchsorted(starts, points, "right") - 1
        size = np.diff(points, append=to)
        # the windows and where their segments begin
        win = points // w
        head = np.flatnonzero(np.diff(win, prepend=-1))
        first, last = points[head], np.append(points[head[1:]], to)
        full = (last - first == w) if self.whole else (last - first != w)
        if full.any():
            offs = np.append(head, len(points))
            segments = pa.ListArray.from_arrays(
                pa.array(offs, pa.int32()),
                pa.StructArray.from_arrays(
                    [pa.array(docs, pa.int64()).take(pa.array(doc)), pa.array(points - starts[doc]), pa.array((points % w).astype(np.int32)), pa.array(size.astype(np.int32))],
                    names=["doc_id", "doc_start", "start", "n"],
                ),
            )
            tokens = pa.ListArray.from_arrays(pa.array(np.append(first, to) - begin, pa.int32()), pa.array(ids[: to - begin].astype(np.int32)))
            pick = pa.array(np.flatnonzero(full))
            yield pa.RecordBatch.from_arrays([pa.array(win[head]).take(pick), pa.array(first % w, pa.int64()).take(pick), tokens.take(pick), segments.take(pick)], names=["window_id", "start", "ids", "segments"])
        left = int(np.searchsorted(starts, to, "right")) - 1 if to < self.next else len(starts)
        self.ids = [ids[to - begin :]] if to < self.next else []
        self.starts, self.docs, self.begin = ([starts[left:]], docs[left:], to) if to < self.next else ([], [], to)


def pack(docs: DataFrame, window: int = WINDOW, folder: str = FOLDER) -> DataFrame:
    """Windows of the concatenation of all documents: window_id (0, 1, ...), n_tokens, ids, segments.

    Needs doc_id (of an integer type, else a ValueError) and text. Documents come in order of doc_id (nulls first) and text, each as its BPE ids and END. Every window has `window`
    tokens but the last, which may have fewer. segments are the boundary records: for each document in the window its
    doc_id, where the piece starts in the document (in tokens) and in the window, and its number of tokens.

    The first pass encodes, sorted by range, and writes ids and the offset within the partition; the partitions' token
    totals, summed, give each its place in the whole; the second pass cuts. Only windows over the border of what two
    tasks read are put together by a shuffle. Null and empty texts have no tokens and no place; a text of any length is
    cut as often as needed; repeated rows come repeatedly; extra columns are dropped. No tokens give no rows.
    """
    ids = stored(_tokenised(docs, folder))
    totals = ids.groupBy("pid").agg(F.sum("n").alias("n")).orderBy("pid").collect()
    places, base = {}, 0
    for r in totals:
        places[r.pid], base = base, base + r.n
    shared = docs.sparkSession.sparkContext.broadcast(places)

    def cut(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = _Cutter(window, whole)
            for big in batches:
                for lo in range(0, big.num_rows, ROWS):
                    b = big.slice(lo, ROWS)
                    pid, n = b.column("pid").to_numpy(), b.column("n").to_numpy()
                    start = b.column("at").to_numpy() + np.array([shared.value[p] for p in pid.tolist()], np.int64)
                    data = [np.frombuffer(x.as_py(), np.uint16) for x in b.column("ids")]
                    names = b.column("doc_id").to_pylist()
                    cuts = [0, *(np.flatnonzero(start[1:] != start[:-1] + n[:-1]) + 1).tolist(), len(n)]
                    for i, j in zip(cuts[:-1], cuts[1:]):
                        yield from c.add(int(start[i]), np.concatenate(data[i:j]), start[i:j], names[i:j])
            yield from c.flush()

        return ids.mapInArrow(run, f"window_id long, start long, ids array<int>, segments {_SEGMENT}")

    parts = (
        cut(False)
        .groupBy("window_id")
        .agg(F.array_sort(F.collect_list(F.struct("start", "ids", "segments"))).alias("p"))
        .select("window_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.flatten(F.transform("p", lambda x: x["segments"])).alias("segments"))
    )
    return cut(True).select("window_id", "ids", "segments").unionByName(parts).select("window_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "segments")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
