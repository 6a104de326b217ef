"""BPE encoding with content-defined chunk reuse, and decoding.

A rolling hash cuts each text into chunks where its content says so, whatever stands before. A chunk that more than one
text has is encoded once, at one place; every other chunk is encoded where it is. A text's
ids are its chunks' ids joined; each join is repaired by encoding again around it until both sides agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import _M, _mix1, bloom_filter, buffers, may_hold, mix, powers, slices, stored, table, take
from .tokens import FOLDER, PATTERN, Encoder

#: Bytes the rolling hash sees; a boundary is where its top BITS bits are 0, so chunks have 2**BITS bytes on average.
SPAN, BITS = 32, 10
_U = np.uint64
_PIECE = regex.compile(PATTERN)


def boundaries(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places, within the slice, where a chunk ends inside a row: behind SPAN bytes of the row whose hash says so, at the next
    start of a character."""
    b = data[offsets[0] : offsets[-1]]
    if len(b) <= SPAN:
        return np.zeros(0, np.int64)
    p, inv = powers(len(b) + 1)
    c = np.zeros(len(b) + 1, _U)
    np.cumsum((b.astype(_U) + _U(1)) * p[: len(b)], out=c[1:])
    h = mix((c[SPAN:] - c[:-SPAN]) * inv[: len(b) - SPAN + 1])
    at = np.flatnonzero(h >> _U(64 - BITS) == 0) + SPAN
    o = offsets - offsets[0]
    row = np.searchsorted(o, at - 1, "right") - 1
    at = at[(at - SPAN >= o[row]) & (at < o[row + 1])]
    while len(at):
        inside = (b[np.minimum(at, len(b) - 1)] & 0xC0) == 0x80
        if not inside.any():
            break
        at = at + inside
    row = np.searchsorted(o, at - 1, "right") - 1
    return np.unique(at[at < o[row + 1]])


def chunked(col: pa.Array) -> Iterator[list[bytes]]:
    """The chunks of each row; none for an empty one."""
    offsets, data = buffers(col)
    raw = data.tobytes() if len(data) else b""
    for i, j in slices(offsets):
        cuts = boundaries(data, offsets[i : j + 1]) + offsets[i]
        lo = np.searchsorted(cuts, offsets[i:j], "right")
        hi = np.searchsorted(cuts, offsets[i + 1 : j + 1], "left")
        for r in range(j - i):
            s, e = int(offsets[i + r]), int(offsets[i + r + 1])
            at = [s, *cuts[lo[r] : hi[r]].tolist(), e]
            yield [raw[x:y] for x, y in zip(at[:-1], at[1:]) if y > x]


def _starts(text: str) -> Iterator[int]:
    return (m.start() for m in _PIECE.finditer(text))


def _sure(text: str) -> int:
    """The last start of a piece that no text to come can change: pieces look up to three characters ahead. text starts a piece."""
    top = len(text) - 3
    at = text.rfind(" ", 0, max(0, top - 8))
    while at > 0 and (text[at - 1].isspace() or text[at + 1].isspace()):
        at = text.rfind(" ", 0, at)
    last = 0
    for m in _PIECE.finditer(text, max(0, at)):  # a single blank starts a piece
        if m.start() > top:
            break
        last = m.start()
    return last


def join(parts: list[tuple[str, list[int]]], enc: Encoder) -> list[int]:
    """Ids of the joined texts from each one's own ids.

    The pattern reads left to right and looks ahead only. So the pieces up to _sure() are those of the whole text, and from a
    place where a piece of the whole and one of the next chunk start, both agree to that chunk's end. Around a join the
    pieces from the last sure start on are encoded anew until such a place comes up. Where a chunk has none, it is
    encoded anew with what stands before, and the next join decides.
    """
    own = enc.bpe.encode_ordinary
    out: list[int] = []
    tail = ""
    for text, ids in parts:
        both, edge = tail + text, len(tail)
        pieces, skipped, at, here = [], [], 0, -1
        starts = _starts(text)
        before, nxt = 0, next(starts, None)
        agreed = False
        while at <= len(both) - 3:
            if at >= edge:
                while nxt is not None and nxt < at - edge:
                    before, nxt = nxt, next(starts, None)
                    skipped.append(text[before : nxt if nxt is not None else len(text)])
                if nxt == at - edge:
                    agreed = True
                    break
            here = _PIECE.match(both, at).end()
            pieces.append(both[at:here])
            at = here
        if edge:
            del out[len(out) - len(own(tail)) :]
        if agreed:
            for p in pieces:
                out += own(p)
            out += ids[sum(len(own(p)) for p in skipped) :]
            rest = text[at - edge :]
        else:
            out += own(both)
            rest = both
        tail = rest[_sure(rest) :]
    return out


def _key(raw: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(raw)
    a, b = h >> 64, h & _M
    return a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b


def _owner(c1: int, c2: int, doc: int) -> int:
    return _mix1((c1 * 3 + c2 * 5 + doc * 7) & _M)


def _small(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


def encode(docs: DataFrame, folder: str = FOLDER, verify: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids; with `verify` also round_trip, whether decoding them gives the text
    back. The ids are those of encoding the whole text.

    Needs doc_id and text; extra columns are dropped. A null or empty text has no ids. Null doc_ids and repeated rows
    stay. Texts of any length are encoded whole. No rows give no rows.

    Passes: chunk hashes of all texts, counted; the text of least hash among those that hold a shared chunk encodes it;
    a text without shared chunks is encoded where it is read; the others go once, compressed, to where the ids of their
    shared chunks are gathered. Filters over hashes (of bounded size) tell texts and chunks apart while they are read.
    """
    d = take(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    sc = d.sparkSession.sparkContext
    kind = d.schema["doc_id"].dataType

    def refs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, parts in zip(b.column("text"), chunked(b.column("text"))):
                if parts:
                    doc = _key(t.as_buffer().to_pybytes())[0]
                    rows += [(*_key(p), doc) for p in dict.fromkeys(parts)]
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["c1", "c2", "doc"])

    places = d.select("text").mapInArrow(refs, "c1 long, c2 long, doc long")
    shared = places.groupBy("c1", "c2").agg(F.min("doc").alias("owner"), F.max("doc").alias("other")).filter("owner <> other").select("c1", "c2", "owner")
    wants = stored(places.join(shared, ["c1", "c2"]).distinct())

    def by_owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_owner(*r) - (1 << 63) for r in zip(*(b.column(c).to_pylist() for c in ("c1", "c2", "doc")))], pa.int64())], names=["key"])

    owned = sc.broadcast(bloom_filter(wants.filter("doc = owner").select("c1", "c2", "doc").mapInArrow(by_owner, "key long")))
    mixed = sc.broadcast(bloom_filter(wants.select("doc")))

    def shared_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, done = Encoder(folder), set()
        for b in batches:
            rows = []
            for t, parts in zip(b.column("text"), chunked(b.column("text"))):
                if not parts:
                    continue
                doc = _key(t.as_buffer().to_pybytes())[0]
                if doc in done or not may_hold(mixed.value, doc):
                    continue
                done.add(doc)
                for p in dict.fromkeys(parts):
                    c = _key(p)
                    if may_hold(owned.value, _owner(*c, doc) - (1 << 63)):
                        rows.append((*c, _small(enc.bpe.encode_ordinary(p.decode()))))
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary()))], names=["c1", "c2", "ids"])

    book = d.select("text").mapInArrow(shared_ids, "c1 long, c2 long, ids binary").groupBy("c1", "c2").agg(F.first("ids").alias("ids"))
    given = wants.select("c1", "c2", "doc").join(book, ["c1", "c2"]).groupBy("doc").agg(F.collect_list(F.struct("c1", "c2", "ids")).alias("given"))

    result = StructType().add("doc_id", kind).add("n_tokens", "long").add("ids", ArrayType(IntegerType()))
    if verify:
        result = result.add("round_trip", "boolean")

    def ids_batch(names: pa.Array, ids: list[list[int]], texts: list[bytes], enc: Encoder) -> pa.RecordBatch:
        n = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate([np.zeros(0, np.int32), *[np.asarray(x, np.int32) for x in ids]])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(flat))
        same = [pa.array([enc.bpe.decode_bytes(x) == t for x, t in zip(ids, texts)], pa.bool_())] if verify else []
        return pa.RecordBatch.from_arrays([names, pa.array(n), lists, *same], names=result.names)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(folder)
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                raw = [t.as_buffer().to_pybytes() for t in b.column("text")]
                here = [i for i, r in enumerate(raw) if not r or not may_hold(mixed.value, _key(r)[0])]
                yield ids_batch(b.column("doc_id").take(pa.array(here, pa.int64())), [enc.bpe.encode_ordinary(raw[i].decode()) for i in here], [raw[i] for i in here], enc)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            raw = [t.as_buffer().to_pybytes() for t in b.column("text")]
            keys = [_key(r)[0] if r else 0 for r in raw]
            go = [i for i, r in enumerate(raw) if r and may_hold(mixed.value, keys[i])]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(go, pa.int64())), pa.array([keys[i] for i in go], pa.int64()), pa.array([press.compress(raw[i]) for i in go], pa.binary())],
                names=["doc_id", "doc", "data"],
            )

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, open_ = Encoder(folder), zstandard.ZstdDecompressor()
        last: tuple[bytes, list[int]] = (b"", [])
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                texts = [open_.decompress(x.as_py()) for x in b.column("data")]
                out = []
                for raw, given_, parts in zip(texts, b.column("given"), chunked(pa.array([t.decode() for t in texts], pa.string()))):
                    if raw != last[0]:
                        book_ = {(g["c1"], g["c2"]): g["ids"] for g in given_.as_py() or ()}
                        last = raw, join(_runs(parts, book_, enc), enc)
                    out.append(last[1])
                yield ids_batch(b.column("doc_id"), out, texts, enc)

    moved = d.mapInArrow(move, StructType().add("doc_id", kind).add("doc", "long").add("data", "binary")).join(given, "doc", "left")
    return d.mapInArrow(alone, result).unionByName(moved.select("doc_id", "data", "given").mapInArrow(put_together, result))


def _runs(parts: list[bytes], book: dict, enc: Encoder) -> list[tuple[str, list[int]]]:
    """The chunks with their ids: those of the book as they are, neighbours that aren't in it as one."""
    out, run = [], []
    for p in [*parts, None]:
        known = book.get(_key(p)) if p is not None and book else None
        if run and (p is None or known is not None):
            text = b"".join(run).decode()
            out.append((text, enc.bpe.encode_ordinary(text)))
            run = []
        if known is not None:
            out.append((p.decode(), np.frombuffer(known, np.int32).tolist()))
        elif p is not None:
            run.append(p)
    return out


def decode(encoded: DataFrame, folder: str = FOLDER) -> DataFrame:
    """doc_id, text of rows of doc_id and ids; the inverse of encode, a row for each row.

    Null ids give a null text, no ids the empty one; so does a list with a null or an id that the vocabulary lacks give null.
    What isn't whole characters (ids cut from the middle of a text) gets replacement characters. Null doc_ids and repeated rows
    stay, lists of any length are decoded whole, extra columns are dropped. No rows give no rows.
    """

    def text(ids: list | None, enc: Encoder) -> str | None:
        if ids is None or not all(x is not None and 0 <= x < enc.size for x in ids):
            return None
        return enc.bpe.decode(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(folder)
        for b in batches:
            texts = [text(x, enc) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    d = take(encoded, "doc_id", "ids")
    return d.mapInArrow(run, StructType().add("doc_id", d.schema["doc_id"].dataType).add("text", "string"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), verify=True)
