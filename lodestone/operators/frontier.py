"""The crawl frontier over tables: duplicates, blocked hosts, quotas, order, sampling, cool-down and rate limits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions.url_rank import with_crawl_rank
from ..functions.urls import canonical_urls, host_suffixes
from ..sources.store import stored

QUOTA = 25
#: Requests in a window of so many milliseconds, by address.
REQUESTS, WINDOW_MS = 60, 60_000
GOOD, GOOD_SHARE, OVERSAMPLE = 90, 0.9, 1.5


def not_blocked(urls: DataFrame, blocked: DataFrame, host: str = "host") -> DataFrame:
    """Without the rows whose host is, or lies under, a host of blocked (column host)."""
    s = urls.select(F.col(host).alias("_h")).distinct().select("_h", F.explode(host_suffixes(F.col("_h"))).alias("s"))
    bad = s.join(blocked.select(F.col("host").alias("s")), "s", "left_semi").select("_h").distinct()
    return urls.join(bad, urls[host] == bad["_h"], "left_anti")


def fresh(urls: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Valid new URLs by canonical form: url, host, path; once each, without what was seen."""
    p = canonical_urls(urls).dropDuplicates(["url"])
    return p if seen is None else p.join(seen.select("url"), "url", "left_anti")


def score(urls: DataFrame, scorer: Callable[[Column], Column] | None = None, keep: Column | None = None) -> DataFrame:
    """Adds score, by the crawl rank or a scorer of the caller's; rows below 0 are seen but never queued. keep: a condition of
    the caller's."""
    out = (with_crawl_rank(urls) if scorer is None else urls.withColumn("score", scorer(F.col("url")))).filter("score >= 0")
    return out if keep is None else out.filter(keep)


def host_quota(urls: DataFrame, most: int = QUOTA) -> DataFrame:
    """The best `most` of each host; Spark cuts each partition's groups before the shuffle."""
    w = Window.partitionBy("host").orderBy(F.desc("score"), "url")
    return urls.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def placed(rows: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """rows with the place of each, from 1 on, among those of its key: `name`. Ranges of key and order count on their own, and a key
    that goes on from one range to the next is told how many came before, so that a common key is many tasks' work."""
    fields = [f for f in rows.schema if f.name not in ("_p", "_n")]
    cols = [f.name for f in fields]
    ranged = stored(rows.select(*cols).repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order).withColumn("_p", F.spark_partition_id()).mapInArrow(_count_runs(key), StructType([*fields, StructField("_p", IntegerType()), StructField("_n", LongType())])))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = ranged.groupBy(key, "_p").agg(F.max("_n").alias("_k")).withColumn("_b", before).filter("_b > 0").select(F.col(key).alias("_key"), F.col("_p").alias("_q"), "_b")
    out = ranged.join(F.broadcast(parts), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_p") == F.col("_q")), "left")  # a row for each range at most
    return out.select(*cols, (F.col("_n") + F.coalesce("_b", F.lit(0))).alias(name))


def _count_runs(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(key).dictionary_encode()
            code = np.asarray(keys.indices.fill_null(-1))
            first = np.flatnonzero(np.diff(code, prepend=-2))
            n = np.arange(1, len(code) + 1) - np.repeat(first, np.diff(first, append=len(code)))
            value = b.column(key)
            if value[0].as_py() == last:
                n[: first[1] if len(first) > 1 else len(n)] += count
            last, count = value[len(code) - 1].as_py(), int(n[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n)], names=[*b.schema.names, "_n"])

    return run


def round_robin(urls: DataFrame, passes: int | None = None) -> DataFrame:
    """turn and url: one URL of each host in each pass, hosts in order."""
    out = placed(urls, "host", [F.desc("score"), F.asc("url")], "turn")
    return (out.filter(F.col("turn") <= passes) if passes else out).orderBy("turn", "host")


def _lot(url: Column, seed: int) -> Column:
    """A place in a random order that only the URL and the seed decide, so that a task that is done again draws alike."""
    return F.md5(F.concat(url, F.lit(f"#{seed}")))


def random_pop(urls: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k URLs to crawl next (all if there are fewer): 90 % of those of a high score, each part the best of a random sample of 1.5
    times as many. What one part lacks the other fills up, in its order."""
    good = round(k * GOOD_SHARE)
    lot = _lot(F.col("url"), seed)

    def part(rows: DataFrame, n: int, name: int) -> DataFrame:
        drawn = rows.withColumn("_lot", lot).orderBy("_lot", "url").limit(max(int(OVERSAMPLE * n), k))
        in_sample = F.row_number().over(Window.orderBy("_lot", "url")) <= int(OVERSAMPLE * n)  # of at most 1.5 k rows
        drawn = drawn.withColumn("_in", in_sample.cast("int"))
        place = F.row_number().over(Window.orderBy(F.desc("_in"), F.when(F.col("_in") == 1, -F.col("score")), F.when(F.col("_in") == 0, F.col("_lot")), "url"))
        # a part's own come before what it lends to the other
        return drawn.withColumn("_n", place).withColumn("_lent", (F.col("_n") > n).cast("int")).withColumn("_part", F.lit(name))

    both = part(urls.filter(F.col("score") >= GOOD), good, 0).unionByName(part(urls.filter(F.col("score") < GOOD), k - good, 1))
    return both.orderBy("_lent", "_n", "_part").limit(k).drop("_lot", "_in", "_n", "_lent", "_part")


def admit(urls: DataFrame, basis_points: int, seed: int = 0) -> DataFrame:
    """About basis_points in 10,000 of the URLs; which ones, the URL and the seed decide."""
    return urls.filter(F.pmod(F.conv(F.substring(_lot(F.col("url"), seed), 1, 8), 16, 10).cast("long"), F.lit(10_000)) < basis_points)


def limit_times(ts: list[int], count: int, window: int, start: int | None = None, used: int = 0) -> tuple[list[int], int | None, int]:
    """For requests in order of time: 0 if let through, else the wait; then the state. A window begins with the first request
    after the one before it ended."""
    out = []
    for t in ts:
        if start is None or t - start >= window:
            start, used = t, 0
        if used >= count:
            out.append(window - (t - start))
        else:
            used += 1
            out.append(0)
    return out, start, used


def cool_times(ts: list[int], delay: int, last: int | None = None) -> tuple[list[int], int | None]:
    """For requests in order of time: 0 if let through, else how long until the delay since the last one let through is over; and
    the last one let through."""
    out = []
    for t in ts:
        wait = 0 if last is None else max(0, last + delay - t)
        last = last if wait else t
        out.append(wait)
    return out, last


def _in_order(requests: DataFrame, key: str, fresh_state: tuple, step) -> DataFrame:
    """event_id, key, wait_ms by step(times, *state) -> waits, *state, for the requests (key, ts_ms, event_id) of each key in order
    of time: sorted by Spark and streamed, not held by key. Of null keys or times nothing is said: null waits."""
    d = requests.select(F.col(key).cast("string").alias("key"), F.col("ts_ms").cast("long").alias("ts_ms"), F.col("event_id").cast("long").alias("event_id"))
    null = d.filter("key is null or ts_ms is null").select("event_id", "key", F.lit(None).cast("long").alias("wait_ms"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, fresh_state
        for b in batches:
            keys, ts = b["key"].to_numpy(), b["ts_ms"].to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(b)] if len(b) else [0]
            waits: list[int] = []
            for i, j in zip(cuts[:-1], cuts[1:]):
                if keys[i] != now:
                    now, state = keys[i], fresh_state
                got, *state = step(ts[i:j].tolist(), *state)
                waits += got
            yield pd.DataFrame({"event_id": b["event_id"], "key": b["key"], "wait_ms": pd.Series(waits, index=b.index, dtype="int64")})

    known = d.filter("key is not null and ts_ms is not null")
    return known.repartition("key").sortWithinPartitions("key", "ts_ms", "event_id").mapInPandas(walk, "event_id long, key string, wait_ms long").unionByName(null)


def cooldown(requests: DataFrame, key: str, delay_ms: int) -> DataFrame:
    """event_id, key, wait_ms: 0 where the key's last request that was let through is at least the delay ago."""
    return _in_order(requests, key, (None,), lambda ts, last: cool_times(ts, delay_ms, last))


def rate_limit(requests: DataFrame, key: str, count: int = REQUESTS, window_ms: int = WINDOW_MS) -> DataFrame:
    """event_id, key, wait_ms: 0 for the first `count` requests of each window. A window begins with the first request after the one
    before it ended."""
    return _in_order(requests, key, (None, 0), lambda ts, start, used: limit_times(ts, count, window_ms, start, used))


def dispatch(fetched: DataFrame) -> dict[str, DataFrame]:
    """fetched (status, location, html, ...) by what is done with it: parse pages, push redirects, drop the rest."""
    parse_ = (F.col("status") == 200) & F.col("html").isNotNull()
    push = F.col("status").between(300, 399) & F.col("location").isNotNull()
    return {"parse": fetched.filter(parse_), "push": fetched.filter(push).select(F.col("location").alias("url")), "drop": fetched.filter(~F.coalesce(parse_, F.lit(False)) & ~F.coalesce(push, F.lit(False)))}


def domain_groups(results: DataFrame) -> DataFrame:
    """results (query, rank, url) with grp: 1 for the first result and those right after it of its host (five at most), else the
    rank's own. One query's results are few, so the window is."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#:]*)", 1)
    w = Window.partitionBy("query").orderBy("rank")
    d = results.withColumn("_same", (host == F.first(host).over(w)).cast("int"))
    run = F.min("_same").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("grp", F.when((run == 1) & (F.row_number().over(w) <= 5), 1).otherwise(F.col("rank"))).drop("_same")


def distinct_results(results: DataFrame) -> DataFrame:
    """The first result of each URL, www. and a final slash aside."""
    from ..functions.urls import result_url

    d = results.withColumn("_u", result_url(F.col("url")))
    return d.withColumn("_n", F.row_number().over(Window.partitionBy("query", "_u").orderBy("rank"))).filter("_n = 1").drop("_u", "_n")
