"""The crawl loop as streams: new URLs without duplicates, rules that come late, rate limits and cool-down with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.urls import canonical_urls
from ..operators import frontier
from ..operators.frontier import REQUESTS, WINDOW_MS, cool_times, limit_times
from ..operators.robots import allowed
from ..sources.store import exists

LIMITED = "event_id long, key string, wait_ms long"


def fresh_urls(urls: DataFrame) -> DataFrame:
    """A stream of url to each canonical URL once. The set of those seen is the stream's state, kept in its checkpoint."""
    return canonical_urls(urls).dropDuplicates(["url"])


def with_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """A stream of host, url, path against a table of rules, read anew in each batch: URLs that the rules allow."""
    return allowed(urls, rules).filter("allowed").drop("allowed")


_WAITING = "host string, url string, path string, bucket int, batch long"
#: Folders by hash of the host in which URLs wait.
BUCKETS = 32


def _bucket(host: Column) -> Column:
    return F.pmod(F.xxhash64(host), F.lit(BUCKETS)).cast("int")


def push(urls: DataFrame, at: str, rules_of, checkpoint: str, blocked: DataFrame | None = None, scorer=None, keep: Column | None = None):
    """The frontier, from its second step on: a stream of host, url, path. Blocked hosts go; URLs of hosts whose rules are known are
    scored and go to {at}/queue if the rules allow them (and their score isn't below 0); others wait in {at}/waiting until they are.

    rules_of() gives the known hosts and their rules (host, type, regex, length). Waiting URLs are only ever added to: a batch takes
    out of those of earlier batches the URLs of hosts that were not known one batch before, and reads the folders of these hosts
    only. Each batch writes under its number, so that one that is done again after a failure replaces what it wrote. No URL is
    queued twice, as long as a host that is known stays so. scorer, keep: as in frontier.score."""
    spark = urls.sparkSession

    def step(new: DataFrame, number: int) -> None:
        hosts, rules = rules_of()
        path = f"{at}/hosts/batch={number}"
        hosts.select("host").distinct().write.mode("overwrite").parquet(path)
        hosts = spark.read.schema("host string").parquet(path)
        before = f"{at}/hosts/batch={number - 1}"
        came = hosts.join(spark.read.schema("host string").parquet(before), "host", "left_anti") if exists(spark, before) else hosts
        new = new.select("host", "url", "path")
        if blocked is not None:
            new = frontier.not_blocked(new, blocked)
        new = new.persist()  # of one batch; what is lost is computed anew
        ready = new.join(hosts, "host", "left_semi")
        if exists(spark, f"{at}/waiting"):
            old = spark.read.schema(_WAITING).parquet(f"{at}/waiting").filter(F.col("batch") < number)
            ready = ready.unionByName(old.join(came.withColumn("bucket", _bucket(F.col("host"))), ["bucket", "host"], "left_semi").select("host", "url", "path"))
        frontier.score(allowed(ready, rules).filter("allowed").select("url", "host", "path"), scorer, keep).write.mode("overwrite").parquet(f"{at}/queue/batch={number}")
        new.join(hosts, "host", "left_anti").withColumn("bucket", _bucket(F.col("host"))).write.partitionBy("bucket").mode("overwrite").parquet(f"{at}/waiting/batch={number}")
        new.unpersist()

    return urls.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def crawl(urls: DataFrame, at: str, rules_of, checkpoint: str, seen: DataFrame | None = None, **how):
    """The frontier as one stream, from a stream of url: valid URLs in canonical form, once each (a state, so a restart remembers them)
    and without those of a table seen (url); then push(). From its queue next_urls() takes what is crawled next."""
    fresh = fresh_urls(urls)
    if seen is not None:
        fresh = fresh.join(seen.select("url"), "url", "left_anti")
    return push(fresh.select("host", "url", "path"), at, rules_of, checkpoint, **how)


def next_urls(queue: DataFrame, crawled: DataFrame | None = None, per_host: int = frontier.QUOTA) -> DataFrame:
    """The best per_host URLs of each host in the queue that weren't crawled (url)."""
    rest = queue if crawled is None else queue.join(crawled.select("url"), "url", "left_anti")
    return frontier.host_quota(rest, per_host)


def rate_limited(requests: DataFrame, count: int = REQUESTS, window_ms: int = WINDOW_MS) -> DataFrame:
    """A stream of event_id, key, ts_ms to event_id, key, wait_ms: windows begin with a key's first request after the last one
    ended, so the state is where its window began and how much of it is used; within a batch requests go in order of time."""

    def walk(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["ts_ms", "event_id"])
        start, used = state.get if state.exists else (None, 0)
        waits, start, used = limit_times(rows["ts_ms"].tolist(), count, window_ms, start, used)
        state.update((start, used))
        yield pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "key": key[0], "wait_ms": waits})

    return requests.groupBy("key").applyInPandasWithState(walk, LIMITED, "start long, used long", "append", GroupStateTimeout.NoTimeout)


def cooled(requests: DataFrame, delay_ms: int) -> DataFrame:
    """A stream of event_id, key, ts_ms to event_id, key, wait_ms: how long until the delay since the last one let through is over."""

    def walk(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["ts_ms", "event_id"])
        last = state.get[0] if state.exists else None
        waits, last = cool_times(rows["ts_ms"].tolist(), delay_ms, last)
        state.update((last,))
        yield pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "key": key[0], "wait_ms": waits})

    return requests.groupBy("key").applyInPandasWithState(walk, LIMITED, "last long", "append", GroupStateTimeout.NoTimeout)
