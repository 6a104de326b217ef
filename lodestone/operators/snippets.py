"""Snippets and the shape of results."""

from __future__ import annotations

import re
from collections import OrderedDict
from time import monotonic

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_lower

REACH, AROUND, SHORT, LONGER = 100, 150, 75, 50


def document_text(title: Column, description: Column, words: Column) -> Column:
    """Title, description and words; without words the description."""
    join = lambda c: F.coalesce(F.array_join(c, " "), F.lit(""))
    head = F.when(F.size(title) > 0, F.concat(join(title), F.lit(". "))).otherwise("")
    return F.when(F.size(words) > 0, F.concat(head, F.when(F.size(description) > 0, F.concat(join(description), F.lit(" "))).otherwise(""), join(words))).otherwise(join(description))


def bounds(text: Column, pos: Column, around: int) -> tuple[Column, Column]:
    """Start and end (counted from 0) of the text around a place: up to REACH characters further to the end of a sentence."""
    n = F.length(text)
    start, end = F.greatest(pos - around, F.lit(0)), F.least(pos + around, n)
    low = F.greatest(start - REACH, F.lit(0))
    # the last mark in (low, start]
    back = F.substring(text, low + 2, start - low)
    at = F.length(back) - F.length(F.regexp_extract(back, r"(?s)[.!?]([^.!?]*)$", 1))
    first = F.when(start == 0, 0).when(back.rlike("[.!?]"), low + 1 + at).otherwise(low)
    high = F.least(end + REACH, n)
    ahead = F.substring(text, end + 1, high - end)
    last = F.when(end >= n, end).when(ahead.rlike("[.!?]"), end + F.length(F.regexp_extract(ahead, r"(?s)^([^.!?]*[.!?])", 1))).otherwise(high)
    return first, last


def around(text: Column, pos: Column, width: int) -> Column:
    first, last = bounds(text, pos, width)
    return F.concat(F.when(first > 0, "...").otherwise(""), F.substring(text, first + 1, last - first), F.when(last < F.length(text), "...").otherwise(""))


def fallback(text: Column) -> Column:
    """The start of the text, to the end of a sentence if one is near."""
    ahead = F.substring(text, SHORT + 1, LONGER)
    end = F.when(ahead.rlike("[.!?]"), F.length(F.regexp_extract(ahead, r"(?s)^([^.!?]*[.!?])", 1))).otherwise(F.length(ahead))
    return F.when(F.length(text) <= SHORT, text).otherwise(F.concat(F.substring(text, 1, F.lit(SHORT) + end), F.lit("...")))


def snippet(text: Column, terms: list[str]) -> Column:
    """Around the first term (of three letters and more) that the text has, in the order of the query; else its start."""
    low = ascii_lower(text)
    found = [F.when(F.instr(low, t.lower()) > 0, around(text, F.instr(low, t.lower()) - 1, AROUND)) for t in terms if len(t) >= 3]
    return F.when(text.isNull(), "No preview available").when(text == "", "No content available").otherwise(F.coalesce(*found, fallback(text)))


def snippet_at(text: Column, places: Column) -> Column:
    """Around the middle one of sorted places of characters."""
    return around(text, F.try_element_at(F.array_sort(places), (F.size(places) / 2).cast("int") + 1), SHORT)


def highlight(snip: Column, query: str) -> Column:
    out = snip
    for t in query.lower().split():
        if len(t) > 2 and t not in ("and", "not"):
            out = F.regexp_replace(out, rf"(?i)(\b{re.escape(t)}\b)", '<span class="highlight">$1</span>')
    return out


def result_json(results: DataFrame, total: int | DataFrame, time_ms: int) -> DataFrame:
    """One row: the results (doc_id, url, title, snippet, score), best first, as the JSON an interface reads. total: how many
    documents match, or the matches, which are counted."""
    one = F.struct(F.col("doc_id").alias("id"), "url", "title", "snippet")
    rows = results.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), (-F.col("doc_id")).alias("d"), one.alias("r")))), lambda x: x["r"]).alias("results"))
    rows = rows.withColumn("total", F.lit(total)) if isinstance(total, int) else rows.crossJoin(F.broadcast(total.agg(F.count("*").alias("total"))))
    return rows.select(F.to_json(F.struct("results", "total", F.lit(time_ms).alias("time_ms"))).alias("json"))


def calculate(spark: SparkSession, query: str) -> float | None:
    """The value of a query that is arithmetic: digits, + - * / ( ) and points only."""
    if not re.fullmatch(r"[0-9+\-*/(). ]{1,200}", query) or not re.search(r"[0-9]\s*[+\-*/]", query):
        return None
    try:
        v = spark.sql(f"SELECT try_cast({query} AS double) AS v").first().v
    except Exception:  # not an expression, or a division by zero
        return None
    return v


class ResultCache:
    """Results by query: `most` of them, each for `seconds`, the oldest going first."""

    def __init__(self, most: int = 100, seconds: float = 300.0, clock=monotonic):
        self.most, self.seconds, self.clock, self._held = most, seconds, clock, OrderedDict()

    def get(self, key):
        got = self._held.get(key)
        if got and self.clock() - got[0] < self.seconds:
            return got[1]
        self._held.pop(key, None)
        return None

    def put(self, key, value) -> None:
        self._held.pop(key, None)
        self._held[key] = (self.clock(), value)
        while len(self._held) > self.most:
            self._held.popitem(last=False)
