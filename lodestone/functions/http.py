"""Replies as they come over the wire, and what is asked of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import language_ok, mime_ok


def parse_response(head: Column) -> Column:
    """struct(status, headers) of a reply's head: headers by lower-case name, the last of a name counts; null without a status line."""
    lines = F.split(head, "\r?\n")
    status = F.regexp_extract(F.try_element_at(lines, F.lit(1)), r"^HTTP/[0-9.]+ ([0-9]{3})", 1)
    pairs = F.transform(
        F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: x.rlike(r"^[^:\s]+:")),
        lambda x: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")),
    )
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["key"]), F.create_map(p["key"], p["value"])))
    return F.when(status != "", F.struct(status.cast("int").alias("status"), last.alias("headers")))


def acceptable(reply: Column, body: Column, max_bytes: int | None = None) -> Column:
    """A page of an allowed type and language that isn't too large (of more than max_bytes, where that is given)."""
    h = lambda name: F.try_element_at(reply["headers"], F.lit(name))
    return mime_ok(F.coalesce(h("content-type"), F.lit(""))) & language_ok(h("content-language")) & (F.lit(True) if max_bytes is None else F.coalesce(F.octet_length(body), F.lit(0)) <= max_bytes)


def form_decode(s: Column) -> Column:
    """%XX and + of a request's parameters; null where a code is broken."""
    return F.try_url_decode(s)
