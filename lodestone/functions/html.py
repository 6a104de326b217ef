"""HTML: entities, and a one-pass scanner for words, title, links, metas, base and language."""

from __future__ import annotations

import re
from collections.abc import Container, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

from .lists import ENTITIES
from .urls import decode_url_py

#: What a tag does, if it is more than to end a word. Of all others, known or not, nothing is kept.
ACTIONS = {"!--": "comment", "a": "anchor", "base": "base", "embed": "embed", "html": "html", "meta": "meta", "title": "title"} | dict.fromkeys(("script", "style", "svg", "defs", "symbol"), "section")
#: Tags whose content is dropped up to the end tag of the same name.
SECTIONS = {t for t, a in ACTIONS.items() if a == "section"}
PARSED = (
    StructType()
    .add("words", ArrayType(StringType()))
    .add("title", ArrayType(StringType()))
    .add("links", ArrayType(StructType().add("url", StringType()).add("anchor", ArrayType(StringType()))))
    .add("metas", MapType(StringType(), StringType()))
    .add("base", StringType())
    .add("lang", StringType())
)
_ARROW = pa.struct([("words", pa.list_(pa.string())), ("title", pa.list_(pa.string())), ("links", pa.list_(pa.struct([("url", pa.string()), ("anchor", pa.list_(pa.string()))]))), ("metas", pa.map_(pa.string(), pa.string())), ("base", pa.string()), ("lang", pa.string())])
#: Bytes of pages that are parsed at a time (one page at least), so that the words of few are Python objects at once.
SLICE = 1 << 20
_SPACE = " \t\n\r\f\v"
_TAG_END = re.compile(r"""[^>"']*(?:"[^"]*(?:"|$)[^>"']*|'[^']*(?:'|$)[^>"']*)*""")
_NAME = re.compile(r"[^ \t\n\r\f\v>]*")
_TEXT = re.compile(r"[^<]+")


def decode_entity(name: str) -> str | None:
    """The text of what stands between & and ;, null for what is no entity."""
    if name.startswith("#"):
        n = name[1:]
        if re.fullmatch("[xX][0-9a-fA-F]+", n):
            code = int(n[1:], 16)
        elif re.fullmatch("[0-9]+", n):
            code = int(n)
        else:
            return None
        if code == 0xA0:
            return " "
        return chr(code) if code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else None
    return ENTITIES.get(name)


def decode_entities(s: str, only: Container[str] | None = None) -> str:
    """With all entities decoded, or only those of these names."""
    return re.sub("&([^;]*);", lambda m: m.group(0) if (only is not None and m.group(1) not in only) or (t := decode_entity(m.group(1))) is None else t, s)


def _after(doc: str, at: int) -> int:
    """Behind the > that ends a tag, quoted ones skipped; -1 where there is none."""
    end = _TAG_END.match(doc, at).end()
    return end + 1 if end < len(doc) else -1


def attribute(doc: str, at: int, name: str) -> str:
    """The quoted value of the attribute of this very name in the tag that starts at `at`, or nothing."""
    n = len(doc)
    while at < n:
        while at < n and doc[at] in _SPACE:
            at += 1
        if at >= n or doc[at] == ">":
            return ""
        if doc.startswith(name + "=", at):
            at += len(name) + 1
            while at < n and doc[at] in _SPACE:
                at += 1
            if at < n and doc[at] in "\"'":
                end = doc.find(doc[at], at + 1)
                if end >= 0:
                    return doc[at + 1 : end]
                return ""
        while at < n and doc[at] not in _SPACE and doc[at] != ">":
            if doc[at] in "\"'" and doc[at - 1] == "=":
                end = doc.find(doc[at], at + 1)
                if end < 0:
                    return ""
                at = end
            at += 1
    return ""


def tag_action(name: str) -> str:
    """comment, section, title, anchor, base, embed, meta, html or discard."""
    return ACTIONS.get(name.lower(), "discard")


def parse_html(doc: str | None, max_links: int | None = None, entities: Container[str] | None = None) -> dict:
    """words, title, links, metas, base and lang of a page, in one pass. Links beyond max_links are left out, if it is given. Of the
    text, all entities are decoded, or only those named."""
    most = float("inf") if max_links is None else max_links
    out = {"words": [], "title": [], "links": [], "metas": {}, "base": "", "lang": ""}
    if not doc:
        return out
    n, at, text = len(doc), 0, []
    in_title = in_anchor = based = False
    link: dict = {"url": "", "anchor": []}

    def take():
        """The words of the text so far. A word with & is decoded, and may then be several."""
        if not text:
            return
        got = []
        for w in re.split(f"[{_SPACE}]+", "".join(text)):
            if w:
                got += [w] if "&" not in w else [x for x in re.split(f"[{_SPACE}]+", decode_entities(w, entities)) if x]
        text.clear()
        if in_anchor:
            link["anchor"] += got
        (out["title"] if in_title else out["words"]).extend(got)

    while at < n:
        if doc[at] != "<":
            end = _TEXT.match(doc, at).end()
            text.append(doc[at:end])
            at = end
            continue
        start = at + 1
        ending = doc.startswith("/", start)
        start += ending
        comment = doc.startswith("!--", start)
        stop = start + 3 if comment else _NAME.match(doc, start).end()
        if stop >= n:
            text.append("<")
            at += 1
            continue
        if not comment and doc[stop - 1] == "/":
            ending = True
            stop -= 1
        name = doc[start:stop].lower()
        take()
        if comment:
            end = doc.find("-->", stop)
            if ending:
                at = stop
                continue
            if end < 0:
                return out
            at = end + 3
            continue
        if name in SECTIONS and not ending:
            at = _after(doc, stop)
            if at < 0:
                return out
            raw = doc[start:stop]
            while True:
                at = doc.find("</", at)
                if at < 0:
                    return _closed(out, link, in_anchor, most)
                got = _NAME.match(doc, at + 2).group()
                if got.rstrip("/") == raw:
                    behind = _after(doc, at + 2)
                    at = behind if behind >= 0 else at + 2
                    break
                at += 2
            continue
        if name == "title":
            in_title = not ending
        elif name == "a":
            if ending:
                if in_anchor and len(out["links"]) < most:
                    out["links"].append(link)
                    link, in_anchor = {"url": "", "anchor": []}, False
            elif href := attribute(doc, start, "href"):
                if in_anchor and len(out["links"]) < most:
                    out["links"].append(link)
                link, in_anchor = {"url": decode_entities(decode_url_py(href)), "anchor": []}, True
        elif not ending and name == "base" and not based:
            out["base"], based = decode_entities(decode_url_py(attribute(doc, start, "href"))), True
        elif not ending and name == "embed":
            src = attribute(doc, start, "src")
            if src and len(out["links"]) < most:
                out["links"].append({"url": decode_entities(decode_url_py(src)), "anchor": []})
        elif not ending and name == "meta":
            key = attribute(doc, start, "name") or attribute(doc, start, "property")
            content = decode_entities(attribute(doc, start, "content"))
            if key and content:
                out["metas"][key] = content
        elif not ending and name == "html":
            out["lang"] = attribute(doc, start, "lang")
        at = _after(doc, stop)
        if at < 0:
            return out
    take()
    return _closed(out, link, in_anchor, most)


def _closed(out: dict, link: dict, in_anchor: bool, most: float) -> dict:
    if in_anchor and link["url"] and len(out["links"]) < most:
        out["links"].append(link)
    return out


def _slices(col: pa.Array) -> Iterator[pa.Array]:
    size, lo = np.cumsum(np.asarray(pc.binary_length(col).fill_null(0))), 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(size, (int(size[lo - 1]) if lo else 0) + SLICE, "right")))
        yield col.slice(lo, hi - lo)
        lo = hi


def _rows(docs: pa.Array, max_links: int | None, entities: Container[str] | None) -> pa.Array:
    rows = [parse_html(d, max_links, entities) for d in docs.to_pylist()]
    for r in rows:
        r["metas"] = list(r["metas"].items())
    return pa.array(rows, _ARROW)


def parsed_html(html, max_links: int | None = None, entities: Container[str] | None = None) -> Column:
    """parse_html() of a column, a slice of each batch at a time."""

    @F.arrow_udf(PARSED)
    def parsed(docs: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in docs:
            for part in _slices(batch):
                yield _rows(part, max_links, entities)

    return parsed(html)


@F.pandas_udf(StringType())
def decoded_entities(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else decode_entities(x))


def page_documents(pages: DataFrame, allowed: tuple[str, ...] = ("en",), max_bytes: int | None = None, max_links: int | None = None, blocked_hosts: tuple[str, ...] = ()) -> DataFrame:
    """The pages that are indexed, as documents: canonical URL, a title and words, an allowed language, no noindex. Links are those
    that may be crawled (none under nofollow, none to or under a blocked host). Where they are given, pages of more than max_bytes
    are left out, and links beyond max_links. A null html or url, or one that isn't a URL, gives no document."""
    from .urls import absolute_link, blocked_path, canonical, language_ok, parse

    if max_bytes is not None:
        pages = pages.filter(F.octet_length("html") <= max_bytes)
    p = pages.select(F.col("page_id").cast("long").alias("doc_id"), parse(F.col("url")).alias("u"), parsed_html("html", max_links).alias("h")).filter("u is not null")
    robots = F.transform(F.split(F.coalesce(F.try_element_at("h.metas", F.lit("robots")), F.lit("")), ","), F.trim)
    p = p.filter((F.size("h.title") > 0) & (F.size("h.words") > 0) & language_ok(F.col("h.lang"), allowed) & ~F.array_contains(robots, "noindex"))
    links = F.transform("h.links", lambda x: parse(absolute_link(F.col("u"), F.col("h.base"), x["url"])))
    under = "|".join(re.escape(h.lower()) for h in sorted(blocked_hosts))
    bad = (lambda x: F.lower(x["host"]).rlike(rf"(^|\.)({under})$")) if under else (lambda x: F.lit(False))
    links = F.filter(links, lambda x: x.isNotNull() & ~blocked_path(x["path"]) & ~bad(x))
    return p.select(
        "doc_id",
        canonical(F.col("u")).alias("url"),
        F.col("h.title").alias("title"),
        F.split(F.coalesce(F.try_element_at("h.metas", F.lit("description")), F.lit("")), r"[ \t\n\x0B\f\r]+").alias("d"),
        F.col("h.words").alias("words"),
        F.when(F.array_contains(robots, "nofollow"), F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(links, canonical))).alias("forward_links"),
        F.flatten(F.transform("h.links", lambda x: x["anchor"])).alias("anchor_words"),
    ).withColumn("description", F.filter("d", lambda w: w != "")).drop("d")
