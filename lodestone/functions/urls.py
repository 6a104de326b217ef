"""URL functions as Column expressions: parse, canonical form, hosts, links, filters. Percent coding is an Arrow UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .lists import TRACKING
from .text import ascii_lower

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_URL = rf"^(?i:(https?))://({_LABEL}(?:\.{_LABEL})*)(?::([0-9]+))?((?:[/?#].*)?)$"
MAX_HOST = 253
NOT_PAGES = ("javascript:", "data:", "mailto:", "tel:", "sms:", "ftp:", "#", "about:", "file:", "ws:", "wss:")
BLOCKED_PATHS = ("/search",)


def parse(url: Column) -> Column:
    """struct(url, scheme, host, port, path), null for what isn't an http URL with a valid host and port."""
    g = lambda i: F.regexp_extract(url, f"(?s){_URL}", i)
    port = g(3)
    number = F.coalesce(F.regexp_extract(port, "^0*([0-9]{1,5})$", 1).try_cast("int").between(1, 65535), F.lit(False))
    ok = url.rlike(f"(?s){_URL}") & (F.length(g(2)) <= MAX_HOST) & ((port == "") | number)
    return F.when(ok, F.struct(url.alias("url"), F.lower(g(1)).alias("scheme"), g(2).alias("host"), port.alias("port"), g(4).alias("path")))


def resolve_path(path: Column) -> Column:
    """The path with . and .. resolved; .. at the top stays."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    step = lambda a, s: F.when((s == "..") & (F.size(a) > 0), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(s != ".", F.concat(a, F.array(s))).otherwise(a)
    done = F.aggregate(parts, F.array().cast("array<string>"), step)
    resolved = F.when(F.size(done) > 0, F.concat(F.lit("/"), F.array_join(done, "/"))).otherwise("")
    # most paths have neither
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), resolved).otherwise(F.concat(F.lit("/"), F.regexp_replace(path, "^/", "")))


def clean_params(path: Column) -> Column:
    """Query parameters by name, without those that only track, and without = before an empty value."""
    base, query = F.substring_index(path, "?", 1), F.regexp_replace(path, r"(?s)^[^?]*\??", "")
    raw = F.split(F.regexp_replace(query, "&$", ""), "&")
    name = lambda p: F.substring_index(p, "=", 1)
    kept = F.filter(F.transform(raw, lambda p, i: F.struct(name(p).alias("n"), i.alias("i"), F.regexp_replace(p, "(?s)^([^=]*)=$", "$1").alias("p"))), lambda x: ~x["n"].isin(*sorted(TRACKING)))
    q = F.array_join(F.transform(F.array_sort(kept), lambda x: x["p"]), "&")
    return F.when(~path.contains("?") | (query == ""), base).when(F.size(kept) == 0, base).otherwise(F.concat(base, F.lit("?"), q))


def _port(u: Column) -> Column:
    default = ((u["scheme"] == "http") & (u["port"] == "80")) | ((u["scheme"] == "https") & (u["port"] == "443"))
    return F.when((u["port"] == "") | default, "").otherwise(u["port"])


def canonical_path(u: Column) -> Column:
    """Without fragment and repeated slashes, . and .. resolved, parameters cleaned."""
    path = F.regexp_replace(u["path"], "(?s)#.*$", "")
    path = F.regexp_replace(F.concat(F.when(path.startswith("/"), "").otherwise("/"), path), "/+", "/")
    return clean_params(resolve_path(path))


def canonical(u: Column) -> Column:
    """The canonical URL of a parsed one: lower host, no default port, canonical path."""
    return F.concat(canonical_host(u), canonical_path(u))


def once(expr: Column) -> Column:
    """The expression as a generated column: filters on it are not written out in terms of the expression beneath it, as they
    would be, again and again, for a projected one."""
    return F.explode(F.array(expr))


def canonical_urls(urls: DataFrame) -> DataFrame:
    """url, host, path of the valid URLs of the column url, in canonical form."""
    p = urls.filter(valid_url(F.col("url"))).select(once(parse(F.col("url"))).alias("u")).filter("u is not null")
    p = p.select(canonical_host(F.col("u")).alias("site"), ascii_lower(F.col("u.host")).alias("host"), once(canonical_path(F.col("u"))).alias("path"))
    return p.filter(~blocked_path(F.col("path"))).select(F.concat("site", "path").alias("url"), "host", "path")


def canonical_host(u: Column) -> Column:
    port = _port(u)
    return F.concat(u["scheme"], F.lit("://"), ascii_lower(u["host"]), F.when(port == "", "").otherwise(F.concat(F.lit(":"), port)))


def port_or_default(u: Column) -> Column:
    return F.when(u["port"] != "", u["port"]).when(u["scheme"] == "https", "443").otherwise("80")


def base_path(path: Column) -> Column:
    return F.regexp_replace(path, "(?s)[?#].*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(base_path(path), r"\.([^./]*)$", 1)


def base_host(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def result_url(url: Column) -> Column:
    """The URL without www. before the host and without a slash after the path; what two equal results share."""
    plain = F.regexp_replace(F.regexp_replace(url, r"^(?i)([a-z]+://)www\.", "$1"), r"^([^?#]*[^/?#])/([?#].*)?$", "$1$2")
    return F.when(url.rlike("^(?i)https?://"), plain).otherwise(url)


def absolute_link(page: Column, base: Column, href: Column) -> Column:
    """The URL a link of the page means; null for links to no page. page is parsed; base is the base tag's href or empty."""
    pre = F.concat(page["scheme"], F.lit("://"), page["host"], F.when(page["port"] == "", "").otherwise(F.concat(F.lit(":"), page["port"])))
    base = F.coalesce(base, F.lit(""))
    web = r"^https?://"
    folder = (
        F.when(base == "", page["path"]).when(base.startswith("/"), base)
        .when(base.rlike(web), F.regexp_extract(base, r"(?s)^https?://[^/]*(/.*)?$", 1)).otherwise(F.concat(F.lit("/"), base))
    )
    folder = F.when(folder.contains("/"), F.regexp_replace(folder, "(?s)[^/]*$", "")).otherwise(folder)
    skip = F.lit(False)
    for p in NOT_PAGES:
        skip = skip | href.startswith(p)
    return (
        F.when((F.coalesce(href, F.lit("")) == "") | skip, F.lit(None))
        .when(href.rlike(web), href)
        .when(href.startswith("//"), F.concat(page["scheme"], F.lit(":"), href))
        .when(href.startswith("/"), F.concat(pre, resolve_path(href)))
        .otherwise(F.concat(pre, resolve_path(F.concat(folder, href))))
    )


def valid_url(url: Column) -> Column:
    return F.length(url).between(10, 2048) & url.rlike("^[!-~]+$")


def blocked_path(canonical_path: Column) -> Column:
    return base_path(canonical_path).isin(*BLOCKED_PATHS)


def host_suffixes(host: Column) -> Column:
    """com, example.com, www.example.com of www.example.com: to be joined with blocked hosts."""
    labels = F.split(ascii_lower(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), "."))


def language_ok(lang: Column, allowed: tuple[str, ...] = ("en",)) -> Column:
    """Empty, or an allowed language with or without a region."""
    low = ascii_lower(F.trim(F.coalesce(lang, F.lit(""))))
    c = low == ""
    for a in allowed:
        c = c | (low == a) | low.startswith(a + "-") | low.startswith(a + "_")
    return c


def mime_ok(content_type: Column, allowed: tuple[str, ...] = ("text/html",)) -> Column:
    """The type before any ; is allowed; a final * allows all that goes on."""
    low = ascii_lower(F.trim(F.substring_index(content_type, ";", 1)))
    c = F.lit(False)
    for a in allowed:
        c = c | (low.startswith(a[:-1]) if a.endswith("*") else low == a)
    return c


def encode_path_py(s: str) -> str:
    out, query = [], False
    for b in s.encode():
        c = chr(b)
        if b < 128 and (c.isalnum() or c in "-._~"):
            keep = True
        elif c == "/":
            keep = not query
        elif c in "?#":
            keep, query = not query, True
        else:
            keep = c in "&=" and query
        out.append(c if keep else f"%{b:02X}")
    return "".join(out)


def decode_url_py(s: str) -> str:
    import re

    def one(m):
        b = int(m.group(1), 16)
        return m.group(0).encode() if chr(b) in ":/?#[]@!$&'()*+,;=" else bytes([b])

    out, at = b"", 0
    for m in re.finditer("%([0-9A-F]{2})", s):
        out += s[at : m.start()].encode() + one(m)
        at = m.end()
    return (out + s[at:].encode()).decode("utf-8", "replace")


@F.pandas_udf(StringType())
def encode_path(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else encode_path_py(x))


@F.pandas_udf(StringType())
def decode_url(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else decode_url_py(x))
