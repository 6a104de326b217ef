"""Robots rules: lines, groups, patterns as regular expressions, and which paths they allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower

MAX_SEGMENTS, MAX_PATTERN = 50, 2048
#: Milliseconds: least and most delay between requests.
DELAY, MAX_DELAY = 1000, 30_000
#: Hours that rules are kept, and that a failure to get them is.
TTL_HOURS, FAILED_HOURS = 4, 1


def parse_line(line: Column) -> Column:
    """struct(directive, value), null for a comment, an empty line or an empty value."""
    pattern = r"^\s*([^\s:#][^\s:]*)[^:]*:\s*([^#\r\n]*?)\s*(?:[#\r\n].*)?$"
    value = F.regexp_extract(line, pattern, 2)
    return F.when(line.rlike(pattern) & (value != ""), F.struct(F.regexp_extract(line, pattern, 1).alias("directive"), value.alias("value")))


def rules(files: DataFrame, agent: str, max_bytes: int | None = None) -> DataFrame:
    """host, type (disallow, allow, crawl-delay), value, n (line) for our agent: all groups for * or the agent count together. files
    has host and txt; of a file of more than max_bytes, where that is given, the rest isn't read (500 KiB is usual). A null txt has
    no rules."""
    txt = F.col("txt") if max_bytes is None else F.make_valid_utf8(F.substring(F.encode("txt", "UTF-8"), 1, max_bytes).cast("string"))
    lines = files.select("host", F.posexplode(F.split(txt, r"[\r\n]")).alias("n", "line")).select("host", "n", parse_line(F.col("line")).alias("l")).filter("l is not null")
    kind = ascii_lower(F.col("l.directive"))
    w = Window.partitionBy("host").orderBy("n")
    d = lines.select("host", "n", kind.alias("type"), F.col("l.value").alias("value"))
    # a group starts at a user-agent line that follows another directive
    d = d.withColumn("new", ((F.col("type") == "user-agent") & (F.coalesce(F.lag("type").over(w), F.lit("")) != "user-agent")).cast("int"))
    d = d.withColumn("grp", F.sum("new").over(w))
    ours = (F.col("type") == "user-agent") & ((F.col("value") == "*") | (ascii_lower(F.col("value")) == agent.lower()))
    d = d.withColumn("ours", F.max(ours.cast("int")).over(Window.partitionBy("host", "grp")))
    return d.filter((F.col("ours") == 1) & F.col("type").isin("disallow", "allow", "crawl-delay")).select("host", "type", "value", "n")


def pattern_regex(pattern: Column) -> Column:
    """The regular expression a path matches from its start; null for a pattern that is discarded (empty, too long, or with a *
    inside or at the end of a segment other than the last). A segment * takes any one segment, an empty one too; so does an
    empty last segment; a final * takes any rest."""
    p = F.regexp_replace(pattern, "^/", "")
    segments = F.split(p, "/")
    bad = F.exists(
        F.transform(segments, lambda s, i: F.struct(s.alias("s"), i.alias("i"))),
        lambda x: (F.length(x["s"]) > 1) & x["s"].rlike(r"\*.+$") & (x["i"] < F.size(segments) - 1) | (F.length(x["s"]) > 1) & x["s"].endswith("*") & (x["i"] < F.size(segments) - 1),
    )
    quoted = lambda s: F.regexp_replace(s, r"([\\.\[\]{}()+?^$|*])", r"\\$1")
    body = F.transform(
        segments,
        lambda s, i: F.when((s == "*") | (s == ""), "[^/]*")
        .when((i == F.size(segments) - 1) & s.endswith("*"), F.concat(quoted(F.regexp_replace(s, r"\*$", "")), F.lit("[^/]*")))
        .otherwise(quoted(s)),
    )
    last = F.element_at(segments, -1)
    # a fixed last segment is matched as the start of the path's
    end = F.when((last == "*") | (last == "") | last.endswith("*"), "").otherwise("[^/]*")
    return F.when((pattern != "") & (F.length(pattern) <= MAX_PATTERN) & (F.size(segments) <= MAX_SEGMENTS) & ~bad, F.concat(F.lit("^/"), F.array_join(body, "/"), end, F.lit("(/|$)")))


def compiled(rule: DataFrame) -> DataFrame:
    """host, type, regex, length of the allow and disallow rules that aren't discarded."""
    r = rule.filter(F.col("type").isin("allow", "disallow")).select("host", "type", "value", pattern_regex(F.col("value")).alias("regex"), F.length("value").alias("length"))
    return r.filter("regex is not null")


def allowed(urls: DataFrame, rule: DataFrame) -> DataFrame:
    """urls (host, path and what else there is) with allowed: the longest matching pattern decides, of equals an allow; none: allowed.

    The rules of a host are one array, joined once; so a URL is one row throughout."""
    by_host = rule.groupBy("host").agg(F.collect_list(F.struct("length", (F.col("type") == "allow").alias("allow"), "regex")).alias("_rules"))
    hit = F.array_max(F.transform(F.filter("_rules", lambda r: F.regexp_like(F.col("path"), r["regex"])), lambda r: F.struct(r["length"].alias("length"), r["allow"].alias("allow"))))
    return urls.join(by_host, "host", "left").withColumn("allowed", F.coalesce(hit["allow"], F.lit(True))).drop("_rules")


def status_policy(status: Column, content_type: Column) -> Column:
    """What a reply to the request for the rules means: parse, allow_all or disallow_all."""
    plain = ascii_lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1))) == "text/plain"
    return F.when((status == 200) & plain, "parse").when(status.isin(200, 404), "allow_all").otherwise("disallow_all")


def crawl_delay_ms(seconds: Column, default: int = DELAY) -> Column:
    return F.least(F.greatest(F.coalesce(seconds, F.lit(0)) * 1000, F.lit(default)), F.lit(MAX_DELAY))


def expires(fetched: Column, failed: Column) -> Column:
    return fetched + F.when(failed, F.make_interval(hours=F.lit(FAILED_HOURS))).otherwise(F.make_interval(hours=F.lit(TTL_HOURS)))
