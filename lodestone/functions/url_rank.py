"""Scores of a URL by its form: the static rank (0 to 1) and the crawl rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lists import FILE_EXTENSIONS, PAGE_EXTENSIONS, TRUSTED_DOMAINS, TRUSTED_TLDS

#: Points of the static rank; a configuration may replace any of them.
STATIC = {
    "base": 1000, "https": 100, "tld": 200, "domain": 500, "name": 200, "name_ok": 11, "name_step": 50, "length": 400, "length_ok": 60, "length_step": 50,
    "params": 200, "params_ok": 1, "params_step": 100, "depth": 400, "depth_ok": 2, "depth_step": 75, "page": 500, "dots_ok": 2, "dots_step": 200, "name_digit": 500, "digits": 500,
}
CRAWL = {
    "no_https": 50, "tld": 10, "domain": 10, "name": 10, "name_ok": 11, "name_step": 5, "length": 10, "length_ok": 60, "length_step": 5,
    "params": 20, "params_ok": 1, "params_step": 5, "depth": 40, "depth_ok": 2, "depth_step": 15, "page": 30, "dots_ok": 1, "dots_step": 15, "name_digit": 20, "digits": 35,
}


def features(url: Column) -> dict[str, Column]:
    """https, host (without www.), tld, dots, digit in the host; length, parameters, depth, extension and long numbers behind it."""
    scheme = F.regexp_extract(url, r"^([^:]*):", 1)
    host = F.regexp_extract(url, r"^[^:]*:..([^/]*)", 1)
    rest = F.regexp_extract(url, r"^[^:]*:..[^/]*(.*)$", 1)
    www = host.startswith("www.")
    ext = F.regexp_extract(rest, r"\.([^./?&]*)(?:[?&][^./]*)?$", 1)
    return {
        "https": scheme.contains("s"),
        "host": F.regexp_replace(host, r"^www\.", ""),
        "tld": F.regexp_extract(host, r"\.([^.]*)$", 1),
        "dots": F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) - F.when(www, 1).otherwise(0),
        "host_digit": host.rlike("[0-9]"),
        "length": F.length(rest),
        "params": F.length(rest) - F.length(F.regexp_replace(rest, "[?&]", "")),
        "depth": F.length(rest) - F.length(F.replace(rest, F.lit("/"), F.lit(""))) - F.when(url.endswith("/"), 1).otherwise(0),
        "ext": ext,
        "digits": rest.rlike("[0-9]{5}"),
    }


def _less(points: int, step: int, value: Column, ok: int) -> Column:
    return F.lit(points) - F.least(F.lit(step) * F.greatest(value - ok, F.lit(0)), F.lit(points))


def static_points(url: Column, c: dict = STATIC) -> Column:
    f = features(url)
    trusted = f["host"].isin(*sorted(TRUSTED_DOMAINS))
    return (
        F.lit(c["base"])
        + F.when(f["tld"].isin(*sorted(TRUSTED_TLDS)), c["tld"]).otherwise(0)
        + F.when(trusted, c["domain"] + c["name"]).otherwise(
            _less(c["name"], c["name_step"], F.length(f["host"]), c["name_ok"])
            - c["dots_step"] * F.greatest(f["dots"] - c["dots_ok"], F.lit(0))
            - F.when(f["host_digit"], c["name_digit"]).otherwise(0)
        )
        + F.when(f["ext"].isin(*sorted(PAGE_EXTENSIONS)), c["page"]).otherwise(0)
        + _less(c["length"], c["length_step"], f["length"], c["length_ok"])
        + _less(c["params"], c["params_step"], f["params"], c["params_ok"])
        + _less(c["depth"], c["depth_step"], f["depth"], c["depth_ok"])
        + F.when(f["https"], c["https"]).otherwise(0)
        - F.when(f["digits"], c["digits"]).otherwise(0)
    )


def static_rank(url: Column, c: dict = STATIC) -> Column:
    least = c["base"] - 500
    most = sum(c[k] for k in ("base", "https", "tld", "domain", "name", "length", "params", "depth", "page"))
    return (static_points(url, c) - F.lit(least)) / F.lit(float(most - least))


def with_crawl_rank(urls: DataFrame, c: dict = CRAWL) -> DataFrame:
    """Adds score; the features are columns of a step of their own and the score a generated column, so that each is computed and
    written out once."""
    f = features(F.col("url"))
    step = urls.withColumns({f"_f_{k}": v for k, v in f.items()})
    return step.select("*", F.explode(F.array(crawl_points({k: F.col(f"_f_{k}") for k in f}, c))).alias("score")).drop(*[f"_f_{k}" for k in f])


def crawl_rank(url: Column, c: dict = CRAWL) -> Column:
    return crawl_points(features(url), c)


def crawl_points(f: dict[str, Column], c: dict = CRAWL) -> Column:
    """-100 for a file that isn't a page, else at least 0."""
    page, trusted = f["ext"].isin(*sorted(PAGE_EXTENSIONS)), f["host"].isin(*sorted(TRUSTED_DOMAINS))
    s = (
        F.when(page, c["page"]).otherwise(0)
        + F.when(f["tld"].isin(*sorted(TRUSTED_TLDS)), c["tld"]).otherwise(0)
        + F.when(trusted, c["domain"]).otherwise(
            _less(c["name"], c["name_step"], F.length(f["host"]), c["name_ok"])
            - c["dots_step"] * F.greatest(f["dots"] - c["dots_ok"], F.lit(0))
            - F.when(f["host_digit"], c["name_digit"]).otherwise(0)
        )
        + _less(c["length"], c["length_step"], f["length"], c["length_ok"])
        + _less(c["params"], c["params_step"], f["params"], c["params_ok"])
        + _less(c["depth"], c["depth_step"], f["depth"], c["depth_ok"])
    )
    # without https at least 0 is left of a sum above 0, and a sum below it becomes 0, before long numbers count
    s = F.when(f["https"], s).otherwise(F.greatest(s - c["no_https"], F.lit(0)))
    s = F.greatest(s - F.when(f["digits"], c["digits"]).otherwise(0), F.lit(0))
    return F.when(~page & f["ext"].isin(*sorted(FILE_EXTENSIONS)), F.lit(-100)).otherwise(s)
