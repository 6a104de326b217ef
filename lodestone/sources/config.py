"""Readers of configuration files: a crawl's, the rankers', and the lists they name."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from ..functions.url_rank import STATIC
from ..operators.rank import WEIGHTS


class ConfigError(ValueError):
    pass


def read_pairs(text: str, mark: str) -> list[tuple[str, str]]:
    """Key and value of each line, split at the first mark; lines that are empty or begin with # are skipped."""
    out = []
    for n, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        key, found, value = line.partition(mark)
        if not found:
            raise ConfigError(f"line {n} has no {mark}")
        out.append((key.strip(), value.strip()))
    return out


def read_list(text: str) -> list[str]:
    """Lines that are neither empty nor comments."""
    return [x for line in text.splitlines() if (x := line.strip()) and not x.startswith("#")]


@dataclass
class CrawlConfig:
    """What a crawl is told: where its tables are, what it starts from, whom it leaves alone, and how fast it goes."""

    docs: str = ""
    state: str = ""
    snapshot: str = ""
    seeds: list[str] = field(default_factory=list)
    blocked_hosts: list[str] = field(default_factory=list)
    growth_basis_points: int | None = None
    crawl_delay_ms: int = 2000
    window_ms: int = 60_000
    window_requests: int = 60
    per_host: int = 25
    batch: int = 50_000
    utilization: float = 0.8
    request_timeout: int = 30
    #: Options of a fetcher's machine (workers, connections, caches, ports): kept, not used here.
    other: dict[str, str] = field(default_factory=dict)


_TEXT = {"docs_directory": "docs", "state_directory": "state", "snapshot_directory": "snapshot"}
_WHOLE = {
    "frontier_growth_rate_bp": "growth_basis_points", "default_crawl_delay_ms": "crawl_delay_ms", "ratelimit_bucket_ms": "window_ms", "ratelimit_bucket_count": "window_requests",
    "middle_queue.host_url_limit": "per_host", "middle_queue.url_batch_size": "batch", "request_timeout": "request_timeout",
}
_LISTS = {"seed_url": "seeds", "blacklist_host": "blocked_hosts"}
_POSITIVE = ("workers", "concurrent_requests")
_OTHER = (*_POSITIVE, "log_level", "dns_cache_size", "middle_queue.queue_count", "concurrent_robots_requests", "robots_cache_size", "metrics_port", "snapshot_period_seconds")


def crawl_config(text: str, folder: str = ".") -> CrawlConfig:
    """A crawl's configuration, of lines key=value. Files that it names are in the folder. Unknown keys, values that aren't numbers
    where they must be, and missing tables or seeds are errors."""
    c = CrawlConfig()
    for key, value in read_pairs(text, "="):
        try:
            if key in _TEXT:
                setattr(c, _TEXT[key], value)
            elif key in _WHOLE:
                setattr(c, _WHOLE[key], int(value))
            elif key == "middle_queue.utilization_target":
                c.utilization = float(value)
            elif key in _LISTS:
                getattr(c, _LISTS[key]).append(value)
            elif key.removesuffix("_file") in _LISTS and key.endswith("_file"):
                with open(os.path.join(folder, value)) as f:
                    getattr(c, _LISTS[key.removesuffix("_file")]).extend(read_list(f.read()))
            elif key in _OTHER:
                if key in _POSITIVE and int(value) <= 0:
                    raise ConfigError(f"{key} must be above 0")
                c.other[key] = value
            else:
                raise ConfigError(f"unknown key {key}")
        except ValueError as e:
            raise e if isinstance(e, ConfigError) else ConfigError(f"{key}: {value} is no number") from e
    for name in ("docs", "state", "snapshot", "seeds"):
        if not getattr(c, name):
            raise ConfigError(f"{name} isn't set")
    return c


_FEATURE = {
    "query_in_title": "in_title", "query_in_url": "in_url", "query_in_description": "in_desc", "query_in_body": "in_body", "coverage_percent_query_url": "cover_url",
    "coverage_percent_query_title": "cover_title", "coverage_percent_query_description": "cover_desc", "order_sensitive_title": "order_title", "density_percent_query_url": "density_url",
    "density_percent_query_title": "density_title", "density_percent_query_description": "density_desc", "earliest_pos_title": "early_title", "earliest_pos_body": "early_body",
}
_POINTS = {
    "HttpsScore": "https", "WhitelistTldScore": "tld", "WhitelistDomainScore": "domain", "DomainNameScore": "name", "DomainLengthAcceptable": "name_ok", "DomainPenaltyPerExtraLength": "name_step",
    "UrlLengthScore": "length", "UrlLengthAcceptable": "length_ok", "UrlPenaltyPerExtraLength": "length_step", "NumberParamScore": "params", "NumberParamAcceptable": "params_ok",
    "NumberParamPenaltyPerExtraParam": "params_step", "DepthPageScore": "depth", "DepthPageAcceptable": "depth_ok", "DepthPagePenalty": "depth_step", "ExtensionBoost": "page",
    "SubdomainAcceptable": "dots_ok", "SubdomainPenalty": "dots_step", "DomainNameNumberPenalty": "name_digit", "URLNumberPenalty": "digits",
}


def _numbers(text: str, names: dict[str, str], start: dict, kind) -> dict:
    out = dict(start)
    for key, value in read_pairs(text, ":"):
        name = names.get(key, key if key in start else None)
        if name is None:
            raise ConfigError(f"unknown key {key}")
        try:
            out[name] = kind(value)
        except ValueError as e:
            raise ConfigError(f"{key}: {value} is no number") from e
    return out


def ranking_weights(text: str) -> dict[str, float]:
    """Weights for rank.search, of lines key: number; what isn't named keeps its default."""
    return _numbers(text, _FEATURE, WEIGHTS, float)


def static_points(text: str) -> dict[str, int]:
    """Points for url_rank.static_rank, of lines key: number; what isn't named keeps its default."""
    return _numbers(text, _POINTS, STATIC, int)
