"""Ranking: BM25, query features, the weighted score, and the top documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lists import ADULT
from ..functions.text import ascii_lower, occurrences, ranking_tokens
from ..functions.url_rank import static_rank
from ..plans.query import matches
from .index import Index

K1, B, CAP = 1.2, 0.75, 6.0
TOP = 50
WEIGHTS = {
    "bm25": 250, "in_title": 200, "in_url": 120, "in_desc": 50, "in_body": 40, "cover_url": 70, "cover_title": 60, "cover_desc": 50, "order_title": 200,
    "density_url": 60, "density_title": 60, "density_desc": 0, "early_title": 80, "early_body": 65, "static_rank": 120, "pagerank": 0,
}


def idf(n: Column, df: Column) -> Column:
    """Below 0 for terms of more than half of the documents."""
    return F.log((n - df + 0.5) / (df + 0.5))


def bm25(tf: Column, df: Column, n: Column, length: Column, avg: Column) -> Column:
    """Score of a body term, capped and scaled to at most 1; 0 for a term of no document."""
    norm = F.when(avg > 0, (1 - B) + B * length / avg).otherwise(1.0)
    x = F.greatest(tf, F.lit(1)) / norm
    s = idf(n, df) * (x * (K1 + 1)) / (x + K1)
    return F.when(df == 0, 0.0).otherwise(F.least(s, F.lit(CAP)) / CAP)


def is_adult(url: Column, title: Column) -> Column:
    return url.rlike(ADULT) | F.exists(title, lambda w: w.rlike(ADULT))


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols, F.lit(0.0))


def _all(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cols, F.lit(True))


def ordered_title(title: Column, tokens: list[str]) -> Column:
    """Share of the query's tokens that the title's words, each as the start of the next token, get through."""
    q = F.array(*[F.lit(t) for t in tokens])
    step = lambda i, w: F.when((i < len(tokens)) & F.startswith(F.try_element_at(q, i + 1), ascii_lower(w)), i + 1).otherwise(i)
    return F.aggregate(title, F.lit(0), step) / F.lit(float(len(tokens)))


def features(index: Index, query: str, docs: DataFrame) -> DataFrame:
    """For each doc_id of docs the url, title and the query features. Documents that the index lacks have null features."""
    toks = ranking_tokens(query)
    names, t = [x for x, _ in toks], float(len(toks))
    terms = index.positions.filter(F.col("token").isin(*sorted(set(names))) & F.col("field").isin("body", "desc")) if toks else index.positions.limit(0)
    per = []
    for i, w in enumerate(names):
        body = (F.col("token") == w) & (F.col("field") == "body")
        per += [
            F.coalesce(F.max(F.when(body, F.col("freq"))), F.lit(0)).alias(f"tf{i}"),
            F.max(F.when(body, F.array_min("positions"))).alias(f"first{i}"),
            F.coalesce(F.bool_or((F.col("token") == w) & (F.col("field") == "desc")), F.lit(False)).alias(f"desc{i}"),
        ]
    by_doc = terms.groupBy("doc_id").agg(*per) if per else terms.select("doc_id").distinct()
    # one row: statistics and the tokens' document frequencies
    df = index.term_dict.filter((F.col("field") == "body") & F.col("token").isin(*sorted(set(names)))) if toks else index.term_dict.limit(0)
    one = index.stats.crossJoin(df.agg(*[F.coalesce(F.max(F.when(F.col("token") == w, F.col("doc_freq"))), F.lit(0)).alias(f"df{i}") for i, w in enumerate(names)] or [F.lit(0).alias("df")]))
    d = (
        docs.select("doc_id").join(by_doc, "doc_id", "left")
        .join(index.doc_map.select("doc_id", "body_len", "pagerank", "url", "title_words"), "doc_id", "left")
        .crossJoin(F.broadcast(one))
    )
    url, title = F.col("url"), ascii_lower(F.array_join("title_words", ""))
    w_title, l_url = F.size("title_words"), F.octet_length(url)
    nonstop = [i for i, (_, s) in enumerate(toks) if not s]
    stop = [i for i, (_, s) in enumerate(toks) if s]
    tf = lambda i: F.coalesce(F.col(f"tf{i}"), F.lit(0))
    in_url = {i: url.contains(w) for i, w in enumerate(names)}
    in_title = {i: title.contains(w) for i, w in enumerate(names)}
    in_desc = {i: F.coalesce(F.col(f"desc{i}"), F.lit(False)) for i in range(len(names))}
    in_body = {i: tf(i) > 0 for i in range(len(names))}
    found = _sum([F.when(in_url[i] | in_title[i] | in_desc[i], 1.0).otherwise(0.0) for i in nonstop])
    stops = (found / F.lit(float(len(nonstop))) >= 0.66) if nonstop else F.lit(False)

    def each(value) -> Column:
        """Summed over the tokens that count: stop words only if enough others were found."""
        return _sum([value(i) for i in nonstop]) + (F.when(stops, _sum([value(i) for i in stop])).otherwise(0.0) if stop else F.lit(0.0))

    def every(flag: dict) -> Column:
        c = _all([flag[i] for i in nonstop])
        return c & (~stops | _all([flag[i] for i in stop])) if stop else c

    when = lambda c, v: F.when(c, v).otherwise(0.0)
    offset = lambda w: F.octet_length(F.substring_index(title, w, 1))
    f = {
        "in_url": every(in_url), "in_title": every(in_title), "in_desc": every(in_desc), "in_body": every(in_body),
        "cover_url": each(lambda i: when(in_url[i], 1.0)) / t if t else F.lit(0.0),
        "cover_title": each(lambda i: when(in_title[i], 1.0)) / t if t else F.lit(0.0),
        "cover_desc": each(lambda i: when(in_desc[i], 1.0)) / t if t else F.lit(0.0),
        "order_title": F.sqrt(ordered_title(F.col("title_words"), names)) if toks else F.lit(0.0),
        "density_url": each(lambda i: when(in_url[i], F.least(occurrences(url, names[i]) * len(names[i]), l_url) / l_url / t)),
        "density_title": each(lambda i: when(in_title[i], F.least(occurrences(title, names[i]), w_title) / w_title / t)),
        "density_desc": F.lit(0.0),
        "early_title": each(lambda i: when(in_title[i], 1.0 / (offset(names[i]) + 1) / t)),
        "early_body": each(lambda i: when(in_body[i], 1.0 / (F.col(f"first{i}") + 1) / t)),
        "bm25": each(lambda i: bm25(tf(i), F.col(f"df{i}"), F.col("doc_count"), F.col("body_len"), F.col("avg_body")) / t),
        "static_rank": static_rank(url), "pagerank": F.col("pagerank"),
    }
    return d.select("doc_id", "url", "title_words", *[c.cast("double").alias(k) for k, c in f.items()])


def dynamic_score(weights: dict = WEIGHTS) -> Column:
    """0 to 10000 from the feature columns; 0 for a document without them."""
    total = float(sum(weights.values()))
    # rounded before it is cut, so that the order of the sum doesn't matter
    s = F.round(_sum([F.col(k) * float(w) for k, w in weights.items()]) / total * 10000, 6)
    return F.coalesce(F.greatest(F.floor(s), F.lit(0)), F.lit(0)).cast("int")


def search(index: Index, query: str, k: int | None = TOP, weights: dict = WEIGHTS) -> DataFrame:
    """doc_id, score, url, title of the k best matches (all for None), of equals the greater doc_id; adult pages are left out."""
    f = features(index, query, matches(index, query))
    f = f.filter(~F.coalesce(is_adult(F.col("url"), F.col("title_words")), F.lit(False)))
    r = f.select("doc_id", dynamic_score(weights).alias("score"), F.coalesce("url", F.lit("")).alias("url"), F.concat_ws(" ", "title_words").alias("title"))
    return r.orderBy(F.desc("score"), F.desc("doc_id")).limit(k) if k is not None else r


def bm25_search(index: Index, words: list[str], k: int | None = TOP) -> DataFrame:
    """doc_id, bm25: the sum of the body scores of normalised terms, best first, of equals the greater doc_id."""
    p = index.positions.filter((F.col("field") == "body") & F.col("token").isin(*words))
    df = index.term_dict.filter((F.col("field") == "body") & F.col("token").isin(*words)).select("token", "doc_freq")
    s = p.join(F.broadcast(df), "token").join(index.doc_map.select("doc_id", "body_len"), "doc_id").crossJoin(F.broadcast(index.stats))
    s = s.groupBy("doc_id").agg(F.round(F.sum(bm25(F.col("freq"), F.col("doc_freq"), F.col("doc_count"), F.col("body_len"), F.col("avg_body"))), 6).alias("bm25"))
    return s.orderBy(F.desc("bm25"), F.desc("doc_id")).limit(k) if k is not None else s


def merge_top(parts: list[DataFrame], k: int = TOP) -> DataFrame:
    """The best k of several result lists."""
    return reduce(lambda a, b: a.unionByName(b), parts).orderBy(F.desc("score"), F.desc("doc_id")).limit(k)
