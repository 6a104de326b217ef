import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions.url_rank import crawl_rank, static_rank
from lodestone.operators import rank
from lodestone.operators.index import Index
from lodestone.plans import query as ql

DOCS = {
    0: "alpha beta gamma delta", 1: "alpha gamma beta", 2: "beta alpha", 3: "delta epsilon the alpha alpha", 4: "", 5: "alpha x1 x2 x3 x4 beta", 6: "alpha x1 x2 x3 x4 x5 beta",
}


@pytest.fixture(scope="module")
def index(spark):
    rows = [(i, f"https://h{i}.example.com/", ["T", f"word{i}"], ["desc"], t.split(), []) for i, t in DOCS.items()]
    d = spark.createDataFrame(rows, "doc_id long, url string, title array<string>, description array<string>, words array<string>, forward_links array<string>").cache()
    i = Index.build(d)
    i.positions = i.positions.cache()
    return i


def ids(index, q):
    got = [r.doc_id for r in ql.matches(index, q).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize(
    "q,want",
    [
        ("alpha", {0, 1, 2, 3, 5, 6}), ("alpha AND delta", {0, 3}), ("alpha delta", {0, 3}), ("gamma OR epsilon", {0, 1, 3}), ("NOT alpha", {4}), ("alpha NOT beta", {3}), ("NOT (alpha OR beta)", {4}),
        ("title:word3", {3}), ("title:alpha", set()), ("url:h2", {2}), ("anchor:alpha", set()), ("the", set()), ("the alpha", {0, 1, 2, 3, 5, 6}), ("NOT the", set(DOCS)), ("the OR epsilon", {3}),
        ('"alpha beta"', {0}), ('"Alpha, Beta"', {0}), ('"beta alpha"', {2}), ("'alpha beta'", {0, 1, 5}), ("delta 'alpha beta'", {0}), ('"alpha alpha"', {3}), ("'alpha alpha'", {0, 1, 2, 3, 5, 6}),
        ("NOT NOT alpha", {0, 1, 2, 3, 5, 6}), ("(alpha", set()), ("", set()), ('"open', set()), ("alpha )", set()), ("nothing", set()), ("epsilon OR gamma AND delta", {0, 3}), ("!!!", set()),
    ],
)
def test_matches(index, q, want):
    assert ids(index, q) == want


def test_laws(index):
    everything = set(DOCS)
    for a, b in (("alpha", "beta"), ("delta", '"alpha beta"')):
        assert ids(index, f"NOT ({a} AND {b})") == everything - (ids(index, a) & ids(index, b)) == ids(index, f"(NOT {a}) OR (NOT {b})")
        assert ids(index, f"{a} OR {b}") == ids(index, f"{b} OR {a}") == ids(index, a) | ids(index, b)
    assert ids(index, '"alpha beta"') <= ids(index, "'alpha beta'") <= ids(index, "alpha beta")


def test_lexer_and_parser():
    kinds = lambda q: [t.kind for t in ql.lex(q)]
    assert kinds('title:x AND (a OR "b c") NOT \'d\'') == ["TITLE", "AND", "(", "WORD", "OR", "QUOTE", ")", "NOT", "PHRASE", "EOF"]
    assert kinds("title: x and") == ["WORD", "WORD", "WORD", "EOF"]
    assert str(ql.parse("a b OR c")) == "OR(AND(TERM(a), TERM(b)), TERM(c))"
    assert str(ql.parse("a NOT b")) == "AND(TERM(a), NOT(TERM(b)))"
    for bad in ("", "(", "a )", "AND", "a OR", '"x', "'x", "NOT"):
        with pytest.raises(ql.QueryError):
            ql.parse(bad)
    long = " OR ".join(f"w{i}" for i in range(3000))
    assert len(ql.parse(long).of) == 3000


def test_one_scan_and_one_shuffle(index):
    plan = ql.matches(index, "alpha AND (beta OR NOT gamma) delta")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 0


def test_distance(index):
    assert {r.doc_id for r in ql.distance(index, "alpha", "beta", 2).collect()} == {1}


def test_bm25_values(spark):
    f = lambda tf, df, n: spark.range(1).select(rank.bm25(F.lit(tf), F.lit(df), F.lit(n), F.lit(10), F.lit(10.0)).alias("s")).first().s
    assert f(3, 10, 1000) == 1.0 and abs(f(3, 400, 1000) - 0.10608) < 1e-4 and f(3, 0, 1000) == 0.0 and f(1, 900, 1000) < 0


@pytest.mark.parametrize(
    "url,static,crawl",
    [
        ("https://example.com/", 2500 / 3000, 120), ("http://sub.example.com/", 2200 / 3000, 45), ("https://en.wikipedia.org/wiki/Cat", None, None), ("https://x.com/file.pdf", None, -100),
        ("https://www.x.com/a/b/c/d/e?q=1&r=2&s=3", None, None), ("http://h4x.net/12345", None, None),
    ],
)
def test_url_ranks(spark, url, static, crawl):
    r = spark.range(1).select(static_rank(F.lit(url)).alias("s"), crawl_rank(F.lit(url)).alias("c")).first()
    assert static is None or abs(r.s - static) < 1e-9
    assert crawl is None or r.c == crawl
    assert r.c == -100 or r.c >= 0


def test_search_order_and_scores(index):
    rows = rank.search(index, "alpha beta").collect()
    assert [(-r.score, -r.doc_id) for r in rows] == sorted((-r.score, -r.doc_id) for r in rows)
    assert all(0 <= r.score <= 10000 for r in rows) and {r.doc_id for r in rows} == {0, 1, 2, 5, 6}
    assert len(rank.search(index, "alpha", k=2).collect()) == 2 and rank.search(index, "the").collect() == []


def test_missing_document_scores_nothing(spark, index):
    f = rank.features(index, "alpha", spark.createDataFrame([(99,)], "doc_id long"))
    assert f.select(rank.dynamic_score().alias("s")).first().s == 0


def test_ordered_title(spark):
    v = lambda title, toks: spark.createDataFrame([(title,)], "t array<string>").select(rank.ordered_title(F.col("t"), toks).alias("v")).first().v
    assert v(["Big", "cat"], ["big", "cats"]) == 1.0 and v(["cat", "Big"], ["big", "cats"]) == 0.5 and v([], ["a"]) == 0.0
    assert math.isclose(v(["b", "c"], ["bee", "cee", "dee"]), 2 / 3)


def test_lists_of_results_merge(spark):
    a, b = ([(i, i * 7 % 10) for i in x] for x in (range(0, 20, 2), range(1, 20, 2)))
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, score int")
    got = [(r.doc_id, r.score) for r in rank.merge_top([df(a), df(b)], 6).collect()]
    assert got == sorted(a + b, key=lambda r: (-r[1], -r[0]))[:6]


def test_a_syntax_nodes_and_readers_of_ones_own(index):
    own = ql.Syntax(operators=(("und", "AND"), ("oder", "OR"), ("nicht", "NOT")), fields=("title",), stop_words=frozenset({"alpha"}))
    both = lambda q, s=own: {r.doc_id for r in ql.matches(index, q, s).collect()}
    assert both("gamma oder epsilon") == {0, 1, 3} and both("beta nicht gamma") == {2, 5, 6} and both("alpha") == set() and both("gamma AND") == set()

    class Either(ql.Node):
        def tree(self, stop_words):
            return ql.rewrite(ql.Many("OR", (ql.Term("gamma"), ql.Term("epsilon"))), stop_words)

    even = ql.Reader("even", lambda i: i.doc_map.filter("doc_id % 2 = 0").select("doc_id"))
    assert both(ql.Many("AND", (Either(), ql.Term("alpha"))), ql.Syntax()) == {0, 1, 3}
    assert both(ql.Many("AND", (even, ql.Term("alpha"))), ql.Syntax()) == {0, 2, 6} and both(ql.Not(even), ql.Syntax()) == {1, 3, 5} and both(even, ql.Syntax()) == {0, 2, 4, 6}
    assert both(ql.Many("AND", (even, ql.Quote("beta alpha"))), ql.Syntax()) == {2}


def test_token_counts():
    assert ql.token_counts('a b a "x y" \'z\' title:a AND "x y"') == {"a": 2, "b": 1, "x y": 2}


def test_weights_from_a_file(index):
    from lodestone.sources import config

    w = config.ranking_weights("# presence\nquery_in_title: 7\nbm25: 1.5\n\npagerank: 3\n")
    assert w == rank.WEIGHTS | {"in_title": 7.0, "bm25": 1.5, "pagerank": 3.0}
    assert rank.search(index, "alpha", weights=w).count() == 6
    assert config.static_points("HttpsScore: 1\nDepthPagePenalty: 2")["depth_step"] == 2
    for bad in ("nothing", "what: 1", "bm25: x"):
        with pytest.raises(config.ConfigError):
            config.ranking_weights(bad)


def test_a_crawl_from_a_file(tmp_path):
    from lodestone.sources import config

    (tmp_path / "seeds").write_text("# start\nhttps://a.com/\n\nhttps://b.com/\n")
    text = "docs_directory=d\nstate_directory = s\n# c\nsnapshot_directory=n\nseed_url_file=seeds\nseed_url=https://c.com/?a=b\nblacklist_host=x.org\nratelimit_bucket_count=5\nworkers=2\nmiddle_queue.utilization_target=0.5\n"
    c = config.crawl_config(text, str(tmp_path))
    assert (c.docs, c.state, c.snapshot, c.window_requests, c.utilization, c.other["workers"]) == ("d", "s", "n", 5, 0.5, "2")
    assert c.seeds == ["https://a.com/", "https://b.com/", "https://c.com/?a=b"] and c.blocked_hosts == ["x.org"]
    for bad in ("", text.replace("=d", "="), text + "x=1", text + "workers=0", text + "ratelimit_bucket_ms=a", text + "line"):
        with pytest.raises(config.ConfigError):
            config.crawl_config(bad, str(tmp_path))


def test_the_index_is_stored_once(spark, tmp_path):
    from lodestone.plans import catalogue

    sf = "/root/testdata/sf0.001"
    a = catalogue._index(spark, sf)
    n = len(catalogue._stored)
    plan = catalogue._index(spark, sf).find("thon")._jdf.queryExecution().toString()
    assert len(catalogue._stored) == n and "PushedFilters" in plan and "EqualTo(token,thon)" in plan and "MapInArrow" not in plan
    assert a.positions.count() == catalogue._index(spark, sf).positions.count() > 0
