import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import frontier, graph, metrics, snippets
from lodestone.sources import corpus
from lodestone.streaming import crawl


def test_frontier(spark):
    raw = ["http://a.com/x", "http://a.com/x#f", "http://A.com:80/x", "http://b.fr/y", "http://a.com/search?q=1", "bad", "http://c.com/f.pdf"]
    fresh = frontier.fresh(spark.createDataFrame([(u,) for u in raw], "url string"), spark.createDataFrame([("http://b.fr/y",)], "url string"))
    assert {r.url for r in fresh.collect()} == {"http://a.com/x", "http://c.com/f.pdf"}
    assert {r.url for r in frontier.score(fresh).collect()} == {"http://a.com/x"}
    hosts = spark.createDataFrame([("a.b.fr",), ("fr.com",), ("b.fr",), ("fr",)], "host string")
    assert {r.host for r in frontier.not_blocked(hosts, spark.createDataFrame([("fr",)], "host string")).collect()} == {"fr.com"}
    many = spark.createDataFrame([(f"u{i}", f"h{i % 3}", i) for i in range(90)], "url string, host string, score int")
    assert frontier.host_quota(many).count() == 75
    turns = frontier.round_robin(many, 2).collect()
    assert [r.turn for r in turns] == [1, 1, 1, 2, 2, 2] and [r.score for r in turns[:3]] == [87, 88, 89]
    popped = frontier.random_pop(many.withColumn("score", F.col("score") + 50), 20)
    assert popped.count() == 20 and popped.filter("score >= 90").count() == 18
    parts = frontier.dispatch(spark.createDataFrame([(200, None, "h"), (301, "http://x", None), (404, None, "h"), (200, None, None)], "status int, location string, html string"))
    assert (parts["parse"].count(), parts["push"].count(), parts["drop"].count()) == (1, 1, 2)


def brute(rows, count, window):
    state, out = {}, {}
    for e, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        start, used = state.get(k, (None, 0))
        if start is None or t - start >= window:
            start, used = t, 0
        out[e] = window - (t - start) if used >= count else 0
        state[k] = (start, used + (used < count))
    return out


def requests():
    rng = random.Random(3)
    return [(i, f"k{rng.randint(0, 4)}", i * 37 + rng.randint(0, 30)) for i in range(400)]


def test_rate_limit_by_batch_and_stream(spark, tmp_path):
    rows = requests()
    want = brute(rows, 4, 1000)
    df = spark.createDataFrame(rows, "event_id long, key string, ts_ms long")
    assert {r.event_id: r.wait_ms for r in frontier.rate_limit(df, "key", 4, 1000).collect()} == want
    for part in range(3):
        spark.createDataFrame(rows[part * 150 : part * 150 + 150], df.schema).coalesce(1).write.parquet(f"{tmp_path}/in/b={part}")
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/b=*")
    q = crawl.rate_limited(s, 4, 1000).writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.event_id: r.wait_ms for r in spark.table("limited").collect()}
    assert got == want


def test_cooldown_by_batch_and_stream(spark, tmp_path):
    rows = requests()
    last, want = {}, {}
    for e, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        want[e] = max(0, last[k] + 150 - t) if k in last else 0
        last[k] = last[k] if want[e] else t
    df = spark.createDataFrame(rows, "event_id long, key string, ts_ms long")
    assert {r.event_id: r.wait_ms for r in frontier.cooldown(df, "key", 150).collect()} == want
    for part in range(3):
        spark.createDataFrame(rows[part * 150 : part * 150 + 150], df.schema).coalesce(1).write.parquet(f"{tmp_path}/in/b={part}")
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/b=*")
    crawl.cooled(s, 150).writeStream.format("memory").queryName("cooled").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert {r.event_id: r.wait_ms for r in spark.table("cooled").collect()} == want


def test_requests_without_key_or_time(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "a", None), (3, "a", 7), (4, "a", 8)], "event_id long, key string, ts_ms long")
    assert {r.event_id: r.wait_ms for r in frontier.rate_limit(df, "key", 1, 10).collect()} == {1: None, 2: None, 3: 0, 4: 9}
    assert frontier.cooldown(df.limit(0), "key", 5).collect() == []


def test_stream_dedupe_is_batch_dedupe(spark, tmp_path):
    raw = [(f"http://h{i % 7}.com/p{i % 11}#f{i}",) for i in range(200)]
    for part in range(4):
        spark.createDataFrame(raw[part::4], "url string").coalesce(1).write.parquet(f"{tmp_path}/in/b={part}")
    s = spark.readStream.schema("url string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/b=*")
    q = crawl.fresh_urls(s).writeStream.format("memory").queryName("fresh").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [r.url for r in spark.table("fresh").collect()]
    assert sorted(got) == sorted(r.url for r in frontier.fresh(spark.createDataFrame(raw, "url string")).collect())


def test_urls_wait_for_their_rules(spark, tmp_path):
    known: list[str] = []

    def rules_of():
        return spark.createDataFrame([(h,) for h in known], "host string"), spark.createDataFrame([("a", "disallow", "^/no[^/]*(/|$)", 3)], "host string, type string, regex string, length int")

    schema = "host string, url string, path string"

    def run(rows, n):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b={n}")
        s = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/b=*")
        crawl.push(s.select("host", "url", "path"), str(tmp_path), rules_of, f"{tmp_path}/c", scorer=lambda u: F.lit(1)).trigger(availableNow=True).start().awaitTermination()

    run([("a", "a/yes", "/yes"), ("a", "a/no", "/no"), ("b", "b/x", "/x")], 0)
    known += ["a"]
    run([("b", "b/y", "/y")], 1)
    assert {r.url for r in spark.read.parquet(f"{tmp_path}/queue").collect()} == {"a/yes"}
    known += ["b"]
    run([("c", "c/z", "/z")], 2)
    assert {r.url for r in spark.read.parquet(f"{tmp_path}/queue").collect()} == {"a/yes", "b/x", "b/y"}
    run([("a", "a/z", "/z")], 3)
    assert sorted(r.url for r in spark.read.parquet(f"{tmp_path}/queue").collect()) == ["a/yes", "a/z", "b/x", "b/y"]


def test_the_crawl_as_one_stream_goes_on_after_a_restart(spark, tmp_path):
    known = ["a.com"]

    def rules_of():
        return spark.createDataFrame([(h,) for h in known], "host string"), spark.createDataFrame([("a.com", "disallow", "^/no[^/]*(/|$)", 3)], "host string, type string, regex string, length int")

    seen = spark.createDataFrame([("https://a.com/old",)], "url string")
    blocked = spark.createDataFrame([("bad.org",)], "host string")

    def run(urls, n):
        spark.createDataFrame([(u,) for u in urls], "url string").coalesce(1).write.parquet(f"{tmp_path}/in/b={n}")
        s = spark.readStream.schema("url string").parquet(f"{tmp_path}/in/b=*")
        crawl.crawl(s.select("url"), f"{tmp_path}/t", rules_of, f"{tmp_path}/c", seen=seen, blocked=blocked).trigger(availableNow=True).start().awaitTermination()

    queue = lambda: sorted(r.url for r in spark.read.parquet(f"{tmp_path}/t/queue").collect())
    run(["https://a.com/x", "https://a.com/x#f", "https://A.com:443/x", "https://a.com/old", "https://a.com/no", "https://www.bad.org/y", "nonsense", "https://b.com/1"], 0)
    assert queue() == ["https://a.com/x"]
    known.append("b.com")  # each run is a new query on the same checkpoint: what was seen and what waits is remembered
    run(["https://a.com/x", "https://b.com/1", "https://b.com/2"], 1)
    assert queue() == ["https://a.com/x", "https://b.com/1", "https://b.com/2"]
    next_ = crawl.next_urls(spark.read.parquet(f"{tmp_path}/t/queue"), spark.createDataFrame([("https://b.com/1",)], "url string"), per_host=1)
    assert sorted(r.url for r in next_.collect()) == ["https://a.com/x", "https://b.com/2"]


def test_rules_of_a_stream(spark, tmp_path):
    spark.createDataFrame([("a", "u1", "/no/x"), ("a", "u2", "/yes"), ("b", "u3", "/no/x")], "host string, url string, path string").write.parquet(f"{tmp_path}/in")
    rules = spark.createDataFrame([("a", "disallow", "^/no[^/]*(/|$)", 3)], "host string, type string, regex string, length int")
    s = spark.readStream.schema("host string, url string, path string").parquet(f"{tmp_path}/in")
    crawl.with_rules(s, rules).writeStream.format("memory").queryName("ruled").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert {r.url for r in spark.table("ruled").collect()} == {"u2", "u3"}


def test_a_short_class_is_filled_from_the_other(spark):
    few = spark.createDataFrame([(f"u{i}", 95 if i < 3 else i % 80) for i in range(40)], "url string, score int")
    got = frontier.random_pop(few, 20).collect()
    assert len(got) == len({r.url for r in got}) == 20 and sum(r.score >= 90 for r in got) == 3
    assert {r.url for r in frontier.random_pop(few, 20).collect()} == {r.url for r in got} != {r.url for r in frontier.random_pop(few, 20, seed=1).collect()}
    assert frontier.random_pop(few, 100).count() == 40 and frontier.random_pop(few.limit(0), 5).count() == 0
    many = spark.range(20_000).select(F.concat(F.lit("http://x/"), "id").alias("url"))
    assert abs(frontier.admit(many, 2500).count() - 5000) < 300 and frontier.admit(many, 0).count() == 0 and frontier.admit(many, 10_000).count() == 20_000


def test_scorer_and_filter_of_ones_own(spark):
    u = spark.createDataFrame([("http://a.com/x",), ("http://a.com/y",), ("http://b.com/x",)], "url string")
    got = frontier.score(u, scorer=lambda c: F.when(c.endswith("y"), -1).otherwise(7), keep=F.col("url").contains("//a"))
    assert [(r.url, r.score) for r in got.collect()] == [("http://a.com/x", 7)]


def test_pagerank_against_plain_python(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randint(0, 20)}", f"n{rng.randint(0, 25)}") for _ in range(120)]
    df = spark.createDataFrame(edges, "src string, dst string")
    nodes = sorted({x for e in edges for x in e})
    r = {n: 1 / len(nodes) for n in nodes}
    deg = {n: sum(s == n for s, _ in edges) for n in nodes}
    for _ in range(5):
        new = {n: 0.15 / len(nodes) for n in nodes}
        for s, d in edges:
            new[d] += 0.85 * r[s] / deg[s]
        r = new
    got = {x.node: x.rank for x in graph.pagerank(df, iterations=5).collect()}
    assert got.keys() == r.keys() and all(abs(got[n] - r[n]) < 1e-12 for n in r)
    assert sum(x.rank for x in graph.pagerank(df).collect()) <= 1 + 1e-9
    std = [x.std_rank for x in graph.standardized(graph.pagerank(df, iterations=2)).collect()]
    assert min(std) == 0.0 and max(std) == 1.0
    same = graph.standardized(spark.createDataFrame([("a", 0.5), ("b", 0.5)], "node string, rank double"))
    assert {x.std_rank for x in same.collect()} == {0.0}
    assert graph.pagerank(df.limit(0)).collect() == []
    graph.HUB, hub = 3, graph.HUB  # sources in several parts give the same ranks
    try:
        parts = {x.node: x.rank for x in graph.pagerank(df, iterations=5).collect()}
    finally:
        graph.HUB = hub
    assert parts.keys() == got.keys() and all(abs(parts[k] - got[k]) < 1e-12 for k in got)
    hosts = graph.domain_edges(spark.createDataFrame([("http://a.com/x", "https://b.com/y/z"), ("http://a.com/", "http://a.com/q")], "src string, dst string"))
    assert sorted((r.src, r.dst) for r in hosts.collect()) == [("http://a.com", "http://a.com"), ("http://a.com", "https://b.com")]


def test_edges_stay_where_they_are(spark):
    t, name = graph._bucketed(spark.createDataFrame([(f"s{i % 5}", f"d{i}") for i in range(50)], "src string, dst string"))
    ranks = t.select("src", "part").distinct().withColumn("rank", F.lit(1.0))
    plan = t.join(ranks.hint("merge"), ["src", "part"])._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "SelectedBucketsCount" in plan
    spark.sql(f"DROP TABLE {name}")


def test_snippets(spark):
    v = lambda t, terms: spark.createDataFrame([(t,)], "t string").select(snippets.snippet(F.col("t"), terms).alias("s")).first().s
    assert v(None, ["cat"]) == "No preview available" and v("", ["cat"]) == "No content available" and v("short text", ["zebra"]) == "short text"
    long = "x" * 300 + ". Start here " + "y" * 20 + " the CAT sat " + "z" * 200 + "! After " + "w" * 300
    got = v(long, ["at", "cat"])
    assert got.startswith("...") and got.endswith("...") and "CAT sat" in got
    assert v("a" * 80 + ". rest " + "b" * 100, ["zzz"]) == "a" * 80 + "...."
    df = spark.createDataFrame([("The cat and cats",)], "t string")
    assert df.select(snippets.highlight(F.col("t"), "cat AND the").alias("s")).first().s == '<span class="highlight">The</span> <span class="highlight">cat</span> and cats'
    one = snippets.result_json(spark.createDataFrame([(1, 5, "u", "t", 's"q'), (2, 9, "v", "t", "s")], "doc_id long, score int, url string, title string, snippet string"), 2, 7).first().json
    assert one == '{"results":[{"id":2,"url":"v","title":"t","snippet":"s"},{"id":1,"url":"u","title":"t","snippet":"s\\"q"}],"total":2,"time_ms":7}'
    assert snippets.calculate(spark, "2 * (3+4)") == 14.0 and snippets.calculate(spark, "cats + dogs") is None and snippets.calculate(spark, "2 +") is None


def test_result_cache():
    now = [0.0]
    c = snippets.ResultCache(most=2, seconds=10, clock=lambda: now[0])
    c.put("a", 1), c.put("b", 2), c.put("c", 3)
    assert c.get("a") is None and c.get("b") == 2
    now[0] = 11
    assert c.get("c") is None


def test_metrics(spark):
    e = spark.createDataFrame([("a", 1.0, 1), ("a", 7.0, 2), ("b", None, 3), ("a", 100.0, 0)], "l string, v double, t int")
    h = {(r.l, r.le): r["count"] for r in metrics.histogram(e, "v", metrics.linear_buckets(1, 6, 2), ["l"]).collect()}
    assert h == {("a", "1"): 1, ("a", "7"): 2, ("a", "+Inf"): 3}
    assert metrics.exponential_buckets(1, 2, 4) == [1, 2, 4, 8]
    assert {r.l: r.value for r in metrics.gauge(e, ["l"], "v", ["t"]).collect()} == {"a": 7.0, "b": None}
    assert {r.l: r.value for r in metrics.counter(e, ["l"]).collect()} == {"a": 3, "b": 1}


def test_documents_round_trip_and_ids(spark, tmp_path):
    d = corpus.text_documents(spark, "/root/testdata/sf0.001")
    corpus.write_documents(d, f"{tmp_path}/d")
    back = corpus.read_documents(spark, f"{tmp_path}/d")
    assert sorted(map(repr, back.select("doc_id", "url", "words").collect())) == sorted(map(repr, d.select("doc_id", "url", "words").collect()))
    n = corpus.numbered(d, 5).select("doc_id", "url").orderBy("url").collect()
    assert [r.doc_id for r in n] == list(range(5, 5 + len(n)))


@pytest.mark.parametrize("shared", [True, False])
def test_result_shaping(spark, shared):
    r = spark.createDataFrame([("q", i + 1, u) for i, u in enumerate(["http://a.com/1", "http://a.com/2", "http://b.com/", "http://a.com/3", "http://www.a.com/1/"])], "query string, rank int, url string")
    if shared:
        assert [x.grp for x in frontier.domain_groups(r).orderBy("rank").collect()] == [1, 1, 3, 4, 5]
    else:
        assert [x.rank for x in frontier.distinct_results(r).orderBy("rank").collect()] == [1, 2, 3, 4]


def test_places_across_ranges(spark):
    rng = random.Random(4)
    rows = [(f"u{i}", "hot" if i % 3 else rng.choice(["a", "b", None]), rng.randint(0, 9)) for i in range(900)]
    df = spark.createDataFrame(rows, "url string, host string, score int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that a key lies in several ranges
    try:
        got = {r.url: r.turn for r in frontier.placed(df, "host", [F.desc("score"), F.asc("url")], "turn").collect()}
        assert frontier.placed(df.limit(0), "host", [F.asc("url")], "turn").collect() == []
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for host in ("hot", "a", "b", None):
        want |= {u: i for i, (u, _, _) in enumerate(sorted((r for r in rows if r[1] == host), key=lambda r: (-r[2], r[0])), 1)}
    assert got == want


def test_all_steps_of_a_graph_that_fits_in_one_task(spark, monkeypatch):
    """One task and buckets give the same ranks, over chunks and partitions; and one task needs as many jobs for 3 steps as for 60."""
    rng = random.Random(7)
    edges = spark.createDataFrame([(f"n{rng.randint(0, 40)}", f"n{rng.randint(0, 60)}") for _ in range(500)] + [("a", None), (None, "b"), ("loop", "loop")], "src string, dst string")
    monkeypatch.setattr(graph, "CHUNK", 64)
    tracker = spark.sparkContext.statusTracker()

    def run(**how):
        spark.sparkContext.setJobGroup(name := str(rng.random()), "")
        got = {r.node: r.rank for r in graph.pagerank(edges, **how).collect()}
        return got, len(tracker.getJobIdsForGroup(name))

    (few, jobs), (many, as_many), (done, _) = run(iterations=3), run(iterations=60), run()
    assert jobs == as_many
    monkeypatch.setattr(graph, "ONE", 0)
    for got, how in ((few, {"iterations": 3}), (done, {})):
        want, _ = run(**how)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert many.keys() == done.keys()
