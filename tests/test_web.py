import pytest
from pyspark.sql import functions as F

from lodestone.functions import html, urls
from lodestone.operators import robots


def col(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "url,want",
    [
        ("http://a.b", ("http", "a.b", "", "")), ("HTTPS://A.b:8443/p?q#f", ("https", "A.b", "8443", "/p?q#f")), ("http://x?q=1", ("http", "x", "", "?q=1")), ("ftp://a.b/", None),
        ("http:/a.b", None), ("//a.b", None), ("http://", None), ("http://-a.b/", None), ("http://a-.b/", None), ("http://a..b/", None), ("http://.a/", None), ("http://a.b:/", None),
        ("http://a.b:0/", None), ("http://a.b:65535/", ("http", "a.b", "65535", "/")), ("http://a.b:65536/", None), ("http://a.b:x/", None), ("http://[::1]/", None), ("http://a_b.c/", None),
        ("http://" + "a" * 63 + ".com/", ("http", "a" * 63 + ".com", "", "/")), ("http://" + "a" * 64 + ".com/", None), ("", None), ("http://a b/", None),
    ],
)
def test_parse(spark, url, want):
    r = col(spark, url, urls.parse)
    assert (r and (r.scheme, r.host, r.port, r.path)) == want


@pytest.mark.parametrize(
    "url,want",
    [
        ("HTTP://Ex.COM", "http://ex.com/"), ("http://ex.com:80/", "http://ex.com/"), ("https://ex.com:443", "https://ex.com/"), ("https://ex.com:80/", "https://ex.com:80/"),
        ("http://ex.com//a///b", "http://ex.com/a/b"), ("http://ex.com/a/./b/../c", "http://ex.com/a/c"), ("http://ex.com/../a", "http://ex.com/../a"), ("http://ex.com/a#frag", "http://ex.com/a"),
        ("http://ex.com/?utm_source=x&b=2&a=1", "http://ex.com/?a=1&b=2"), ("http://ex.com/?ref=1", "http://ex.com/"), ("http://ex.com/?", "http://ex.com/"), ("http://ex.com?x=1", "http://ex.com/?x=1"),
        ("http://ex.com/?a=&b", "http://ex.com/?a&b"), ("http://ex.com/A?B=c", "http://ex.com/A?B=c"), ("http://ex.com/a/", "http://ex.com/a/"), ("http://ex.com/a/..", "http://ex.com"),
    ],
)
def test_canonical(spark, url, want):
    assert col(spark, url, lambda c: urls.canonical(urls.parse(c))) == want


@pytest.mark.parametrize("s,enc", [("/a b", "/a%20b"), ("/a?b=c&d/e", "/a?b=c&d%2Fe"), ("/a&b=c", "/a%26b%3Dc"), ("/é", "/%C3%A9"), ("/a?b?c", "/a?b%3Fc"), ("", "")])
def test_percent_coding(spark, s, enc):
    assert urls.encode_path_py(s) == enc and col(spark, s, urls.encode_path) == enc


@pytest.mark.parametrize("s,dec", [("%41", "A"), ("%2F", "%2F"), ("%C3%A9", "é"), ("%zz", "%zz"), ("%4", "%4"), ("a+b", "a+b"), ("%e9", "%e9"), ("100%", "100%")])
def test_decode(spark, s, dec):
    assert urls.decode_url_py(s) == dec and col(spark, s, urls.decode_url) == dec


@pytest.mark.parametrize(
    "href,base,want",
    [
        ("/x", "", "http://h.com:81/x"), ("y", "", "http://h.com:81/a/y"), ("../y", "", "http://h.com:81/y"), ("//o.org/z", "", "http://o.org/z"), ("https://o.org", "", "https://o.org"), ("#top", "", None),
        ("mailto:a@b", "", None), ("javascript:1", "", None), ("", "", None), ("y", "/b/c", "http://h.com:81/b/y"), ("y", "https://o.org/d/e", "http://h.com:81/d/y"), ("y", "sub/", "http://h.com:81/sub/y"), ("?q", "", "http://h.com:81/a/?q"),
    ],
)
def test_absolute_link(spark, href, base, want):
    df = spark.createDataFrame([(href, base)], "h string, b string")
    assert df.select(urls.absolute_link(urls.parse(F.lit("http://h.com:81/a/p")), F.col("b"), F.col("h")).alias("r")).first().r == want


def test_small_url_functions(spark):
    assert col(spark, "/a/b.html?x=1.y#z", urls.extension) == "html" and col(spark, "/a.b/c", urls.extension) == "" and col(spark, "a.b.example.com", urls.base_host) == "example.com"
    assert col(spark, "https://WWW.a.com/x/", urls.result_url) == "https://a.com/x" and col(spark, "nope/", urls.result_url) == "nope/"
    assert [col(spark, x, urls.language_ok) for x in ("", None, "EN", "en-US", "en_GB", "eng", "de")] == [True, True, True, True, True, False, False]
    assert [col(spark, x, urls.mime_ok) for x in ("text/html; charset=utf-8", "TEXT/HTML", "text/plain")] == [True, True, False]
    assert col(spark, "A.b.C", urls.host_suffixes) == ["c", "b.c", "a.b.c"]
    assert [col(spark, x, urls.valid_url) for x in ("http://a.b", "short", "http://a.b/ c", "http://a.b/é")] == [True, False, False, False]


@pytest.mark.parametrize("s,want", [("a&amp;b", "a&b"), ("&#65;&#x42;", "AB"), ("&#160;", " "), ("&nope;", "&nope;"), ("&#xZZ;", "&#xZZ;"), ("&#1114112;", "&#1114112;"), ("&amp", "&amp"), ("&;", "&;"), ("&copy;&frac12;", "©½"), ("&nbsp;", " ")])
def test_entities(s, want):
    assert html.decode_entities(s) == want


PAGE = """<!DOCTYPE html><HTML lang="en-US"><head><title>My &amp; title</title><base href="/base/"><base href="/no/"><meta name="description" content="A &lt;b&gt; desc">
<meta property="og:x" content="y"><meta name="robots" content="noindex, nofollow"><style>p { color: red } </style></head><body>One<b>two</b>three <!-- no <p> -- here -->
<script>var x = "<p>"; if (a < b) {}</script><a href="/l?a=1&amp;b=2">link <i>text</i></a><a name=x>plain</a><embed src="/e.swf"><unknown>word</unknown>four&nbsp;five<a href='/open'>end</body></html>"""


def test_html_scanner(spark):
    h = html.parse_html(PAGE)
    assert h["title"] == ["My", "&", "title"] and h["lang"] == "en-US" and h["base"] == "/base/"
    assert h["metas"] == {"description": "A <b> desc", "og:x": "y", "robots": "noindex, nofollow"}
    assert h["words"] == ["One", "two", "three", "link", "text", "plain", "word", "four", "five", "end"]
    assert [(x["url"], x["anchor"]) for x in h["links"]] == [("/l?a=1&b=2", ["link", "text"]), ("/e.swf", []), ("/open", ["end"])]
    assert col(spark, PAGE, html.parsed_html).words == h["words"]
    for odd in (None, "", "<", "<a", "a < b", "<title>", "<script>x", "<!-- open", "<a href=", "<a href='x", "<p title='>'>z</p>", "</", "<script>a</scriptx>b</script>c"):
        html.parse_html(odd)
    assert html.parse_html("<p title='>'>z</p>")["words"] == ["z"] and html.parse_html("<script>a</scriptx>b</script>c")["words"] == ["c"]
    assert len(html.parse_html("<a href='/x'>y</a>" * 6000)["links"]) == 6000 and len(html.parse_html("<a href='/x'>y</a>" * 6000, 5000)["links"]) == 5000


def test_pages_that_are_indexed(spark):
    ok = "<html lang='en'><title>T</title><body>words <a href='x'>l</a><a href='/search?q'>s</a>"
    rows = [(1, "http://a.com/p/", ok), (2, "http://a.com/p/", ok.replace("'en'", "'de'")), (3, "bad", ok), (4, "http://b.com", ok.replace("<title>T</title>", "")), (5, "http://c.com", ok.replace("<body>", "<meta name='robots' content='noindex'>"))]
    got = html.page_documents(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [(r.doc_id, r.url, r.forward_links) for r in got] == [(1, "http://a.com/p/", ["http://a.com/p/x"])]


def allowed(spark, disallow, allow, path):
    rules = spark.createDataFrame([("h", t, v) for t, vs in (("disallow", disallow), ("allow", allow)) for v in vs], "host string, type string, value string")
    return robots.allowed(spark.createDataFrame([("h", path)], "host string, path string"), robots.compiled(rules)).first().allowed


@pytest.mark.parametrize(
    "disallow,allow,path,want",
    [
        (["/find/"], [], "/find/", False), (["/find/"], [], "/find/x", False), (["/find/"], [], "/finder", True), (["/"], [], "/any/thing", False), (["/p"], [], "/pq/r", False), (["/priv/*"], [], "/priv/", False),
        (["/priv/*"], [], "/pub", True), (["/a/"], ["/a/"], "/a/b", True), (["/a/", "/a/b/c/"], ["/a/b/"], "/a/b/c/", False), (["/a/", "/a/b/c/"], ["/a/b/"], "/a/b/d", True), (["/v/*/docs"], [], "/v/1/docs", False),
        (["/v/*/docs"], [], "/v/1/2/docs", True), (["/x*y/"], [], "/x1y/", True), (["/t*/"], [], "/t1/", True), (["/S:*"], ["/S:Ok"], "/S:no", False), (["/S:*"], ["/S:Ok"], "/S:Ok", True), (["/S:*"], [], "/S", True), ([""], [], "/", True),
        (["/" + "/".join("a" * 1 for _ in range(60))], [], "/a", True), (["/a.b"], [], "/aXb", True), (["/*/adm/*"], [], "/us/adm/x", False),
    ],
)
def test_robots_paths(spark, disallow, allow, path, want):
    assert allowed(spark, disallow, allow, path) == want


def test_robots_groups_and_lines(spark):
    txt = "# c\nUser-agent: Other\nDisallow: /o\n\nUSER-AGENT: bot\nUser-agent: x\nDisallow : /b # why\nCrawl-delay: 3\nAllow:\nUser-agent: *\nDisallow: /all\nnonsense\n"
    got = robots.rules(spark.createDataFrame([("h", txt)], "host string, txt string"), "Bot").orderBy("n").collect()
    assert [(r.type, r.value) for r in got] == [("disallow", "/b"), ("crawl-delay", "3"), ("disallow", "/all")]
    s = spark.createDataFrame([(200, "text/plain; x"), (200, "text/html"), (404, None), (500, None), (None, None)], "s int, t string")
    assert [r.p for r in s.select(robots.status_policy(F.col("s"), F.col("t")).alias("p")).collect()] == ["parse", "allow_all", "allow_all", "disallow_all", "disallow_all"]
    assert [col(spark, x, robots.crawl_delay_ms, "long") for x in (None, 0, 5, 100)] == [1000, 1000, 5000, 30000]


def test_responses(spark):
    from lodestone.functions import http

    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=x\r\nX: 1\r\nx:  2 \r\nbroken\r\nLocation: http://a:80/b\r\n"
    r = col(spark, head, http.parse_response)
    assert r.status == 200 and r.headers == {"content-type": "text/html; charset=x", "x": "2", "location": "http://a:80/b"}
    assert col(spark, "nonsense", http.parse_response) is None and col(spark, None, http.parse_response) is None
    ok = lambda h, body: spark.createDataFrame([(h, body)], "h string, b string").select(http.acceptable(http.parse_response(F.col("h")), F.col("b")).alias("r")).first().r
    assert ok(head, "x") and ok(head, "x" * 9) and not ok("HTTP/1.1 200 OK\nContent-Type: image/png", "x") and not ok(head + "Content-Language: de\r\n", "x")
    assert col(spark, "a+b%20c", http.form_decode) == "a b c"


def test_links_to_blocked_hosts_are_left_out(spark):
    doc = "<html lang='en'><title>T</title>w <a href='http://bad.org/1'>x</a><a href='http://sub.bad.org/2'>x</a><a href='http://notbad.org/3'>x</a>"
    got = html.page_documents(spark.createDataFrame([(1, "http://a.com/", doc), (2, None, doc), (3, "http://a.com/n", None)], "page_id long, url string, html string"), blocked_hosts=("bad.org",)).collect()
    assert [(r.doc_id, r.forward_links) for r in got] == [(1, ["http://notbad.org/3"])]
    few = html.page_documents(spark.createDataFrame([(1, "http://a.com/", doc)], "page_id long, url string, html string"), max_links=1).collect()
    assert len(few[0].forward_links) == 1 and html.page_documents(spark.createDataFrame([(1, "http://a.com/", doc)], "page_id long, url string, html string"), max_bytes=10).count() == 0


def test_tag_actions():
    assert [html.tag_action(t) for t in ("A", "script", "Style", "title", "p", "made-up", "!--")] == ["anchor", "section", "section", "title", "discard", "discard", "comment"]


def test_rules_of_long_files(spark):
    txt = "User-agent: *\nDisallow: /é" + "\nDisallow: /b"
    f = spark.createDataFrame([("h", txt), ("n", None)], "host string, txt string")
    at = len("User-agent: *\nDisallow: /é".encode())
    assert [r.value for r in robots.rules(f, "x").orderBy("n").collect()] == ["/é", "/b"] and [r.value for r in robots.rules(f, "x", max_bytes=at).collect()] == ["/é"]


def test_rules_expire(spark):
    from datetime import datetime

    d = spark.createDataFrame([(datetime(2020, 1, 1), False), (datetime(2020, 1, 1), True)], "t timestamp, failed boolean")
    assert [r.e.hour for r in d.select(robots.expires(F.col("t"), F.col("failed")).alias("e")).collect()] == [robots.TTL_HOURS, robots.FAILED_HOURS]


def test_titles_json_and_stop_words(spark):
    import json

    from lodestone.functions import text as tx

    d = spark.createDataFrame([(["a"] * 16,), (["a", "b"],), ([],), (None,)], "t array<string>")
    assert [r.s for r in d.select(tx.short_title(F.col("t")).alias("s")).collect()] == [" ".join(["a"] * 15) + "...", "a b", "Untitled Document", "Untitled Document"]
    odd = 'a"b\\c\n\u0001é'
    assert json.loads(col(spark, odd, tx.json_text)) == {"v": odd}
    w = tx.StopWords(frozenset({"the"})).add("of")
    assert "the" in w and "of" in w and w.current() == {"the", "of"} and "the" not in w.remove("the")
    w.enabled = False
    assert "of" not in w and w.current() == frozenset()


def test_snippet_at_places(spark):
    from lodestone.operators import snippets

    text = "One. " + "x " * 200 + "Here it is. " + "y " * 200
    at = text.index("Here")
    got = spark.createDataFrame([(text, [3, at, 700])], "t string, p array<int>").select(snippets.snippet_at(F.col("t"), F.col("p")).alias("s")).first().s
    assert "Here it is." in got and got.startswith("...") and got.endswith("...")


def test_pages_are_parsed_by_slices():
    import pyarrow as pa

    pages = [PAGE, None, "", "<title>é</title>" + "x " * html.SLICE, "a", "<meta name=a content=b>" * 3] + ["<p>y z</p>" * 20_000] * 40
    parts = list(html._slices(pa.array(pages)))
    assert [d for p in parts for d in p.to_pylist()] == pages and all(len(p) == 1 or sum(len((d or "").encode()) for d in p.to_pylist()) <= html.SLICE for p in parts)
    got = [r for p in parts for r in html._rows(p, None, None).to_pylist()]
    assert [r | {"metas": dict(r["metas"])} for r in got] == [html.parse_html(d) for d in pages]
