"""API payloads, URLs and pages: mapping rules, paging, addresses and link targets, and the defined results of odd input."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.operators import captions as C
from lodestrata.operators import payloads as L
from lodestrata.operators import web as W
from lodestrata.sources import http


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_casefold_equals_pythons(spark):
    texts = ["Straße ﬁx ŉ", "İstanbul ǅ", "ΣΑΣ ς", "ᾈ ﬗ ẞ", "Ꭰ plain", "", None, "".join(map(chr, range(0x80, 0x600))), "".join(map(chr, range(0x1E00, 0x2000)))]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.casefold("t")).collect()]
    assert got == [None if t is None else t.casefold() for t in texts]


def test_urls_equal_the_librarys(spark):
    bases = ["https://h.example/a/b/c?q#f", "http://h.example", "https://h.example/a/"]
    refs = ["", "x", "./x", "../x", "../../x", "../../../x", "/x/./y/../z", "//o.example/p", "?n=1", "#t", "x?y#z", "https://q.example/../r", "a/b/..", "x/.", "x%20y;p", "..", "."]
    rows = [(b, r) for b in bases for r in refs]
    got = [r[0] for r in spark.createDataFrame(rows, "b string, r string").select(X.join_url("b", "r")).collect()]
    assert got == [urllib.parse.urljoin(b, r) for b, r in rows]
    for t in ("a b/ü~*+._-'(", ""):
        assert one(spark, q=X.quote(F.lit(t)))["q"] == urllib.parse.quote(t, safe="")
    assert one(spark, u=X.unescaped(F.lit("&lt;&#233;&amp;&nope;")))["u"] == "<é&&nope;"


def mapped(spark, kind, payloads):
    return [r.asDict() for r in L.mapped(spark.createDataFrame([(json.dumps(p) if not isinstance(p, str | None) else p,) for p in payloads], "payload string"), kind).collect()]


def test_rules_of_fields(spark):
    good = {"number": 7, "title": "t", "state": "open", "created_at": "a", "updated_at": "b", "body": None, "user": {"login": "me"}, "extra": [1]}
    rows = [good, {**good, "number": True}, {**good, "number": "7"}, {**good, "number": 7.5}, {**good, "title": None}, {**good, "body": 3}, {**good, "user": None}, {**good, "user": {"login": ""}}, {**good, "title": ""}, None, "[1]", "no", "{}"]
    got = mapped(spark, "issue", rows)
    assert [r["problem"] for r in got] == [None, *["missing or invalid number"] * 3, "missing or invalid title", "missing or invalid body", None, None, None, *["no JSON object"] * 3, "missing or invalid number"]
    assert (got[0]["number"], got[0]["body"], got[0]["author"], got[6]["author"], got[7]["author"], got[1]["title"]) == (7, "", "me", None, None, None)
    rel = {"id": 1, "tag_name": "v", "created_at": "a", "draft": False, "prerelease": True}
    got = mapped(spark, "release", [rel, {**rel, "draft": 0}, {**rel, "published_at": 3}, {**rel, "name": "n", "published_at": "p"}])
    assert [(r["problem"], r["title"], r["published_at"]) for r in got] == [(None, "", None), ("missing or invalid draft", None, None), ("missing or invalid published_at", None, None), (None, "n", "p")]
    assert mapped(spark, "review_comment", [{"created_at": "a", "updated_at": "b", "line": 3}, {"created_at": "a", "updated_at": "b", "line": True}])[1]["problem"] == "missing or invalid line"


def test_tracked_records_and_comments(spark):
    base = {"title": "t", "state": "s", "created_at": "a", "updated_at": "b"}
    df = spark.createDataFrame([(json.dumps({"number": 1, **base}),), (json.dumps({"number": 2, "pull_request": None, **base}),)], "payload string")
    assert [r["source_url"] for r in L.tracked(df, "issue", owner="o/o", repo="r", web_root="https://w.example/").collect()] == ["https://w.example/o%2Fo/r/issues/1"]
    assert L.tracked(df, "pull_request", owner="o", repo="r", web_root="https://w.example").count() == 2 and L.tracked(df.where("false"), "issue", owner="o", repo="r", web_root="u").count() == 0
    c = spark.createDataFrame([(1, json.dumps({"created_at": "a", "updated_at": "b", "html_url": "", "url": "u", "id": 5}))], "k int, payload string")
    r = L.comments(c, "pull_comment", "k").first()
    assert (r["k"], r["source_url"], r["comment_id"], r["problem"]) == (1, "u", 5, None) and "source_url" not in L.comments(c, "issue_comment", "k").columns
    assert [len(L.comment_key(k)) for k in ("issue_comment", "pull_comment", "review_comment")] == [4, 6, 9]


def test_pages_and_listings(spark):
    page = {"id": "1", "title": "t", "body": {"storage": {"value": ""}}, "version": {"number": 3, "when": "w"}, "_links": {"webui": "/x", "base": "https://w.example/b/"}}
    rows = [("1", page), ("2", page), ("1", {**page, "body": {}}), ("1", {**page, "version": {"number": True}}), ("1", {**page, "_links": {"webui": "/x"}}), ("1", {**page, "_links": {"webui": "https://a.example/x"}}), ("1", {**page, "id": ""})]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in rows], "requested_id string, payload string")
    got = L.pages(df).collect()
    assert [r["problem"] for r in got] == [None, "canonical_id mismatch", "missing or invalid content", None, "missing source_url", None, "missing or invalid canonical_id"]
    assert (got[0]["source_url"], got[0]["page_version"], got[3]["page_version"], got[5]["source_url"]) == ("https://w.example/b/x", 3, None, "https://a.example/x")
    assert L.pages(df, summary=True).where("problem IS NULL").count() == 4 and "content" not in L.pages(df, summary=True).columns
    lists = [{"results": [{"id": "b", "type": "page"}, {"id": "a", "type": "page"}]}, {"results": []}, {"results": [{"id": ""}]}, {"results": 3}, {"results": [{"id": "x", "type": "blog"}]}, None]
    df = spark.createDataFrame([(n, p if p is None else json.dumps(p)) for n, p in enumerate(lists)], "n int, payload string")
    got = {(r["n"], r["position"], r["id"], r["problem"]) for r in L.listed(df, only_pages=True, keep=["n"]).collect()}
    assert got == {(0, 0, "b", None), (0, 1, "a", None), (2, 0, None, "a result is no page"), (3, 0, None, "invalid listing"), (4, 0, None, "a result is no page"), (5, 0, None, "invalid listing")}
    assert {r["problem"] for r in L.listed(df.where("n IN (2, 4)"), only_pages=False, keep=["n"]).collect()} == {"a result has no id", None}
    v = lambda n: F.try_parse_json(F.lit(json.dumps({"_links": {"next": n}})))
    r = one(spark, a=L.next_listing(v("/b/rest?x"), "https://w.example/b"), b=L.next_listing(v("/rest"), "https://w.example/b/"), c=L.next_listing(v("https://o.example/n"), "https://w.example/b"), d=L.next_listing(v(None), "https://w.example/b"), e=L.next_listing(v("rest"), "https://w.example/b"))
    assert tuple(r) == ("https://w.example/b/rest?x", "https://w.example/b/rest", "https://o.example/n", None, "https://w.example/b/rest")
    assert [tuple(r) for r in L.stub_pages(spark.createDataFrame([("7", None), (None, "u")], "page_id string, page_url string")).select("canonical_id", "title", "source_url").collect()] == [("7", "stub-page-7", ""), ("unknown", "stub-page-unknown", "u")]


def test_next_links_hints_and_videos(spark):
    n = lambda h: tuple(one(spark, n=L.next_link(F.lit(h), "https://a.example/v3/"))["n"])
    assert n('<https://a.example/v3/x?p=2>; rel="next", <https://a.example/v3/y>; rel="last"') == ("https://a.example/v3/x?p=2", None) and n(None) == n('<https://a.example/v3/x>; rel="prev"') == (None, None)
    assert n('<https://a.example/v33/x>; rel="next"') == n('<http://a.example/v3/x>; rel="next"') == (None, "pagination URL outside the API root")
    h = lambda *a: one(spark, h=L.rate_limit_hint(*[F.lit(x) for x in a]))["h"]
    assert [h(200, "3", None, None), h(429, None, None, None), h(200, None, "0", "0"), h(200, "", "0", "soon"), h(200, None, "5", "9")] == ["retry after 3 second(s)", "no retry time provided", "reset at 1970-01-01T00:00:00", "reset at soon", None]
    one_video, many = {"id": "v", "title": "t"}, {"id": "p", "entries": [{"id": "a", "availability": "private"}, {"id": "b", "playlist_index": 9}, {"title": "x"}]}
    df = spark.createDataFrame([(json.dumps(p),) for p in (one_video, many)], "payload string")
    got = [(r["collection_id"], r["video_id"], r["position"], r["available"], r["failure"]) for r in L.discovered(df).collect()]
    assert got == [("v", "v", 1, True, None), ("p", "a", 1, False, "private"), ("p", "b", 9, True, None), ("p", None, 3, False, "no_id")]
    with pytest.raises(Exception, match="more than 2"):
        L.discovered(df, max_items=2).collect()


class _Api(BaseHTTPRequestHandler):
    def log_message(self, *_):
        pass

    def do_GET(self):
        root = f"http://127.0.0.1:{self.server.server_port}"
        status, link, body = 200, None, [{"number": 1}]
        if self.path == "/v3/a":
            link = f'<{root}/v3/b>; rel="next"'
        elif self.path == "/v3/b":
            body = [{"number": 2}, 3]
        elif self.path == "/v3/out":
            link = f'<{root}/v4/a>; rel="next"'
        elif self.path == "/v3/busy":
            status, body = 403, {}
        elif self.path == "/jump":
            status = 302
        else:
            body = {}
        self.send_response(status)
        self.send_header("Content-Type", "application/json")
        if link:
            self.send_header("Link", link)
        if status == 403:
            self.send_header("X-RateLimit-Remaining", "0")
        if status == 302:
            self.send_header("Location", f"{root}/v3/a")
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())


def test_apis_and_addresses(spark):
    s = HTTPServer(("127.0.0.1", 0), _Api)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{s.server_port}"
    http.register(spark)
    read = lambda *p: [(r["payload"], r["problem"], r["rate_remaining"]) for r in spark.read.format("lodestrata_paged").option("urls", json.dumps([f"{at}/v3/{x}" for x in p])).option("apiroot", f"{at}/v3").load().orderBy("listing", "position").collect()]
    assert read("a") == [('{"number": 1}', None, None), ('{"number": 2}', None, None), ("3", "Response error: no object", None)]
    assert read("out")[1][1] == "Response error: pagination URL outside the API root" and read("busy") == [(None, "status 403", "0")] and read("none")[0][1] == "Response error: no list"
    urls = spark.createDataFrame([(f"{at}/v3/a",), (f"{at}/v3/a",), (None,), (f"{at}/jump",)], "url string")
    assert {(r["requested_url"].rpartition("/")[2], r["status"], r["problem"]) for r in http.fetch(urls, private="true").collect()} == {("a", 200, None), ("jump", 200, None)}
    assert {r["problem"] for r in http.fetch(urls).collect()} == {"loopback address"}  # looked at before anything is sent
    s.shutdown()
    for u, why in (("ftp://x.example/", "no http or https"), ("http://u:p@x.example/", "credentials"), ("http://", "no host"), ("http://localhost/", "local name"), ("http://10.1.2.3/", "private address"), ("http://0x7f000001/", "loopback address"), ("http://[::1]/", "loopback address"), ("http://[x/", "malformed")):
        assert http.address_problem(u) == why, u
    with pytest.raises(PermissionError):
        http._Checked(False).redirect_request(None, None, 302, "", {}, "http://127.0.0.1/x")


PAGE = "id int, title string, visible_text string, requested_url string, resolved_url string, commercial_landing boolean, likely_target_mismatch boolean, confidence string"
LINK = "id int, pos int, url string, label string, source string"


def targets(spark, links, html="", page=("State of DevOps DORA 2025", "", "https://h.example/go", "https://h.example/landing", False, True, "low")):
    pages = spark.createDataFrame([(1, *page)], PAGE)
    found = spark.createDataFrame([(1, i, *x) for i, x in enumerate(links)], LINK).unionByName(W.embedded_links(spark.createDataFrame([(1, html)], "id int, html string")).withColumn("pos", F.col("pos") + 1000).select("id", "pos", "url", "label", "source"))
    scored = W.scored_links(W.link_choice(W.absolute_links(found, pages), on="id"), pages)
    return {r["url"]: (r["score"], r["reason"]) for r in scored.collect()}, W.target_selection(pages, scored).first()


def test_targets(spark):
    pdf = "https://h.example/files/2025-dora-report.pdf"
    got, pick = targets(spark, [("files/2025-dora-report.pdf", "", "anchor_href"), ("/files/2025-dora-report.pdf", "Get it", "anchor_href"), ("#x", "dora 2025 report", "anchor_href"), ("mailto:dora-2025-report@h.example", "", "anchor_href")])
    assert got == {pdf: (48 + 8 + 12 + 12 + 16, "pdf_asset,observed_in_anchor_href,stable_research_asset")}
    assert (pick["status"], pick["reason"], pick["canonical_status"], pick["canonical_confidence"], pick["selected_url"], pick["selected_content_type"], len(pick["candidates"])) == ("selected", got[pdf][1], "selected_stable_canonical_asset", "high", pdf, "pdf", 1)
    # Two good ones are ambiguous; an abridged one, the page itself, other hosts, rejected places and non-public addresses don't count.
    more = [("/reports/dora-2025", "DORA report", "anchor_href"), (pdf, "", "link_href"), ("/files/dora-2025-report-abridged.pdf", "", "anchor_href"), ("https://h.example/landing/?dora=2025&report=1", "dora 2025 report", "link_href"), ("https://o.example/dora-2025-report.pdf", "", "anchor_href"),
            ("/blog/dora-2025-report.pdf", "", "anchor_href"), ("/dora-2025-report?continue=x", "", "anchor_href"), ("/dora-2025-report?continue=", "", "anchor_href"), ("http://127.0.0.1/dora-2025-report.pdf", "", "anchor_href")]
    got, pick = targets(spark, more)
    assert pick["status"] == "ambiguous_multiple_high_confidence_targets" and (pick["selected_url"], pick["canonical_confidence"]) == ("", "low")
    assert set(got) == {pdf, "https://h.example/reports/dora-2025", "https://h.example/files/dora-2025-report-abridged.pdf", "https://h.example/dora-2025-report?continue="} and got["https://h.example/files/dora-2025-report-abridged.pdf"][0] == 48 + 8 + 12 + 12 + 16 - 35
    got, _ = targets(spark, [], html='{"u":"https:\\/\\/www.h.example\\/paper\\/dora-2025\\u0026x"} https://h.example/dora-2025).')
    assert set(got) == {"https://www.h.example/paper/dora-2025&x"} and "observed_in_embedded_page_url" in got["https://www.h.example/paper/dora-2025&x"][1]
    page = ("DORA 2025", "", None, "https://h.example/", False, True, "low")
    assert targets(spark, [], page=page)[1]["status"] == "no_high_confidence_target" and targets(spark, [], page=(*page[:4], True, True, "low"))[1]["status"] == "no_selection_commercial_landing_page"
    assert targets(spark, [(pdf, "", "anchor_href")], page=(*page[:4], False, False, "high"))[1]["canonical_confidence"] == "high"


def test_second_hop(spark):
    kind = "title string, paragraphs array<string>, links array<struct<url:string,label:string,source:string>>"
    own = spark.createDataFrame([(1, "a", ["x"], []), (2, "b", ["y"], []), (3, "c", ["z"], [])], f"id int, {kind}")
    picked = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, "")], "id int, selected_url string")
    far = spark.createDataFrame([("u1", "far", ["f"], [])], f"id string, {kind}")
    assert {(r["id"], r["followed"], r["title"]) for r in W.second_hop(own, picked, far).collect()} == {(1, "u1", "far"), (2, None, "b"), (3, None, "c")}


@pytest.mark.parametrize("body,automatic,cues,problem", [
    ("WEBVTT\nx: y\n\n00:01.000 --> 00:02.000\na &amp; b\n", False, ["a & b"], None), ("WEBVTT\n\n00:01.000 --> 00:02.000\n\nlate\n", True, ["late"], None), ("WEBVTT\n\n00:01.000 --> 00:02.000\n\n\ntoo late\n", True, None, C.MALFORMED),
    ("WEBVTT\n\n00:01.000 --> 00:02.000\n\nlate\n", False, None, C.MALFORMED), ("WEBVTT\n\n00:01.000 --> 00:02.000\n\nNOTE spoken\n", True, ["NOTE spoken"], None), ("WEBVTT\n\nNOTE a\nb\n\nname\n00:01.000 --> 00:02.000\n<v Ann>hi</v>\n", False, ["**Ann:** hi"], None),
    ("WEBVTT\n\nname\n\n00:01.000 --> 00:02.000\nx\n", False, None, C.MALFORMED), ("WEBVTT\n\n00:01.000 --> 00:02.000\n", True, None, C.NO_CUES), ("WEBVTT", False, None, C.NO_CUES), ("x", False, None, C.NO_HEADER), ("", False, None, C.NO_HEADER)])
def test_caption_states(spark, body, automatic, cues, problem):
    r = C.parse(spark.createDataFrame([("i", body.encode(), automatic)], "id string, data binary, automatic boolean"), id_col="id").first()
    assert (r["cues"], r["problem"]) == (cues, problem)
