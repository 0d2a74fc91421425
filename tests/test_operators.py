"""Operators against brute force and their defined results on odd input."""

import datetime as dt
import fnmatch
import hashlib
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.operators import bundles as B
from lodestrata.operators import captions as C
from lodestrata.operators import issues as I
from lodestrata.operators import manifests as M
from lodestrata.operators import packages as P
from lodestrata.operators import paged as G
from lodestrata.operators import quality as Q
from lodestrata.operators import records as R
from lodestrata.operators import runs as U
from lodestrata.operators import tree as T
from lodestrata.operators import urls as L
from lodestrata.operators import web as W

ODD = ["", " ", "a", "  a \t b\u00a0", "x\r\ny\rz\n", "\u2028l\u2029", "Straße ſ", "é\u0301\U0001f600", "\x1c\x1d", "tab\tnbsp\u00a0end\n\n", "A.B.", "x" * 5000 + "\n"]


def one(spark, values, *cols):
    return [tuple(r) for r in spark.createDataFrame([(v,) for v in values], "t string").select(*cols).collect()]


def test_text_kernel_equals_python(spark):
    got = one(spark, ODD, X.strip("t"), X.rstrip("t"), X.squeeze("t"), X.splitlines("t"), X.byte_length("t"), X.sha256("t"), X.casefold("t"))
    for t, g in zip(ODD, got):
        assert g == (t.strip(), t.rstrip(), " ".join(t.split()), t.splitlines(), len(t.encode()), hashlib.sha256(t.encode()).hexdigest(), t.casefold())
    assert one(spark, [None], X.strip("t"), X.splitlines("t")) == [(None, None)]


@pytest.mark.parametrize("pattern", ["*.md", "a[0-9]?", "[!x]*", "docs/*", "a.b", "*[*]*", "**"])
def test_globs(spark, pattern):
    values = ["a.md", "a1b", "x", "docs/a/b", "a.b", "axb", "s*r", "", "A.MD"]
    got = [r[0] for r in one(spark, values, F.col("t").rlike(X.glob_regex(pattern)))]
    assert got == [fnmatch.fnmatchcase(v, pattern) for v in values]


@pytest.mark.parametrize("pattern", ["*.md", "docs/*.md", "docs/**/*.md", "a?.txt", "/a/b", "[ab].c"])
def test_path_patterns(spark, pattern):
    values = ["a.md", "docs/a.md", "docs/x/a.md", "docs/x/y/a.md", "q/ab.txt", "a/b", "z/b.c"]
    assert [r[0] for r in one(spark, values, F.col("t").rlike(X.path_regex(pattern)))] == [pathlib.PurePosixPath(v).match(pattern) for v in values]


def next_fit(sizes, limit):
    out, used, no = [], None, 0
    for b in sizes:
        if used is not None and used + 7 + b <= limit:
            used += 7 + b
        else:
            used, no = b + 1, no + 1
        out.append(no)
    return out


@pytest.mark.parametrize("seed,limit", [(1, 60), (2, 200), (3, 20), (4, 1000)])
def test_split_against_next_fit(spark, seed, limit):
    rng = random.Random(seed)
    groups = {g: [rng.choice([0, 3, 10, 50, 300, 2500]) if seed != 4 else rng.randrange(400) for _ in range(n)] for g, n in (("a", 160), ("b", 1), ("c", 25))}
    rows = [(g, i + 1, b) for g, bs in groups.items() for i, b in enumerate(bs)]
    df = spark.createDataFrame(rows, "g string, position bigint, n_bytes bigint")
    got = {(r["g"], r["position"]): (r["file_no"], r["oversized"]) for r in B.split(df, "g", max_bytes=limit).collect()}
    assert got == {(g, i + 1): (no, bs[i] + 1 > limit) for g, bs in groups.items() for i, no in enumerate(next_fit(bs, limit))}


def test_sections_and_names(spark):
    df = spark.createDataFrame([("t", "id", "u", "body\n\n", True, None, "p", ""), (None, None, None, None, None, None, None, None)], "title string, cid string, url string, c string, st boolean, f string, p string, r string")
    s = B.section(title="title", canonical_id="cid", source_url="url", content="c", is_stale="st", fetched_at="f", path="p", ref="r")
    assert [x[0] for x in df.select(s).collect()] == ["## t\nsource_url: u\nstale: true\ncanonical_id: id\npath: p\n\nbody", "##\nsource_url:\ncanonical_id:".replace("##\n", "## \n").replace("url:\n", "url: \n")]
    m = B.section(title="title", canonical_id="cid", source_url="url", content="c", header="minimal", flag_stale=False)
    assert df.select(m).first()[0] == "## t\nsource_url: u\n\nbody"


def test_classify_every_reason(spark):
    cols = "b string, canonical_id string, output_path string, v string, h string"
    cur = spark.createDataFrame([("m", i, p, v, h) for i, p, v, h in [("none", "x", "1", "1"), ("nopath", None, "1", "1"), ("moved", "new", "1", "1"), ("gone", "g", "1", "1"), ("same", "s", "1", "9"), ("diff", "d", "2", "1"), ("second", "e", None, "1"), ("cur0", "f", None, None), ("prev0", "k", "1", None)]] + [("no", "any", "x", "1", "1")], cols)
    prev = spark.createDataFrame([("m", i, p, v, h) for i, p, v, h in [("nopath", "o", "1", "1"), ("moved", "old", "1", "1"), ("gone", "g", "1", "1"), ("same", "s", "1", "8"), ("diff", "d", "1", "1"), ("second", "e", "7", "1"), ("cur0", "f", "1", "1"), ("prev0", "k", None, "1")]], cols)
    have = spark.createDataFrame([("m", p) for p in ("o", "old", "s", "d", "e", "f", "k")], "b string, output_path string")
    got = {r["canonical_id"]: (r["status"], r["reason"]) for r in M.classify(cur, prev, have, on=["b"], change_keys=["v", "h"], has_manifest=F.col("b") == "m", reasons={"missing_current": "no key"}).collect()}
    assert got == {"none": ("new", "prior manifest entry missing entirely"), "nopath": ("changed", "output_path changed"), "moved": ("changed", "output_path changed"), "gone": ("changed", "prior artifact missing, so safe rewrite"), "same": ("unchanged", "v unchanged"),
                   "diff": ("changed", "v changed"), "second": ("unchanged", "h unchanged"), "cur0": ("changed", "no key"), "prev0": ("changed", "prior manifest entry missing metadata, so safe rewrite"), "any": ("new", "no previous manifest")}


def test_walk(spark):
    links = [("r", "b"), ("r", "a"), ("a", "c"), ("b", "c"), ("c", "r"), ("c", "d"), (None, "x"), ("d", None)]
    df = spark.createDataFrame(links, "parent string, child string")
    roots = spark.createDataFrame([("r",), ("lone",), (None,)], "root string")
    assert {tuple(x) for x in T.walk(df, roots).collect()} == {("r", "r", 0), ("r", "a", 1), ("r", "b", 1), ("r", "c", 2), ("r", "d", 3), ("lone", "lone", 0)}
    assert {x["id"] for x in T.walk(df, roots, max_depth=1).collect()} == {"r", "a", "b", "lone"}
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(20)], "parent string, child string")
    assert T.walk(chain, spark.createDataFrame([("0",)], "root string")).agg(F.max("depth")).first()[0] == 20
    assert T.walk(df, roots.where("false")).count() == 0


def test_line_repairs(spark):
    t = "see https :// a.example/x\nhttps://a.example/long-\npath-two/x\nhttps://a.example/b-\nNo Path\n•  item\n- x\nT\nhe end\nauthors\nA\nlice Smith"
    df = spark.createDataFrame([("d", [t, None, ""]), ("e", None), (None, ["x"])], "id string, raw_pages array<string>")
    got = {(r["id"], r["page_no"]): r for r in G.repaired_pages(df).collect()}
    r = got["d", 1]
    assert (r["n_scheme"], r["n_wrap"], r["n_split"]) == (1, 1, 2) and "https://a.example/long-path-two/x" in r["text"] and "The end" in r["text"] and "Alice Smith" in r["text"] and "b-\nNo Path" in r["text"] and "https://a.example/x" in r["text"]
    assert got["d", 2]["text"] == "" and ("e", 1) not in got


def test_footers(spark):
    pages = [f"Body line {chr(97 + i)} with words\n\nReport Name\nSome Institute\n{i + 1}" for i in range(12)]
    small = [f"text {chr(97 + i)}\nFooter Line\n{i + 5}" for i in range(3)]
    risky = [f"text {chr(97 + i)}\ntotal 12\nFooter Line\n{i + 5}" for i in range(3)]
    back = [f"text {chr(97 + i)}\nFooter Line\n{9 - i}" for i in range(3)]
    docs = {"many": pages, "small": small, "risky": risky, "back": back, "one": ["a\nb\n1"]}
    df = spark.createDataFrame([(k, i + 1, t) for k, ps in docs.items() for i, t in enumerate(ps)], "id string, page_no int, text string")
    got = {r["id"]: r for r in G.without_footers(df).collect()}
    assert got["many"]["pages"] == [f"Body line {chr(97 + i)} with words" for i in range(12)]
    assert got["small"]["pages"] == [f"text {chr(97 + i)}" for i in range(3)] and got["small"]["n_anchored"] == 6
    assert got["risky"]["n_context"] == 3 and got["risky"]["pages"] == risky and got["back"]["n_order"] == 3 and got["one"]["pages"] == ["a\nb\n1"]
    assert spark.range(1).select(G.signature(F.lit("  Page 3 of 9 | x  "))).first()[0] == "page # | x"


def test_captions(spark):
    df = spark.createDataFrame([(["a", "a b", "a b c", "x", "x", None, "", "a"],), ([],), (None,)], "c array<string>")
    assert [r[0] for r in df.select(C.collapse("c", F.lit(True))).collect()] == [["a b c", "x", "a"], [], None]
    assert df.select(C.collapse("c", F.lit(False))).first()[0] == ["a", "a b", "a b c", "x", "a"]
    good = "\ufeffWEBVTT\nKind: captions\n\n1\n00:01.000 --> 00:02.000\n<v Ann>Hi &amp; <b>bye</b></v>\n\nNOTE x\n\n00:03.000 --> 00:04.000 align:start\nTwo\nlines\n".encode()
    rows = [("ok", good, False), ("utf", b"WEBVTT\n\xff", False), ("head", b"x", False), ("cue", b"WEBVTT\n\nno timing\nhere\n", False), ("none", b"WEBVTT\n", True), ("null", None, True)]
    got = {r["id"]: (r["cues"], r["problem"]) for r in C.parse(spark.createDataFrame(rows, "id string, data binary, automatic boolean"), id_col="id").collect()}
    assert got["ok"] == (["**Ann:** Hi & bye", "Two lines"], None) and got["utf"][1] == "captions are not valid UTF-8" and got["head"][1] == got["null"][1] == "missing WEBVTT header" and got["cue"][1] == "malformed WebVTT cue" and got["none"][1] == "WebVTT contains no spoken cues"
    t = spark.createDataFrame([("v", "en-US", "automatic", "vtt", None), ("v", "de", "creator", "srv", "b"), ("v", "de", "creator", "vtt", "a"), ("w", "fr", "creator", "vtt", None), ("x", "EN", "automatic", "vtt", "n")], "v string, language string, kind string, format string, name string")
    got = {r["v"]: (r["language"], r["name"], r["reason"]) for r in C.choose(t, on="v", languages=["en", "de"]).collect()}
    assert got == {"v": ("de", "a", "creator_then_automatic:exact:de:creator"), "x": ("EN", "n", "creator_then_automatic:exact:EN:automatic")}
    assert {r["v"]: r["language"] for r in C.choose(t, on="v", languages=["en", "de"], policy="best_language").collect()}["v"] == "en-US"


def test_urls(spark):
    urls = {"https://a.example/x": None, "ftp://a": "no http or https", None: "no http or https", "https://": "no host", "http://u:p@a.example": "credentials", "http://localhost.": "localhost", "http://x.local/": "local name", "http://127.0.0.1": "loopback address",
            "http://0x7f.1/": "loopback address", "http://10.0.0.1:80/": "private address", "http://[::1]/": "loopback address", "http://224.0.0.1": "multicast address", "http://169.254.1.1": "link-local address", "http://8.8.8.8": None}
    assert [r[0] for r in one(spark, list(urls), L.url_problem("t"))] == list(urls.values())
    targets = {"123": ("page_id", "123"), " ": ("empty", None), "http:///x://": ("invalid_url", None), "https://w/pages/77/x": ("url", "77"), "https://w/p?a=1&pageId=9": ("url", "9"), "https://w/p?pageId=x": ("url", None), "word": ("unknown", None), None: ("empty", None)}
    assert [tuple(r[0]) for r in one(spark, list(targets), L.page_target("t"))] == list(targets.values())
    safe = {"a/b.md": True, "/a": False, "a//b": False, "../a": False, "a/./b": False, "a\\b": False, "": False, None: False, "a/..b": True}
    assert [r[0] for r in one(spark, list(safe), L.is_safe_path("t"))] == list(safe.values())
    names = {"https://h.example/a/My Report.v2.pdf?x=1": "my-report.v2", "https://h.example": "h.example", "https://h.example/%%%/": "public-source", "https://h/.x/": "x"}
    for u, r in zip(names, one(spark, list(names), R.output_name("t"))):
        assert r[0] == f"{names[u]}-{hashlib.sha256(u.encode()).hexdigest()[:12]}"


def test_web_text(spark):
    html = "<html><head><title>T &amp; U</title><style>x{}</style></head><body><nav><a href='/r.pdf'>The report</a></nav><script>var a='</p>'</script><p>One<b>two</b><p>Three<br>four</body></html>"
    r = {x["id"]: x for x in W.extract_html(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")).collect()}
    assert r[1]["title"] == "T & U" and r[1]["paragraphs"] == ["The report", "One two", "Three", "four"] and r[1]["links"][0]["label"] == "The report" and r[2]["paragraphs"] == []
    df = spark.createDataFrame([("p", "Share\n\n\n\n Sign  In \n\nReal text.\n\n© 2030 X. Privacy. Terms\n\nMore"), ("q", "")], "id string, c string")
    got = {(r["id"], r["pos"]): (r["reason"], r["kept_pos"]) for r in W.text_paragraphs(df, id_col="id", content="c").collect()}
    assert got["p", 0] == ("share_prompt", None) and got["p", 1] == (None, None) and got["p", 2][0] == "subscription_sign_in_prompt" and got["p", 3] == (None, 0) and got["p", 4][0] == "footer_legal_text" and got["p", 5] == (None, 1)
    links = spark.createDataFrame([(1, "https://h.example/report/dora-2025.pdf", "DORA 2025 report", "anchor_href"), (1, "https://h.example/privacy", "privacy report dora 2025", "anchor_href"), (1, "https://other.test/report/dora-2025.pdf", "dora 2025", "anchor_href"), (1, "https://h.example/x", "y", "anchor_href")], "id int, url string, label string, source string")
    pages = spark.createDataFrame([(1, "The DORA 2025 report", "accelerate performance", "https://h.example/land", "https://h.example/land", True, False)], "id int, title string, visible_text string, requested_url string, resolved_url string, likely_target_mismatch boolean, commercial_landing boolean")
    s = W.scored_links(links, pages)
    assert [(r["url"], r["score"], r["rank"]) for r in s.collect()] == [("https://h.example/report/dora-2025.pdf", 48 + 8 + 12 + 12 + 16, 1)]
    assert tuple(W.target_selection(pages, s).select("id", "status", "selected_url", "canonical_confidence").first()) == (1, "selected", "https://h.example/report/dora-2025.pdf", "high")
    c = spark.createDataFrame([(1, "u", 0, None), (1, "u", 1, "l"), (1, "u", 2, "m"), (1, "w", 5, ""), (1, "w", 6, None)], "id int, url string, pos int, label string")
    assert {r["url"]: (r["pos"], r["label"]) for r in W.link_choice(c, on="id").collect()} == {"u": (0, "l"), "w": (5, None)}


def test_quality(spark):
    df = spark.createDataFrame([(0, {}, {}, None, False), (200, {"a": -3, "b": 2}, {"x": 10}, [], False), (10, {}, {"x": 6}, ["b", "b"], False), (10, {}, {}, None, True)], "u int, c map<string,int>, r map<string,int>, b array<string>, m boolean")
    got = [(r[0]["state"], r[0]["promotion"], r[0]["effort"], r[0]["cleanup"], r[0]["blockers"]) for r in df.select(Q.classification("u", "c", "r", "b", F.col("m"))).collect()]
    assert got == [("diagnostic-only", "unsafe-to-promote", "not_useful", 0, ["no_retained_content"]), ("review-ready", "promotion-capable", "focused", 2, []), ("review-ready", "unsafe-to-promote", "extended", 0, ["b"]), ("likely-wrong-capture-target", "unsafe-to-promote", "source_target_review", 0, ["likely_wrong_capture_target"])]


def test_issues(spark):
    df = spark.createDataFrame([('{"pull_request": null}',), ('{"a": 1}',), (None,), ("x",)], "p string")
    assert [r[0] for r in df.select(I.is_pull_request("p")).collect()] == [True, False, False, False]
    with pytest.raises(ValueError):
        I.since_filter(df, "p", "yesterday")
    with pytest.raises(ValueError):
        I.first_rows(df, ["p"], 0)
    c = spark.createDataFrame([(1, "b", None, "x\n"), (1, "a", "z", None)], "n int, created_at string, author string, body string")
    h = I.hydrate(spark.createDataFrame([(1,), (2,)], "n int"), I.ordered_comments(c, "n", [F.col("created_at")], ["author", "created_at", "body"]), "n")
    md = h.select("n", R.comment_sections("Comments", "comments", ("author", "created_at"), "_none_", "Comment")).orderBy("n").collect()
    assert md[0][1] == "\n\n## Comments\n\n### Comment 1\n\n- author: z\n- created_at: a\n\n_none_\n\n### Comment 2\n\n- author: \n- created_at: b\n\nx" and md[1][1] == ""


def test_runs(spark):
    codes = [401, 403, 404, 429, 500, 503, 418, None]
    df = spark.createDataFrame([(c, None) for c in codes] + [(None, "SSL: bad certificate"), (None, "timed out")], "s int, e string")
    assert [r[0] for r in df.select(U.page_failure("s", "e")).collect()] == ["auth", "auth", "permanent", "expected_retryable", "provider", "provider", "permanent", None, "configuration", "expected_retryable"]
    assert df.select(U.issue_failure("s", F.lit("3"), None)).first()[0] == "expected_retryable"
    rng = random.Random(2)
    rows = [(u, i, rng.randrange(400)) for u in ("hot", "b", None) for i in range(60)]
    df = spark.createDataFrame(rows, "u string, i int, at int")
    got = {(r["u"], r["i"]): r["start"] for r in U.paced(df, on="u", order=["at", "i"], arrival="at", interval=10).collect()}
    for u in ("hot", "b", None):
        last = None
        for _, i, at in sorted((r for r in rows if r[0] == u), key=lambda r: (r[2], r[1])):
            last = at if last is None else max(at, last + 10)
            assert got[u, i] == last
    runs = spark.createDataFrame([("a", True), ("b", False)], "name string, enabled boolean")
    assert [r["name"] for r in U.selected_runs(runs).collect()] == ["a"] and [r["name"] for r in U.selected_runs(runs, ["b"]).collect()] == ["b"]
    with pytest.raises(ValueError):
        U.selected_runs(runs, ["zz"])


def test_package_rules(spark):
    o = spark.createDataFrame([("p", "package.json"), ("p", "a"), ("p", "b")], "k string, path string")
    l = spark.createDataFrame([("p", "a", "record"), ("p", "c", "diagnostic")], "k string, path string, role string")
    assert {tuple(r) for r in P.coverage(o, l, "k").collect()} == {("p", "b", "unlisted_file"), ("p", "c", "missing_file")}
    items = spark.createDataFrame([("p", "1", ["a", "c"], None), ("p", "2", ["a", "zz"], ["c"])], "k string, item_id string, artifacts array<string>, diagnostics array<string>")
    assert {(r["path"], r["item_id"], r["code"]) for r in P.references(items, l, "k").collect()} == {("c", "1", "wrong_role"), ("zz", "2", "unknown_reference"), ("a", None, "claimed_by_several"), ("c", None, "claimed_by_several")}
    df = spark.createDataFrame([("r", ["a", "a"], None, {}), ("r", ["r"], None, {}), ("r", ["a"], "b", {}), ("r", ["a"], "a", {"x": -1}), ("r", None, None, None)], "o string, p array<string>, s string, a map<string,int>")
    assert [r[0] for r in df.select(P.lineage_problem("o", "p", "s", "a")).collect()] == ["duplicate_prior", "self_reference", "resumes_unknown_run", "negative_attempts", None]
    j = spark.createDataFrame([(1, '{"b":1,"a":{"x":[1]}}'), (2, '{"a":1,"a":2}'), (3, None)], "id int, t string")
    assert {r["id"]: (r["canonical"], r["depth"], r["problem"]) for r in P.canonical(j, id_col="id", text="t").collect()} == {1: ('{"a":{"x":[1]},"b":1}\n', 4, None), 2: (None, None, "duplicate key"), 3: (None, None, "no JSON")}


def test_stale_rules(spark):
    cols = "b string, canonical_id string, output_path string, source_url string, entry_index int, is_stale boolean"
    e = spark.createDataFrame([("m", "1", "p1", "u", 0, None), ("m", "2", "p2", "u", 1, False)], cols)
    s = spark.createDataFrame([("m", "1", "x", "u", 0, None), ("m", "9", "p2", "u", 1, None), ("m", "3", "p3", "u", 2, None), ("m", "3", "p4", "u", 3, None), ("m", "4", "p3", "u", 4, None), ("m", "5", "p5", "", 5, None), ("m", "1", "p1", "u", 6, None)], cols)
    assert {r["canonical_id"] for r in B.stale_appended(e, s, ["b"]).collect()} == {"3"}
    assert {r["canonical_id"]: r["is_stale"] for r in B.stale_marked(e, s, ["b"]).collect()} == {"1": True, "2": False}
    plan = M.prune_plan(spark.createDataFrame([("m", "a.md"), ("m", "../b.md"), ("m", "c.txt"), ("m", "d.md")], "b string, output_path string"), spark.createDataFrame([("m", "d.md")], "b string, output_path string"), ["b"])
    assert {r["output_path"]: r["violation"] for r in plan.collect()} == {"a.md": None, "../b.md": "outside the output folder", "c.txt": "not a markdown file", "d.md": "still referenced"}
