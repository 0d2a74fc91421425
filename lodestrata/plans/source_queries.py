"""Registered queries of payload mapping, link targets, captions, sinks that are read back, and reports, with their SQL."""

from __future__ import annotations

import json
import os
import subprocess
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import byte_length, join_url, path_regex, quote, sha256, unescaped
from lodestrata.operators import captions as C
from lodestrata.operators import hierarchy as H
from lodestrata.operators import issues as I
from lodestrata.operators import manifests as M
from lodestrata.operators import packages as P
from lodestrata.operators import payloads as L
from lodestrata.operators import quality as Q
from lodestrata.operators import records as R
from lodestrata.operators import runs as U
from lodestrata.operators import web as W
from lodestrata.plans.record_queries import _fold, _has, _in, _squeeze
from lodestrata.session import app_dir, table
from lodestrata.sources import caches, checkpoints, config, files, git, packages
from lodestrata.sources import manifests as stored

WIKI = "https://wiki.example/base"


def _here(spark: SparkSession, name: str) -> str:
    """A new folder of this application, for what a query writes and reads back."""
    return f"{app_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _page_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Every captured page as the API would give it; some lack what a page needs."""
    link = F.struct(F.when(F.col("version") % 5 != 0, F.concat(F.lit("/x/"), "id")).alias("webui"), F.lit(f"{WIKI}/").alias("base"))
    body = F.struct(F.struct(F.col("content").alias("value")).alias("storage"))
    p = F.to_json(F.struct("id", "title", body.alias("body"), F.struct(F.col("version").alias("number"), F.col("last_modified").alias("when")).alias("version"), link.alias("_links")))
    asked = F.when(F.col("version") % 7 == 0, F.concat("id", F.lit("x"))).otherwise(F.col("id"))
    return table(spark, d, "pages").where("id IS NOT NULL").select(asked.alias("requested_id"), p.alias("payload")).distinct()


def page_records(spark: SparkSession, d: str) -> DataFrame:
    """Page payloads as records, or what is wrong with them."""
    r = L.pages(_page_payloads(spark, d))
    return r.groupBy("requested_id", "title", "source_url", "page_version", "last_modified", "problem").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.length("content"), F.lit(-1))).cast("bigint").alias("chars"))


def page_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The same without contents."""
    return L.pages(_page_payloads(spark, d), summary=True).select("requested_id", "title", "page_version", "last_modified", "problem").distinct()


def stub_pages(spark: SparkSession, d: str) -> DataFrame:
    """A made-up page for every captured id."""
    return L.stub_pages(table(spark, d, "pages").select(F.col("id").alias("page_id"), F.lit(None).cast("string").alias("page_url")).distinct())


def child_listing(spark: SparkSession, d: str) -> DataFrame:
    """The children of every captured row as the API lists them; null and empty ids spoil a listing."""
    kids = F.transform("child_page_ids", lambda x: F.struct(x.alias("id")))
    rows = table(spark, d, "pages").where("id IS NOT NULL").select("id", "child_page_ids").distinct().select(F.col("id").alias("page"), F.to_json(F.struct(kids.alias("results"))).alias("payload"))
    return L.listed(rows, only_pages=False, keep=["page"]).select("page", "position", F.col("id").alias("child"), "problem")


def served_listing(spark: SparkSession, d: str) -> DataFrame:
    """The second hundred of a space's pages as a server answers, and the next address."""
    pages = table(spark, d, "pages")
    space = pages.groupBy("space_key").agg(F.countDistinct("id").alias("n")).where("space_key IS NOT NULL").orderBy(F.desc("n"), "space_key").first()
    one = L.served(pages, base=WIKI, space=space["space_key"] if space else "", start=100)
    v = F.try_parse_json("payload")
    ids = L.listed(one, only_pages=True, keep=["payload"])
    return ids.select("position", "id", L.next_listing(v, WIKI).isNotNull().alias("more"))


def _tracked(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Documents of the tracker as payloads of one kind; some break a rule."""
    t = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    user = F.struct(F.when(F.col("lang") != "de", F.col("lang")).alias("login"))
    common = [F.col("title").alias("name" if kind == "release" else "title"), t("loaded_at").alias("created_at"), F.col("text").alias("body"), user.alias("user")]
    if kind == "release":
        p = F.struct(F.col("doc_id").alias("id"), F.coalesce("canonical_id", F.lit("v 1/2")).alias("tag_name"), *common, F.when(F.col("doc_id") % 3 != 0, t("fetched_at")).alias("published_at"), (F.col("doc_id") % 2 == 0).alias("draft"), F.lit(False).alias("prerelease"))
    else:
        p = F.struct(F.when(F.col("doc_id") % 11 != 0, F.col("doc_id")).alias("number"), F.when(F.col("doc_id") % 2 == 0, "open").otherwise("closed").alias("state"), *common, t("fetched_at").alias("updated_at"),
                     *([F.when(F.col("doc_id") % 4 == 0, F.struct(F.lit("u").alias("url"))).alias("pull_request")] if kind == "issue" else []))
    return table(spark, d, "documents").where("source = 'github_metadata'").select(F.to_json(p).alias("payload"))


def _mapped(spark: SparkSession, d: str, kind: str, key: str) -> DataFrame:
    r = L.tracked(_tracked(spark, d, kind), kind, owner="a b", repo="c", web_root="https://tracker.example/")
    return r.select(F.col(key).cast("string").alias("key"), "title", "author", "created_at", byte_length("body").alias("n_bytes"), "source_url", "problem")


def issue_records(spark: SparkSession, d: str) -> DataFrame:
    """Issue payloads as records; those with the key ``pull_request`` are none."""
    return _mapped(spark, d, "issue", "number")


def pull_request_records(spark: SparkSession, d: str) -> DataFrame:
    """Pull request payloads as records."""
    return _mapped(spark, d, "pull_request", "number")


def release_records(spark: SparkSession, d: str) -> DataFrame:
    """Release payloads as records."""
    return _mapped(spark, d, "release", "release_id")


def pull_request_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pull requests, their items as comments that went through the API's payloads, by size and hash."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    p = F.struct(day("l_shipdate").alias("created_at"), day("l_shipdate").alias("updated_at"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"),
                 F.when(F.col("l_suppkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("https://t.example/c/"), F.col("l_linenumber").cast("string"))).alias("html_url"), F.lit("https://api.example/c").alias("url"),
                 F.struct(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("login")).alias("user"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("body"))
    c = L.comments(table(spark, d, "lineitem").select("l_orderkey", F.to_json(p).alias("payload")), "pull_comment", "l_orderkey")
    fields = ("author", "created_at", "updated_at", "source_url")
    c = I.ordered_comments(c, "l_orderkey", L.comment_key("pull_comment"), [*fields, "body"]).withColumnRenamed("l_orderkey", "o_orderkey")
    o = I.hydrate(table(spark, d, "orders"), c, "o_orderkey")
    s = R.comment_sections("Comments", "comments", fields, R.EMPTY["pull_request_comment"], "Comment")
    md = R.issue_markdown(kind="pull_request", number="o_orderkey", title="o_orderpriority", state="o_orderstatus", author=F.lit(None), created_at=day("o_orderdate"), updated_at=day("o_orderdate"), source_url=F.lit("u"), repo=F.lit("a/b"), body=F.lit("x"), sections=s)
    return o.select("o_orderkey", F.explode(F.array(md)).alias("md")).select("o_orderkey", byte_length("md").alias("n_bytes"), sha256("md").alias("content_hash"))


def next_links(spark: SparkSession, d: str) -> DataFrame:
    """Next pages that Link headers name, kept below the API's root."""
    host = F.element_at(F.array(F.lit("https://api.example/v3"), F.lit("HTTPS://API.example/v3"), F.lit("https://api.example/v33"), F.lit("https://other.example/v3")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    h = F.concat(F.lit("<https://api.example/v3/first>; rel=\"first\", <"), host, F.lit("/items?page="), F.col("o_custkey").cast("string"), F.lit(">; rel=\""), F.when(F.col("o_orderstatus") == "F", "prev").otherwise("next"), F.lit("\""))
    n = L.next_link(h, "https://api.example/v3")
    return table(spark, d, "orders").select("o_orderkey", n["url"].alias("url"), n["problem"].alias("problem"))


def rate_limits(spark: SparkSession, d: str) -> DataFrame:
    """When held-back requests may be made again."""
    status = (F.lit(427) + F.col("event_id") % 4).cast("int")
    hint = L.rate_limit_hint(status, F.when(F.col("event_id") % 5 == 0, "30"), (F.col("event_id") % 3).cast("string"), F.when(F.col("event_id") % 7 < 3, ((F.col("event_id") % 7) * 86400).cast("string")).when(F.col("event_id") % 7 < 5, "soon"))
    return table(spark, d, "events").groupBy(hint.alias("hint")).agg(F.count(F.lit(1)).alias("n"))


def video_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Orders as playlists, their items as videos in the playlist's order."""
    why = F.element_at(F.array(F.lit("public"), F.lit("private"), F.lit("unlisted"), F.lit("gone"), F.lit(None).cast("string")), (F.col("l_partkey") % 5 + 1).cast("int"))
    e = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.struct(F.when(F.col("l_suppkey") % 9 != 0, F.col("l_partkey").cast("string")).alias("id"), F.col("l_returnflag").alias("title"), why.alias("availability"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber") * 10).alias("playlist_index")).alias("e"))
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(e)), lambda x: x["e"]).alias("entries"))
    p = lists.select(F.to_json(F.struct(F.col("l_orderkey").cast("string").alias("id"), "entries")).alias("payload"))
    return L.discovered(p).select("collection_id", "video_id", "position", "available", "failure")


def video_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """The caption tracks that orders' payloads name, by language and kind."""
    track = lambda ext, name: F.struct(F.lit(ext).alias("ext"), name.alias("name"))
    subs = F.map_filter(F.create_map(F.lit("en"), F.array(track("vtt", F.col("o_orderpriority")), track("srv1", F.lit(None).cast("string"))), F.lit("de"), F.array(track("vtt", F.lit("x")))), lambda k, _: (k == "en") | (F.col("o_orderstatus") == "O"))
    auto = F.when(F.col("o_orderstatus") != "F", F.create_map(F.lit("fr"), F.array(track("vtt", F.lit("auto")))))
    p = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("id"), subs.alias("subtitles"), auto.alias("automatic_captions")))
    return C.enriched(table(spark, d, "orders").select(p.alias("payload"))).select("video_id", "kind", "language", "format", "name")


def canonical_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids and output paths of tracker records and repository files."""
    doc = table(spark, d, "documents").where("source IN ('github_metadata', 'git_repo') AND origin IS NOT NULL")
    cid = F.when(F.col("source") == "git_repo", R.file_id("origin", F.substring(sha256("origin"), 1, 40), F.coalesce("canonical_id", F.lit("x")))).otherwise(R.tracked_id(F.col("source"), F.lit("tracker.example"), F.col("origin"), F.lit("issue"), F.col("doc_id")))
    return doc.select("doc_id", cid.alias("id"), R.tree_output_path(F.coalesce("canonical_id", F.lit("x")), "pages/").alias("output_path"))


def web_html_text(spark: SparkSession, d: str) -> DataFrame:
    """Captured paragraphs put into HTML and taken out again."""
    ps = F.filter(F.split(F.regexp_replace("raw_content", r"\r\n", "\n"), r"\n[ \t]*\n"), lambda p: F.trim(p) != "")
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(F.lit("<html><title>T &amp; x</title><script>var a;</script><body><nav><a href='/n'>Go</a></nav>"), F.array_join(F.transform(ps, lambda p: F.concat(F.lit("<p>"), esc(p), F.lit("</p>"))), ""), F.lit("</body></html>"))
    rows = table(spark, d, "article_chrome_cases").where("id IS NOT NULL AND raw_content IS NOT NULL").groupBy("id").agg(F.max("raw_content").alias("raw_content")).select(F.col("id").alias("page_id"), html.alias("html"))
    got = W.extract_html(rows)
    return got.select("id", "title", F.size("paragraphs").alias("n"), sha256(F.array_join("paragraphs", "\n")).alias("text_hash"), F.col("links")[0]["url"].alias("first_link"), F.col("links")[0]["label"].alias("first_label"))


def _target_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("source IN ('public_webpage', 'public_pdf') AND origin IS NOT NULL AND canonical_id IS NOT NULL").select(
        F.col("doc_id").alias("id"), "title", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.lit("yearly research")).alias("visible_text"), F.concat(F.lit("http://"), "canonical_id").alias("requested_url"), F.concat(F.lit("https://"), "canonical_id", F.lit("/")).alias("resolved_url"),
        (F.col("doc_id") % 13 == 0).alias("commercial_landing"), (F.col("doc_id") % 7 != 0).alias("likely_target_mismatch"), F.lit("medium").alias("confidence"))


def _target_links(pages: DataFrame) -> DataFrame:
    """Links that such pages have: a report beside them, themselves, a landing page, a rejected one, and one in their source."""
    title = F.coalesce("title", F.lit(""))
    link = lambda u, label, source: F.struct(u.alias("url"), label.alias("label"), F.lit(source).alias("source"))
    slug = F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-")
    found = F.array(link(F.concat(F.lit("../reports/./"), slug, F.lit(".pdf")), F.concat(title, F.lit(" report")), "anchor_href"), link(F.col("resolved_url"), F.concat(F.lit("canonical "), title), "link_href"), link(F.concat(F.lit("/download/"), slug, F.lit("?a=1&amp;b=2")), title, "anchor_href"),
                    link(F.concat(F.lit("/blog/report-"), slug), title, "anchor_href"), link(F.concat(F.lit("https://elsewhere.example/report/"), slug), title, "meta_url"), link(F.lit("mailto:report@x.example"), title, "anchor_href"))
    own = pages.select("id", F.posexplode(found).alias("pos", "x")).select("id", "pos", "x.*")
    html = F.concat(F.lit('{"u":"'), F.regexp_extract("resolved_url", r"^https?://[^/]*", 0), F.lit("\\/paper\\/"), slug, F.lit('"}'))
    inside = W.embedded_links(pages.select("id", html.alias("html"))).withColumn("pos", F.col("pos") + 100)
    return own.unionByName(inside)


def web_link_targets(spark: SparkSession, d: str) -> DataFrame:
    """The scored links of captured pages."""
    pages = _target_pages(spark, d)
    links = W.link_choice(W.absolute_links(_target_links(pages), pages), on="id")
    return W.scored_links(links, pages).select("id", "url", "score", "rank", F.array_join("matches", ",").alias("matches"), "reason", "content_type")


def web_target_selection(spark: SparkSession, d: str) -> DataFrame:
    """Which target each page's capture should have gone to."""
    pages = _target_pages(spark, d)
    links = W.link_choice(W.absolute_links(_target_links(pages), pages), on="id")
    return W.target_selection(pages, W.scored_links(links, pages)).withColumn("n_candidates", F.size("candidates")).drop("candidates")


def joined_urls(spark: SparkSession, d: str) -> DataFrame:
    """Scalar functions: URLs joined to their page, quoted titles and character references."""
    pages = _target_pages(spark, d)
    up = join_url("resolved_url", F.lit("../a/./b/../c?x#y"))
    return pages.select("id", up.alias("up"), join_url("resolved_url", F.lit("//h.example/p")).alias("host"), quote(F.coalesce("title", F.lit(""))).alias("quoted"), unescaped(F.concat(F.lit("&lt;&#38;&eacute; "), F.coalesce("title", F.lit("")))).alias("plain"))


def caption_cues(spark: SparkSession, d: str) -> DataFrame:
    """Texts put into caption files, parsed and collapsed; a file without cues says so."""
    lines = F.filter(F.transform(F.split(F.regexp_replace("text", r"[^\x20-\x7e]+|[<>&]+", "\n"), "\n"), lambda x: F.trim(F.regexp_replace(x, " +", " "))), lambda x: (x != "") & ~x.rlike("^(NOTE|STYLE|REGION)"))
    body = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("00:00:01.000 --> 00:00:02.000\n"), x, F.lit("\n"))), "\n")
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.encode(F.concat(F.lit("WEBVTT\nKind: captions\n\n"), body), "UTF-8").alias("data"), (F.col("doc_id") % 2 == 0).alias("automatic"))
    got = C.parse(rows, id_col="doc_id").join(rows.select(F.col("doc_id").alias("id"), "automatic"), "id")
    return got.select("id", "problem", F.size(C.collapse("cues", F.col("automatic"))).alias("n"), sha256(F.array_join(C.collapse("cues", F.col("automatic")), "\n")).alias("text_hash"))


def written_files(spark: SparkSession, d: str) -> DataFrame:
    """Every text as a file below the shared folder, scanned back by name, size and digest; a file of no bytes is valid."""
    at = _here(spark, "files").removeprefix("file://")
    rows = table(spark, d, "documents").select(F.concat(F.pmod("doc_id", F.lit(50)).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("output_path"), F.col("text").alias("markdown"))
    files.write_files(rows, at)
    return files.scan_files(spark, f"file://{at}", pattern="*.md").select(F.regexp_replace("title", r"\.md$", "").cast("bigint").alias("doc_id"), "n_bytes", "sha256", "skip_reason")


def manifest_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Each region's nations as a manifest file, written and read back."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("canonical_id"), F.concat(F.lit("n/"), "n_name", F.lit(".md")).alias("output_path"), F.col("n_name").alias("title"), F.lit("").alias("ref"), "n_regionkey")
    at, paths = _here(spark, "manifests").removeprefix("file://"), []
    for r in table(spark, d, "region").select("r_regionkey").orderBy("r_regionkey").collect():  # five fixed rows
        part = n.where(F.col("n_regionkey") == r["r_regionkey"]).drop("n_regionkey")
        paths.append(stored.write_manifest(f"{at}/{r['r_regionkey']}.json", part, generated_at="t", stale=part.where("CAST(canonical_id AS INT) % 2 = 0").select("canonical_id", "output_path")))
    got = stored.read_manifests(spark, paths)
    return got.select(F.regexp_extract("manifest", r"(\d+)\.json$", 1).cast("int").alias("region"), "part", "entry_index", "canonical_id", "output_path", "title", "ref")


def state_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Two runs' entries committed as versioned state; the later one counts."""
    at = _here(spark, "state")
    e = table(spark, d, "bundle_artifact").where("canonical_id IS NOT NULL").groupBy("bundle_name", "canonical_id").agg(F.max("snapshot_no").alias("last_no"))
    stored.commit_state(e.where("last_no > 1"), at, "1")
    stored.commit_state(e, at, "2")
    return stored.current_state(spark, at).select("bundle_name", "canonical_id", "last_no")


def cache_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Pages and child listings stored twice and loaded; the later store counts, a cleared cache is empty."""
    at = _here(spark, "cache")
    src = table(spark, d, "pages").where("id IS NOT NULL").groupBy("id").agg(F.max("version").alias("v"), F.max("space_key").alias("space"))
    rows = src.select(F.col("id").alias("canonical_id"), F.col("v").cast("string").alias("page_version"), F.lit(None).cast("string").alias("last_modified"), F.col("id").alias("payload"))
    caches.store(rows.withColumn("payload", F.lit("old")), f"{at}/pages", WIKI, at="1")
    caches.store(rows.where("page_version IS NOT NULL"), f"{at}/pages", WIKI, at="2")
    caches.store(rows, f"{at}/pages", "https://gone.example", at="1")
    caches.clear(spark, f"{at}/pages", "https://gone.example")
    caches.store_listing(src.select(F.lit("child").alias("kind"), F.col("id").alias("key"), F.array("id", "space").alias("ids")), f"{at}/lists", WIKI, at="1")
    hits = caches.load(spark, f"{at}/pages", WIKI + "/").groupBy((F.col("payload") == "old").alias("old")).agg(F.count(F.lit(1)).alias("n")).select(F.when(F.col("old"), "page, old").otherwise("page, new").alias("what"), "n")
    lists = caches.load_listing(spark, f"{at}/lists", WIKI).agg(F.count(F.lit(1)).alias("n")).select(F.lit("listing").alias("what"), "n")
    gone = caches.load(spark, f"{at}/pages", "https://gone.example").agg(F.count(F.lit(1)).alias("n")).select(F.lit("cleared").alias("what"), "n")
    return hits.unionByName(lists).unionByName(gone)


def bundle_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Regions as bundles that name nations as runs."""
    runs = table(spark, d, "nation").where("n_nationkey % 7 <> 3").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 5 != 0, F.concat(F.lit("out/"), "n_name")).alias("output_dir"))
    named = table(spark, d, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("runs"))
    return U.bundle_inputs(named.select(F.col("n_regionkey").alias("bundle"), "runs"), runs)


DIMENSIONS = ["confluence", "git_repo", "github_metadata", "local_files", "public_pdf", "public_webpage"]


def readiness_matrix(spark: SparkSession, d: str) -> DataFrame:
    """which languages have documents of which source."""
    return U.readiness(table(spark, d, "documents").where("lang IS NOT NULL").select(F.col("lang").alias("adapter"), F.col("source").alias("dimension")), DIMENSIONS)


def retry_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Events as attempts; a run is a day, an item a user."""
    kind = F.when(F.col("event_type") == "click", "timeout").when(F.col("event_type") == "view", "completed").when(F.col("event_type") == "signup", "throttled").otherwise("unavailable")
    log = table(spark, d, "events").where("user_id IS NOT NULL").select("user_id", "event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("day"), kind.alias("outcome"))
    return U.retry_rule(log, key="user_id", run="day", order="event_id", outcome="outcome", max_attempts=2)


def reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """reused, acquired, dropped and pending items of each supplier's run, and how often those tried were tried."""
    l = table(spark, d, "lineitem")
    items = l.select(F.col("l_suppkey").alias("run"), F.col("l_orderkey").alias("item")).distinct()
    disposition = F.when(F.col("item") % 4 == 0, "preserved").when(F.col("item") % 4 == 1, "unattempted").otherwise("attempted")
    log = l.where("l_returnflag <> 'N' AND l_orderkey % 4 > 1").select(F.col("l_suppkey").alias("run"), F.col("l_orderkey").alias("item"))
    s = U.reconciliation_summary(items.withColumn("disposition", disposition), log, on="run", key="item")
    return s.withColumn("attempts", F.array_join(F.transform(F.array_sort(F.map_entries("attempts")), lambda x: F.concat_ws(":", x["key"].cast("string"), x["value"].cast("string"))), ","))


def first_examples(spark: SparkSession, d: str) -> DataFrame:
    """The first eight orders of each priority, and how many there are."""
    e = Q.first_examples(table(spark, d, "orders"), ["o_orderpriority"], ["o_orderdate", "o_orderkey"], ["o_orderkey"], 8)
    return e.select("o_orderpriority", "total", F.array_join(F.transform("examples", lambda x: x["o_orderkey"].cast("string")), ",").alias("examples"))


def run_report_text(spark: SparkSession, d: str) -> DataFrame:
    """Nations as runs, as one markdown report."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("position"), F.col("n_name").alias("name"), F.lit("local_files").alias("run_type"), F.when(F.col("n_nationkey") % 4 == 0, "failed").otherwise("succeeded").alias("status"), (F.col("n_regionkey") == 1).alias("dry_run"),
                                         F.col("n_nationkey").cast("bigint").alias("wrote"), F.col("n_regionkey").cast("bigint").alias("skipped"), F.when(F.col("n_nationkey") % 4 == 0, "a|b").alias("message"))
    return U.report_markdown(n)


def orchestrated_runs(spark: SparkSession, d: str) -> DataFrame:
    """Three runs, the second of which fails; the third is reached because errors don't end the whole."""
    def fails(_: SparkSession) -> tuple[int, int]:
        raise ValueError("no such table")

    plans = [("nations", "count", lambda s: (table(s, d, "nation").count(), 0)), ("nothing", "count", fails), ("regions", "count", lambda s: (0, table(s, d, "region").count()))]
    return U.run_all(spark, plans, continue_on_error=True)


def request_records(spark: SparkSession, d: str) -> DataFrame:
    """C14: orders as requests: their JSON without absent members, and what they break first."""
    o = table(spark, d, "orders")
    r = o.select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderkey").cast("string")).alias("request_id"), F.lit("local_files").alias("adapter_type"), F.when(F.col("o_orderstatus") == "P", F.array(F.lit("x"), F.lit("x"))).otherwise(F.array(F.col("o_orderpriority"))).alias("targets"), F.lit(None).cast("map<string,string>").alias("scope"),
                 F.when(F.col("o_custkey") % 10 != 0, "out").alias("output_location"), F.lit(None).cast("string").alias("credential_reference"), F.lit(None).cast("map<string,string>").alias("selection"), F.lit(None).cast("string").alias("checkpoint_reference"),
                 F.create_map(F.lit("max"), F.col("o_orderkey") % 5 - 1).alias("retry_policy"), F.lit(None).cast("string").alias("expected_contract"), F.when(F.col("o_orderkey") % 13 == 0, F.create_map(F.lit("scope"), F.lit("1"))).alias("extensions"))
    return r.select("o_orderkey", P.request_problem().alias("problem"), P.record_json("request_id", "adapter_type", "output_location", "expected_contract").alias("json"))


def verified_claims(spark: SparkSession, d: str) -> DataFrame:
    """What may be said of suppliers' packages, by how far their verification came."""
    s = table(spark, d, "supplier").select("s_suppkey")
    found = s.where("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("p"), (F.col("s_suppkey") % 11 + 1).cast("int").alias("stage_no"), F.lit("x").alias("code"))
    v = P.first_failing_stage(found, s.select(F.col("s_suppkey").alias("p")), "p")
    m = s.select(F.col("s_suppkey").alias("p"), F.repeat(F.lit("i"), (F.col("s_suppkey") * 7 % 400).cast("int")).alias("package_id"), F.lit("r").alias("run_id"), F.lit("completed").alias("status"), F.create_map(F.lit("failed"), F.lit(0)).alias("counts"), F.array(F.lit("q")).alias("prior_run_ids"), F.array(F.struct(F.col("s_suppkey").cast("bigint").alias("bytes"))).alias("artifacts"))
    c = P.claims(v, m, "p")
    return c.select("p", "state", F.length("package_id").alias("id_chars"), "status", F.size("prior_run_ids").alias("n_prior"), F.col("totals.bytes").alias("bytes"))


def report_order(spark: SparkSession, d: str) -> DataFrame:
    """Stored artifacts in the order of a stale report, with their places."""
    e = table(spark, d, "bundle_artifact").where("output_path IS NOT NULL AND canonical_id IS NOT NULL").select("bundle_name", "output_path", "canonical_id").distinct()
    n = H.running_offsets(e.where("bundle_name IS NOT NULL").withColumn("one", F.lit(1).cast("bigint")), "bundle_name", M.REPORT_ORDER["stale"], "one", "before")
    return M.in_report_order(n.select("bundle_name", "output_path", "canonical_id", (F.col("before") + 1).alias("place")), "stale", ["bundle_name"])


def _nations(spark: SparkSession, d: str) -> list:
    """The nations, which are 25 at any scale, for what a driver writes as one artifact."""
    return table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").limit(1000).collect()


def checkpoint_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A resume checkpoint of nations, saved and loaded with its invariants, and what two broken ones break."""
    at = f"{_here(spark, 'checkpoint').removeprefix('file://')}/c.json"
    ids = [str(r["n_nationkey"]) for r in _nations(spark, d)]
    done = [{"video_id": i, "captured_sha256": "a" * 64, "normalized_sha256": "b" * 64} for i in ids if int(i) % 3 == 1]
    state = {"request_fingerprint": "f", "run_id": "r2", "prior_run_ids": ["r1"], "observed": ids, "pending": [i for i in ids if int(i) % 3 == 0], "completed": done, "attempts": {i: 1 + int(i) % 3 for i in ids}}
    checkpoints.save(state, at)
    got = checkpoints.load(at, "f")
    kept = {c["video_id"] for c in got["completed"]}
    rows = [(i, "pending" if i in got["pending"] else "completed" if i in kept else "observed", got["attempts"][i]) for i in got["observed"]]
    for name, change in (("overlap", {"pending": [c["video_id"] for c in done[:1]]}), ("stranger", {"pending": ["zz"]})):
        rows.append((name, "; ".join(checkpoints.problems(got | change, "f")), None))
    return spark.createDataFrame(rows, "id string, state string, attempts int")


def configured_runs(spark: SparkSession, d: str) -> DataFrame:
    """Nations as the runs of a configuration file, loaded with its checks; relative folders are taken from the file's place."""
    at = _here(spark, "config").removeprefix("file://")
    os.makedirs(at, exist_ok=True)
    runs = [{"name": r["n_name"], "type": config.RUN_TYPES[r["n_regionkey"] % 4], "enabled": r["n_nationkey"] % 6 != 0, "dry_run": r["n_regionkey"] == 2, "options": {"output_dir": f"out/../o/{r['n_nationkey']}"}} for r in _nations(spark, d)]
    with open(f"{at}/runs.json", "w", encoding="utf-8") as f:
        json.dump({"runs": runs}, f)
    loaded, _ = config.load(f"{at}/runs.json")
    place = F.replace(F.element_at("options", F.lit("output_dir")), F.lit(os.path.abspath(at)), F.lit("."))
    return config.frame(spark, loaded).select("index", "name", "type", "enabled", "dry_run", place.alias("output_dir"))


def git_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Nations as a repository's files, a folder a region, read at a branch: text, skipped, or left out by patterns."""
    at = _here(spark, "git").removeprefix("file://")
    for r in _nations(spark, d):
        os.makedirs(f"{at}/r{r['n_regionkey']}", exist_ok=True)
        with open(f"{at}/r{r['n_regionkey']}/{r['n_name']}.{'bin' if r['n_nationkey'] % 5 == 0 else 'md'}", "wb") as f:
            f.write(b"\0" if r["n_nationkey"] % 5 == 0 else b"\xff" if r["n_nationkey"] % 7 == 0 else r["n_name"].encode())
    for args in (["init", "-q", "-b", "main"], ["add", "."], ["-c", "user.name=x", "-c", "user.email=x@x.example", "commit", "-qm", "all"]):
        subprocess.run(["git", "-C", at, *args], check=True, capture_output=True)
    git.register(spark)
    g = spark.read.format("lodestrata_git").option("repo", at).option("ref", "main").option("filesperpartition", "7").load()
    return g.where(~F.col("repo_path").rlike(path_regex("r4/*"))).select("repo_path", "content", "skip_reason", (F.length("commit_sha") == 40).alias("resolved"))


def verified_packages(spark: SparkSession, d: str) -> DataFrame:
    """A sealed package a region, each but the first broken in another way, and what the verifier says of them."""
    at, rows = _here(spark, "packages").removeprefix("file://"), []
    for n in range(5):
        mine = [r for r in _nations(spark, d) if r["n_regionkey"] == n]
        items = [{"item_id": str(r["n_nationkey"]), "outcome": "completed", "artifacts": [f"data/{r['n_nationkey']}.txt"]} for r in mine]
        P.seal(f"{at}/{n}", package_id=str(n), run_id="r", request={"request_id": "q"}, items=items, artifacts={f"data/{r['n_nationkey']}.txt": (r["n_name"].encode(), "record", "text/plain") for r in mine}, created_at="t")
        if n == 1:
            os.remove(f"{at}/{n}/package.sha256")
        elif n == 2:
            with open(f"{at}/{n}/package.json", "ab") as f:
                f.write(b" ")
        elif n > 2:
            with open(f"{at}/{n}/" + ("extra" if n == 3 else f"data/{mine[0]['n_nationkey']}.txt"), "wb") as f:
                f.write(b"other")
        v = packages.verify(spark, f"{at}/{n}")
        rows.append((n, v["state"], v["failed_stage"], v["last_completed_stage"], ",".join(v["findings"])))
    return spark.createDataFrame(rows, "region int, state string, failed_stage string, last_completed_stage string, findings string")


QUERIES = {f.__name__: f for f in (page_records, page_summaries, stub_pages, child_listing, served_listing, issue_records, pull_request_records, release_records, pull_request_markdown, next_links, rate_limits, video_discovery, video_enrichment, canonical_ids, web_html_text, web_link_targets, web_target_selection,
                                   joined_urls, caption_cues, written_files, manifest_round_trip, state_round_trip, cache_round_trip, bundle_inputs, readiness_matrix, retry_decisions, reconciliation, first_examples, run_report_text, orchestrated_runs, request_records, verified_claims, report_order,
                                   checkpoint_round_trip, configured_runs, git_round_trip, verified_packages)}

_TIME = lambda c: f"strftime({c} AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ')"
_PAGES = """WITH r AS (SELECT DISTINCT CASE WHEN version % 7 = 0 THEN id || 'x' ELSE id END AS requested_id, id, title, content, version, last_modified FROM pages WHERE id IS NOT NULL),
 s AS (SELECT *, CASE WHEN version % 5 <> 0 THEN 'https://wiki.example/base/x/' || id END AS url, CASE WHEN id = '' THEN 'missing or invalid canonical_id' WHEN coalesce(title, '') = '' THEN 'missing or invalid title' {content} END AS m FROM r),
 t AS (SELECT *, coalesce(m, CASE WHEN requested_id <> id THEN 'canonical_id mismatch' WHEN url IS NULL THEN 'missing source_url' END) AS problem, CASE WHEN m IS NULL THEN version END AS page_version, CASE WHEN m IS NULL THEN nullif(last_modified, '') END AS changed, CASE WHEN m IS NULL THEN title END AS name FROM s)
"""


def _records(kind: str, key: str, number: str, rules: list[tuple[str, str]], title: str, url: str, where: str = "") -> str:
    bad = f"CASE WHEN {number} IS NULL THEN 'missing or invalid {key}' " + " ".join(f"WHEN {v} IS NULL THEN 'missing or invalid {n}'" for n, v in rules) + " END"
    return f"""WITH d AS (SELECT *, {number} AS num, {bad} AS problem FROM documents WHERE source = 'github_metadata' {where})
 SELECT CASE WHEN problem IS NULL THEN num::VARCHAR END AS key, CASE WHEN problem IS NULL THEN {title} END AS title, CASE WHEN problem IS NULL AND lang <> 'de' THEN nullif(lang, '') END AS author, CASE WHEN problem IS NULL THEN {_TIME('loaded_at')} END AS created_at,
  CASE WHEN problem IS NULL THEN strlen(coalesce(text, '')) END AS n_bytes, CASE WHEN problem IS NULL THEN 'https://tracker.example/a%20b/c/{kind}/' || {url} END AS source_url, problem FROM d"""


_DATED = [("title", "title"), ("created_at", _TIME("loaded_at")), ("updated_at", _TIME("fetched_at"))]
_ODD = "CASE WHEN doc_id % 11 <> 0 THEN doc_id END"
_spaced = lambda x: _squeeze(f"translate({_fold(x)}, '_-', '  ')")
_tokens = lambda x: f"list_filter(list_distinct(regexp_extract_all({_spaced(x)}, '[a-z0-9]+')), lambda t: {_in('t', W.KEEPWORDS)} OR (length(t) >= 4 AND NOT {_in('t', W.STOPWORDS)}))"
_TARGETS = rf"""WITH p AS (SELECT doc_id AS id, coalesce(title, '') AS title, 'https://' || canonical_id || '/' AS resolved, 'http://' || canonical_id AS requested, regexp_extract(canonical_id, '^[^/]*') AS host, regexp_extract(canonical_id, '^[^/]*(.*)$', 1) || '/' AS path, doc_id % 13 = 0 AS commercial, doc_id % 7 <> 0 AS mismatch,
  regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', '-', 'g') AS slug FROM documents WHERE source IN ('public_webpage', 'public_pdf') AND origin IS NOT NULL AND canonical_id IS NOT NULL),
 w AS (SELECT *, {_tokens("title || ' ' || title || ' yearly research'")} AS who, 'https://' || host AS root FROM p),
 l0 AS (SELECT id, 0 AS pos, root || regexp_replace(path, '[^/]+/$', '') || 'reports/' || slug || '.pdf' AS url, title || ' report' AS label, 'anchor_href' AS source FROM w
  UNION ALL SELECT id, 1, resolved, 'canonical ' || title, 'link_href' FROM w UNION ALL SELECT id, 2, root || '/download/' || slug || '?a=1&b=2', title, 'anchor_href' FROM w UNION ALL SELECT id, 3, root || '/blog/report-' || slug, title, 'anchor_href' FROM w
  UNION ALL SELECT id, 4, 'https://elsewhere.example/report/' || slug, title, 'meta_url' FROM w UNION ALL SELECT id, 100, root || '/paper/' || slug, '', 'embedded_page_url' FROM w),
 l1 AS (SELECT l0.*, w.who, w.host AS home, w.resolved, w.requested, regexp_extract(url, '^https?://([^/?#]*)', 1) AS netloc, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS pth, regexp_extract(url, '\?([^#]*)', 1) AS query FROM l0 JOIN w USING (id)),
 l2 AS (SELECT *, lower(pth) AS lpath, {_spaced("netloc || ' ' || pth || ' ' || query")} AS txt, {_spaced('label')} AS lab FROM l1),
 l3 AS (SELECT *, list_sort(list_filter({_tokens("txt || ' ' || lab")}, lambda t: list_contains(who, t))) AS m FROM l2),
 l4 AS (SELECT *, lpath LIKE '%.pdf' AS pdf, lpath LIKE '%.pdf' OR {_has('lpath', W.STABLE_PATHS)} OR regexp_matches(lpath, '/(toc|table-of-contents)/?$') OR (contains(lab, 'canonical') AND {_has("(translate(lpath, '_-', '  ') || ' ' || lab)", W.REPORT_TERMS)}) AS stable FROM l3
  WHERE (netloc = home OR (regexp_extract(netloc, '([^.]+\.[^.]+)$', 1) = regexp_extract(home, '([^.]+\.[^.]+)$', 1) AND regexp_extract(netloc, '([^.]+\.[^.]+)$', 1) <> '')) AND NOT {_has('lpath', W.REJECT_PATHS)} AND NOT {_in('netloc', W.REJECT_HOSTS)} AND {_has("(txt || ' ' || lab)", W.REPORT_TERMS)}
  AND (len(m) >= 2 OR (list_contains(m, 'dora') AND list_contains(m, '2025')))),
 l5 AS (SELECT *, NOT pdf AND NOT stable AND {_has('txt', ['report', 'whitepaper', 'download'])} AS html_like, {_has('lab', ['canonical', 'citation_pdf_url', 'og:url'])} AS named, contains(txt, 'abridged') AS abridged,
  (netloc = home AND rtrim(pth, '/') IN (rtrim(regexp_extract(resolved, '^https?://[^/?#]*([^?#]*)', 1), '/'), rtrim(regexp_extract(requested, '^https?://[^/?#]*([^?#]*)', 1), '/'))) AS back FROM l4),
 l6 AS (SELECT *, CASE WHEN pdf THEN 48 WHEN stable THEN 34 WHEN html_like THEN 28 ELSE 0 END + CASE WHEN source IN ('anchor_href', 'link_href', 'meta_url') THEN 8 ELSE 6 END + CASE WHEN named THEN 10 ELSE 0 END + CASE WHEN stable THEN 12 ELSE 0 END + least(36, 6 * len(m)) + CASE WHEN list_contains(m, 'dora') THEN 8 ELSE 0 END
  + CASE WHEN list_contains(m, '2025') THEN 8 ELSE 0 END - CASE WHEN abridged THEN 35 ELSE 0 END - CASE WHEN back THEN 40 ELSE 0 END AS score,
  concat_ws(',', CASE WHEN pdf THEN 'pdf_asset' WHEN stable THEN 'stable_publication_url' WHEN html_like THEN 'report_like_html_target' END, CASE WHEN source <> 'embedded_page_url' THEN 'observed_in_' || source END, CASE WHEN named THEN 'explicit_canonical_metadata' END,
   CASE WHEN source = 'embedded_page_url' THEN 'observed_in_embedded_page_url' END, CASE WHEN stable THEN 'stable_research_asset' END, CASE WHEN abridged THEN 'abridged_asset_penalty' END, CASE WHEN back THEN 'points_back_to_wrapper_page_penalty' END) AS reason FROM l5),
 scored AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, url) AS rank FROM l6 WHERE score >= 35 QUALIFY rank <= 12)
"""
_PICK = lambda k: "CASE c " + " ".join(f"WHEN '{n}' THEN '{v[k]}'" for n, v in W.TARGETS.items()) + " END"
_DAY = lambda c: f"strftime({c}, '%Y-%m-%d')"

SQL: dict[str, str] = {
    "page_records": _PAGES.format(content="WHEN content IS NULL THEN 'missing or invalid content'") + "SELECT requested_id, name AS title, url AS source_url, page_version, changed AS last_modified, problem, count(*) AS n, sum(CASE WHEN m IS NULL THEN length(content) ELSE -1 END)::BIGINT AS chars FROM t GROUP BY ALL",
    "page_summaries": _PAGES.format(content="") + "SELECT DISTINCT requested_id, name AS title, page_version, changed AS last_modified, problem FROM t",
    "stub_pages": "SELECT DISTINCT coalesce(id, 'unknown') AS canonical_id, 'stub-page-' || coalesce(id, 'unknown') AS title, '' AS source_url, 'Stub content for page ' || coalesce(id, 'unknown') || '.' AS content, 1::BIGINT AS page_version, '1970-01-01T00:00:00Z' AS last_modified FROM pages",
    "child_listing": """WITH r AS (SELECT DISTINCT id, child_page_ids AS k FROM pages WHERE id IS NOT NULL), p AS (SELECT *, CASE WHEN k IS NULL THEN 'invalid listing' WHEN len(list_filter(k, lambda x: x IS NULL OR x = '')) > 0 THEN 'a result has no id' END AS problem FROM r)
 SELECT id AS page, 0 AS position, NULL::VARCHAR AS child, problem FROM p WHERE problem IS NOT NULL UNION ALL SELECT id, unnest(range(len(k)))::INT, unnest(k), problem FROM p WHERE problem IS NULL""",
    "served_listing": """WITH s AS (SELECT space_key FROM pages WHERE space_key IS NOT NULL GROUP BY 1 ORDER BY count(DISTINCT id) DESC, space_key LIMIT 1), o AS (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM (SELECT DISTINCT id FROM pages WHERE space_key = (SELECT space_key FROM s)))
 SELECT (rn - 101)::INT AS position, id, (SELECT count(*) FROM o) > 200 AS more FROM o WHERE rn BETWEEN 101 AND 200""",
    "issue_records": _records("issues", "number", _ODD, _DATED, "title", "num", "AND doc_id % 4 <> 0"),
    "pull_request_records": _records("pull", "number", _ODD, _DATED, "title", "num"),
    "release_records": _records("releases/tag", "release_id", "doc_id", [("created_at", _TIME("loaded_at"))], "coalesce(title, '')", "url_encode(coalesce(canonical_id, 'v 1/2'))"),
    "pull_request_markdown": f"""WITH c AS (SELECT l_orderkey, {_DAY('l_shipdate')} AS t, l_partkey * 10 + l_linenumber AS i, CASE WHEN l_suppkey % 3 = 0 THEN 'https://api.example/c' ELSE 'https://t.example/c/' || l_linenumber::VARCHAR END AS u, 's' || l_suppkey::VARCHAR AS a, CASE WHEN l_returnflag <> 'N' THEN l_returnflag ELSE '' END AS b FROM lineitem),
 n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY t, i, u, a, b) AS k FROM c),
 s AS (SELECT l_orderkey, string_agg('### Comment ' || k::VARCHAR || chr(10) || chr(10) || '- author: ' || a || chr(10) || '- created_at: ' || t || chr(10) || '- updated_at: ' || t || chr(10) || '- source_url: ' || u || chr(10) || chr(10) || CASE WHEN b = '' THEN '{R.EMPTY["pull_request_comment"]}' ELSE b END || chr(10), chr(10) ORDER BY k) AS s FROM n GROUP BY 1),
 m AS (SELECT o_orderkey, '# Pull Request #' || o_orderkey::VARCHAR || ': ' || o_orderpriority || chr(10) || chr(10) || '## Metadata' || chr(10) || '- repo: a/b' || chr(10) || '- resource_type: pull_request' || chr(10) || '- number: ' || o_orderkey::VARCHAR || chr(10) || '- state: ' || o_orderstatus || chr(10) || '- author: ' || chr(10) || '- created_at: ' || {_DAY('o_orderdate')} || chr(10) || '- updated_at: ' || {_DAY('o_orderdate')}
   || chr(10) || '- source_url: u' || chr(10) || chr(10) || '## Body' || chr(10) || chr(10) || 'x' || CASE WHEN s IS NULL THEN '' ELSE chr(10) || chr(10) || '## Comments' || chr(10) || chr(10) || rtrim(s, chr(10)) END || chr(10) AS md FROM orders LEFT JOIN s ON l_orderkey = o_orderkey)
 SELECT o_orderkey, strlen(md) AS n_bytes, sha256(md) AS content_hash FROM m""",
    "next_links": """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 4 < 2 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'https://api.example/v3' ELSE 'HTTPS://API.example/v3' END || '/items?page=' || o_custkey::VARCHAR END AS url,
 CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 4 >= 2 THEN 'pagination URL outside the API root' END AS problem FROM orders""",
    "rate_limits": """SELECT CASE WHEN event_id % 5 = 0 THEN 'retry after 30 second(s)' WHEN event_id % 3 = 0 OR event_id % 4 = 2 THEN CASE WHEN event_id % 7 < 3 THEN 'reset at 1970-01-0' || (1 + event_id % 7)::VARCHAR || 'T00:00:00' WHEN event_id % 7 < 5 THEN 'reset at soon' ELSE 'no retry time provided' END END AS hint, count(*) AS n FROM events GROUP BY 1""",
    "video_discovery": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS i, l_partkey % 5 AS k FROM lineitem),
 f AS (SELECT *, CASE WHEN l_suppkey % 9 = 0 THEN 'no_id' WHEN k = 1 THEN 'private' WHEN k = 3 THEN 'unavailable' END AS failure FROM e)
 SELECT l_orderkey::VARCHAR AS collection_id, CASE WHEN l_suppkey % 9 <> 0 THEN l_partkey::VARCHAR END AS video_id, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber * 10 ELSE i END::BIGINT AS position, failure IS NULL AS available, failure FROM f""",
    "video_enrichment": """SELECT o_orderkey::VARCHAR AS video_id, t.kind, t.language, t.format, CASE WHEN t.name = 'p' THEN o_orderpriority ELSE t.name END AS name FROM orders, (VALUES ('creator', 'en', 'vtt', 'p'), ('creator', 'en', 'srv1', NULL), ('creator', 'de', 'vtt', 'x'), ('automatic', 'fr', 'vtt', 'auto')) t(kind, language, format, name)
 WHERE t.language = 'en' OR (t.language = 'de' AND o_orderstatus = 'O') OR (t.language = 'fr' AND o_orderstatus <> 'F')""",
    "canonical_ids": """SELECT doc_id, CASE WHEN source = 'git_repo' THEN origin || '@' || substr(sha256(origin), 1, 40) || ':' || coalesce(canonical_id, 'x') ELSE 'github_metadata:tracker.example:' || origin || ':issue:' || doc_id::VARCHAR END AS id,
 'pages/' || coalesce(canonical_id, 'x') || CASE WHEN coalesce(canonical_id, 'x') LIKE '%.md' THEN '' ELSE '.md' END AS output_path FROM documents WHERE source IN ('github_metadata', 'git_repo') AND origin IS NOT NULL""",
    "web_html_text": f"""WITH r AS (SELECT id, max(raw_content) AS c FROM article_chrome_cases WHERE id IS NOT NULL AND raw_content IS NOT NULL GROUP BY 1),
 p AS (SELECT id, list_filter(list_transform(list_filter(string_split_regex(regexp_replace(c, '\r\n', chr(10), 'g'), '\n[ \t]*\n'), lambda x: trim(x, ' ') <> ''), lambda x: {_squeeze('x')}), lambda x: x <> '') AS ps FROM r)
 SELECT id, 'T & x' AS title, (len(ps) + 1)::INT AS n, sha256(array_to_string(list_prepend('Go', ps), chr(10))) AS text_hash, '/n' AS first_link, 'Go' AS first_label FROM p""",
    "web_link_targets": _TARGETS + "SELECT id, url, score::INT AS score, rank::INT AS rank, array_to_string(m, ',') AS matches, reason, CASE WHEN pdf THEN 'pdf' ELSE 'html' END AS content_type FROM scored",
    "web_target_selection": _TARGETS + f""", b AS (SELECT id, count(*) FILTER (score >= 70) AS strong, count(*) AS n, first(url ORDER BY rank) AS u, first(reason ORDER BY rank) AS r, first(CASE WHEN pdf THEN 'pdf' ELSE 'html' END ORDER BY rank) AS t, max(score) AS top FROM scored GROUP BY 1),
 j AS (SELECT w.id, CASE WHEN commercial THEN 'commercial' WHEN NOT mismatch THEN 'no_mismatch' WHEN coalesce(strong, 0) = 0 THEN 'none' WHEN strong > 1 THEN 'ambiguous' ELSE 'selected' END AS c, b.* EXCLUDE (id) FROM w LEFT JOIN b ON b.id = w.id)
 SELECT id, {_PICK(0)} AS status, CASE WHEN c = 'selected' THEN r ELSE {_PICK(1)} END AS reason, {_PICK(2)} AS canonical_status, CASE WHEN c = 'selected' THEN CASE WHEN top >= 75 THEN 'high' ELSE 'medium' END WHEN c = 'no_mismatch' THEN 'medium' ELSE {_PICK(3)} END AS canonical_confidence,
  CASE WHEN c = 'selected' THEN u ELSE '' END AS selected_url, CASE WHEN c = 'selected' THEN t ELSE '' END AS selected_content_type, (CASE WHEN c IN ('commercial', 'no_mismatch') THEN 0 ELSE coalesce(n, 0) END)::INT AS n_candidates FROM j""",
    "joined_urls": """SELECT doc_id AS id, 'https://' || regexp_extract(canonical_id, '^[^/]*') || regexp_replace(regexp_extract(canonical_id, '^[^/]*(.*)$', 1) || '/', '[^/]+/$', '') || 'a/c?x#y' AS up, 'https://h.example/p' AS host, url_encode(coalesce(title, '')) AS quoted, '<&é ' || coalesce(title, '') AS plain
 FROM documents WHERE source IN ('public_webpage', 'public_pdf') AND origin IS NOT NULL AND canonical_id IS NOT NULL""",
    "caption_cues": r"""WITH l AS (SELECT doc_id, doc_id % 2 = 0 AS automatic, list_filter(list_transform(string_split(regexp_replace(text, '[^\x20-\x7e]+|[<>&]+', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, ' +', ' ', 'g'), ' ')), lambda x: x <> '' AND NOT regexp_matches(x, '^(NOTE|STYLE|REGION)')) AS c FROM documents WHERE text IS NOT NULL),
 k AS (SELECT doc_id, len(c) AS total, list_filter(c, lambda x, i: NOT coalesce(CASE WHEN automatic THEN starts_with(c[i + 1], x) ELSE c[i + 1] = x END, false)) AS c FROM l)
 SELECT doc_id AS id, CASE WHEN total = 0 THEN 'WebVTT contains no spoken cues' END AS problem, CASE WHEN total > 0 THEN len(c)::INT END AS n, CASE WHEN total > 0 THEN sha256(array_to_string(c, chr(10))) END AS text_hash FROM k""",
    "written_files": "SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes, sha256(coalesce(text, '')) AS sha256, CASE WHEN contains(text, chr(0)) THEN 'binary file' END AS skip_reason FROM documents",
    "manifest_round_trip": """WITH n AS (SELECT n_regionkey AS region, n_nationkey::VARCHAR AS canonical_id, 'n/' || n_name || '.md' AS output_path, n_name AS title, n_nationkey FROM nation)
 SELECT region, 'files' AS part, (row_number() OVER (PARTITION BY region ORDER BY output_path) - 1)::INT AS entry_index, canonical_id, output_path, title, NULL::VARCHAR AS ref FROM n
 UNION ALL SELECT region, 'stale_artifacts', (row_number() OVER (PARTITION BY region ORDER BY output_path) - 1)::INT, canonical_id, output_path, NULL, NULL FROM n WHERE n_nationkey % 2 = 0""",
    "state_round_trip": "SELECT bundle_name, canonical_id, max(snapshot_no) AS last_no FROM bundle_artifact WHERE canonical_id IS NOT NULL GROUP BY 1, 2",
    "cache_round_trip": """WITH s AS (SELECT id, max(version) AS v, max(space_key) AS space FROM pages WHERE id IS NOT NULL GROUP BY 1)
 SELECT CASE WHEN v IS NULL THEN 'page, old' ELSE 'page, new' END AS what, count(*) AS n FROM s GROUP BY 1 UNION ALL SELECT 'listing', count(*) FROM s WHERE trim(id, ' ') <> '' AND trim(space, ' ') <> '' UNION ALL SELECT 'cleared', 0""",
    "bundle_inputs": """WITH n AS (SELECT n_regionkey AS bundle, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS position, n_name AS run, CASE WHEN n_nationkey % 7 = 3 THEN 'unknown run' WHEN n_nationkey % 5 = 0 THEN 'run without an output folder' END AS problem FROM nation)
 SELECT bundle, position, run, CASE WHEN problem IS NULL THEN 'out/' || run END AS input_dir, problem FROM n""",
    "readiness_matrix": "SELECT lang AS adapter, " + ", ".join(f"coalesce(bool_or(source = '{x}'), false) AS {x}" for x in DIMENSIONS) + " FROM documents WHERE lang IS NOT NULL GROUP BY 1",
    "retry_decisions": """WITH l AS (SELECT user_id, event_id, strftime(ts, '%Y-%m-%d') AS day, CASE event_type WHEN 'click' THEN 'timeout' WHEN 'view' THEN 'completed' WHEN 'signup' THEN 'throttled' ELSE 'unavailable' END AS outcome FROM events WHERE user_id IS NOT NULL),
 n AS (SELECT day, user_id, count(*) AS attempts, arg_max(outcome, event_id) AS last_outcome FROM l GROUP BY 1, 2)
 SELECT *, (sum(attempts) OVER (PARTITION BY user_id ORDER BY day))::BIGINT AS total_attempts, CASE WHEN last_outcome = 'completed' THEN 'done' WHEN last_outcome IN ('timeout', 'throttled', 'transient') AND attempts < 2 THEN 'retry' ELSE 'give_up' END AS decision FROM n""",
    "reconciliation": """WITH i AS (SELECT DISTINCT l_suppkey AS run, l_orderkey AS item FROM lineitem), t AS (SELECT l_suppkey AS run, l_orderkey AS item, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' AND l_orderkey % 4 > 1 GROUP BY 1, 2),
 h AS (SELECT run, string_agg(n::VARCHAR || ':' || c::VARCHAR, ',' ORDER BY n) AS attempts FROM (SELECT run, n, count(*) AS c FROM t GROUP BY 1, 2) GROUP BY 1)
 SELECT i.run, count(*) FILTER (i.item % 4 = 0) AS reused, count(*) FILTER (i.item % 4 > 1 AND t.n IS NOT NULL) AS acquired, count(*) FILTER (i.item % 4 > 1 AND t.n IS NULL) AS dropped, count(*) FILTER (i.item % 4 = 1) AS pending, coalesce(any_value(h.attempts), '') AS attempts
 FROM i LEFT JOIN t ON t.run = i.run AND t.item = i.item LEFT JOIN h ON h.run = i.run GROUP BY 1""",
    "first_examples": "WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS k FROM orders) SELECT o_orderpriority, count(*) AS total, string_agg(o_orderkey::VARCHAR, ',' ORDER BY k) FILTER (k <= 8) AS examples FROM o GROUP BY 1",
    "run_report_text": """WITH n AS (SELECT *, n_nationkey % 4 = 0 AS bad, n_regionkey = 1 AS dry FROM nation) SELECT '# Run report' || chr(10) || chr(10) || '- runs: ' || count(*) || chr(10) || '- succeeded: ' || count(*) FILTER (NOT bad) || chr(10) || '- failed: ' || count(*) FILTER (bad) || chr(10) || '- interrupted: 0' || chr(10)
 || '- wrote: ' || sum(n_nationkey) FILTER (NOT dry) || ', skipped: ' || sum(n_regionkey) FILTER (NOT dry) || chr(10) || '- would write: ' || sum(n_nationkey) FILTER (dry) || ', would skip: ' || sum(n_regionkey) FILTER (dry) || chr(10) || chr(10)
 || '| # | name | type | status | dry run | wrote | skipped | message |' || chr(10) || '| --- | --- | --- | --- | --- | --- | --- | --- |' || chr(10)
 || string_agg('| ' || n_nationkey || ' | ' || n_name || ' | local_files | ' || CASE WHEN bad THEN 'failed' ELSE 'succeeded' END || ' | ' || CASE WHEN dry THEN 'yes' ELSE 'no' END || ' | ' || n_nationkey || ' | ' || n_regionkey || ' | ' || CASE WHEN bad THEN 'a/b' ELSE '' END || ' |', chr(10) ORDER BY n_nationkey) || chr(10) AS markdown FROM n""",
    "orchestrated_runs": """SELECT 1 AS position, 'nations' AS name, 'count' AS run_type, 'succeeded' AS status, false AS dry_run, (SELECT count(*) FROM nation) AS wrote, 0::BIGINT AS skipped, NULL::VARCHAR AS message
 UNION ALL SELECT 2, 'nothing', 'count', 'failed', false, NULL, NULL, 'no such table' UNION ALL SELECT 3, 'regions', 'count', 'succeeded', false, 0, (SELECT count(*) FROM region), NULL""",
    "request_records": """SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'missing request_id' WHEN o_orderstatus = 'P' THEN 'repeated target' WHEN o_custkey % 10 = 0 THEN 'missing output_location' WHEN o_orderkey % 5 = 0 THEN 'negative retry_policy' WHEN o_orderkey % 13 = 0 THEN 'reserved extension' END AS problem,
 '{"adapter_type":"local_files"' || CASE WHEN o_custkey % 10 <> 0 THEN ',"output_location":"out"' ELSE '' END || CASE WHEN o_orderkey % 9 <> 0 THEN ',"request_id":"' || o_orderkey || '"' ELSE '' END || '}' AS json FROM orders""",
    "verified_claims": """WITH s AS (SELECT s_suppkey AS p, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 11 ELSE 11 END AS done, s_suppkey * 7 % 400 AS c FROM supplier)
 SELECT p, CASE WHEN p % 3 > 0 THEN 'rejected' ELSE 'verified' END AS state, CASE WHEN done > 3 AND c <= 200 THEN c END AS id_chars, CASE WHEN done > 7 THEN 'completed' END AS status, CASE WHEN done > 9 THEN 1 END AS n_prior, CASE WHEN done > 10 THEN p END AS bytes FROM s""",
    "checkpoint_round_trip": """SELECT n_nationkey::VARCHAR AS id, CASE n_nationkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'completed' ELSE 'observed' END AS state, (1 + n_nationkey % 3)::INT AS attempts FROM nation
 UNION ALL SELECT 'overlap', 'completed and pending overlap', NULL UNION ALL SELECT 'stranger', 'pending is no part of observed', NULL""",
    "configured_runs": """SELECT n_nationkey::INT AS index, n_name AS name, (['confluence', 'local_files', 'git_repo', 'github_metadata'])[n_regionkey % 4 + 1] AS type, n_nationkey % 6 <> 0 AS enabled, n_regionkey = 2 AS dry_run, './o/' || n_nationkey::VARCHAR AS output_dir FROM nation""",
    "git_round_trip": """SELECT 'r' || n_regionkey || '/' || n_name || CASE WHEN n_nationkey % 5 = 0 THEN '.bin' ELSE '.md' END AS repo_path, CASE WHEN n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 0 THEN n_name END AS content,
 CASE WHEN n_nationkey % 5 = 0 THEN 'binary file' WHEN n_nationkey % 7 = 0 THEN 'binary or non-UTF-8 file' END AS skip_reason, true AS resolved FROM nation WHERE n_regionkey <> 4""",
    "verified_packages": """SELECT 0 AS region, 'verified' AS state, NULL::VARCHAR AS failed_stage, 'complete' AS last_completed_stage, '' AS findings UNION ALL SELECT 1, 'rejected', 'envelope', NULL, 'package.sha256: missing-required-file' UNION ALL SELECT 2, 'rejected', 'manifest-digest', 'sidecar-format', 'package.json: manifest-digest-mismatch'
 UNION ALL SELECT 3, 'rejected', 'inventory-coverage', 'path-safety', 'extra: inventory-coverage-mismatch' UNION ALL SELECT 4, 'rejected', 'artifact-integrity', 'lineage', 'data/' || (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 4)::VARCHAR || '.txt: artifact-size-mismatch'""",
    "report_order": "SELECT bundle_name, output_path, canonical_id, row_number() OVER (PARTITION BY bundle_name ORDER BY output_path, canonical_id) AS place FROM (SELECT DISTINCT bundle_name, output_path, canonical_id FROM bundle_artifact WHERE output_path IS NOT NULL AND canonical_id IS NOT NULL AND bundle_name IS NOT NULL)",
}
