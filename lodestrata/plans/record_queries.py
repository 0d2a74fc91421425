"""Registered queries of the record, tree, web and paged-text operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import byte_length, rstrip, sha256, splitlines
from lodestrata.operators import bundles as B
from lodestrata.operators import captions as C
from lodestrata.operators import hierarchy as H
from lodestrata.operators import packages as P
from lodestrata.operators import paged as G
from lodestrata.operators import quality as Q
from lodestrata.operators import records as R
from lodestrata.operators import tree as T
from lodestrata.operators import urls as L
from lodestrata.operators import web as W
from lodestrata.session import cut, table

MAX_BYTES = 65_536
FETCHED = "see manifest fetched_at; omitted from candidate markdown for stable diffs"


def record_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Every document as markdown, by its size and hash."""
    md = R.record_markdown(title="title", canonical_id="canonical_id", source_url="origin", content="text", source="source", adapter="source", updated_at="lang")
    return table(spark, d, "documents").select("doc_id", md.alias("md")).select("doc_id", byte_length("md").alias("n_bytes"), sha256("md").alias("content_hash"))


def web_markdown(spark, d):
    """Captured pages with their extra metadata lines and the note."""
    md = R.record_markdown(title="description", canonical_id="id", source_url="resolved_url", content="raw_content", source=F.lit("public_webpage"), adapter=F.lit("public_webpage"), extra=(("candidate_status", F.lit("unreviewed")), ("extraction_notes", F.lit("Unreviewed candidate material."))),
                           note="This is unreviewed candidate material generated from an external public source.")
    return table(spark, d, "article_chrome_cases").select("id", sha256(md).alias("content_hash")).distinct()


def paged_markdown(spark, d):
    """Scanned reports with one block a page; the hash doesn't depend on when they were fetched."""
    pages = F.array_join(F.transform(F.coalesce("raw_pages", F.array().cast("array<string>")), lambda p, i: F.concat(F.lit("## Page "), (i + 1).cast("string"), F.lit("\n\n"), F.coalesce(p, F.lit("")))), "\n\n")
    md = R.record_markdown(title="description", canonical_id="id", source_url=F.lit(""), content=pages, source=F.lit("public_pdf"), adapter=F.lit("public_pdf"), fetched_at=F.lit(FETCHED), extra=(("candidate_status", F.lit("unreviewed")), ("page_count", F.coalesce(F.size("raw_pages"), F.lit(0)).cast("string")), ("extraction_notes", F.lit("Unreviewed candidate material."))), note="This is unreviewed candidate material generated from an external public PDF/report.")
    return table(spark, d, "dora_regression_cases").select("id", byte_length(md).alias("n_bytes"), sha256(md).alias("content_hash")).distinct()


def _sections(spark, d):
    s = B.section(title="title", canonical_id="canonical_id", source_url="origin", content="text", is_stale=F.col("lang").isNull(), fetched_at=F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss"), path="source", ref="lang")
    return table(spark, d, "documents").select("doc_id", F.coalesce("origin", F.lit("")).alias("origin"), F.coalesce("canonical_id", F.lit("")).alias("canonical_id"), F.explode(F.array(s)).alias("md"))


def bundle_sections(spark, d):
    """Every document as a bundle section."""
    return _sections(spark, d).select("doc_id", byte_length("md").alias("n_bytes"), sha256("md").alias("section_hash"))


def _split(spark, d):
    # Written once: range partitioning looks at its input twice, which would render every section twice.
    sizes = cut(_sections(spark, d).select("doc_id", "origin", F.col("canonical_id"), byte_length("md").alias("n_bytes")))
    s = B.ordered(sizes.withColumns({"input_index": F.lit(0), "entry_index": F.col("doc_id")}), ["origin"], "manifest")
    return B.split(s, "origin", max_bytes=MAX_BYTES)


def bundle_split(spark, d):
    """The file of each section, one bundle an origin, files of at most 64 KiB."""
    return _split(spark, d).select("origin", "doc_id", "position", "file_no", "oversized")


def bundle_files(spark, d):
    """The files themselves, by their size and hash; a file's sections are bounded by its size."""
    j = _split(spark, d).select("doc_id", "position", "file_no").join(_sections(spark, d), "doc_id")
    md = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "md"))), lambda x: x["md"]), B.SEPARATOR)
    return j.groupBy("origin", "file_no").agg(F.count(F.lit(1)).alias("sections"), F.concat(md, F.lit("\n")).alias("md")).select("origin", "file_no", "sections", byte_length("md").alias("n_bytes"), sha256("md").alias("file_hash"))


def package_inventory(spark, d):
    """Bytes and digest of each document as an artifact of its origin's package."""
    a = table(spark, d, "documents").select("origin", "doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    return P.inventory(a)


def package_totals(spark, d):
    return P.totals(package_inventory(spark, d), ["origin"])


def canonical_json(spark, d):
    """Expected metadata in canonical form."""
    return P.canonical(table(spark, d, "dora_regression_cases").where("expected_metadata IS NOT NULL"), id_col="id", text="expected_metadata").distinct()


def git_skip_reasons(spark, d):
    """Which texts a file scan would skip, by reason."""
    t = F.col("text")
    why = F.when(t.isNull(), "missing after checkout").when(F.instr(t, "\u0000") > 0, "binary file")
    return table(spark, d, "documents").groupBy("source", why.alias("skip_reason")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(byte_length(t), F.lit(0))).cast("bigint").alias("n_bytes"))


def _links_and_roots(spark, d):
    cur = cut(H.current_rows(table(spark, d, "pages")))
    links = cut(H.page_links(cur))
    return links, cur.select(F.col("id").alias("root")).join(links.select(F.col("child").alias("root")), "root", "left_anti")


def tree_bfs(spark, d):
    """Pages below each page that has no parent, by their shortest depth, at most eight levels down."""
    return T.walk(*_links_and_roots(spark, d), max_depth=8)


def tree_bfs_all(spark, d):
    """As ``tree_bfs``, down to the deepest page."""
    return T.walk(*_links_and_roots(spark, d))


def space_listing(spark, d):
    """Each space's distinct ids with their place in lexical order."""
    ids = T.listing(table(spark, d, "pages"), "space_key", "id").where("space_key IS NOT NULL").withColumn("one", F.lit(1).cast("bigint"))
    return H.running_offsets(ids, "space_key", "id", "one", "before").select("space_key", "id", (F.col("before") + 1).alias("place"))


def url_output_name(spark, d):
    """C11: file names of the requested URLs."""
    return table(spark, d, "article_chrome_cases").select("requested_url").distinct().select("requested_url", R.output_name("requested_url").alias("name"))


def public_url_check(spark, d):
    """What speaks against each resolved URL."""
    return table(spark, d, "article_chrome_cases").groupBy(L.url_problem("resolved_url").alias("problem")).agg(F.count(F.lit(1)).alias("n"))


def api_roots(spark, d):
    """Web and API roots of the hosts at hand, and whether pages lie under their host's wiki root."""
    u = F.col("requested_url")
    host = F.regexp_extract(u, r"^(https?://[^/?#]*)", 1)
    r = L.api_root(host)
    return table(spark, d, "article_chrome_cases").where("requested_url IS NOT NULL").groupBy(host.alias("host"), r["web"].alias("web"), r["api"].alias("api")).agg(F.count_if(L.under_base(u, F.concat(host, F.lit("/wiki")))).alias("under_wiki"), F.count(F.lit(1)).alias("n"))


def _paras(spark, d):
    rows = table(spark, d, "article_chrome_cases").where("id IS NOT NULL AND raw_content IS NOT NULL").select("id", "raw_content", "requested_url", "resolved_url").distinct()
    return rows, W.text_paragraphs(rows, id_col="id", content="raw_content")


def web_chrome_reasons(spark, d):
    """Suppressed paragraphs and characters of each page by reason."""
    return _paras(spark, d)[1].where("reason IS NOT NULL").groupBy("id", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("para")).cast("bigint").alias("chars"))


def web_shape_counts(spark, d):
    """Paragraph counters of every page."""
    return W.intent_counts(_paras(spark, d)[1])


def web_source_intent(spark, d):
    """each page's flags, confidence and shape."""
    rows, paras = _paras(spark, d)
    return W.intent_shape(W.intent_counts(paras).join(rows.select("id", "requested_url", "resolved_url"), "id")).select("id", "ratio", "wrapper", "likely_target_mismatch", "confidence", "shape")


def _links(spark, d):
    found = F.regexp_extract_all("text", F.lit(r"\[([^\]\n]*)\]\((https?://[^)\s]+)\)"), F.lit(0))
    e = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.posexplode(found).alias("pos", "m"))
    return e.select("id", "pos", F.regexp_extract("m", r"\]\(([^)]*)\)", 1).alias("url"), F.regexp_extract("m", r"^\[([^\]]*)\]", 1).alias("label"), F.lit("anchor_href").alias("source"))


def web_link_choice(spark, d):
    """The links of each document, one a URL."""
    return W.link_choice(_links(spark, d), on="id").select("id", "url", "pos", "label")


def _reports(spark, d):
    """The distinct reports, spread over as many tasks as shuffles have: their texts cost more than their bytes tell."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, d, "dora_regression_cases").where("id IS NOT NULL AND raw_pages IS NOT NULL").select("id", "raw_pages").distinct().repartition(n, "id")


def _pages(spark, d):
    rows = _reports(spark, d)
    return rows.select("id", F.posexplode("raw_pages").alias("p", "t")).select("id", (F.col("p") + 1).alias("page_no"), F.coalesce("t", F.lit("")).alias("text"))


def web_quality_markdown(spark, d):
    """Captured pages with the lines of their assessment, by hash."""
    rows, paras = _paras(spark, d)
    c = W.intent_shape(W.intent_counts(paras).join(rows, "id"))
    none = F.create_map().cast("map<string,bigint>")
    c = c.select("*", F.explode(F.array(Q.classification("retained_chars", F.create_map(F.lit("page_chrome"), F.col("suppressed")), none, F.array().cast("array<string>"), F.col("likely_target_mismatch")))).alias("_q"))
    fields = {"operational_state": F.col("_q.state"), "promotion_state": F.col("_q.promotion"), "review_effort": F.col("_q.effort"), "bounded_review_economics": F.col("_q.bounded"), "deterministic_cleanup_count": F.col("_q.cleanup"), "remaining_artifact_count": F.col("_q.remaining"),
              "webpage_chrome_suppressed_paragraph_count": F.col("suppressed"), "webpage_target_shape_assessment": F.col("shape"), "webpage_possible_wrapper_page": F.col("wrapper"), "webpage_possible_lead_form_page": F.col("lead_form"), "webpage_possible_download_landing_page": F.col("download_landing"),
              "webpage_commercial_landing_page_detected": F.col("commercial_landing"), "webpage_mutable_index_page_detected": F.col("mutable_index"), "webpage_chapter_navigation_source_detected": F.col("chapter_navigation"), "webpage_historical_report_redirect_detected": F.col("historical_redirect"),
              "webpage_stable_research_asset_detected": F.col("stable_asset"), "webpage_substantive_content_confidence": F.col("confidence"), "webpage_likely_target_mismatch": F.col("likely_target_mismatch")}
    md = R.record_markdown(title=F.lit("page"), canonical_id="id", source_url="resolved_url", content="raw_content", source=F.lit("public_webpage"), adapter=F.lit("public_webpage"), extra=(("candidate_status", F.lit("unreviewed")), ("extraction_notes", F.lit("Unreviewed candidate material.")), *R.quality_lines("replay_quality", fields)),
                           note="This is unreviewed candidate material generated from an external public source.")
    return c.select("id", sha256(md).alias("content_hash")).distinct()


def paged_quality_markdown(spark, d):
    """Cleaned reports with the counters of their repairs, by hash."""
    rows = _reports(spark, d)
    pages = cut(G.repaired_pages(rows))
    clean = cut(G.without_footers(pages))
    n = G.cleanup_counters(pages, clean).join(clean.select("id", "pages"), "id")
    fields = {f"pdf_{k}": F.col(k) for k in ("total_scheme", "pages_scheme", "total_wrap", "pages_wrap", "total_split", "pages_split", "total_covering", "total_anchored", "empty_pages")}
    text = F.array_join(F.transform("pages", lambda p, i: F.concat(F.lit("## Page "), (i + 1).cast("string"), F.lit("\n\n"), p)), "\n\n")
    md = R.record_markdown(title=F.lit("report"), canonical_id="id", source_url=F.lit(""), content=text, source=F.lit("public_pdf"), adapter=F.lit("public_pdf"), fetched_at=F.lit(FETCHED), extra=(("candidate_status", F.lit("unreviewed")), ("page_count", F.col("n_pages").cast("string")), *R.quality_lines("replay_quality", fields)))
    return n.select("id", sha256(md).alias("content_hash"))


def pdf_trailing_lines(spark, d):
    """The last four non-empty lines of every page."""
    return G.trailing(G.page_lines(_pages(spark, d))).select("id", "page_no", "depth", "line")


def pdf_footer_signatures(spark, d):
    """footer signatures on most pages of a report."""
    p = _pages(spark, d)
    return G.footer_signatures(G.page_lines(p), p.groupBy("id").agg(F.count(F.lit(1)).alias("n_pages"))).select("id", "depth", "signature", "pages", "n_pages")


def pdf_line_diagnostics(spark, d):
    """line counters of every report and the share of layout artifacts as text."""
    x = G.line_diagnostics(_pages(spark, d))
    return x.withColumn("density", G.density_text(F.col("layout_artifacts"), F.col("n_lines")))


def pdf_repairs(spark, d):
    """Line repairs of every page."""
    rows = _reports(spark, d)
    return G.repaired_pages(rows).select("id", "page_no", "n_scheme", "n_wrap", "n_split", sha256("text").alias("text_hash"))


def pdf_footer_suppressed(spark, d):
    """Footers taken from every report, and what was refused."""
    rows = _reports(spark, d)
    return G.without_footers(G.repaired_pages(rows)).withColumn("text_hash", sha256(F.array_join("pages", "\f"))).drop("pages")


def pdf_cleanup_counters(spark, d):
    """what each repair did to every report, in all and by pages."""
    rows = _reports(spark, d)
    pages = cut(G.repaired_pages(rows))
    return G.cleanup_counters(pages, G.without_footers(pages))


def rolling_cues(spark, d):
    """The lines of every text as automatic cues."""
    cues = C.collapse(F.filter(F.transform(splitlines("text"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(True))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.array(cues)).alias("c")).select("doc_id", F.size("c").alias("cues"), sha256(F.array_join("c", "\n")).alias("cue_hash"))


def caption_selection(spark, d):
    """The best track of each origin; a document is a track in its language."""
    t = table(spark, d, "documents").where("lang IS NOT NULL").select("origin", F.col("lang").alias("language"), F.when(F.col("source") == "youtube", "creator").otherwise("automatic").alias("kind"),
                                                                   F.when(F.col("n_chars") > 1000, "vtt").otherwise("srv3").alias("format"), F.concat(F.coalesce("title", F.lit("")), F.lit("#"), F.col("doc_id").cast("string")).alias("name"))
    return C.choose(t, on="origin", languages=["es", "de-CH"])


def replay_classification(spark, d):
    """quality class of every captured page from its own counts."""
    c = web_source_intent(spark, d).select("id", "likely_target_mismatch").join(web_shape_counts(spark, d), "id")
    k = Q.classification("retained", F.create_map(F.lit("chrome"), F.col("suppressed")), F.create_map(F.lit("form"), F.col("form_fields"), F.lit("catalog"), F.col("catalog")), F.when(F.col("legal") > 0, F.array(F.lit("legal_text"))).otherwise(F.array().cast("array<string>")), F.col("likely_target_mismatch"))
    return c.select("id", k.alias("k")).select("id", "k.state", "k.promotion", "k.effort", "k.bounded", "k.reason", "k.cleanup", "k.remaining", F.array_join("k.blockers", ",").alias("blockers"))


def acceptance_ranges(spark, d):
    """Lines and pages of the corpus by language against accepted ranges."""
    m = pdf_line_diagnostics(spark, d).join(table(spark, d, "dora_regression_cases").select("id", F.coalesce("lang", F.lit("none")).alias("source_key")).distinct(), "id")
    m = m.groupBy("source_key").agg(F.sum("n_lines").cast("bigint").alias("lines"), F.sum("layout_artifacts").cast("bigint").alias("artifacts"))
    metrics = m.select("source_key", F.explode(F.array(F.struct(F.lit("lines").alias("path"), F.col("lines").alias("value")), F.struct(F.lit("artifacts").alias("path"), F.col("artifacts").alias("value")))).alias("x")).select("source_key", "x.*")
    specs = spark.createDataFrame([(k, label, path, lo, hi) for k in ("en", "de", "none", "it") for label, path, lo, hi in (("retained lines", "lines", 100, 5000), ("layout artifacts", "artifacts", 0, 300))], "source_key string, label string, path string, minimum bigint, maximum bigint")
    return Q.acceptance(F.broadcast(specs), metrics)


def acceptance_report(spark, d):
    return Q.acceptance_report(acceptance_ranges(spark, d))


QUERIES = {f.__name__: f for f in (record_markdown, web_markdown, paged_markdown, web_quality_markdown, paged_quality_markdown, bundle_sections, bundle_split, bundle_files, package_inventory, package_totals, canonical_json, git_skip_reasons, tree_bfs, tree_bfs_all, space_listing, url_output_name, public_url_check,
                                   api_roots, web_chrome_reasons, web_shape_counts, web_source_intent, web_link_choice, pdf_trailing_lines, pdf_footer_signatures, pdf_line_diagnostics, pdf_repairs, pdf_footer_suppressed, pdf_cleanup_counters, rolling_cues,
                                   caption_selection, replay_classification, acceptance_ranges, acceptance_report)}

_WS = r"[\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_strip = lambda x: f"regexp_replace({x}, '^{_WS}|{_WS}$', '', 'g')"
_squeeze = lambda x: _strip(f"regexp_replace({x}, '{_WS}', ' ', 'g')")
_fold = lambda x: f"translate(replace(lower({x}), 'ß', 'ss'), 'ſς', 'sσ')"
_rstripn = lambda x: f"regexp_replace({x}, '\\n+$', '')"
_has = lambda x, ps: "(" + " OR ".join(f"contains({x}, '{p}')" for p in ps) + ")"
_in = lambda x, ps: f"{x} IN (" + ", ".join(f"'{p}'" for p in ps) + ")"
_OPT = lambda label, x: f"'- {label}:' || CASE WHEN coalesce({x}, '') <> '' THEN ' ' || {x} ELSE '' END"


def _md(title, cid, url, content, source, updated="''", extra=(), note="", fetched=""):
    lines = [f"'# ' || coalesce({title}, 'untitled')", "''", "'## Metadata'", f"'- source: ' || coalesce({source}, '')", f"'- canonical_id: ' || coalesce({cid}, '')", "'- parent_id:'", f"'- source_url: ' || coalesce({url}, '')", f"'- fetched_at:{fetched and ' ' + fetched}'", _OPT("updated_at", updated), f"'- adapter: ' || coalesce({source}, '')"]
    lines += [f"'- {k}: ' || coalesce({v}, '')" for k, v in extra] + ["''", "'## Content'", "''"] + ([f"'> {note}'", "''"] if note else [])
    return " || chr(10) || ".join(lines) + f" || chr(10) || {_rstripn(f'coalesce({content}, {chr(39)*2})')} || chr(10)"


_SEC = ("'## ' || coalesce(nullif(title, ''), coalesce(canonical_id, '')) || chr(10) || 'source_url: ' || coalesce(origin, '') || chr(10) || CASE WHEN lang IS NULL THEN 'stale: true' || chr(10) ELSE '' END || 'canonical_id: ' || coalesce(canonical_id, '') || chr(10)"
        " || CASE WHEN fetched_at IS NOT NULL THEN 'fetched_at: ' || strftime(fetched_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') || chr(10) ELSE '' END || CASE WHEN coalesce(source, '') <> '' THEN 'path: ' || source || chr(10) ELSE '' END || CASE WHEN coalesce(lang, '') <> '' THEN 'ref: ' || lang || chr(10) ELSE '' END || chr(10) || " + _rstripn("coalesce(text, '')"))
_SECTIONS = f"sec AS (SELECT doc_id, coalesce(origin, '') AS origin, coalesce(canonical_id, '') AS canonical_id, regexp_replace({_SEC}, '{_WS}$', '') AS md FROM documents)"
_SPLIT = f"""WITH RECURSIVE {_SECTIONS},
o AS (SELECT origin, doc_id, md, strlen(md) AS b, row_number() OVER (PARTITION BY origin ORDER BY doc_id, canonical_id) AS position FROM sec),
f(origin, position, used, file_no) AS (SELECT origin, position, b + 1, 1::BIGINT FROM o WHERE position = 1
  UNION ALL SELECT o.origin, o.position, CASE WHEN f.used + 7 + o.b <= {MAX_BYTES} THEN f.used + 7 + o.b ELSE o.b + 1 END, CASE WHEN f.used + 7 + o.b <= {MAX_BYTES} THEN f.file_no ELSE f.file_no + 1 END FROM f JOIN o ON o.origin = f.origin AND o.position = f.position + 1)
"""
_P = f"""WITH rows AS (SELECT DISTINCT id, raw_content, requested_url, resolved_url FROM article_chrome_cases WHERE id IS NOT NULL AND raw_content IS NOT NULL),
x AS (SELECT id, string_split(raw_content, chr(10) || chr(10)) AS ps FROM rows), y AS (SELECT id, unnest(ps) AS p0, unnest(range(len(ps))) AS pos FROM x),
z AS (SELECT id, pos, {_strip('p0')} AS para FROM y), w AS (SELECT *, {_squeeze(_fold('para'))} AS t FROM z),
paras AS (SELECT id, pos, para, t, CASE WHEN para = '' THEN NULL {" ".join(f"WHEN {_in('t', ps)} THEN '{r}'" for r, ps in W.CHROME.items())} WHEN regexp_matches(para, '(?i)(©|copyright).*privacy.*terms') THEN 'footer_legal_text' WHEN t LIKE 'discussion about this post%' THEN 'comments_discussion_placeholder' END AS reason FROM w),
kept AS (SELECT *, para <> '' AND reason IS NULL AS k, CASE WHEN para <> '' AND reason IS NULL THEN sum(CASE WHEN para <> '' AND reason IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) - 1 END AS kept_pos FROM paras)"""
_n = lambda c: f"count(*) FILTER ({c})"
_words = "len(string_split(t, ' '))"
_COUNTS = _P + f""", counts AS (SELECT id, (sum(CASE WHEN k THEN length(para) ELSE 0 END) + 2 * greatest({_n('k')} - 1, 0))::BIGINT AS retained_chars, sum(CASE WHEN reason IS NOT NULL THEN length(para) ELSE 0 END)::BIGINT AS suppressed_chars, {_n('k')} AS retained, {_n('reason IS NOT NULL')} AS suppressed,
 {_n(f"k AND length(para) >= 140 AND len(string_split({_squeeze('para')}, ' ')) >= 24 AND length(regexp_replace(para, '[^.?!]', '', 'g')) >= 2")} AS substantive,
 {_n(f"{_in('t', W.FORM_FIELDS)} OR ({_words} <= 6 AND {_has('t', W.FORM_FIELDS)})")} AS form_fields, {_n(_has('t', W.CTA))} AS cta, {_n(_has('t', W.DOWNLOAD_CTA))} AS download_cta, {_n(_has('t', W.LEGAL))} AS legal,
 {_n(f"length(t) <= 100 AND ({_in('t', W.CATALOG)} OR ({' + '.join(f'contains(t, {chr(39)}{p}{chr(39)})::INT' for p in W.CATALOG)}) >= 3)")} AS catalog,
 {_n(f"kept_pos < 12 AND {_has('t', W.REPORT_TITLE)}")} AS report_title, {_n(f"length({_squeeze('para')}) BETWEEN 1 AND 80 AND NOT regexp_matches({_squeeze('para')}, '[.?!]$')")} AS selector_like,
 {_n(f"pos < 30 AND {_has('t', W.BOOK)}")} AS book, {_n(f"pos < 40 AND {_has('t', W.INDEX)}")} AS research_index, {_n(f"pos < 50 AND {_has('t', W.CHAPTER)}")} AS chapter, {_n(f"kept_pos < 8 AND {_has('t', ['abstract', 'doi', 'published', 'proceedings'])}")} AS asset_marks FROM kept GROUP BY id)"""
_YEARS = lambda u: f"regexp_extract_all({u}, '20[0-9]{{2}}')"
_INTENT = _COUNTS + f""", i0 AS (SELECT c.*, lower(coalesce(r.requested_url, '')) AS req, lower(coalesce(r.resolved_url, '')) AS res, regexp_extract(regexp_replace(lower(coalesce(r.resolved_url, '')), '^[a-z][a-z0-9+.-]*://[^/?#]*', ''), '^([^?#]*)', 1) AS path FROM counts c JOIN rows r USING (id)),
i1 AS (SELECT *, CASE WHEN retained_chars + suppressed_chars > 0 THEN round(retained_chars / (retained_chars + suppressed_chars), 3) ELSE 0 END AS ratio, form_fields >= 3 AND (download_cta >= 1 OR legal >= 1) AS lead FROM i0),
i2 AS (SELECT *, download_cta >= 1 AND (lead OR (substantive < 3 AND retained_chars < 3000) OR cta >= 3) AS landing, catalog >= 8 AND substantive < 4 AND selector_like >= 12 AS cat,
 (book >= 3 AND substantive < 4 AND retained_chars < 5000) OR (regexp_matches(path, '/(books?|product|shop)') AND book >= 1 AND (catalog >= 4 OR selector_like >= 20 OR form_fields >= 2)) AS commercial,
 chapter >= 3 AND selector_like >= 8 AND substantive < 4 AS chap,
 req <> res AND req <> '' AND res <> '' AND len({_YEARS('req')}) > 0 AND regexp_matches(req, 'report|state-of-devops|research') AND len(list_filter({_YEARS('req')}, lambda y: NOT list_contains({_YEARS('res')}, y))) > 0 AS redirect,
 ({' OR '.join(f"contains(req, '{p}') OR contains(res, '{p}')" for p in [*W.STABLE_ASSET, 'doi.org/'])}) OR (substantive >= 2 AND asset_marks > 0) AS stable,
 retained_chars + suppressed_chars > 0 AND retained_chars > 0 AND ratio < 0.45 AND substantive < 3 AND (download_cta > 0 OR catalog >= 4 OR form_fields >= 2) AS chrome, report_title > 0 AND download_cta >= 1 AND substantive < 2 AND retained_chars < 2500 AS little,
 retained_chars < 700 OR substantive < 2 AS thin FROM i1),
i3 AS (SELECT *, (research_index >= 2 AND selector_like >= 6 AND substantive < 4) OR (cat AND research_index >= 1 AND substantive < 4) OR ((path IN ('', '/') OR contains(path, 'research')) AND selector_like >= 40 AND (research_index >= 1 OR catalog >= 4)) AS idx FROM i2),
i4 AS (SELECT *, lead OR landing OR cat OR commercial OR idx OR chrome OR redirect OR little AS wrapper FROM i3),
i5 AS (SELECT *, wrapper OR chap OR (thin AND retained_chars > 0 AND (download_cta > 0 OR catalog >= 4)) AS likely_target_mismatch FROM i4),
i6 AS (SELECT *, CASE WHEN likely_target_mismatch OR thin THEN 'low' WHEN retained_chars >= 8000 AND substantive >= 5 THEN 'high' ELSE 'medium' END AS confidence FROM i5),
intent AS (SELECT *, CASE WHEN commercial THEN 'commercial_landing_page' WHEN idx THEN 'mutable_index_page' WHEN chap THEN 'chapter_navigation_source' WHEN redirect AND likely_target_mismatch THEN 'historical_report_redirect' WHEN stable AND NOT likely_target_mismatch THEN 'stable_canonical_asset'
 WHEN likely_target_mismatch THEN 'likely_wrong_capture_target' WHEN retained_chars = 0 THEN 'no_retained_content' WHEN confidence <> 'low' THEN 'substantive_content_page' ELSE 'insufficient_substantive_body' END AS shape FROM i6)"""
_EOL = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_D = f"""WITH rows AS (SELECT DISTINCT id, raw_pages FROM dora_regression_cases WHERE id IS NOT NULL AND raw_pages IS NOT NULL),
pg AS (SELECT id, unnest(range(1, len(raw_pages) + 1)) AS page_no, coalesce(unnest(raw_pages), '') AS text FROM rows),
pl AS (SELECT id, page_no, list_filter(list_transform(string_split_regex(text, '{_EOL}'), lambda x: {_strip('x')}), lambda x: x <> '') AS l FROM pg),
ln AS (SELECT id, page_no, len(l) AS n, unnest(l) AS line, unnest(range(len(l))) AS i, unnest(list_transform(range(len(l)), lambda j: coalesce(CASE WHEN j > 0 THEN l[j] END, ''))) AS prev, unnest(list_transform(range(len(l)), lambda j: coalesce(l[j + 2], ''))) AS nxt FROM pl)"""
_CTX = lambda x: f"(regexp_matches({x}, '\\d') AND (regexp_matches({x}, '\\S\\s{{3,}}\\S') OR regexp_matches({x}, '{G.CONTEXT}') OR len(regexp_extract_all({x}, '\\d+')) >= 2))"


def _sig(x: str) -> str:
    out = _fold(_squeeze(x))
    for p, put in G.SIGNATURE:
        out = f"regexp_replace({out}, '{p.replace(chr(92) + 'z', '$')}', '{put.replace('$1', chr(92) + '1')}', 'g')"
    return out


_PAGED = G.PAGED.replace("\\z", "$")
_DIAG = _D + f""", diag AS (SELECT id, count(*) AS n_lines, {_n("regexp_matches(line, '^\\d{1,4}$')")} AS bare, {_n("regexp_matches(line, '^\\d{1,4}$') AND n - i <= 4")} AS bare_trailing, {_n("regexp_matches(line, '^\\d{1,4}$') AND (" + _CTX('prev') + ' OR ' + _CTX('nxt') + ')')} AS bare_near_numbers,
 {_n(f"regexp_matches(line, '{_PAGED}') AND n - i > 4")} AS footer_like_inside, {_n("regexp_matches(line, '\\S\\s{3,}\\S') OR (regexp_matches(line, '[A-Za-z]{2,}-$') AND regexp_matches(nxt, '^\\p{Ll}'))")} AS layout_artifacts FROM ln GROUP BY id)"""
_z = lambda p: p.replace(chr(92) + "z", "$").replace("'", "''")
_rstrip = lambda x: f"regexp_replace({x}, '{_WS}$', '')"
_LINES = lambda x: f"(SELECT CASE WHEN len(q) > 0 AND q[len(q)] = '' THEN q[:len(q) - 1] ELSE q END FROM (SELECT string_split_regex({x}, '{_EOL}') AS q))"


def _joined(src: str, out: str, hits: str, test: str, keep: str) -> str:
    """Lines of ``src`` (id, page_no, l) that join the next: every other one of a run; ``out`` has (id, page_no, text, hits)."""
    return f"""{out}a AS (SELECT *, string_aggs(l) AS f FROM {src}),
{out} AS (SELECT * EXCLUDE (l, f), {_strip("array_to_string(list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN i > 1 AND f[i - 1] = '1' THEN NULL WHEN f[i] = '1' THEN " + keep + " || " + _strip('l[i + 1]') + " ELSE " + _rstrip('l[i]') + " END), lambda x: x IS NOT NULL), chr(10))")} AS text, length(f) - length(replace(f, '1', '')) AS {hits} FROM {out}a)""".replace(
        "string_aggs(l)", "regexp_replace(array_to_string(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN coalesce(i < len(l) AND " + test + ", false) THEN '1' ELSE '0' END), ''), '11', '10', 'g')")


_WRAPS = f"{_strip('l[i + 1]')} <> '' AND regexp_matches({_rstrip('l[i]')}, '{_z(G.URL_WRAP)}') AND regexp_matches({_strip('l[i + 1]')}, '[-._~/%!$&''()*+,;=:@?#]') AND regexp_matches({_strip('l[i + 1]')}, '^[a-z0-9][a-z0-9._~%!$&''()*+,;=:@/?#-]*$')"
_SPLITS = f"regexp_matches({_strip(chr(99) + 'oalesce(CASE WHEN i > 1 THEN l[i - 1] END, ' + chr(39) * 2 + ')')}, '{_z(G.SPLIT_BEFORE)}') AND regexp_matches({_strip('l[i]')}, '^\\p{{L}}$') AND regexp_matches({_strip('l[i + 1]')}, '^\\p{{Ll}}') AND regexp_matches(substr({_strip('l[i + 1]')}, 2), '\\p{{L}}')"
_SCHEME = _z(G.SCHEME)
_REPAIRED = f"""WITH rows AS (SELECT DISTINCT id, raw_pages FROM dora_regression_cases WHERE id IS NOT NULL AND raw_pages IS NOT NULL),
pg AS (SELECT id, unnest(range(1, len(raw_pages) + 1)) AS page_no, coalesce(unnest(raw_pages), '') AS t FROM rows),
r0 AS (SELECT id, page_no, len(regexp_extract_all(t, '{_SCHEME}')) AS n_scheme, regexp_replace(t, '{_SCHEME}', '\\1://\\2\\3', 'g') AS t FROM pg), r1 AS (SELECT id, page_no, n_scheme, {_LINES('t')} AS l FROM r0),
{_joined('r1', 'r2', 'n_wrap', _WRAPS, _rstrip('l[i]'))}, r3 AS (SELECT id, page_no, n_scheme, n_wrap, {_LINES('text')} AS l FROM r2),
{_joined('r3', 'r4', 'n_split', _SPLITS, _strip('l[i]'))}
"""


def _tails(src: str, out: str, versions: bool) -> str:
    """The last four non-empty lines of each page of ``src`` (id, page_no, text): index, line and anchor by depth."""
    clean = _squeeze("line")
    numbered = f"regexp_matches({clean}, '{_PAGED}')" + (f" AND NOT regexp_matches({clean}, '{_z(G.VERSION)}')" if versions else "")
    return f"""{out}l AS (SELECT *, {_LINES('text')} AS l, count(*) OVER (PARTITION BY id) AS n_pages FROM {src}),
{out}e AS (SELECT id, page_no, i, line, row_number() OVER (PARTITION BY id, page_no ORDER BY i DESC) AS d FROM (SELECT id, page_no, unnest(range(len(l))) AS i, unnest(list_transform(l, lambda x: {_strip('x')})) AS line FROM {out}l) WHERE line <> '' QUALIFY d <= 4),
{out}s AS (SELECT *, CASE WHEN NOT regexp_matches(line, '^\\d{{1,4}}$') AND NOT ({numbered}) AND regexp_matches(line, '\\p{{L}}') AND length({clean}) <= 140 THEN {_sig('line')} END AS a, TRY_CAST(nullif(regexp_extract({clean}, '{_z(G.PAGE_NUMBER)}', 1), '') AS INT) AS v FROM {out}e)"""


_by = lambda c: ", ".join(f"max(CASE WHEN d = {k} THEN {c} END) AS {c}{k}" for k in (1, 2, 3, 4))
_major = lambda n: f"(CASE WHEN {n} <= 2 THEN 2 ELSE {n} // 2 + 1 END)"
_CLEAN = lambda gone: _strip(f"array_to_string(list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN list_contains({gone}, i - 1) THEN NULL ELSE {_rstrip('l[i]')} END), lambda x: x IS NOT NULL), chr(10))")
_FOOTERS = _REPAIRED + f""", {_tails('r4', 'g', True)},
g1 AS (SELECT id, page_no, {_by('a')}, {_by('i')} FROM gs GROUP BY 1, 2), g2 AS (SELECT gl.id, gl.page_no, text, l, n_pages, i1, i2, i3, i4, a1 AS b1, a1 || chr(1) || a2 AS b2, a1 || chr(1) || a2 || chr(1) || a3 AS b3, a1 || chr(1) || a2 || chr(1) || a3 || chr(1) || a4 AS b4 FROM gl LEFT JOIN g1 ON g1.id = gl.id AND g1.page_no = gl.page_no),
g3 AS (SELECT *, {', '.join(f"b{k} IS NOT NULL AND n_pages >= 10 AND count(*) OVER (PARTITION BY id, b{k}) >= greatest(10, {_major('n_pages')}, ceil(n_pages * 0.6)) AS o{k}" for k in (1, 2, 3, 4))} FROM g2), g4 AS (SELECT *, o4 AS c4 FROM g3),
g5 AS (SELECT *, o3 AND bool_or(NOT c4) OVER (PARTITION BY id, b3) AS c3 FROM g4), g6 AS (SELECT *, o2 AND bool_or(NOT (c3 OR c4)) OVER (PARTITION BY id, b2) AS c2 FROM g5), g7 AS (SELECT *, o1 AND bool_or(NOT (c2 OR c3 OR c4)) OVER (PARTITION BY id, b1) AND bool_or(c2 OR c3 OR c4) OVER (PARTITION BY id, b1) AS c1 FROM g6),
g8 AS (SELECT *, list_distinct(list_filter([{', '.join([f"CASE WHEN {' OR '.join(f'c{j}' for j in range(k, 5))} THEN i{k} END" for k in (1, 2, 3, 4)] + [f"CASE WHEN c{k} AND i{k} > 0 AND TRY_CAST(nullif(regexp_extract({_squeeze(f'l[i{k}]')}, '{_z(G.PAGE_NUMBER)}', 1), '') AS INT) = page_no THEN i{k} - 1 END" for k in (2, 3, 4)])}], lambda x: x IS NOT NULL)) AS gone FROM g7),
high AS (SELECT id, page_no, n_pages AS np, len(gone) AS n_gone, CASE WHEN n_pages < 10 THEN {_strip('text')} ELSE {_CLEAN('gone')} END AS text FROM g8), h0 AS (SELECT id, page_no, text FROM high), {_tails('h0', 'h', False)},
spots AS (SELECT hs.id, hs.page_no, hs.d, hs.a AS sig, hs.i, hl.n_pages, hl.l FROM hs JOIN hl ON hl.id = hs.id AND hl.page_no = hs.page_no WHERE hs.a IS NOT NULL AND hl.n_pages > 1 QUALIFY count(*) OVER (PARTITION BY hs.id, hs.d, hs.a) >= {_major('hl.n_pages')}),
tries AS (SELECT s.*, s.d + u.o AS e FROM spots s, (VALUES (-1), (1)) u(o) WHERE s.d + u.o BETWEEN 1 AND 4),
f0 AS (SELECT t.*, x.i AS j, x.v, x.i IS NULL AS lacks FROM tries t LEFT JOIN hs x ON x.id = t.id AND x.page_no = t.page_no AND x.d = t.e),
f1 AS (SELECT *, v IS NOT NULL AND len(list_filter(range(greatest(least(i, j) - 1, 0), least(len(l), greatest(i, j) + 2)), lambda k: k <> i AND k <> j AND {_CTX('l[k + 1]')})) > 0 AS risky FROM f0),
f2 AS (SELECT *, v IS NOT NULL AND NOT risky AS good FROM f1), f3 AS (SELECT f.*, lag(v) OVER (PARTITION BY id, d, sig, e ORDER BY page_no) AS last FROM f2 f WHERE good),
an AS (SELECT id, page_no, {_by('a')} FROM hs GROUP BY 1, 2),
sh AS (SELECT f.id, f.d, f.sig, f.e, bool_or(f.last >= f.v) AS disorder, {', '.join(f"count(an.a{k}) = count(*) AND count(DISTINCT an.a{k}) = 1 AS s{k}" for k in (1, 2, 3, 4))} FROM f3 f LEFT JOIN an ON an.id = f.id AND an.page_no = f.page_no GROUP BY ALL),
k0 AS (SELECT id, d, sig, e, any_value(n_pages) AS n_pages, count(*) FILTER (good) AS n_good, count(*) FILTER (risky) AS n_risky, count(*) FILTER (lacks) AS n_lacks, count(*) FILTER (v IS NULL AND NOT lacks) AS n_odd FROM f2 GROUP BY ALL),
k1 AS (SELECT k0.*, coalesce(disorder, false) AS disorder, s1, s2, s3, s4, n_good < {_major('n_pages')} AS few FROM k0 LEFT JOIN sh USING (id, d, sig, e)), k2 AS (SELECT *, NOT few AND NOT disorder AS ok FROM k1),
k3 AS (SELECT *, coalesce(lag(ok) OVER (PARTITION BY id, d, sig ORDER BY e), false) AS done FROM k2), k4 AS (SELECT * FROM k3 WHERE NOT done),
why AS (SELECT id, coalesce(sum(n_lacks) FILTER (ok), 0)::BIGINT AS n_missing, coalesce(sum(n_odd) FILTER (ok), 0)::BIGINT AS n_nonparseable, coalesce(sum(n_risky) FILTER (ok OR few), 0)::BIGINT AS n_context, coalesce(sum(n_good) FILTER (NOT few AND disorder), 0)::BIGINT AS n_order FROM k4 GROUP BY 1),
m0 AS (SELECT id, d, sig, e, unnest([{', '.join(f"CASE WHEN (CASE WHEN e < d THEN {k} >= d ELSE {k} <= d END) AND " + ' AND '.join(f"(NOT {x} BETWEEN least(d, {k}) AND greatest(d, {k}) OR s{x})" for x in (1, 2, 3, 4)) + f" THEN {k} END" for k in (1, 2, 3, 4))}, e]) AS depth FROM k4 WHERE ok),
m1 AS (SELECT DISTINCT f2.id, f2.page_no, depth FROM f2 JOIN m0 USING (id, d, sig, e) WHERE good AND depth IS NOT NULL), m2 AS (SELECT m1.id, m1.page_no, list(hs.i) AS spot FROM m1 JOIN hs ON hs.id = m1.id AND hs.page_no = m1.page_no AND hs.d = m1.depth GROUP BY ALL),
last AS (SELECT hl.id, hl.page_no, coalesce(spot, []) AS spot, {_CLEAN('coalesce(spot, [])')} AS text FROM hl LEFT JOIN m2 ON m2.id = hl.id AND m2.page_no = hl.page_no)
"""
_ACC = _DIAG + """, lang AS (SELECT DISTINCT id, coalesce(lang, 'none') AS source_key FROM dora_regression_cases), m AS (SELECT source_key, sum(n_lines)::BIGINT AS lines, sum(layout_artifacts)::BIGINT AS artifacts FROM diag JOIN lang USING (id) GROUP BY 1),
mm AS (SELECT source_key, 'lines' AS path, lines AS value FROM m UNION ALL SELECT source_key, 'artifacts', artifacts FROM m),
spec AS (SELECT k.k AS source_key, s.* FROM (VALUES ('en'), ('de'), ('none'), ('it')) k(k), (VALUES ('retained lines', 'lines', 100::BIGINT, 5000::BIGINT), ('layout artifacts', 'artifacts', 0::BIGINT, 300::BIGINT)) s(label, path, minimum, maximum)),
acc AS (SELECT s.source_key, s.label, s.path, coalesce(mm.value, 0) AS value, s.minimum, s.maximum, coalesce(mm.value, 0) BETWEEN s.minimum AND s.maximum AS ok FROM spec s LEFT JOIN mm USING (source_key, path))"""

_SHOWN = {  # line, column, kind of the assessment lines
    "operational_state": ("q_state", "s"), "promotion_state": ("q_promotion", "s"), "review_effort": ("q_effort", "s"), "bounded_review_economics": ("retained_chars > 0", "b"), "deterministic_cleanup_count": ("suppressed", "n"), "remaining_artifact_count": ("0", "n"), "webpage_chrome_suppressed_paragraph_count": ("suppressed", "n"),
    "webpage_target_shape_assessment": ("shape", "s"), "webpage_possible_wrapper_page": ("wrapper", "b"), "webpage_possible_lead_form_page": ("lead", "b"), "webpage_possible_download_landing_page": ("landing", "b"), "webpage_commercial_landing_page_detected": ("commercial", "b"), "webpage_mutable_index_page_detected": ("idx", "b"),
    "webpage_chapter_navigation_source_detected": ("chap", "b"), "webpage_historical_report_redirect_detected": ("redirect", "b"), "webpage_stable_research_asset_detected": ("stable", "b"), "webpage_substantive_content_confidence": ("confidence", "s"), "webpage_likely_target_mismatch": ("likely_target_mismatch", "b")}
_REPORTED = {f"pdf_{k}": (k, "n") for k in ("total_scheme", "pages_scheme", "total_wrap", "pages_wrap", "total_split", "pages_split", "total_covering", "total_anchored", "empty_pages")}


def _quality(fields: dict) -> tuple:
    text = lambda c, k: f"CASE WHEN {c} THEN 'True' ELSE 'False' END" if k == "b" else f"({c})::VARCHAR"
    json = lambda n, c, k: f"'\"{n}\":' || " + (f"'\"' || {c} || '\"'" if k == "s" else f"({c})::VARCHAR")
    return (*((f"replay_quality_{n}", text(c, k)) for n, (c, k) in fields.items()), ("replay_quality_metadata_json", "('{' || " + " || ',' || ".join(json(n, *fields[n]) for n in sorted(fields)) + " || '}')"))


SQL = {
    "web_quality_markdown": _INTENT + ", a AS (SELECT intent.*, r.raw_content, r.resolved_url AS at_url, CASE WHEN retained_chars > 0 AND likely_target_mismatch THEN 'likely-wrong-capture-target' WHEN retained_chars > 0 THEN 'review-ready' ELSE 'diagnostic-only' END AS q_state, CASE WHEN retained_chars = 0 OR likely_target_mismatch THEN 'unsafe-to-promote' ELSE 'promotion-capable' END AS q_promotion,"
                            " CASE WHEN retained_chars > 0 AND likely_target_mismatch THEN 'source_target_review' WHEN retained_chars = 0 THEN 'not_useful' ELSE 'bounded' END AS q_effort FROM intent JOIN rows r USING (id)) SELECT DISTINCT id, sha256(md) AS content_hash FROM (SELECT id, "
                            + _md("'page'", "id", "at_url", "raw_content", "'public_webpage'", extra=(("candidate_status", "'unreviewed'"), ("extraction_notes", "'Unreviewed candidate material.'"), *_quality(_SHOWN)), note="This is unreviewed candidate material generated from an external public source.") + " AS md FROM a)",
    "paged_quality_markdown": _FOOTERS + """, a AS (SELECT id, sum(n_scheme)::BIGINT AS total_scheme, count(*) FILTER (n_scheme > 0) AS pages_scheme, sum(n_wrap)::BIGINT AS total_wrap, count(*) FILTER (n_wrap > 0) AS pages_wrap, sum(n_split)::BIGINT AS total_split, count(*) FILTER (n_split > 0) AS pages_split FROM r4 GROUP BY 1),
 b AS (SELECT last.id, any_value(np)::BIGINT AS n_pages, sum(n_gone)::BIGINT AS total_covering, sum(len(spot))::BIGINT AS total_anchored, count(*) FILTER (last.text = '') AS empty_pages, string_agg('## Page ' || last.page_no::VARCHAR || chr(10) || chr(10) || last.text, chr(10) || chr(10) ORDER BY last.page_no) AS body FROM last JOIN high USING (id, page_no) GROUP BY 1), c AS (SELECT * FROM a JOIN b USING (id))
 SELECT id, sha256(md) AS content_hash FROM (SELECT id, """ + _md("'report'", "id", "''", "body", "'public_pdf'", extra=(("candidate_status", "'unreviewed'"), ("page_count", "n_pages::VARCHAR"), *_quality(_REPORTED)), fetched=FETCHED) + " AS md FROM c)",
    "record_markdown": f"SELECT doc_id, strlen(md) AS n_bytes, sha256(md) AS content_hash FROM (SELECT doc_id, {_md('title', 'canonical_id', 'origin', 'text', 'source', 'lang')} AS md FROM documents)",
    "web_markdown": "SELECT DISTINCT id, sha256(md) AS content_hash FROM (SELECT id, " + _md("description", "id", "resolved_url", "raw_content", "'public_webpage'", extra=(("candidate_status", "'unreviewed'"), ("extraction_notes", "'Unreviewed candidate material.'")), note="This is unreviewed candidate material generated from an external public source.") + " AS md FROM article_chrome_cases)",
    "paged_markdown": "WITH p AS (SELECT id, description, coalesce(len(raw_pages), 0) AS n, array_to_string(list_transform(range(1, coalesce(len(raw_pages), 0) + 1), lambda i: '## Page ' || i::VARCHAR || chr(10) || chr(10) || coalesce(raw_pages[i], '')), chr(10) || chr(10)) AS body FROM dora_regression_cases) SELECT DISTINCT id, strlen(md) AS n_bytes, sha256(md) AS content_hash FROM (SELECT id, "
                      + _md("description", "id", "''", "body", "'public_pdf'", extra=(("candidate_status", "'unreviewed'"), ("page_count", "n::VARCHAR"), ("extraction_notes", "'Unreviewed candidate material.'")), note="This is unreviewed candidate material generated from an external public PDF/report.", fetched=FETCHED) + " AS md FROM p)",
    "bundle_sections": f"WITH {_SECTIONS} SELECT doc_id, strlen(md) AS n_bytes, sha256(md) AS section_hash FROM sec",
    "bundle_split": _SPLIT + f"SELECT o.origin, o.doc_id, o.position, f.file_no, o.b + 1 > {MAX_BYTES} AS oversized FROM o JOIN f USING (origin, position)",
    "bundle_files": _SPLIT + ", m AS (SELECT o.origin, f.file_no, count(*) AS sections, string_agg(o.md, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY o.position) || chr(10) AS md FROM o JOIN f USING (origin, position) GROUP BY ALL) SELECT origin, file_no, sections, strlen(md) AS n_bytes, sha256(md) AS file_hash FROM m",
    "package_inventory": "SELECT origin, doc_id, strlen(coalesce(text, '')) AS bytes, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "package_totals": "SELECT origin, count(*) AS files, sum(strlen(coalesce(text, '')))::BIGINT AS bytes FROM documents GROUP BY 1",
    "git_skip_reasons": "SELECT source, CASE WHEN text IS NULL THEN 'missing after checkout' WHEN contains(text, chr(0)) THEN 'binary file' END AS skip_reason, count(*) AS n, sum(coalesce(strlen(text), 0))::BIGINT AS n_bytes FROM documents GROUP BY ALL",
    "space_listing": "SELECT space_key, id, row_number() OVER (PARTITION BY space_key ORDER BY id) AS place FROM (SELECT DISTINCT space_key, id FROM pages WHERE space_key IS NOT NULL AND id IS NOT NULL)",
    "url_output_name": r"""SELECT DISTINCT requested_url, CASE WHEN slug = '' THEN 'public-source' ELSE slug END || '-' || substr(sha256(requested_url), 1, 12) AS name FROM (SELECT requested_url, lower(regexp_replace(regexp_replace(stem, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g')) AS slug FROM (
 SELECT requested_url, CASE WHEN last <> '' THEN regexp_replace(last, '(.)\.[^.]+$', '\1') ELSE netloc END AS stem FROM (SELECT requested_url, regexp_extract(requested_url, '^https?://([^/?#]*)', 1) AS netloc, regexp_extract(regexp_replace(regexp_extract(requested_url, '^https?://[^/?#]*([^?#]*)', 1), '(/\.?)+$', ''), '([^/]*)$', 1) AS last FROM article_chrome_cases)))""",
    "public_url_check": r"""SELECT CASE WHEN NOT coalesce(regexp_matches(u, '(?i)^https?:'), false) THEN 'no http or https' WHEN regexp_extract(u, '^[^:]+://([^/?#]*)', 1) = '' THEN 'no host' WHEN regexp_matches(u, '^[^:]+://[^/?#]*@') THEN 'credentials' WHEN h IN ('', '.') THEN 'no host' WHEN regexp_replace(h, '\.+$', '') = 'localhost' THEN 'localhost' WHEN regexp_replace(h, '\.+$', '') LIKE '%.local' THEN 'local name' END AS problem, count(*) AS n
 FROM (SELECT resolved_url AS u, lower(regexp_replace(regexp_replace(regexp_extract(resolved_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^[^@]*@', ''), ':\d*$', '')) AS h FROM article_chrome_cases) GROUP BY 1""",
    "api_roots": r"""SELECT host, host AS web, host || '/api/v3' AS api, count(*) FILTER (p = '/wiki' OR p LIKE '/wiki/%') AS under_wiki, count(*) AS n FROM (SELECT regexp_extract(requested_url, '^(https?://[^/?#]*)', 1) AS host, regexp_replace(regexp_extract(requested_url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS p FROM article_chrome_cases WHERE requested_url IS NOT NULL) GROUP BY 1""",
    "web_chrome_reasons": _P + "SELECT id, reason, count(*) AS n, sum(length(para))::BIGINT AS chars FROM paras WHERE reason IS NOT NULL GROUP BY ALL",
    "web_shape_counts": _COUNTS + "SELECT * FROM counts",
    "web_source_intent": _INTENT + "SELECT id, ratio, wrapper, likely_target_mismatch, confidence, shape FROM intent",
    "web_link_choice": r"""WITH m AS (SELECT doc_id AS id, unnest(l) AS m, unnest(range(len(l))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '\[([^\]\n]*)\]\((https?://[^)\s]+)\)') AS l FROM documents WHERE text IS NOT NULL)),
 k AS (SELECT id, pos, regexp_extract(m, '\]\(([^)]*)\)', 1) AS url, regexp_extract(m, '^\[([^\]]*)\]', 1) AS label FROM m)
 SELECT id, url, min(pos)::INT AS pos, arg_min(label, CASE WHEN label <> '' THEN pos ELSE 1000000000 - pos END) AS label FROM k GROUP BY ALL""",
    "rolling_cues": f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '{_EOL}'), lambda x: trim(x, ' ')), lambda x: x <> '') AS c FROM documents WHERE text IS NOT NULL),
 k AS (SELECT doc_id, list_filter(c, lambda x, i: NOT coalesce(starts_with(c[i + 1], x), false)) AS c FROM l) SELECT doc_id, len(c)::INT AS cues, sha256(array_to_string(c, chr(10))) AS cue_hash FROM k""",
    "pdf_trailing_lines": _D + "SELECT id, page_no::INT AS page_no, (n - i)::INT AS depth, line FROM ln WHERE n - i <= 4",
    "pdf_footer_signatures": _D + f", s AS (SELECT id, page_no, (n - i)::INT AS depth, {_sig('line')} AS signature FROM ln WHERE n - i <= 4 AND length({_squeeze('line')}) <= 140), c AS (SELECT id, depth, signature, count(DISTINCT page_no) AS pages FROM s GROUP BY ALL), np AS (SELECT id, count(*) AS n_pages FROM pg GROUP BY 1) SELECT id, depth, signature, pages, n_pages FROM c JOIN np USING (id) WHERE pages >= CASE WHEN n_pages <= 2 THEN 2 ELSE n_pages // 2 + 1 END",
    "pdf_repairs": _REPAIRED + "SELECT id, page_no::INT AS page_no, n_scheme::INT AS n_scheme, n_wrap::INT AS n_wrap, n_split::INT AS n_split, sha256(text) AS text_hash FROM r4",
    "pdf_footer_suppressed": _FOOTERS + """SELECT last.id, any_value(np)::BIGINT AS n_pages, sum(n_gone)::BIGINT AS n_high, sum(len(spot))::BIGINT AS n_anchored, coalesce(any_value(n_missing), 0)::BIGINT AS n_missing, coalesce(any_value(n_nonparseable), 0)::BIGINT AS n_nonparseable, coalesce(any_value(n_context), 0)::BIGINT AS n_context,
 coalesce(any_value(n_order), 0)::BIGINT AS n_order, sha256(string_agg(last.text, chr(12) ORDER BY last.page_no)) AS text_hash FROM last JOIN high USING (id, page_no) LEFT JOIN why ON why.id = last.id GROUP BY 1""",
    "pdf_cleanup_counters": _FOOTERS + """, a AS (SELECT id, sum(n_scheme)::BIGINT AS total_scheme, count(*) FILTER (n_scheme > 0) AS pages_scheme, sum(n_wrap)::BIGINT AS total_wrap, count(*) FILTER (n_wrap > 0) AS pages_wrap, sum(n_split)::BIGINT AS total_split, count(*) FILTER (n_split > 0) AS pages_split FROM r4 GROUP BY 1),
 b AS (SELECT last.id, any_value(np)::BIGINT AS n_pages, sum(n_gone)::BIGINT AS total_covering, sum(len(spot))::BIGINT AS total_anchored, count(*) FILTER (last.text = '') AS empty_pages FROM last JOIN high USING (id, page_no) GROUP BY 1) SELECT * FROM a JOIN b USING (id)""",
    "canonical_json": """WITH j AS (SELECT DISTINCT id, expected_metadata AS x FROM dora_regression_cases WHERE expected_metadata IS NOT NULL), k AS (SELECT id, x, list_sort(json_keys(x)) AS ks FROM j)
 SELECT id, '{' || array_to_string(list_transform(ks, lambda k: '"' || k || '":' || CAST(json_extract(x, '$.' || k) AS VARCHAR)), ',') || '}' || chr(10) AS canonical, CASE WHEN len(ks) > 0 THEN 2 ELSE 1 END AS depth, NULL::VARCHAR AS problem FROM k""",
    "pdf_line_diagnostics": _DIAG + "SELECT *, printf('%.3f', layout_artifacts / n_lines) AS density FROM diag",
    "caption_selection": """WITH t AS (SELECT origin, lang AS language, CASE WHEN source = 'youtube' THEN 'creator' ELSE 'automatic' END AS kind, CASE WHEN n_chars > 1000 THEN 'vtt' ELSE 'srv3' END AS format, coalesce(title, '') || '#' || doc_id::VARCHAR AS name, CASE WHEN lower(lang) = 'es' THEN 0 WHEN split_part(lower(lang), '-', 1) = 'es' THEN 1 WHEN lower(lang) = 'de-ch' THEN 2 WHEN split_part(lower(lang), '-', 1) = 'de' THEN 3 END AS r FROM documents WHERE lang IS NOT NULL)
 SELECT origin, language, kind, format, name, 'creator_then_automatic:' || CASE WHEN r % 2 = 0 THEN 'exact' ELSE 'base-language-fallback' END || ':' || language || ':' || kind AS reason FROM t WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY origin ORDER BY CASE WHEN kind = 'creator' THEN 0 ELSE 1 END, r, CASE WHEN format = 'vtt' THEN 0 ELSE 1 END, language, name) = 1""",
    "replay_classification": _INTENT + """, k AS (SELECT id, retained AS u, suppressed AS cleanup, form_fields + catalog AS remaining, legal, likely_target_mismatch AS mm, greatest(5, retained // 20) AS lim FROM intent)
 SELECT id, CASE WHEN u > 0 AND mm THEN 'likely-wrong-capture-target' WHEN u > 0 THEN 'review-ready' ELSE 'diagnostic-only' END AS state, CASE WHEN legal > 0 OR u = 0 OR mm THEN 'unsafe-to-promote' ELSE 'promotion-capable' END AS promotion,
  CASE WHEN u > 0 AND mm THEN 'source_target_review' WHEN u = 0 THEN 'not_useful' WHEN remaining = 0 THEN 'bounded' WHEN remaining <= lim THEN 'focused' ELSE 'extended' END AS effort, u > 0 AND remaining <= lim AS bounded,
  CASE WHEN u = 0 THEN 'no_retained_content' WHEN remaining > 0 THEN 'retained_content_with_reported_remaining_artifacts' ELSE 'retained_content_with_no_reported_artifacts' END AS reason, cleanup, remaining,
  concat_ws(',', CASE WHEN legal > 0 THEN 'legal_text' END, CASE WHEN u = 0 THEN 'no_retained_content' END, CASE WHEN u > 0 AND mm THEN 'likely_wrong_capture_target' END) AS blockers FROM k""",
    "acceptance_ranges": _ACC + "SELECT * FROM acc",
    "acceptance_report": _ACC + "SELECT source_key, bool_and(ok) AS stable, count(*) FILTER (NOT ok) AS n_failed, array_to_string(list_sort(list_distinct(coalesce(list(label) FILTER (NOT ok), []))), ',') AS failed FROM acc GROUP BY 1",
    "tree_bfs": r"""WITH RECURSIVE cur AS (SELECT id, child_page_ids FROM pages WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC NULLS LAST, fetched_at DESC NULLS LAST) = 1),
 links AS (SELECT DISTINCT c.id AS p, k.kid AS c FROM cur c, LATERAL (SELECT trim(u.x, E' \t\n\r') AS kid FROM unnest(c.child_page_ids) AS u(x)) k WHERE k.kid <> '' AND k.kid IN (SELECT id FROM cur)),
 w(root, id, depth) AS (SELECT id, id, 0 FROM cur WHERE id NOT IN (SELECT c FROM links) UNION SELECT w.root, l.c, w.depth + 1 FROM w JOIN links l ON l.p = w.id WHERE w.depth < 8)
 SELECT root, id, min(depth) AS depth FROM w GROUP BY ALL""",
    "tree_bfs_all": r"""WITH RECURSIVE cur AS (SELECT id, child_page_ids FROM pages WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC NULLS LAST, fetched_at DESC NULLS LAST) = 1),
 links AS (SELECT DISTINCT c.id AS p, k.kid AS c FROM cur c, LATERAL (SELECT trim(u.x, E' \t\n\r') AS kid FROM unnest(c.child_page_ids) AS u(x)) k WHERE k.kid <> '' AND k.kid IN (SELECT id FROM cur)),
 w(root, id, depth) AS (SELECT id, id, 0 FROM cur WHERE id NOT IN (SELECT c FROM links) UNION SELECT w.root, l.c, w.depth + 1 FROM w JOIN links l ON l.p = w.id WHERE w.depth < (SELECT count(*) FROM cur))
 SELECT root, id, min(depth) AS depth FROM w GROUP BY ALL""",
}
