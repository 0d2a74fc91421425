"""Web-page text: chrome phrases, paragraph shapes, source intent, link scoring."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodestrata.functions.text import bind, casefold, col, join_url, rstrip, squeeze, strip, unescaped, url_part
from lodestrata.operators.urls import host_of, url_problem

# Phrases the operators below look for, compared case-folded with white space collapsed.
CHROME = {
    "subscription_sign_in_prompt": ["sign in", "subscribe sign in"],
    "share_prompt": ["share"],
    "comments_discussion_placeholder": ["comments restacks", "no posts", "top latest"],
    "subscription_prompt": ["ready for more?", "subscribe"],
    "platform_promotion": ["start your substack get the app", "substack is the home for great culture"],
}
FORM_FIELDS = ["business email", "business phone", "calling code", "company", "company name", "country", "email", "first name", "job title", "last name", "phone", "phone number", "state", "work email"]
DOWNLOAD_CTA = ["access the report", "download now", "download paper", "download report", "download the paper", "download the report", "get the report", "read paper", "read the paper", "view paper", "view the paper"]
CTA = [*DOWNLOAD_CTA, "book a meeting", "contact sales", "request a demo", "request demo", "submit"]
LEGAL = ["by submitting this form", "i agree to receive", "privacy policy", "terms of service", "unsubscribe", "your personal data"]
CATALOG = ["blog", "case studies", "contact us", "docs", "documentation", "events", "partners", "pricing", "products", "reports", "resources", "solutions", "support", "training", "webinars", "whitepapers"]
REPORT_TITLE = ["report", "research", "state of devops", "dora"]
BOOK = ["add to cart", "audiobook", "book", "buy now", "consulting", "ebook", "kindle", "paperback", "product", "purchase", "shop", "training", "workshop"]
INDEX = ["all research", "developer tools", "latest research", "octoverse", "publications", "research areas", "research index", "research portal", "research projects", "topics"]
CHAPTER = ["chapter", "chapters", "contents", "part i", "part ii", "table of contents", "toc", "workbook"]
REPORT_TERMS = ["abridged", "accelerate", "ai", "article", "assisted", "chapter", "development", "devops", "dora", "download", "paper", "pdf", "publication", "report", "research", "software", "state", "study", "whitepaper", "workbook"]
STABLE_PATHS = ["/article/", "/articles/", "/chapter/", "/chapters/", "/detail.cfm", "/download/", "/files/", "/paper/", "/papers/", "/publication/", "/publications/", "/report/", "/reports/", "/resource/", "/resources/", "/uploads/", "/whitepaper/", "/whitepapers/"]
REJECT_HOSTS = ["accounts.google.com", "facebook.com", "linkedin.com", "policies.google.com", "twitter.com", "x.com", "youtube.com"]
REJECT_PATHS = ["/blog", "/contact", "/docs", "/pricing", "/privacy", "/support", "/terms"]
STOPWORDS = ["about", "after", "and", "assisted", "cloud", "content", "development", "download", "google", "report", "resources", "software", "state", "the", "with"]
KEEPWORDS = ["2025", "ai", "devops", "dora"]
STABLE_ASSET = [".pdf", "/article/", "/chapter/", "/detail.cfm", "/paper/", "/publication/", "/report/", "/whitepaper/"]
BLOCK_TAGS = ["address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "figcaption", "figure", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul"]
SKIPPED_TAGS = ["noscript", "script", "style", "svg", "template"]


# Escapes that page sources write URLs with, what such a URL looks like, and endings of translated assets.
ESCAPES = [("\\u0026", "&"), ("\\u003a", ":"), ("\\u003c", "<"), ("\\u003d", "="), ("\\u003e", ">"), ('\\"', '"'), ("\\/", "/")]
EMBEDDED = r"""https?://[^\s"'<>\\]+"""
LOCALIZED = r"_(de|es|fr|id|it|ja|ko|pt-br|zh-cn|zh-tw)(\.pdf|\z)"
# Status, reason, canonical status and confidence of each outcome of a target selection.
TARGETS = {
    "commercial": ("no_selection_commercial_landing_page", "commercial_landing_page_requires_operator_source_choice", "no_selection", "none"),
    "no_mismatch": ("not_applicable_no_target_mismatch", "source_intent_assessment_did_not_flag_target_mismatch", "not_applicable", ""),
    "none": ("no_high_confidence_target", "no_same_page_report_asset_met_selection_guards", "no_selection", "none"),
    "ambiguous": ("ambiguous_multiple_high_confidence_targets", "multiple_same_page_report_assets_met_selection_guards", "ambiguous", "low"),
    "selected": ("selected", "", "selected_stable_canonical_asset", ""),
}


class _Page(HTMLParser):
    """Title, paragraphs and links of one document, skipping what is never shown."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden, self.in_title, self.title, self.words, self.paragraphs, self.links, self.anchor = 0, False, [], [], [], [], None

    def cut(self) -> None:
        if self.words:
            self.paragraphs.append(" ".join(self.words))
            self.words = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in SKIPPED_TAGS:
            self.hidden += 1
        elif tag == "title":
            self.in_title = True
        elif tag in BLOCK_TAGS:
            self.cut()
        if not self.hidden:
            if tag == "a":
                self.anchor = [a["href"], "", "anchor_href"] if a.get("href") else None
            elif tag == "link" and a.get("href"):
                self.links.append([a["href"], a.get("rel") or "", "link_href"])
            elif tag == "meta" and a.get("content"):
                self.links.append([a["content"], a.get("property") or a.get("name") or "", "meta_url"])

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED_TAGS:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in BLOCK_TAGS:
            self.cut()
        if tag == "a" and self.anchor is not None:
            self.links.append(self.anchor)
            self.anchor = None

    def handle_data(self, data: str) -> None:
        text = " ".join(data.split())
        if self.hidden or not text:
            return
        if self.in_title:
            self.title.append(text)
            return
        self.words.append(text)
        if self.anchor is not None:
            self.anchor[1] = f"{self.anchor[1]} {text}".strip()


def extract_html(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id, title, paragraphs, links(url, label, source)``; null HTML gives nulls and empty arrays. Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, h in zip(b.iloc[:, 0], b.iloc[:, 1]):
                p = _Page()
                p.feed(h or "")
                p.close()
                p.cut()
                out.append((i, " ".join(p.title) or None, p.paragraphs, [dict(zip(("url", "label", "source"), x)) for x in p.links]))
            yield pd.DataFrame(out, columns=["id", "title", "paragraphs", "links"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInPandas(run, f"id {kind}, title string, paragraphs array<string>, links array<struct<url:string,label:string,source:string>>")


def folded(text: str | Column) -> Column:
    """The form phrases are looked for in: case-folded, white space collapsed."""
    return squeeze(casefold(text))


def chrome_reason(paragraph: str | Column, t: str | Column | None = None) -> Column:
    """Why a paragraph is page furniture; null if it is not known to be. ``t`` is its folded form, if it is at hand."""
    text = folded(paragraph) if t is None else col(t)
    out = F.when(F.lit(False), F.lit(""))
    for reason, phrases in CHROME.items():
        out = out.when(text.isin(*phrases), F.lit(reason))
    return out.when(col(paragraph).rlike(r"(?iu)(©|copyright).*privacy.*terms"), F.lit("footer_legal_text")).when(text.startswith("discussion about this post"), F.lit("comments_discussion_placeholder"))


def text_paragraphs(pages: DataFrame, *, id_col: str, content: str) -> DataFrame:
    """``id, pos, para, t, reason, kept_pos``: stripped paragraphs between empty lines; empty ones keep their position.

    ``t`` is the folded form; ``kept_pos`` counts the paragraphs that are neither empty nor chrome. Done inside each row: no window, no shuffle.
    """
    ps = F.transform(F.transform(F.split(col(content), "\n\n", -1), lambda p: strip(p)), lambda p: F.struct(p.alias("para"), folded(p).alias("t")))
    marked = F.transform(ps, lambda x, i: F.struct(i.alias("pos"), x["para"].alias("para"), x["t"].alias("t"), F.when(x["para"] != "", chrome_reason(x["para"], x["t"])).alias("reason")))
    stays = lambda x: (x["para"] != "") & x["reason"].isNull()
    row = lambda x, n: F.struct(*[x[f].alias(f) for f in ("pos", "para", "t", "reason")], n.alias("kept_pos"))
    both = bind(marked, lambda m: F.concat(F.transform(F.filter(m, stays), row), F.transform(F.filter(m, lambda x: ~stays(x)), lambda x: row(x, F.lit(None).cast("int")))))
    return pages.select(F.col(id_col).alias("id"), F.explode(both).alias("m")).select("id", "m.*")


def has_any(t: str | Column, phrases: list[str]) -> Column:
    """Is any phrase a substring of the folded text?"""
    out = F.lit(False)
    for p in sorted(phrases):
        out = out | F.contains(col(t), F.lit(p))
    return out


def is_substantive(p: str | Column) -> Column:
    return (F.length(p) >= 140) & (F.size(F.split(squeeze(p), " ")) >= 24) & (F.length(F.regexp_replace(p, r"[^.?!]", "")) >= 2)


def is_form_field(t: str | Column) -> Column:
    return col(t).isin(*FORM_FIELDS) | ((F.size(F.split(t, " ")) <= 6) & has_any(t, FORM_FIELDS))


def is_catalog(t: str | Column) -> Column:
    n = sum((F.contains(col(t), F.lit(x)).cast("int") for x in CATALOG), F.lit(0))
    return (F.length(t) <= 100) & (col(t).isin(*CATALOG) | (n >= 3))


def is_selector_like(p: str | Column) -> Column:
    t = squeeze(p)
    return F.length(t).between(1, 80) & ~t.rlike(r"[.?!]\z")


def intent_counts(paras: DataFrame) -> DataFrame:
    """per page the eleven paragraph counts (some over the first 12, 30, 40 or 50 only, as the rule states) and sizes."""
    n = lambda test: F.count_if(test).cast("bigint")
    kept, p, t = F.col("kept_pos").isNotNull(), F.col("para"), F.col("t")
    size = F.sum(F.when(kept, F.length(p)).otherwise(0)) + 2 * F.greatest(n(kept) - 1, F.lit(0))
    return paras.groupBy("id").agg(
        size.cast("bigint").alias("retained_chars"), F.sum(F.when(F.col("reason").isNotNull(), F.length(p)).otherwise(0)).cast("bigint").alias("suppressed_chars"), n(kept).alias("retained"), n(F.col("reason").isNotNull()).alias("suppressed"),
        n(kept & is_substantive(p)).alias("substantive"), n(is_form_field(t)).alias("form_fields"), n(has_any(t, CTA)).alias("cta"), n(has_any(t, DOWNLOAD_CTA)).alias("download_cta"), n(has_any(t, LEGAL)).alias("legal"),
        n(is_catalog(t)).alias("catalog"), n((F.col("kept_pos") < 12) & has_any(t, REPORT_TITLE)).alias("report_title"), n(is_selector_like(p)).alias("selector_like"),
        n((F.col("pos") < 30) & has_any(t, BOOK)).alias("book"), n((F.col("pos") < 40) & has_any(t, INDEX)).alias("research_index"), n((F.col("pos") < 50) & has_any(t, CHAPTER)).alias("chapter"),
        n((F.col("kept_pos") < 8) & has_any(t, ["abstract", "doi", "published", "proceedings"])).alias("asset_marks"))


def intent_shape(counts: DataFrame, requested: str = "requested_url", resolved: str = "resolved_url") -> DataFrame:
    """the flags, the confidence and the page's shape label from its counts and URLs."""
    c = F.col
    req, res = F.lower(F.coalesce(requested, F.lit(""))), F.lower(F.coalesce(resolved, F.lit("")))
    path = F.regexp_extract(F.regexp_replace(res, r"^[a-z][a-z0-9+.-]*://[^/?#]*", ""), r"^([^?#]*)", 1)
    total = c("retained_chars") + c("suppressed_chars")
    ratio = F.when(total > 0, F.bround(c("retained_chars") / total, 3)).otherwise(0.0)
    lead = (c("form_fields") >= 3) & ((c("download_cta") >= 1) | (c("legal") >= 1))
    landing = (c("download_cta") >= 1) & (lead | ((c("substantive") < 3) & (c("retained_chars") < 3000)) | (c("cta") >= 3))
    catalog = (c("catalog") >= 8) & (c("substantive") < 4) & (c("selector_like") >= 12)
    commercial = ((c("book") >= 3) & (c("substantive") < 4) & (c("retained_chars") < 5000)) | (path.rlike("/(books?|product|shop)") & (c("book") >= 1) & ((c("catalog") >= 4) | (c("selector_like") >= 20) | (c("form_fields") >= 2)))
    index = ((c("research_index") >= 2) & (c("selector_like") >= 6) & (c("substantive") < 4)) | (catalog & (c("research_index") >= 1) & (c("substantive") < 4)) | ((path.isin("", "/") | path.contains("research")) & (c("selector_like") >= 40) & ((c("research_index") >= 1) | (c("catalog") >= 4)))
    chapter = (c("chapter") >= 3) & (c("selector_like") >= 8) & (c("substantive") < 4)
    years = lambda u: F.regexp_extract_all(u, F.lit("20[0-9]{2}"), F.lit(0))
    redirect = (req != res) & (req != "") & (res != "") & (F.size(years(req)) > 0) & req.rlike("report|state-of-devops|research") & (F.size(F.array_except(years(req), years(res))) > 0)
    stable = F.exists(F.array(*[F.lit(x) for x in [*STABLE_ASSET, "doi.org/"]]), lambda x: F.contains(req, x) | F.contains(res, x)) | ((c("substantive") >= 2) & (c("asset_marks") > 0))
    chrome = (total > 0) & (c("retained_chars") > 0) & (ratio < 0.45) & (c("substantive") < 3) & ((c("download_cta") > 0) | (c("catalog") >= 4) | (c("form_fields") >= 2))
    little = (c("report_title") > 0) & (c("download_cta") >= 1) & (c("substantive") < 2) & (c("retained_chars") < 2500)
    wrapper = lead | landing | catalog | commercial | index | chrome | redirect | little
    thin = (c("retained_chars") < 700) | (c("substantive") < 2)
    mismatch = wrapper | chapter | (thin & (c("retained_chars") > 0) & ((c("download_cta") > 0) | (c("catalog") >= 4)))
    confidence = F.when(mismatch | thin, "low").when((c("retained_chars") >= 8000) & (c("substantive") >= 5), "high").otherwise("medium")
    shape = (F.when(commercial, "commercial_landing_page").when(index, "mutable_index_page").when(chapter, "chapter_navigation_source").when(redirect & mismatch, "historical_report_redirect").when(stable & ~mismatch, "stable_canonical_asset")
             .when(mismatch, "likely_wrong_capture_target").when(c("retained_chars") == 0, "no_retained_content").when(confidence != "low", "substantive_content_page").otherwise("insufficient_substantive_body"))
    return counts.withColumns({"lead_form": lead, "download_landing": landing, "commercial_landing": commercial, "mutable_index": index, "chapter_navigation": chapter, "historical_redirect": redirect, "stable_asset": stable, "ratio": ratio, "wrapper": wrapper, "likely_target_mismatch": mismatch, "confidence": confidence, "shape": shape})


def link_choice(links: DataFrame, *, on: str, url: str = "url", label: str = "label", pos: str = "pos") -> DataFrame:
    """One row a URL: the first labelled one, else the last; at the place of the URL's first occurrence."""
    lab = F.coalesce(col(label), F.lit("")) != ""
    pick = F.min_by(F.struct(*[c for c in links.columns if c not in (on, url, pos)]), F.when(lab, F.struct(F.lit(0).alias("a"), F.col(pos).cast("bigint").alias("b"))).otherwise(F.struct(F.lit(1).alias("a"), (-F.col(pos)).cast("bigint").alias("b"))))
    return links.groupBy(on, url).agg(F.min(pos).alias(pos), pick.alias("_p")).select(on, url, pos, "_p.*")


def spaced(text: str | Column) -> Column:
    """Case-folded, with underscores and hyphens as spaces."""
    return squeeze(F.translate(casefold(text), "_-", "  "))


def identity_tokens(text: str | Column) -> Column:
    """Words that name a page: kept words, or four letters and no stop word."""
    toks = F.array_distinct(F.regexp_extract_all(spaced(text), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.filter(toks, lambda t: t.isin(*KEEPWORDS) | ((F.length(t) >= 4) & ~t.isin(*STOPWORDS)))


def has_report_terms(text: str | Column) -> Column:
    return has_any(text, REPORT_TERMS)


def embedded_links(pages: DataFrame, *, id_col: str = "id", html_col: str = "html") -> DataFrame:
    """``id, url, label, source, pos`` of report-like URLs that stand anywhere in the page's source, escaped ones included."""
    raw = col(html_col)
    for old, new in ESCAPES:
        raw = F.replace(raw, F.lit(old), F.lit(new))
    found = pages.select(F.col(id_col).alias("id"), unescaped(raw).alias("_h")).select("id", F.posexplode(F.array_distinct(F.regexp_extract_all("_h", F.lit(EMBEDDED), F.lit(0)))).alias("pos", "url"))
    found = found.withColumn("url", F.replace(rstrip(unescaped("url"), r".,;)"), F.lit("\\/"), F.lit("/")))
    return found.where(has_report_terms(spaced("url"))).groupBy("id", "url").agg(F.min("pos").alias("pos")).select("id", "url", F.lit("").alias("label"), F.lit("embedded_page_url").alias("source"), "pos")


def absolute_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """``links`` (id, url, label, source, pos) with URLs joined to their page's; anchors, mail, phone and script links go."""
    base = pages.select("id", F.coalesce("resolved_url", "requested_url").alias("_at"))
    ok = (F.col("url") != "") & ~F.col("url").startswith("#") & ~F.lower("url").rlike("^(mailto|tel|javascript):")
    return links.where(ok).join(base, "id").withColumn("url", join_url("_at", unescaped(strip("url")))).drop("_at")


def scored_links(links: DataFrame, pages: DataFrame, *, keep: int = 12, least: int = 35) -> DataFrame:
    """Candidate targets of each page by score, the best ``keep`` of those with at least ``least`` points.

    ``links``: (id, url, label, source), one row a URL (``absolute_links``, ``link_choice``); ``pages``: (id, title, visible_text,
    requested_url, resolved_url). A target must be public, lie on the page's host or second-level domain, must not be
    rejected, must speak of reports and share two identity words (or both of ``dora`` and ``2025``). ``reason`` says what counted.
    """
    two = lambda h: F.regexp_extract(h, r"([^.]+\.[^.]+)\z", 1)
    who = identity_tokens(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.substring(F.coalesce("visible_text", F.lit("")), 1, 2000)))
    base = pages.select("id", F.explode(F.array(who)).alias("_who"), F.coalesce("resolved_url", "requested_url").alias("_at"), F.coalesce("requested_url", F.lit("")).alias("_req"), F.coalesce("resolved_url", F.lit("")).alias("_res"))
    # An explode of one element keeps Catalyst from pasting the folded texts into each of their uses.
    once = lambda df, **c: df.select("*", F.explode(F.array(F.struct(*[x.alias(n) for n, x in c.items()]))).alias("_x")).select(*df.columns, "_x.*")
    j = once(links.join(base, "id"), _host=host_of("url"), _home=host_of("_at"), _path=F.lower(url_part("url", "path")), _label=spaced(F.coalesce("label", F.lit(""))),
             _text=spaced(F.concat_ws(" ", url_part("url", "netloc"), url_part("url", "path"), url_part("url", "query"))))
    j = once(j, matches=F.array_sort(F.array_intersect("_who", identity_tokens(F.concat_ws(" ", "_text", "_label")))), _spoken=F.concat_ws(" ", "_text", "_label"))
    any_of = lambda c, xs: F.exists(F.array(*[F.lit(x) for x in xs]), lambda x: F.contains(c, x))
    shared, path, text, label = F.size("matches"), F.col("_path"), F.col("_text"), F.col("_label")
    has = lambda t: F.array_contains("matches", t)
    rejected = F.col("_host").isin(*REJECT_HOSTS) | any_of(path, REJECT_PATHS) | F.col("url").rlike(r"[?&](continue|redirectPath)=[^&#]")
    gate = (url_problem("url").isNull() & (F.col("_host") != "") & ((F.col("_host") == F.col("_home")) | ((two(F.col("_host")) == two(F.col("_home"))) & (two(F.col("_host")) != ""))) & ~rejected
            & has_report_terms("_spoken") & ((shared >= 2) | (has("dora") & has("2025"))))
    pdf = path.endswith(".pdf")
    stable = (pdf | any_of(path, STABLE_PATHS) | path.rlike(r"/(toc|table-of-contents)/?\z") | ((F.col("_host") == "queue.acm.org") & path.endswith("/detail.cfm") & F.lower(url_part("url", "query")).contains("id="))
              | (label.contains("canonical") & has_report_terms(F.concat_ws(" ", F.translate("_path", "_-", "  "), "_label"))))
    bare = lambda u: F.struct(url_part(u, "netloc").alias("a"), F.regexp_replace(url_part(u, "path"), r"/+\z", "").alias("b"))
    # What each finding is worth, and the name it is given as a reason.
    terms = [(pdf, 48, "pdf_asset"), (~pdf & stable, 34, "stable_publication_url"), (~pdf & ~stable & any_of(text, ["report", "whitepaper", "download"]), 28, "report_like_html_target"),
             *((F.col("source") == x, 8, f"observed_in_{x}") for x in ("anchor_href", "link_href", "meta_url")), (any_of(label, ["canonical", "citation_pdf_url", "og:url"]), 10, "explicit_canonical_metadata"),
             (F.col("source") == "embedded_page_url", 6, "observed_in_embedded_page_url"), (stable, 12, "stable_research_asset"), (F.lit(True), F.least(F.lit(36), 6 * shared), None), (has("dora"), 8, None), (has("2025"), 8, None),
             (text.contains("abridged"), -35, "abridged_asset_penalty"), (text.rlike(LOCALIZED), -20, "localized_asset_penalty"), (bare("url").isin(bare("_req"), bare("_res")), -40, "points_back_to_wrapper_page_penalty")]
    score = sum((F.when(t, n).otherwise(0) for t, n, _ in terms), F.lit(0))
    reason = F.concat_ws(",", *[F.when(t, F.lit(why)) for t, _, why in terms if why])
    got = once(j.where(gate), score=score, reason=reason, content_type=F.when(pdf, "pdf").otherwise("html"), stable=stable).where(F.col("score") >= least)
    return (got.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "url"))).where(F.col("rank") <= keep)
            .select("id", "url", "label", "source", "score", "rank", "matches", "reason", "content_type", "stable"))


def target_selection(pages: DataFrame, scored: DataFrame) -> DataFrame:
    """Which candidate, if any, a page's capture should have gone to, why, and how sure that is.

    ``pages``: (id, commercial_landing, likely_target_mismatch, confidence); one row each comes back, with its candidates in order.
    """
    strong = F.col("score") >= 70
    one = F.struct("rank", *[c for c in ("url", "label", "source", "content_type", "score", "matches", "stable", "reason")])
    best = scored.groupBy("id").agg(F.count_if(strong).alias("_n"), F.min_by(F.struct("url", "content_type", "reason", "score"), F.when(strong, F.col("rank"))).alias("_top"), F.array_sort(F.collect_list(one)).alias("_c"))
    j = pages.join(best, "id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    case = (F.when(F.coalesce("commercial_landing", F.lit(False)), "commercial").when(~F.coalesce("likely_target_mismatch", F.lit(False)), "no_mismatch").when(F.col("_n") == 0, "none").when(F.col("_n") > 1, "ambiguous").otherwise("selected"))
    j = j.withColumn("_case", case)
    pick = lambda k: functools.reduce(lambda w, x: w.when(F.col("_case") == x[0], F.lit(x[1][k])), TARGETS.items(), F.when(F.lit(False), F.lit("")))
    chosen = F.col("_case") == "selected"
    sure = F.when(chosen, F.when(F.col("_top.score") >= 75, "high").otherwise("medium")).when(F.col("_case") == "no_mismatch", F.coalesce("confidence", F.lit("none")) if "confidence" in pages.columns else F.lit("none")).otherwise(pick(3))
    hidden = F.col("_case").isin("commercial", "no_mismatch") | F.col("_c").isNull()
    return j.select("id", pick(0).alias("status"), F.when(chosen, F.col("_top.reason")).otherwise(pick(1)).alias("reason"), pick(2).alias("canonical_status"), sure.alias("canonical_confidence"),
                    F.when(chosen, F.col("_top.url")).otherwise("").alias("selected_url"), F.when(chosen, F.col("_top.content_type")).otherwise("").alias("selected_content_type"),
                    F.when(hidden, F.array().cast(j.schema["_c"].dataType)).otherwise(F.col("_c")).alias("candidates"))


def second_hop(pages: DataFrame, selection: DataFrame, fetched: DataFrame) -> DataFrame:
    """The capture that counts of each page: that of its selected target if it was fetched, else its own; one hop only.

    ``pages`` and ``fetched`` have the columns of ``extract_html`` by ``id``, ``fetched`` by the selected URL as ``id``.
    """
    to = selection.where("selected_url <> ''").select("id", "selected_url")
    far = fetched.select(F.col("id").alias("selected_url"), F.struct("title", "paragraphs", "links").alias("_far"))
    j = pages.join(to, "id", "left").join(far, "selected_url", "left")
    own = F.struct("title", "paragraphs", "links")
    return j.select("id", F.when(F.col("_far").isNotNull(), F.col("selected_url")).alias("followed"), F.coalesce("_far", own).alias("_p")).select("id", "followed", "_p.*")
