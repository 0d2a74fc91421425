"""API payloads to typed records: pages, summaries, listings, issues, pull requests, releases and comments.

A payload is one JSON text. Each kind of record is a list of fields with a path and a rule; the first field that breaks its
rule is the row's ``problem``, and its values are null. Everything is a column expression over the parsed variant, so mapping
runs in the scan's stage and a reader of a few fields parses only those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import col, join_url, quote, rstrip, url_part
from lodestrata.operators.issues import is_pull_request

# Rules of a field: text (a string), filled (a string with a character), text? (a string or nothing), loose (nothing unless it is
# a filled string), int, int?, loose int, flag, body (a string, nothing is ''), name (as text?, nothing is '').
# The API's field names.
_TRACKED = [("title", "$.title", "text"), ("state", "$.state", "text"), ("created_at", "$.created_at", "text"), ("updated_at", "$.updated_at", "text"), ("body", "$.body", "body"), ("author", "$.user.login", "loose")]
_COMMENT = [("created_at", "$.created_at", "text"), ("updated_at", "$.updated_at", "text"), ("body", "$.body", "body"), ("author", "$.user.login", "loose")]
_LINKED = [*_COMMENT, ("comment_id", "$.id", "int?"), ("html_url", "$.html_url", "text?"), ("url", "$.url", "text?")]
_VERSION = [("page_version", "$.version.number", "loose int"), ("last_modified", "$.version.when", "loose")]
KINDS: dict[str, list[tuple[str, str, str]]] = {
    "page": [("canonical_id", "$.id", "filled"), ("title", "$.title", "filled"), ("content", "$.body.storage.value", "text"), *_VERSION],
    "summary": [("canonical_id", "$.id", "filled"), ("title", "$.title", "filled"), *_VERSION],
    "issue": [("number", "$.number", "int"), *_TRACKED],
    "pull_request": [("number", "$.number", "int"), *_TRACKED],
    "release": [("release_id", "$.id", "int"), ("tag_name", "$.tag_name", "text"), ("created_at", "$.created_at", "text"), ("published_at", "$.published_at", "text?"), ("title", "$.name", "name"),
                ("draft", "$.draft", "flag"), ("prerelease", "$.prerelease", "flag"), ("body", "$.body", "body"), ("author", "$.user.login", "loose")],
    "issue_comment": _COMMENT,
    "pull_comment": _LINKED,
    "review_comment": [*_LINKED, ("path", "$.path", "text?"), *((x, f"$.{x}", "int?") for x in ("line", "original_line", "start_line", "original_start_line", "position", "original_position")), ("side", "$.side", "text?"), ("start_side", "$.start_side", "text?")],
}
TYPES = {"int": "bigint", "int?": "bigint", "loose int": "bigint", "flag": "boolean"}


def _field(v: Column, path: str, rule: str) -> tuple[Column, Column]:
    """The value of a field, and whether it breaks its rule."""
    kind = F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))
    nothing = kind == "VOID"
    want = {"bigint": "BIGINT", "boolean": "BOOLEAN"}.get(TYPES.get(rule, ""), "STRING")
    value = F.when(kind == want, F.try_variant_get(v, path, TYPES.get(rule, "string")))
    if rule == "filled":
        return value, (kind != want) | (value == "")
    if rule in ("text", "int", "flag"):
        return value, kind != want
    if rule.startswith("loose"):
        return (F.nullif(value, F.lit("")) if rule == "loose" else value), F.lit(False)
    return (F.coalesce(value, F.lit("")) if rule in ("body", "name") else value), (kind != want) & ~nothing


def mapped(rows: DataFrame, kind: str, *, payload: str = "payload", keep: list[str] = ()) -> DataFrame:
    """``keep`` columns, the record's fields and ``problem`` (null if the payload is sound) of each payload.

    Null texts and texts that are no JSON object have the problem ``no JSON object``.
    """
    v = F.try_parse_json(payload)
    got = rows.select(*keep, F.explode(F.array(F.struct(v.alias("v"), (~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))).alias("bad")))).alias("_p"))
    problem, values = F.when(F.col("_p.bad"), F.lit("no JSON object")), {}
    for name, path, rule in KINDS[kind]:
        values[name], broken = _field(F.col("_p.v"), path, rule)
        problem = problem.when(broken, F.lit(f"missing or invalid {name}"))
    out = got.select("*", problem.alias("problem"), *[x.alias(n) for n, x in values.items()])
    sound = F.col("problem").isNull()
    return out.select(*keep, *[F.when(sound, F.col(n)).alias(n) for n in values], "problem")


def _page_url(v: Column) -> Column:
    """The page's own address: absolute, or below the ``base`` that the payload names; null if there is none."""
    web, base = (F.when(F.coalesce(F.schema_of_variant(F.try_variant_get(v, p, "variant")), F.lit("")) == "STRING", F.try_variant_get(v, p, "string")) for p in ("$._links.webui", "$._links.base"))
    whole = lambda u: u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]")
    return F.when(whole(web), web).when((web != "") & whole(base), F.concat(rstrip(base, "/"), F.lit("/"), F.regexp_replace(web, "^/+", "")))


def pages(rows: DataFrame, *, summary: bool = False, payload: str = "payload", requested: str = "requested_id") -> DataFrame:
    """Page payloads as records with ``source_url``; with ``summary`` without the content (metadata-only read).

    The id must be the requested one. For an incremental run: summaries, ``manifests.classify``, and the contents of the rows
    that come out new or changed by a semi-join.
    """
    out = mapped(rows.withColumn("_url", _page_url(F.try_parse_json(payload))), "summary" if summary else "page", payload=payload, keep=[requested, "_url"])
    problem = F.coalesce("problem", F.when(F.col("canonical_id") != F.col(requested), "canonical_id mismatch").when(F.col("_url").isNull(), "missing source_url"))
    return out.withColumn("problem", problem).withColumnRenamed("_url", "source_url")


def listed(rows: DataFrame, *, only_pages: bool, payload: str = "payload", keep: list[str] = ()) -> DataFrame:
    """``keep``, ``position`` from 0, ``id`` of every result of a listing, or one row with the ``problem`` of a bad listing.

    Children keep their order; a space's listing must hold pages only (``only_pages``).
    """
    v = F.try_parse_json(payload)
    results = F.try_variant_get(v, "$.results", "array<variant>")
    kind = lambda x, p: F.coalesce(F.schema_of_variant(F.try_variant_get(x, p, "variant")), F.lit(""))
    no_id = lambda x: (kind(x, "$.id") != "STRING") | (F.try_variant_get(x, "$.id", "string") == "")
    other = lambda x: F.coalesce(F.try_variant_get(x, "$.type", "string"), F.lit("")) != "page"
    ok = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.results", "variant")).startswith("ARRAY"), F.lit(False))
    problem = F.when(~ok, "invalid listing").when(F.exists(results, other) if only_pages else F.lit(False), "a result is no page").when(F.exists(results, no_id), "a result has no id")
    found = rows.select(*keep, problem.alias("problem"), F.transform(results, lambda x: F.try_variant_get(x, "$.id", "string")).alias("_ids"))
    none = F.array(F.lit(None).cast("string"))
    return found.select(*keep, "problem", F.posexplode_outer(F.when(F.col("problem").isNull(), F.col("_ids")).otherwise(none)).alias("position", "id")).where("problem IS NOT NULL OR id IS NOT NULL")


def tracked(rows: DataFrame, kind: str, *, owner: str, repo: str, web_root: str, payload: str = "payload") -> DataFrame:
    """Issues, pull requests or releases with ``source_url``; among issues, payloads of pull requests are no rows."""
    src = rows.where(~is_pull_request(payload)) if kind == "issue" else rows
    out = mapped(src, kind, payload=payload)
    place = {"issue": ("issues", "number"), "pull_request": ("pull", "number"), "release": ("releases/tag", "tag_name")}[kind]
    root = F.concat_ws("/", rstrip(F.lit(web_root), "/"), quote(F.lit(owner)), quote(F.lit(repo)), F.lit(place[0]))
    return out.withColumn("source_url", F.when(F.col("problem").isNull(), F.concat_ws("/", root, quote(F.col(place[1]).cast("string")))))


def comments(rows: DataFrame, kind: str, parent: str, *, payload: str = "payload") -> DataFrame:
    """Comments with their parent's key; ``source_url`` of a pull request's is the page's address, else the API's."""
    out = mapped(rows, kind, payload=payload, keep=[parent])
    if "html_url" not in out.columns:
        return out
    return out.withColumn("source_url", F.coalesce(F.nullif("html_url", F.lit("")), "url")).drop("html_url", "url")


def comment_key(kind: str) -> list[Column]:
    """The columns that comments of a kind are ordered by (``issues.ordered_comments``)."""
    text = lambda c: F.coalesce(c, F.lit(""))
    number = lambda c: F.coalesce(c, F.lit(-1).cast("bigint"))
    when = [F.col("created_at"), F.col("updated_at")]
    if kind == "issue_comment":
        return [*when, text("author"), F.col("body")]
    if kind == "pull_comment":
        return [*when, number("comment_id"), text("source_url"), text("author"), F.col("body")]
    return [*when, number("comment_id"), text("source_url"), text("path"), number("line"), number("original_line"), text("author"), F.col("body")]


def stub_pages(targets: DataFrame, *, page_id: str = "page_id", page_url: str = "page_url") -> DataFrame:
    """A made-up page of version 1 for each target, the same every time; a target without an id is ``unknown``."""
    i = F.coalesce(page_id, F.lit("unknown"))
    return targets.select(i.alias("canonical_id"), F.concat(F.lit("stub-page-"), i).alias("title"), F.coalesce(page_url, F.lit("")).alias("source_url"), F.format_string("Stub content for page %s.", i).alias("content"),
                          F.lit(1).cast("bigint").alias("page_version"), F.lit("1970-01-01T00:00:00Z").alias("last_modified"))


def served(pages_table: DataFrame, *, base: str, space: str, start: int = 0, limit: int = 100) -> DataFrame:
    """What a page server would answer for a space's listing, from a table of pages: one ``payload`` of at most ``limit`` results.

    The ids are taken in lexical order by a top-k of ``start + limit + 1`` rows, as an offset listing does.
    """
    ids = pages_table.where(F.col("space_key") == space).select("id").distinct().orderBy("id").offset(start).limit(limit + 1)
    got = ids.agg(F.array_sort(F.collect_list("id")).alias("ids"))
    results = F.transform(F.slice("ids", 1, limit), lambda i: F.struct(i.alias("id"), F.lit("page").alias("type")))
    following = F.when(F.size("ids") > limit, F.lit(f"{base}/rest/api/content?spaceKey={space}&type=page&start={start + limit}&limit={limit}"))
    return got.select(F.to_json(F.struct(results.alias("results"), F.struct(following.alias("next")).alias("_links"))).alias("payload"))


def discovered(rows: DataFrame, *, payload: str = "payload", max_items: int = 500) -> DataFrame:
    """The videos of a playlist's (or one video's) payload: ``collection_id, video_id, position, title, available, failure``.

    An entry without a position has its place in the list; what keeps it from being read becomes its ``failure``. A single
    video is one entry at position 1. Entries beyond ``max_items`` are an error of the collection, not cut off.
    """
    v = F.try_parse_json(payload)
    text = lambda x, p: F.nullif(F.try_variant_get(x, p, "string"), F.lit(""))
    entries = F.coalesce(F.try_variant_get(v, "$.entries", "array<variant>"), F.array(v))
    src = rows.select(text(v, "$.id").alias("collection_id"), F.size(entries).alias("_n"), F.posexplode(entries).alias("_i", "_e"))
    place = F.when(F.col("_n") > max_items, F.raise_error(F.lit(f"more than {max_items} entries")).cast("bigint")).otherwise(F.coalesce(F.try_variant_get("_e", "$.playlist_index", "bigint"), F.col("_i") + 1))
    why = F.coalesce(text(F.col("_e"), "$.availability"), F.lit("public"))
    failure = F.when(text(F.col("_e"), "$.id").isNull(), "no_id").when(why.isin(*UNAVAILABLE), why).when(~why.isin(*AVAILABLE), "unavailable")
    return src.select("collection_id", text(F.col("_e"), "$.id").alias("video_id"), place.alias("position"), text(F.col("_e"), "$.title").alias("title"),
                      failure.isNull().alias("available"), failure.alias("failure"))


# How a video's availability is named.
AVAILABLE = ["public", "unlisted"]
UNAVAILABLE = ["private", "premium_only", "subscriber_only", "needs_auth"]


def next_link(header: str | Column, api_root: str) -> Column:
    """struct(url, problem): the next page that a Link header names; it must lie below the API's root."""
    found = F.regexp_extract(F.coalesce(col(header), F.lit("")), r'(?:^|,)\s*<([^<>,;]+)>\s*;[^,]*rel="next"', 1)
    root = F.lit(api_root)
    same = (url_part(found, "scheme") == url_part(root, "scheme")) & (F.lower(url_part(found, "netloc")) == F.lower(url_part(root, "netloc")))
    path = rstrip(url_part(root, "path"), "/")
    below = same & ((path == "") | url_part(found, "path").startswith(F.concat(path, F.lit("/"))))
    return F.struct(F.when((found != "") & below, found).alias("url"), F.when((found != "") & ~below, "pagination URL outside the API root").alias("problem"))


def rate_limit_hint(status: str | Column, retry_after: str | Column, remaining: str | Column, reset: str | Column) -> Column:
    """When a request may be made again, null if it was not held back; a reset time is given in UTC."""
    wait, until = F.nullif(col(retry_after), F.lit("")), F.nullif(col(reset), F.lit(""))
    held = F.coalesce(col(remaining) == "0", F.lit(False)) | F.coalesce(col(status) == 429, F.lit(False))
    time = F.coalesce(F.date_format(F.timestamp_seconds(until.try_cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss"), until)
    return F.when(wait.isNotNull(), F.concat(F.lit("retry after "), wait, F.lit(" second(s)"))).when(held, F.when(until.isNotNull(), F.concat(F.lit("reset at "), time)).otherwise("no retry time provided"))


def next_listing(v: Column, base: str) -> Column:
    """A10: the absolute address of a listing's next page, null at its end; a path below the base's own path is not put below it again."""
    nxt = F.nullif(F.try_variant_get(v, "$._links.next", "string"), F.lit(""))
    own = rstrip(url_part(F.lit(base), "path"), "/")
    below = nxt.startswith("/") & ~((own != "") & ((url_part(nxt, "path") == own) | nxt.startswith(F.concat(own, F.lit("/")))))
    return F.when(nxt.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), nxt).when(below | ~nxt.startswith("/"), F.concat(rstrip(F.lit(base), "/"), F.lit("/"), F.regexp_replace(nxt, "^/+", ""))).otherwise(join_url(F.lit(base), nxt))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Captured payloads, one JSON text a file: ``path, payload``."""
    return spark.read.format("binaryFile").load(path).select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("payload"))
