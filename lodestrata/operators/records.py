"""Records to deterministic markdown, ids, paths and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import col, rstrip, sha256

# What stands for an empty body.
EMPTY = {"issue": "(empty issue body)", "pull_request": "(empty pull request body)", "release": "(empty release body)", "issue_comment": "(empty issue comment body)", "pull_request_comment": "(empty pull request comment body)",
         "review_comment": "(empty pull request review comment body)"}


def _line(label: str, value: str | Column) -> Column:
    """``- label: value``, without a space behind the colon if there is no value."""
    v = F.coalesce(col(value).cast("string"), F.lit(""))
    return F.concat(F.lit(f"- {label}:"), F.when(v != "", F.concat(F.lit(" "), v)).otherwise(""))


def _must(label: str, value: str | Column) -> Column:
    return F.concat(F.lit(f"- {label}: "), F.coalesce(col(value).cast("string"), F.lit("")))


def body_text(content: str | Column, empty: str = "") -> Column:
    """The content without its last line ends, or a marker if nothing is left."""
    text = rstrip(F.coalesce(col(content), F.lit("")), "\\n")
    return F.when(text == "", F.lit(empty)).otherwise(text) if empty else text


def record_markdown(*, title, canonical_id, source_url, content, source, adapter, parent_id=None, fetched_at=None, updated_at=None, extra: tuple[tuple[str, Column], ...] = (), note: str = "") -> Column:
    """A heading, the metadata list, optional further lines and a note, then the content.

    Null values print as empty; only the content's trailing line ends are dropped.
    """
    lines = [F.concat(F.lit("# "), F.coalesce(col(title), F.lit("untitled"))), F.lit(""), F.lit("## Metadata"), _must("source", source), _must("canonical_id", canonical_id),
             _line("parent_id", parent_id), _must("source_url", source_url), _line("fetched_at", fetched_at), _line("updated_at", updated_at), _must("adapter", adapter)]
    lines += [_must(k, v) for k, v in extra]
    lines += [F.lit(""), F.lit("## Content"), F.lit("")]
    if note:
        lines += [F.lit(f"> {note}"), F.lit("")]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"), body_text(content), F.lit("\n"))


def quality_lines(prefix: str, fields: dict[str, Column]) -> tuple[tuple[str, Column], ...]:
    """Metadata lines of a candidate's assessment, for ``record_markdown``'s ``extra``; flags as ``True`` and ``False``.

    The last line has all of them as one JSON object in the order of its keys, absent values left out.
    """
    shown = lambda v: F.coalesce(F.when(F.typeof(v) == "boolean", F.initcap(v.cast("string"))).otherwise(v.cast("string")), F.lit(""))
    lines = [(f"{prefix}_{k}", shown(v)) for k, v in fields.items()]
    return (*lines, (f"{prefix}_metadata_json", F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))))


def tree_output_path(path: str | Column, prefix: str = "") -> Column:
    """The source path with ``.md`` appended unless it is there already, below a prefix."""
    p = col(path)
    return F.concat(F.lit(prefix), F.when(p.endswith(".md"), p).otherwise(F.concat(p, F.lit(".md"))))


def tracked_id(adapter: str | Column, host: str | Column, repo: str | Column, kind: str | Column, number: str | Column) -> Column:
    """The id of an issue, pull request or release: adapter, host, repository, kind and number or tag."""
    return F.concat_ws(":", col(adapter), col(host), col(repo), col(kind), col(number).cast("string"))


def file_id(repo_url: str | Column, commit: str | Column, path: str | Column) -> Column:
    """The id of a repository's file at a commit; a public page's id is its final URL."""
    return F.concat(col(repo_url), F.lit("@"), col(commit), F.lit(":"), col(path))


def output_name(url: str | Column) -> Column:
    """C11: a slug of the last path part without its suffix (or of the host), then 12 digits of the URL's hash."""
    u = col(url)
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    netloc = F.regexp_extract(rest, r"^//([^/?#]*)", 1)
    path = F.regexp_extract(F.regexp_replace(rest, r"^//[^/?#]*", ""), r"^([^?#]*)", 1)
    last = F.regexp_extract(F.regexp_replace(F.regexp_replace(path, r"(/\.?)+\z", ""), r"/(?:\./)+", "/"), r"([^/]*)\z", 1)
    stem = F.when(last != "", F.regexp_replace(last, r"(?<=.)(?<!^\.{1,9})\.[^.]+\z", "")).otherwise(netloc)
    slug = F.lower(F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9._-]+", "-"), r"^[-._]+|[-._]+\z", ""))
    return F.concat(F.when(slug == "", F.lit("public-source")).otherwise(slug), F.lit("-"), F.substring(sha256(u), 1, 12))


def manifest_entries(records: DataFrame, *, optional: tuple[str, ...] = ("title", "content_hash", "path", "ref", "last_modified")) -> DataFrame:
    """The three required columns as they are, optional ones with '' as null; ``page_version`` is kept as it is."""
    return records.select("canonical_id", "source_url", "output_path", *[F.nullif(F.col(c), F.lit("")).alias(c) for c in optional if c in records.columns],
                          *[c for c in ("page_version",) if c in records.columns])


def comment_sections(heading: str, comments: str | Column, fields: tuple[str, ...], empty: str, title: str) -> Column:
    """Numbered sections of an array of structs; nothing at all for a null or empty array."""
    c = col(comments)
    one = F.transform(c, lambda x, i: F.concat(F.lit(f"### {title} "), (i + 1).cast("string"), F.lit("\n\n"), F.concat_ws("\n", *[F.concat(F.lit(f"- {f}: "), F.coalesce(x[f].cast("string"), F.lit(""))) for f in fields]),
                                               F.lit("\n\n"), body_text(x["body"], empty), F.lit("\n")))
    return F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.concat(F.lit(f"\n\n## {heading}\n\n"), rstrip(F.array_join(one, "\n"), "\\n"))).otherwise("")


def issue_markdown(*, kind: str, number, title, state, author, created_at, updated_at, source_url, repo, body, sections: Column | None = None) -> Column:
    """One issue or pull request with its comment sections behind the body."""
    head = {"issue": "Issue", "pull_request": "Pull Request"}[kind]
    lines = [F.concat(F.lit(f"# {head} #"), col(number).cast("string"), F.lit(": "), F.coalesce(col(title), F.lit(""))), F.lit(""), F.lit("## Metadata"), _must("repo", repo), F.lit(f"- resource_type: {kind}"), _must("number", number),
             _must("state", state), _must("author", author), _must("created_at", created_at), _must("updated_at", updated_at), _must("source_url", source_url), F.lit(""), F.lit("## Body"), F.lit("")]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"), body_text(body, EMPTY[kind]), F.lit("") if sections is None else sections, F.lit("\n"))


def release_markdown(*, tag_name, title, release_id, author, created_at, published_at, draft, prerelease, source_url, repo, body) -> Column:
    """One release; the title is left out of the heading if it is empty."""
    t = F.coalesce(col(title), F.lit(""))
    lines = [F.concat(F.lit("# Release "), col(tag_name), F.when(t != "", F.concat(F.lit(": "), t)).otherwise("")), F.lit(""), F.lit("## Metadata"), _must("repo", repo), F.lit("- resource_type: release"), _must("release_id", release_id),
             _must("tag_name", tag_name), _must("title", t), _must("author", author), _must("created_at", created_at), _must("published_at", published_at), _must("draft", col(draft).cast("string")), _must("prerelease", col(prerelease).cast("string")), _must("source_url", source_url), F.lit(""), F.lit("## Body"), F.lit("")]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"), body_text(body, EMPTY["release"]), F.lit("\n"))
