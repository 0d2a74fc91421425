"""Issue-tracker records: kinds, since, limits, ordered comments, hydration."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from lodestrata.functions.text import col


def is_pull_request(payload: str | Column) -> Column:
    """Whether the JSON object has the key ``pull_request``, even with a null value."""
    return F.coalesce(F.array_contains(F.json_object_keys(col(payload)), "pull_request"), F.lit(False))


def since_filter(rows: DataFrame, column: str, since: str | None) -> DataFrame:
    """Rows at or after an ISO-8601 time; without a time all rows, with one no rows that lack a value.

    A naive time is read as UTC. Malformed times raise before any work.
    """
    if since is None:
        return rows
    at = datetime.fromisoformat(since.replace("Z", "+00:00"))
    at = at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)
    kind = rows.schema[column].dataType
    # A column of times is compared as it is, so that the scan can skip row groups; texts are parsed.
    value = F.col(column) if isinstance(kind, (TimestampType, TimestampNTZType)) else F.try_to_timestamp(column)
    text = at.strftime("%Y-%m-%d %H:%M:%S.%f")
    return rows.where(value >= F.lit(text if isinstance(kind, TimestampNTZType) else f"{text}+00:00").cast(kind if isinstance(kind, TimestampNTZType) else "timestamp"))


def first_rows(rows: DataFrame, order: list[str], limit: int | None) -> DataFrame:
    """The limit is taken last, on the sorted rows (a top-k, which never sorts everything in one task)."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def release_key(published: str | Column, tag: str | Column, release_id: str | Column) -> Column:
    """Releases sort by these as texts; unpublished ones come first."""
    return F.struct(F.coalesce(col(published).cast("string"), F.lit("")).alias("a"), col(tag).alias("b"), col(release_id).alias("c"))


def ordered_comments(comments: DataFrame, parent: str, key: list[Column], fields: list[str]) -> DataFrame:
    """The comments of each parent as one array in key order (a parent's comments are one record's content)."""
    s = F.struct(*[k.alias(f"_k{i}") for i, k in enumerate(key)], *fields)
    return comments.groupBy(parent).agg(F.array_sort(F.collect_list(s)).alias("_c")).select(parent, F.transform("_c", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("comments"))


def hydrate(parents: DataFrame, comments: DataFrame, key: str) -> DataFrame:
    """Parents with their arrays; those without comments get an empty one. Limit the parents first."""
    kind = comments.schema["comments"].dataType
    return parents.join(comments, key, "left").withColumn("comments", F.coalesce("comments", F.array().cast(kind)))


STATES = ["open", "closed", "all"]


def options_problem(repo: str, state: str = "open", since: str | None = None, max_items: int | None = None) -> str | None:
    """What is wrong with a scan's options, before any request: the repository's form, the state, the time or the limit."""
    owner, _, name = repo.partition("/")
    if not owner or not name or "/" in name or owner != owner.strip() or name != name.strip():
        return "repo must be owner/name"
    if state not in STATES:
        return f"state must be one of {', '.join(STATES)}"
    if max_items is not None and max_items < 1:
        return "max_items must be at least 1"
    try:
        datetime.fromisoformat((since or "2000-01-01").replace("Z", "+00:00"))
    except ValueError:
        return "since must be an ISO-8601 time"
    return None
