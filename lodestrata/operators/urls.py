"""URL rules: public addresses, page targets, API roots, safe package paths."""

from __future__ import annotations

import ipaddress
import socket

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestrata.functions.text import col, strip


def host_of(url: str | Column) -> Column:
    authority = F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^[^@]*@", ""), r"(?<=[^:\]]|\]):\d*\z", ""))


def special_address(host: str | None) -> str | None:
    """Why an address, in any of its spellings, is not a public one; null for public ones and for names."""
    h = (host or "").strip("[]").rstrip(".")
    try:
        a = ipaddress.ip_address(h)
    except ValueError:
        try:
            a = ipaddress.ip_address(socket.inet_aton(h))
        except OSError:
            return None
    for name, bad in (("loopback", a.is_loopback), ("link-local", a.is_link_local), ("multicast", a.is_multicast), ("unspecified", a.is_unspecified), ("reserved", a.is_reserved), ("private", a.is_private)):
        if bad:
            return f"{name} address"
    return None


@F.pandas_udf(StringType())
def _address_problem(host: pd.Series) -> pd.Series:
    return host.map(special_address)


def url_problem(url: str | Column) -> Column:
    """Why a URL is not on the public web, null if nothing speaks against it; null URLs are ``no scheme``.

    Only hosts that look like numbers reach the Python function that knows the address ranges.
    """
    u, h = col(url), host_of(url)
    numeric = h.rlike(r"^[0-9a-fx.]+\.?\z|^\[")
    return (F.when(~F.coalesce(u.rlike(r"(?i)^https?:"), F.lit(False)), "no http or https").when(F.regexp_extract(u, r"^[^:]+://([^/?#]*)", 1) == "", "no host").when(u.rlike(r"^[^:]+://[^/?#]*@"), "credentials")
            .when(h.isin("", "."), "no host").when(F.regexp_replace(h, r"\.+\z", "") == "localhost", "localhost").when(F.regexp_replace(h, r"\.+\z", "").endswith(".local"), "local name")
            .otherwise(F.when(numeric, _address_problem(h))))


def page_target(target: str | Column) -> Column:
    """struct(kind, page_id): a number is an id; a URL gives the first ``pageId`` if numeric, else ``/pages/<digits>``."""
    t = strip(F.coalesce(col(target), F.lit("")))
    ok = t.rlike(r"(?i)^https?://[^/?#\s]+")
    from_query = F.regexp_extract(F.regexp_extract(t, r"\?([^#]*)", 1), r"(?:^|&)pageId=([^&]*)", 1)
    from_path = F.regexp_extract(F.regexp_extract(t, r"^[^:]+://[^/?#]*([^?#]*)", 1), r"/pages/(\d+)(?:/|\z)", 1)
    kind = F.when(t.rlike(r"^\d+\z"), "page_id").when(t == "", "empty").when(t.contains("://"), F.when(ok, "url").otherwise("invalid_url")).otherwise("unknown")
    return F.struct(kind.alias("kind"), F.when(kind == "page_id", t).when(kind == "url", F.when(from_query.rlike(r"^\d+\z"), from_query).otherwise(F.nullif(from_path, F.lit("")))).alias("page_id"))


def under_base(url: str | Column, base: str | Column) -> Column:
    """Same scheme and host, and the base's path at a segment boundary."""
    root = lambda x: F.lower(F.regexp_extract(x, r"^([^:]+://[^/?#]*)", 1))
    path = lambda x: F.regexp_replace(F.regexp_extract(x, r"^[^:]+://[^/?#]*([^?#]*)", 1), r"/+\z", "")
    u, b = col(url), col(base)
    return (root(u) == root(b)) & ((path(b) == "") | (path(u) == path(b)) | path(u).startswith(F.concat(path(b), F.lit("/"))))


def api_root(base: str | Column) -> Column:
    """struct(web, api): ``https://host/api/v3`` and ``https://host`` name each other; the public host has its own API host."""
    b = F.regexp_replace(strip(col(base)), r"/+\z", "")
    web = F.regexp_replace(b, r"/api/v3\z", "")
    public = host_of(b).isin("api.github.com", "github.com")
    return F.struct(F.when(public, "https://github.com").otherwise(web).alias("web"), F.when(public, "https://api.github.com").otherwise(F.concat(web, F.lit("/api/v3"))).alias("api"))


def is_safe_path(path: str | Column) -> Column:
    """Relative, forward slashes only, no empty, ``.`` or ``..`` segment."""
    p = F.coalesce(col(path), F.lit(""))
    return (p != "") & ~p.contains("\\") & ~p.contains("\u0000") & ~p.startswith("/") & ~p.endswith("/") & ~p.contains("//") & ~p.rlike(r"(^|/)\.{1,2}(/|\z)")
