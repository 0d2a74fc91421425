"""Bounded HTTP scans as Python data sources (A07-A17): URLs of a column, captured URLs, JSON listings and APIs with Link headers."""

from __future__ import annotations

import json
import os
import re
import socket
import ssl
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestrata.operators.urls import special_address
from lodestrata.sources.config import choose

MAX_BYTES = 5_000_000
NEXT = re.compile(r'<([^<>,;]+)>\s*;[^,]*rel="next"')
TIMEOUT = 30


class _Checked(urllib.request.HTTPRedirectHandler):
    """Looks at each address a server sends the reader on to before it is asked."""

    def __init__(self, private: bool):
        self.private = private

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        problem = None if self.private else address_problem(newurl)
        if problem:
            raise PermissionError(f"redirected to {newurl}: {problem}")
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def address_problem(url: str) -> str | None:
    """D04 for one URL: why it is not on the public web; names are looked up, and every address they have must be public."""
    try:
        at = urllib.parse.urlsplit(url)
        host, port = at.hostname, at.port
    except ValueError:
        return "malformed"
    name = (host or "").rstrip(".").lower()
    if at.scheme not in ("http", "https"):
        return "no http or https"
    if at.username or at.password:
        return "credentials"
    if not name:
        return "no host"
    if name == "localhost" or name.endswith(".local"):
        return "local name"
    try:
        found = {x[4][0].partition("%")[0] for x in socket.getaddrinfo(name, port or 80, proto=socket.IPPROTO_TCP)}
    except OSError:
        return None  # the request itself will fail with the reason
    return next(filter(None, map(special_address, sorted(found))), None)


def _bearer(options: dict[str, str]) -> tuple[dict[str, str], ssl.SSLContext | None]:
    name = options.get("tokenenv")
    token = options.get("token") or (os.environ.get(name) if name else None)
    if name and not token:
        raise ValueError(f"the environment variable {name} is not set")
    return ({"Authorization": f"Bearer {token}"} if token else {}), None


def _certificate(options: dict[str, str]) -> tuple[dict[str, str], ssl.SSLContext | None]:
    context = ssl.create_default_context(cafile=options.get("cabundle"))
    context.load_cert_chain(options["clientcert"], options.get("clientkey"))
    return {}, context


# How a reader proves who it is: option ``auth``; secrets are named by the environment, never columns. Add strategies here.
AUTH: dict[str, Callable[[dict[str, str]], tuple[dict[str, str], ssl.SSLContext | None]]] = {"bearer": _bearer, "client_cert": _certificate}


def _get(url: str, options: dict[str, str]) -> tuple[int | None, str, str, bytes | None, str | None, dict[str, str]]:
    """(status, final url, content type, body, problem, headers); a body over the limit is no body.

    The address is looked at before the request and before each redirect, unless ``private`` is ``true`` (an API inside one's own network).
    """
    limit = int(options.get("maxbytes", MAX_BYTES))
    accept = [x for x in options.get("accept", "").split(",") if x]
    private = options.get("private", "false") == "true"
    problem = None if private else address_problem(url)
    if problem:
        return None, url, "", None, problem, {}
    headers, context = choose(AUTH, options.get("auth", "bearer"), label="auth")(options)
    req = urllib.request.Request(url, headers=headers)
    try:
        with urllib.request.build_opener(_Checked(private), *([urllib.request.HTTPSHandler(context=context)] if context else [])).open(req, timeout=float(options.get("timeout", TIMEOUT))) as r:
            kind, head = r.headers.get_content_type(), {k.lower(): v for k, v in r.headers.items()}
            if accept and kind not in accept:
                return r.status, r.url, kind, None, "content type not accepted", head
            if int(r.headers.get("Content-Length") or 0) > limit:
                return r.status, r.url, kind, None, "too large", head
            body = r.read(limit + 1)
            if len(body) > limit:
                return r.status, r.url, kind, None, "too large", head
            return r.status, r.url, f"{kind};{r.headers.get_content_charset() or 'utf-8'}", body, None, head
    except urllib.error.HTTPError as e:
        return e.code, url, "", None, f"status {e.code}", {k.lower(): v for k, v in e.headers.items()}
    except OSError as e:
        return None, url, "", None, str(e)[:200], {}


def _text(kind: str, body: bytes | None) -> str | None:
    if body is None:
        return None
    try:
        return body.decode(kind.partition(";")[2])
    except (LookupError, UnicodeDecodeError):
        return body.decode("utf-8", "replace")


FETCHED = "requested_url string, resolved_url string, status int, content_type string, body string, problem string, retry_after string, rate_remaining string, rate_reset string, link string"


def fetch(urls: DataFrame, *, url: str = "url", **options: str) -> DataFrame:
    """The distinct URLs of a column, fetched where they lie: one row a URL, a failed one with its problem.

    Nothing passes the driver. Spread the rows (``repartition``) over as many tasks as the server may be asked by at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for u in b.column(0).to_pylist():  # a body may be large: one row a batch
                status, final, kind, body, problem, head = _get(u, options)
                row = (u, final, status, kind.partition(";")[0], _text(kind, body), problem, *(head.get(k) for k in HEADERS))
                kinds = [pa.int32() if i == 2 else pa.string() for i in range(len(row))]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], [x.split()[0] for x in FETCHED.split(", ")])

    return urls.select(F.col(url).cast("string")).where(F.col(url).isNotNull()).distinct().mapInArrow(run, FETCHED)


HEADERS = ("retry-after", "x-ratelimit-remaining", "x-ratelimit-reset", "link")


class _Part(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _UrlReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Part([u]) for u in json.loads(self.options["urls"])] or [_Part([])]

    def read(self, partition: _Part):
        for u in partition.urls:
            status, final, kind, body, problem, _ = _get(u, self.options)
            yield u, final, status, kind.partition(";")[0], _text(kind, body), problem


class UrlSource(DataSource):
    """Option ``urls`` (JSON array); one row a URL, a failed one with its problem."""

    @classmethod
    def name(cls) -> str:
        return "lodestrata_urls"

    def schema(self) -> str:
        return "requested_url string, resolved_url string, status int, content_type string, body string, problem string"

    def reader(self, schema) -> DataSourceReader:
        return _UrlReader(dict(self.options))


class _ListReader(DataSourceReader):
    """Follows the pages of each listing in one partition, as each page names the next."""

    def __init__(self, options: dict[str, str]):
        self.options = {"private": "true", **options}  # a named API may lie inside one's own network

    def partitions(self) -> list[InputPartition]:
        return [_Part([u]) for u in json.loads(self.options["urls"])]

    def read(self, partition: _Part):
        for start in partition.urls:
            url, seen, n = start, set(), 0
            root = urllib.parse.urlsplit(start)
            while url:
                at = urllib.parse.urlsplit(url)
                if url in seen:
                    raise ValueError("Response error: a listing page repeats")
                if (at.scheme, at.netloc) != (root.scheme, root.netloc):
                    raise ValueError("Response error: a listing page is outside its API root")
                seen.add(url)
                _, _, _, body, problem, _ = _get(url, self.options)
                if body is None:
                    raise ValueError(f"Response error: {problem}")
                page = json.loads(body)
                if not isinstance(page, dict) or not isinstance(page.get("results"), list):
                    raise ValueError("Response error: results must be a list")
                for r in page["results"]:
                    if not isinstance(r, dict) or not isinstance(r.get("id"), str) or not r["id"]:
                        raise ValueError("Response error: every result needs an id")
                    yield start, n, r["id"], json.dumps(r, ensure_ascii=False, sort_keys=True)
                    n += 1
                nxt = (page.get("_links") or {}).get("next")
                url = urllib.parse.urljoin(url, nxt) if nxt else None


class ListingSource(DataSource):
    """Option ``urls`` (JSON array of listing URLs): rows ``listing, position, id, payload`` in order."""

    @classmethod
    def name(cls) -> str:
        return "lodestrata_listing"

    def schema(self) -> str:
        return "listing string, position int, id string, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _ListReader(dict(self.options))


class _PagedReader(DataSourceReader):
    """Follows the Link headers of each API listing in one partition."""

    def __init__(self, options: dict[str, str]):
        self.options = {"private": "true", **options}

    def partitions(self) -> list[InputPartition]:
        return [_Part([u]) for u in json.loads(self.options["urls"])] or [_Part([])]

    def read(self, partition: _Part):
        root = urllib.parse.urlsplit(self.options["apiroot"])
        for start in partition.urls:
            url, seen, n = start, set(), 0
            while url and url not in seen:
                seen.add(url)
                status, _, kind, body, problem, head = _get(url, self.options)
                try:
                    items = None if body is None else json.loads(body)
                except ValueError:
                    items = None
                if not isinstance(items, list):
                    yield start, n, None, problem or "Response error: no list", status, head.get("retry-after"), head.get("x-ratelimit-remaining"), head.get("x-ratelimit-reset")
                    break
                for x in items:
                    yield start, n, json.dumps(x, ensure_ascii=False), None if isinstance(x, dict) else "Response error: no object", status, None, None, None
                    n += 1
                url = next((m[1] for m in NEXT.finditer(head.get("link", ""))), None)
                at = urllib.parse.urlsplit(url or "")
                inside = (at.scheme.lower(), at.netloc.lower()) == (root.scheme.lower(), root.netloc.lower()) and at.path.startswith(root.path.rstrip("/") + "/")
                if url and not inside:
                    yield start, n, None, "Response error: pagination URL outside the API root", status, None, None, None
                    break


class PagedSource(DataSource):
    """Options ``urls`` (JSON array of listing addresses) and ``apiroot``: rows ``listing, position, payload, problem`` in order.

    Pages are followed by their Link headers, which must stay below ``apiroot``. A failed page ends its listing with a row that
    has the problem, the status and what the headers say about asking again (``payloads.rate_limit_hint``).
    """

    @classmethod
    def name(cls) -> str:
        return "lodestrata_paged"

    def schema(self) -> str:
        return "listing string, position int, payload string, problem string, status int, retry_after string, rate_remaining string, rate_reset string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(UrlSource)
    spark.dataSource.register(ListingSource)
    spark.dataSource.register(PagedSource)
