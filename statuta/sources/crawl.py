"""Portals as a Python data source: one input partition for each page of a listing, raw documents as rows.

``spark.read.format("portal")`` takes the option ``fetcher``, a name in FETCHERS: how addresses become bytes. The one
built in are ``folder`` (offline files) and ``http`` (options ``token`` and ``timeout``). A partition belongs to one host;
where a host has several, each takes its part of the host's rate, of which every try takes a token. Failures are retried with
doubled waits, then the row carries the error and the others go on. ``spark.read.format("listing")`` reads listings page by page, until one is short;
``fetched`` adds what was fetched to rows that have an address, such as those of ``listings.requests``.
"""

from __future__ import annotations

import functools
import http.client
import json
import os
import time
import urllib.error
import urllib.request
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from statuta.sources.listings import until_short

#: Requests a second, tries and seconds to wait for an answer.
RATE, TRIES, TIMEOUT = 2.0, 3, 30
#: Answers with which a request may be made again though they are among those that blame it; the longest wait that an answer can ask for.
AGAIN, LONGEST = (408, 425, 429), 60.0
RAW = "url string, host string, format string, content binary, error string"


def from_folder(url: str) -> bytes:
    with open(url.removeprefix("file://"), "rb") as f:
        return f.read()


def from_http(url: str, token: str | None = None, timeout: float = TIMEOUT) -> bytes:
    """The body of an answer; errors of the network, of the server and of time are OSError."""
    headers = {"User-Agent": "statuta"} | ({"Authorization": f"Bearer {token}"} if token else {})
    if not url.startswith(("http://", "https://")):
        raise OSError(f"no address of the web: {url}")
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as answer:
        return answer.read()


#: How to fetch an address, by name; others can be registered.
FETCHERS: dict[str, Callable[[str], bytes]] = {"folder": from_folder, "http": from_http}


def fetcher(options: dict) -> Callable[[str], bytes]:
    name = options.get("fetcher", "folder")
    if name == "http":
        return functools.partial(from_http, token=options.get("token"), timeout=float(options.get("timeout", TIMEOUT)))
    return FETCHERS[name]


def host_of(url: str) -> str:
    return url.split("/")[2] if "://" in url else "local"


def retried(fetch: Callable[[str], bytes], url: str, tries: int = TRIES, wait: float = 0.05, sleep=time.sleep, take: Callable[[], None] | None = None) -> bytes:
    """What is fetched, with doubled waits between tries; ``take`` is called before each one. All that can be wrong with an
    address or an answer is an OSError. An answer that says that the request is wrong is not asked for again; one that says
    when to come again (up to LONGEST seconds) is believed."""
    for n in range(tries):
        if take:
            take()
        pause = wait * 2**n
        try:
            return fetch(url)
        except urllib.error.HTTPError as e:
            if n == tries - 1 or (400 <= e.code < 500 and e.code not in AGAIN):
                raise
            after = (e.headers or {}).get("Retry-After") or ""
            pause = max(pause, min(float(after), LONGEST)) if after.isdigit() else pause
        except (OSError, http.client.HTTPException, ValueError) as e:
            if isinstance(e, ValueError | http.client.InvalidURL) and not isinstance(e, OSError):
                raise OSError(f"{type(e).__name__}: {e}") from e
            if n == tries - 1:
                raise e if isinstance(e, OSError) else OSError(f"{type(e).__name__}: {e}") from e
        sleep(pause)
    raise ValueError("tries must be at least 1")


class TokenBucket:
    """At most ``rate`` takes a second after a burst of as many."""

    def __init__(self, rate: float, clock=time.monotonic, sleep=time.sleep):
        self.rate, self.clock, self.sleep = rate, clock, sleep
        self.left, self.at = rate, clock()

    def take(self) -> None:
        now = self.clock()
        self.left, self.at = min(self.rate, self.left + (now - self.at) * self.rate), now
        if self.left < 1:
            self.sleep((1 - self.left) / self.rate)
            self.left = 1
        self.left -= 1


class CircuitBreaker:
    """After more than ``most`` failures in a row calls are refused until ``rest`` seconds have passed."""

    def __init__(self, most: int = 5, rest: float = 60, clock=time.monotonic):
        self.most, self.rest, self.clock, self.failed, self.since = most, rest, clock, 0, 0.0

    def call(self, f: Callable, *args):
        if self.failed > self.most and self.clock() - self.since < self.rest:
            raise ConnectionError("too many failures; resting")
        try:
            out = f(*args)
        except OSError:
            self.failed, self.since = self.failed + 1, self.clock()
            raise
        self.failed = 0
        return out


def sniff(head: bytes) -> str:
    if head.startswith((b"<?xml", b"<gesetz")):
        return "xml"
    return "pdf" if head.startswith(b"%PDF") else "html"


class Page(InputPartition):
    def __init__(self, host: str, urls: list[str], rate: float):
        self.host, self.urls, self.rate = host, urls, rate


class PortalReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.rate, self.size = dict(options), float(options.get("rate", RATE)), int(options.get("pageSize", 100))
        urls = options.get("urls")
        self.urls = urls.split("\n") if urls else sorted(os.path.join(options["path"], f) for f in os.listdir(options["path"]))

    def partitions(self) -> list[Page]:
        hosts: dict[str, list[str]] = {}
        for url in self.urls:
            hosts.setdefault(host_of(url), []).append(url)
        out = []
        for host, urls in hosts.items():
            cuts = range(0, len(urls), self.size)
            out += [Page(host, urls[i : i + self.size], self.rate / len(cuts)) for i in cuts]
        return out

    def read(self, page: Page) -> Iterator[tuple]:
        bucket, breaker, fetch = TokenBucket(page.rate), CircuitBreaker(), fetcher(self.options)
        for url in page.urls:
            try:
                content = breaker.call(functools.partial(retried, take=bucket.take), fetch, url)
                yield url, page.host, sniff(content[:64]), content, None
            except OSError as e:
                yield url, page.host, None, None, f"{type(e).__name__}: {e}"


class ListingReader(PortalReader):
    """Options: urls with {offset} and {limit} in them, a line each; items: the path of names to the list in an answer."""

    def partitions(self) -> list[Page]:
        hosts = Counter(map(host_of, self.urls))
        return [Page(host_of(url), [url], self.rate / hosts[host_of(url)]) for url in self.urls]

    def read(self, page: Page) -> Iterator[tuple]:
        bucket, breaker, fetch = TokenBucket(page.rate), CircuitBreaker(), fetcher(self.options)

        def rows(offset: int, limit: int) -> list:
            found = json.loads(breaker.call(functools.partial(retried, take=bucket.take), fetch, page.urls[0].replace("{offset}", str(offset)).replace("{limit}", str(limit))))
            for name in filter(None, self.options.get("items", "").split(".")):
                found = found[name]
            return found

        at = 0
        try:
            for at, item in enumerate(until_short(rows, self.size), 1):  # noqa: B007
                yield page.urls[0], at - 1, json.dumps(item), None
        except (OSError, ValueError, KeyError, TypeError) as e:
            yield page.urls[0], at, None, f"{type(e).__name__}: {e}"


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "url string, place long, item string, error string"

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)


def fetched(requests: DataFrame, url: str = "url", rate: float = RATE, **options: str) -> DataFrame:
    """Rows with the content of their address or the error. A host's rows are in one partition, which keeps its rate."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hosts: dict[str, tuple[TokenBucket, CircuitBreaker]] = {}
        fetch = fetcher(options)
        for part in parts:
            contents, errors = [], []
            for address in part[url]:
                bucket, breaker = hosts.setdefault(host_of(address or ""), (TokenBucket(rate), CircuitBreaker()))
                content = error = None
                try:
                    content = breaker.call(functools.partial(retried, take=bucket.take), fetch, address or "")
                except OSError as e:
                    error = f"{type(e).__name__}: {e}"
                contents.append(content)
                errors.append(error)
            yield part.assign(content=contents, error=errors)

    shape = StructType([*requests.schema.fields, StructField("content", BinaryType()), StructField("error", StringType())])
    return requests.repartition(F.regexp_extract(url, "^[a-z]+://([^/?#]*)", 1)).mapInPandas(run, shape)


class PortalSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "portal"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> PortalReader:
        return PortalReader(self.options)


def register(spark) -> None:
    from statuta.sources.discover import DiscoverSource

    spark.dataSource.register(PortalSource)
    spark.dataSource.register(ListingSource)
    spark.dataSource.register(DiscoverSource)
