"""Discovery as a stream: the listings of portals, day by day and page by page, and the documents that they name.

``spark.readStream.format("discover")`` takes the options ``listings`` (addresses with {day} and {page} in them, a line each),
``from`` and ``until`` (days; ``until`` is today if it is not given), ``pageSize`` (a shorter page is the last one of its day),
``items`` (the path of names to the list of addresses in an answer), ``progress`` (a folder that outlives the stream), and those
of the ``portal`` source. An offset names, for each listing, the day and the page up to which it has been read. A batch takes
no more pages of a host than its rate has allowed since the batch before, MOST at most, so a backlog comes in steps. Pages are
tasks: each asks for its page and fetches what it names, at its part of the host's rate.

A batch's end is written to ``progress`` when the batch is planned, since Spark does not tell a source that starts again where
it was; the checkpoint decides what is read, so a batch that was not finished is read again from its offsets, and each
document comes once. A page that cannot be read is a row with an error, and the listing goes on behind it.
"""

from __future__ import annotations

import datetime as dt
import functools
import json
import time
from collections import Counter
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from statuta.sources.crawl import RATE, CircuitBreaker, TokenBucket, fetcher, host_of, retried, sniff

#: Pages of a listing in a batch at most.
MOST = 50
ROWS = "listing string, day string, page int, place int, url string, format string, content binary, error string"


class ListedPage(InputPartition):
    def __init__(self, listing: str, day: str, page: int, rate: float):
        self.listing, self.day, self.page, self.rate = listing, day, page, rate


class DiscoverReader(DataSourceStreamReader):
    def __init__(self, options: dict, clock=time.monotonic):
        self.options, self.rate, self.size, self.clock = dict(options), float(options.get("rate", RATE)), int(options.get("pageSize", 100)), clock
        self.listings = options["listings"].split("\n")
        self.hosts = Counter(map(host_of, self.listings))
        self.at, self.asked = self.kept() or self.initialOffset(), None
        self.buckets = {host: TokenBucket(self.rate) for host in self.hosts}

    # where the stream stands

    def file(self) -> tuple[pyarrow.fs.FileSystem, str] | None:
        where = self.options.get("progress")
        if not where:
            return None
        store, path = pyarrow.fs.FileSystem.from_uri(where if "://" in where else f"file://{where}")
        return store, f"{path}/offset.json"

    def kept(self) -> dict | None:
        if not (found := self.file()) or found[0].get_file_info(found[1]).type != pyarrow.fs.FileType.File:
            return None
        with found[0].open_input_stream(found[1]) as f:
            return json.loads(f.read())

    def keep(self, offset: dict) -> None:
        if found := self.file():
            store, path = found
            store.create_dir(path.rpartition("/")[0], recursive=True)
            with store.open_output_stream(f"{path}.new") as f:
                f.write(json.dumps(offset).encode())
            store.move(f"{path}.new", path)

    def initialOffset(self) -> dict:  # noqa: N802
        return {listing: {"day": self.options["from"], "page": 0, "done": False} for listing in self.listings}

    def until(self) -> str:
        return self.options.get("until") or dt.date.today().isoformat()

    def following(self, at: dict) -> dict | None:
        """Where a listing goes on; None when its last day has been read."""
        if not at["done"]:
            return at
        day = (dt.date.fromisoformat(at["day"]) + dt.timedelta(days=1)).isoformat()
        return {"day": day, "page": 0, "done": False} if day <= self.until() else None

    def latestOffset(self) -> dict:  # noqa: N802
        """As many pages further as the rate has allowed since it was last asked, of one day of each listing."""
        now = self.clock()
        seconds = 1.0 if self.asked is None else now - self.asked
        self.asked, end = now, {}
        for listing in self.listings:
            at = self.following(self.at.get(listing) or self.initialOffset()[listing])
            if at is None or at["day"] > self.until():
                end[listing] = self.at[listing]
                continue
            admitted = min(MOST, max(1, int(seconds * self.rate / self.hosts[host_of(listing)])))
            page, done = at["page"], False
            while admitted and not done:
                done, page, admitted = self.last(listing, at["day"], page), page + 1, admitted - 1
            end[listing] = {"day": at["day"], "page": page, "done": done}
        self.at = end
        return end

    def last(self, listing: str, day: str, page: int) -> bool:
        """Whether a page is the last one of its day; one that cannot be read is."""
        try:
            return len(self.addresses(listing, day, page, self.buckets[host_of(listing)])) < self.size
        except (OSError, ValueError, KeyError, TypeError):
            return True

    def addresses(self, listing: str, day: str, page: int, bucket: TokenBucket) -> list[str]:
        found = json.loads(retried(fetcher(self.options), listing.replace("{day}", day).replace("{page}", str(page)), take=bucket.take))
        for name in filter(None, self.options.get("items", "").split(".")):
            found = found[name]
        return found

    # what a batch reads

    def partitions(self, start: dict, end: dict) -> list[ListedPage]:
        self.keep(end)
        self.at, pages = end, []
        for listing, to in end.items():
            at = self.following(start.get(listing) or self.initialOffset()[listing])
            if at and at["day"] == to["day"]:
                pages += [(listing, to["day"], page) for page in range(at["page"], to["page"])]
        hosts = Counter(host_of(listing) for listing, _, _ in pages)
        return [ListedPage(*p, self.rate / hosts[host_of(p[0])]) for p in pages]

    def read(self, part: ListedPage) -> Iterator[tuple]:
        bucket, breaker, fetch = TokenBucket(part.rate), CircuitBreaker(), fetcher(self.options)
        own = part.listing, part.day, part.page
        try:
            urls = self.addresses(*own, bucket)
        except (OSError, ValueError, KeyError, TypeError) as e:
            yield *own, None, None, None, None, f"{type(e).__name__}: {e}"
            return
        for place, url in enumerate(urls):
            try:
                content = breaker.call(functools.partial(retried, take=bucket.take), fetch, url)
                yield *own, place, url, sniff(content[:64]), content, None
            except OSError as e:
                yield *own, place, url, None, None, f"{type(e).__name__}: {e}"

    def commit(self, end: dict) -> None:
        """The end of a batch is kept when it is planned."""


class DiscoverSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "discover"

    def schema(self) -> str:
        return ROWS

    def streamReader(self, schema) -> DiscoverReader:  # noqa: N802
        return DiscoverReader(self.options)
