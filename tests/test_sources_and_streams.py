import json

import pandas as pd
import pytest

from statuta.functions import embed
from statuta.sources import crawl, listings, objects
from statuta.streaming import flows


def test_portal_source(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes(b"<?xml version='1.0'?><a/>")
    (tmp_path / "b.html").write_bytes(b"<html>b</html>")
    crawl.register(spark)
    rows = spark.read.format("portal").option("urls", f"{tmp_path}/a.xml\n{tmp_path}/b.html\n{tmp_path}/missing").option("rate", "1000").load().collect()
    assert sorted(str(r.format) for r in rows) == ["None", "html", "xml"]
    assert [r.error.split(":")[0] for r in rows if r.error] == ["FileNotFoundError"]
    assert spark.read.format("portal").option("path", str(tmp_path)).option("rate", "1000").option("pageSize", "1").load().rdd.getNumPartitions() == 2


def test_retries_and_rate():
    calls, waits = [], []

    def fetch(url):
        calls.append(url)
        if len(calls) < 3:
            raise OSError
        return b"ok"

    assert crawl.retried(fetch, "u", sleep=waits.append) == b"ok" and len(waits) == 2 and waits[1] == 2 * waits[0]
    with pytest.raises(OSError, match="no"):
        crawl.retried(lambda u: (_ for _ in ()).throw(OSError("no")), "u", sleep=lambda s: None)
    now, slept = [0.0], []
    bucket = crawl.TokenBucket(2, lambda: now[0], slept.append)
    for _ in range(3):
        bucket.take()
    assert slept == [0.5]


def test_toc(spark):
    xml = "<items><item><title>Bürgerliches Gesetzbuch (BGB)</title><link>https://x.de/bgb/xml.zip</link></item><item><title>Leer</title><link></link></item><item><title>Grundgesetz (GG)</title><link>/gg/xml.zip</link></item></items>"
    got = listings.toc(spark.createDataFrame([(xml,)], "xml string")).collect()
    assert [(r.abbreviation, r.external_id) for r in got] == [("BGB", "bgb"), ("GG", "gg")]


def test_query_answers(spark):
    doc = {"results": {"bindings": [{"celex": {"type": "literal", "value": "32016R0679"}}, {"title": {"type": "literal", "value": "x"}}]}}
    got = listings.sparql_bindings(spark.createDataFrame([(json.dumps(doc),)], "json string"), ["celex", "title"]).collect()
    assert [(r.celex, r.title) for r in got] == [("32016R0679", "32016R0679")]
    assert listings.pages(250) == [(0, 100), (100, 100), (200, 50)]
    codes = json.dumps({"codes": [{"id": "A", "titre": "Code"}, {"titre": "no id"}]})
    assert [(r.id, r.title) for r in listings.codes(spark.createDataFrame([(codes,)], "json string")).collect()] == [("A", "Code")]


def test_acts_under_either_name(spark):
    answers = [(json.dumps({"atti": [{"id": "1", "titoloAtto": "t"}]}), "a"), (json.dumps({"docs": [{"id": "2"}, {"titoloAtto": "no id"}]}), "b")]
    got = listings.acts(spark.createDataFrame(answers, "json string, kind string")).collect()
    assert sorted((r.id, r.kind) for r in got) == [("1", "a"), ("2", "b")]
    assert listings.act_requests(spark).count() == 3


def test_gazette(spark):
    days = listings.gazette_days(spark, "2024-03-02")
    issues = spark.sql("SELECT DATE '2024-03-01' AS day, '<s><item id=\"BOE-A-1\"/><item id=\"BOE-B-2\"/></s>' AS xml")
    assert days.count() == 7 and [r.item for r in listings.gazette_items(days, issues).collect()] == ["BOE-A-1"]


def test_robots_and_links(spark):
    robots = "User-agent: bad\nDisallow: /secret\nUser-agent: *\nDisallow: /blocked # why\nDisallow:\n"
    rules = listings.disallowed(spark.createDataFrame([("h", robots)], "host string, robots string"))
    assert [r.prefix for r in rules.collect()] == ["/blocked"]
    urls = spark.createDataFrame([("h", "/blocked/x"), ("h", "/secret"), ("i", "/blocked")], "host string, path string")
    assert sorted(tuple(r) for r in listings.allowed(urls, rules).collect()) == [("h", "/secret"), ("i", "/blocked")]
    pages = spark.createDataFrame([(1, '<a href="/Document/a"><a href="/x"><a href="/Document/a">'), (2, '<a href="/Norm/b"><a href="/Document/a">')], "page int, html string")
    got = listings.law_links(pages, pages.html, ["/Document/", "/Norm/"]).collect()
    assert sorted((r.link, r.page) for r in got) == [("/Document/a", 1), ("/Norm/b", 2)]


def test_blobs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bin").write_bytes(b"\xff\xfe")
    (tmp_path / "in/b.xml").write_bytes("<?xml?>ä".encode())
    got = {r.path[-5:]: (r.format, r.text) for r in objects.blobs(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.bin": ("html", None), "b.xml": ("xml", "<?xml?>ä")}
    assert objects.delete(spark, str(tmp_path / "in")) and not objects.delete(spark, str(tmp_path / "in"))
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, " ")], "d int, p int, t string")
    assert {r.d: (r.text, r.error) for r in objects.joined_pages(pages, "d", "p", "t").collect()} == {1: ("a\n\nb", None), 2: ("", "no text")}


def test_incremental_ingest(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    put = lambda n, rows: pd.DataFrame(rows, columns=["doc_id", "source", "text"]).to_parquet(docs / f"{n}.parquet")
    sink = flows.Ingest(str(tmp_path / "out"), lambda c: embed.embed(c, embed.FeatureHash(8), 8))
    run = lambda: flows.run_now(spark.readStream.schema("doc_id long, source string, text string").parquet(str(docs)), sink, str(tmp_path / "state"))
    put(1, [(1, "a", "first text"), (2, "a", "second"), (3, "b", " ")])
    run()
    put(2, [(1, "a", "first text"), (2, "a", "second, changed"), (4, "b", "new one")])
    run()
    run()
    versions = sorted((r.doc_id, r.version_number) for r in sink.table(spark, "versions").collect())
    assert versions == [(1, 1), (2, 1), (2, 2), (4, 1)]
    assert {r.doc_id: r.content for r in sink.chunks(spark).collect()} == {1: "first text", 2: "second, changed", 4: "new one"}
    assert sink.table(spark, "rejected").select("doc_id").collect()[0].doc_id == 3
    totals = {(r.batch, r.source): (r.discovered, r.n_new, r.n_updated, r.n_unchanged) for r in sink.table(spark, "runs").collect()}
    assert totals[1, None] == (3, 1, 1, 1)
    sink(spark.read.parquet(str(docs / "2.parquet")), 1)  # the same batch again
    assert sorted((r.doc_id, r.version_number) for r in sink.table(spark, "versions").collect()) == versions


def test_rate_limit_with_state(spark, tmp_path):
    t = pd.Timestamp("2024-01-01")
    rows = pd.DataFrame([("c", t + pd.Timedelta(seconds=10 * i)) for i in range(8)] + [("d", t)], columns=["client", "at"]).astype({"at": "datetime64[us]"})
    (tmp_path / "in").mkdir()
    rows.to_parquet(tmp_path / "in/1.parquet")
    stream = spark.readStream.schema("client string, at timestamp_ntz").parquet(str(tmp_path / "in"))
    out = flows.rate_limit(stream, "client", "at", 60, 5)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).where("client = 'c'").orderBy("at").collect()
    assert [r.recent for r in got] == [1, 2, 3, 4, 5, 6, 7, 7] and [r.rejected for r in got] == [False] * 5 + [True] * 3


@pytest.fixture
def server():
    """A listing of 7 items in pages, a page that needs a token, one that answers late, one that fails."""
    import threading
    import time
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, urlsplit

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            at, asked = urlsplit(self.path), parse_qs(urlsplit(self.path).query)
            status, body = 200, b""
            if at.path == "/list":
                offset, limit = int(asked["offset"][0]), int(asked["limit"][0])
                body = json.dumps({"a": {"items": list(range(7))[offset : offset + limit]}}).encode()
            elif at.path == "/act":
                status = 200 if self.headers.get("Authorization") == "Bearer key" else 401
                body = asked.get("id", [""])[0].encode()
            elif at.path == "/slow":
                time.sleep(2)
            else:
                status = 500
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_http_pages_until_one_is_short_and_requests_by_id(spark, server):
    crawl.register(spark)
    reader = spark.read.format("listing").option("fetcher", "http").option("rate", "1000").option("pageSize", "3").option("items", "a.items")
    got = reader.option("urls", f"{server}/list?offset={{offset}}&limit={{limit}}").load().collect()
    assert sorted((r.place, r.item) for r in got) == [(i, str(i)) for i in range(7)]
    broken = reader.option("urls", f"{server}/none?{{offset}}").load().collect()
    assert [r.item for r in broken] == [None] and broken[0].error.startswith("HTTPError")
    assert list(listings.until_short(lambda a, n: list(range(6))[a : a + n], 3)) == list(range(6))
    ids = spark.createDataFrame([("A 1",), ("B/2",)], "code string")
    rows = crawl.fetched(listings.requests(ids, f"{server}/act?id={{id}}", id="code"), rate=1000.0, fetcher="http", token="key").collect()
    assert sorted((r.code, bytes(r.content), r.error) for r in rows) == [("A 1", b"A 1", None), ("B/2", b"B/2", None)]
    rows = crawl.fetched(listings.requests(ids, f"{server}/act?id={{code}}"), rate=1000.0, fetcher="http").collect()
    assert all(r.content is None and "401" in r.error for r in rows)


def test_http_gives_up_in_time(server):
    import time

    began = time.monotonic()
    with pytest.raises(OSError):
        crawl.from_http(f"{server}/slow", timeout=0.2)
    assert time.monotonic() - began < 1.5
    with pytest.raises(OSError):
        crawl.from_http("file:///etc/hostname")


def test_partitions_of_a_host_share_its_rate():
    pages = crawl.PortalReader({"urls": "\n".join([f"http://a/{i}" for i in range(1000)] + ["http://b/1"]), "rate": "2"}).partitions()
    rates = {h: sum(p.rate for p in pages if p.host == h) for h in ("a", "b")}
    assert rates == pytest.approx({"a": 2, "b": 2}) and sum(len(p.urls) for p in pages) == 1001


def test_robots_with_carriage_returns(spark):
    rows = [("h", "User-agent: *\r\nDisallow: /a \r\n\tDisallow:\t/b\r\n"), ("i", "User-Agent: *\rDisallow: /c")]
    assert sorted(tuple(r) for r in listings.disallowed(spark.createDataFrame(rows, "host string, robots string")).collect()) == [("h", "/a"), ("h", "/b"), ("i", "/c")]


def test_rate_limit_counts_all_of_a_span_and_forgets_idle_clients(spark, tmp_path):
    t = pd.Timestamp("2024-01-01")
    (tmp_path / "in").mkdir()
    put = lambda n, rows: pd.DataFrame(rows, columns=["client", "at"]).astype({"at": "datetime64[us]"}).to_parquet(tmp_path / f"in/{n}.parquet")
    stream = spark.readStream.schema("client string, at timestamp_ntz").parquet(str(tmp_path / "in"))
    def run():
        out = flows.rate_limit(stream, "client", "at", 60, 2)
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]
    put(1, [("c", t + pd.Timedelta(seconds=i)) for i in range(20)])
    run()
    put(2, [("c", t + pd.Timedelta(seconds=21)), ("c", t + pd.Timedelta(seconds=21))])
    run()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("at", "recent").collect()
    assert [r.recent for r in got] == list(range(1, 23)) and sum(r.rejected for r in got) == 20
    put(3, [("d", t + pd.Timedelta(hours=1))])
    run()
    put(4, [("d", t + pd.Timedelta(hours=2))])
    assert run() == 1


def test_dead_letters_are_tried_again(spark, tmp_path):
    def failing(texts):
        raise RuntimeError("no model")

    sink = flows.Ingest(str(tmp_path / "out"), lambda c: embed.embed(c, failing, 8))
    rows = spark.createDataFrame([(1, "a", "text one"), (1, "a", "text and one"), (None, "a", "no id"), (2, "a", "")], "doc_id long, source string, text string")
    sink(rows, 0)
    assert sink.table(spark, "dead").count() == 1 and {r.error for r in sink.table(spark, "rejected").collect()} == {"no id", "no text"}
    assert sink.table(spark, "versions").first().text == "text and one"
    sink.embed = lambda c: embed.embed(c, embed.FeatureHash(8), 8)
    assert sink.retried(spark).where("embedding is not null").count() == 1


def test_bytes_to_text(spark):
    df = spark.createDataFrame([(1, bytearray("ä".encode())), (2, bytearray(b"\xe4")), (3, bytearray(b"\xef\xbb\xbfx")), (4, None)], "i int, b binary")
    assert {r[0]: r[1] for r in df.select("i", objects.decoded(df.b)).collect()} == {1: "ä", 2: "ä", 3: "x", 4: None}
