"""Written indexes, tables in parts, keyed state and the discovery stream: what queries alone do not show."""

import functools
import http.server
import json
import os
import random
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statuta.functions import markup
from statuta.functions import text as tx
from statuta.operators import ann, feeds, graph, layout, postings, search, state
from statuta.sources import crawl, discover
from statuta.streaming import flows, keyed


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """3000 vectors, a third of them in one place, and some that cannot be scored."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24))
    x = np.concatenate([centres[rng.integers(0, 12, 2000)] + rng.normal(size=(2000, 24)) * 0.5, centres[0] + rng.normal(size=(1000, 24)) * 0.3])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 24), (9002, [1.0]), (9003, [])]
    path = str(tmp_path_factory.mktemp("vectors") / "t.parquet")
    spark.createDataFrame(rows, "id long, embedding array<float>").repartition(6).write.parquet(path)
    return spark.read.parquet(path), x


def test_graphs_find_nine_in_ten_and_cells_are_split(spark, vectors, tmp_path, monkeypatch):
    monkeypatch.setattr(graph, "SHARD", 300)
    chunks, x = vectors
    at = graph.ensured(chunks, "id", str(tmp_path / "graphs"), cells=8)
    shards = spark.read.parquet(f"{at}/graphs").select(F.size("keys").alias("n")).collect()
    assert sum(r.n for r in shards) == 3000 and max(r.n for r in shards) < 600 and len(shards) >= 10
    wanted = chunks.where("id % 50 = 0 and id < 3000")
    found = graph.search(spark, at, wanted, "id", probes=4)
    exact = {(r["query"], r["key"]): r for r in graph.exact(chunks, "id", wanted, "id").collect()}
    rows = found.collect()
    assert all(r["rank"] == 1 and r["score"] == 1.0 for r in rows if r["query"] == r["key"]) and len(rows) == 600
    assert sum((r["query"], r["key"]) in exact for r in rows) >= 0.9 * len(exact)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert {k for q, k in exact if q == 100} == set(np.argsort(-(unit @ unit[100]))[:10].tolist())
    files = sorted(os.listdir(f"{at}/graphs"))
    assert graph.ensured(chunks, "id", str(tmp_path / "graphs"), cells=8) == at and sorted(os.listdir(f"{at}/graphs")) == files
    plan = spark.read.parquet(f"{at}/graphs").where("cell in (1, 2)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


def test_walks_reach_all_of_a_graph():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (80, 8)) for c in rng.normal(size=(6, 8))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = graph.linked(x)
    assert links.shape == (480, 32) and (links >= 0).sum(axis=1).min() >= 1 and (links != np.arange(480)[:, None]).all()
    for q in range(0, 480, 40):
        assert len(set(np.argsort(-(x @ x[q]))[:10]) & set(graph.walk(x, links, x[q]).tolist())) >= 9
    assert graph.linked(x[:1]).tolist() == [[-1] * 32] and graph.walk(x[:1], graph.linked(x[:1]), x[0]).tolist() == [0]


def test_probing_goes_on_until_a_page_is_full(spark, vectors, tmp_path):
    chunks, x = vectors
    ann.write(chunks, "id", str(tmp_path / "cells"), 16)
    cells, centres = spark.read.parquet(str(tmp_path / "cells/chunks")), ann.centres_of(spark, str(tmp_path / "cells"))
    query, rare = x[2500].tolist(), F.expr("id % 97 = 5 and id < 2000")
    plain = ann.probe(cells.where(rare), centres, query, "id", 1)
    full = ann.probe_filtered(cells, centres, query, "id", rare, 1)
    assert plain.count() < 10 <= full.count() and full.where(~rare).count() == 0
    few = F.col("id").isin(3, 77, 1500)
    assert {r.id for r in ann.probe_filtered(cells, centres, query, "id", few, 1).collect()} == {3, 77, 1500}
    assert ann.probe_filtered(cells, centres, query, "id", F.lit(False)).count() == 0
    assert ann.centres_of(spark, str(tmp_path / "nothing")) is None


def test_lists_give_what_a_scan_gives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "PART", 20)
    rng = random.Random(2)
    words = ["blue", "anvil", "green", "house", "law", "of", "the", "sea"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 4)))) for i in range(400)] + [(500, None), (501, ""), (502, "x")]
    table = spark.createDataFrame(rows, "id long, title string")
    postings.write(table, "id", tx.trigrams(F.col("title")), str(tmp_path / "grams"))
    index = postings.opened(spark, str(tmp_path / "grams"))
    assert index.groupBy("gram").count().agg(F.max("count")).first()[0] > 3  # lists of frequent grams are cut
    for query in ("blue anvil", "law of the sea", "zzz", "x"):
        for least in (0.2, 0.3, 0.8, 1.0):
            want = {(r.id, r.likeness) for r in feeds.similar_titles(table, "title", query, least).collect()}
            assert {(r.id, r.likeness) for r in postings.similar_titles(table, "id", "title", index, query, least).select("id", "likeness").collect()} == want
    plan = postings.lists_of(index, ["  b", "sea"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [folder" in plan and "In(gram" in plan
    postings.write(table, "id", F.array_distinct(F.split("title", " ")), str(tmp_path / "words"))
    keys = postings.having_any(postings.opened(spark, str(tmp_path / "words")), ["sea", "x", "none"])
    assert {r.key for r in keys.collect()} == {i for i, t in rows if t and {"sea", "x"} & set(t.split(" "))}
    assert postings.opened(spark, str(tmp_path / "no")) is None


def test_parts_that_are_not_touched_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    layout.write(spark.range(200).select("id", (F.col("id") % 7).alias("x")), "id", path, 16)
    files = lambda: {p: sorted(f for f in os.listdir(f"{path}/{p}") if f.startswith("part-")) for p in os.listdir(path) if p.startswith("part=")}
    before, keys = files(), spark.createDataFrame([(3,), (4,), (900,)], "id long")
    touched = layout.replace(spark, path, "id", keys.where("id < 5"), spark.createDataFrame([(4, 99), (4, 98), (900, 1)], "id long, x long"), 16)
    after = files()
    assert {p for p in after if after[p] != before.get(p)} == {f"part={p}" for p in touched} and 0 < len(touched) <= 3
    got = sorted((r.id, r.x) for r in layout.read(spark, path).collect())
    assert got == sorted([(i, i % 7) for i in range(200) if i not in (3, 4)] + [(4, 99), (4, 98), (900, 1)])
    assert [tuple(r) for r in layout.lookup(spark, path, "id", [900, 3], 16).collect()] == [(900, 1)]
    layout.remove(spark, path, "id", layout.read(spark, path).select("id"), 16)
    assert not files()
    assert [d for d in os.listdir(tmp_path) if ".next-" in d] == []


def test_sketches_of_batches_merge(spark):
    rng = random.Random(1)
    rows = [(g, b, rng.gauss(50, 20), b % 2 == 0) for g in ("a", "b") for b in range(20) for _ in range(300)] + [("c", 0, None, True)]
    samples = spark.createDataFrame(rows, "g string, b int, v double, bad boolean")
    per_batch = feeds.latency_sketches(samples, "g", "v", F.col("bad"), "b")
    assert per_batch.count() == 41
    for r in feeds.merged_latencies(per_batch, "g").collect():
        own = sorted(v for g, _, v, _ in rows if g == r.g and v is not None)
        if own:
            assert r.n == 6000 and r.error_rate == 0.5
            assert all(abs(np.searchsorted(own, p) / len(own) - q) < 0.01 for p, q in ((r.p50, 0.5), (r.p95, 0.95)))
        else:
            assert (r.n, r.p50, r.p95, r.error_rate) == (1, None, None, 1.0)


def test_counts_come_with_the_write(spark, tmp_path):
    rows = spark.createDataFrame([(1, "new"), (2, "new"), (3, "updated")], "id int, status string")
    assert state.written_run(rows, str(tmp_path / "run")) == {"discovered": 3, "n_new": 2, "n_updated": 1, "n_unchanged": 0}
    assert spark.read.parquet(str(tmp_path / "run")).count() == 3
    assert state.written_run(rows.limit(0), str(tmp_path / "none"))["discovered"] == 0


class Fed:
    """A stream of files that are added one by one; each step is a start from the checkpoint."""

    def __init__(self, spark, folder, schema, make):
        self.spark, self.at, self.schema, self.make, self.n = spark, folder, schema, make, 0
        (folder / "in").mkdir()

    def step(self, rows=()):
        if rows:
            self.n += 1
            names = [c.split()[0] for c in self.schema.split(", ")]
            frame = pd.DataFrame(rows, columns=names)
            for c in names:
                if str(frame[c].dtype).startswith("datetime"):
                    frame[c] = frame[c].astype("datetime64[us]")
            frame.to_parquet(self.at / f"in/{self.n}.parquet")
        out = self.make(self.spark.readStream.schema(self.schema).parquet(str(self.at / "in")))
        query = out.writeStream.format("parquet").option("path", str(self.at / "out")).option("checkpointLocation", str(self.at / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
        self.states = query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress else None
        return [tuple(r) for r in self.spark.read.parquet(str(self.at / "out")).collect()]


T = pd.Timestamp("2024-01-01")
seconds = lambda n: T + pd.Timedelta(seconds=n)


def test_buckets_refill_over_restarts_and_are_forgotten_when_full(spark, tmp_path):
    fed = Fed(spark, tmp_path, "id long, client string, at timestamp_ntz", lambda s: keyed.token_bucket(s, "client", "at", "id", rate=1, burst=2))
    got = fed.step([(1, "a", seconds(0)), (2, "a", seconds(0)), (3, "a", seconds(0)), (4, "a", seconds(1)), (5, "b", seconds(1)), (6, "a", seconds(1.5))])
    assert sorted(got) == [(1, True, 1_000_000), (2, True, 0), (3, False, 0), (4, True, 0), (5, True, 1_000_000), (6, False, 500_000)]
    got = fed.step([(7, "a", seconds(2)), (8, "a", seconds(2))])  # from the state that the first run left
    assert sorted(got)[6:] == [(7, True, 0), (8, False, 0)]
    fed.step([(9, "b", seconds(1000))])
    fed.step([(10, "b", seconds(2000))])
    assert sorted(fed.step([(11, "a", seconds(3000))]))[-1] == (11, True, 1_000_000)


def test_versions_go_on_after_a_restart(spark, tmp_path):
    fed = Fed(spark, tmp_path, "row long, doc string, digest string, at timestamp_ntz", lambda s: keyed.current(s, "doc", "at", "row", "digest"))
    fed.step([(1, "x", "p", seconds(0)), (2, "x", "p", seconds(1)), (3, "y", "p", seconds(0))])
    fed.step([(4, "x", "q", seconds(2)), (5, "y", "p", seconds(2)), (6, "z", None, seconds(0))])
    got = fed.step([(7, "x", "p", seconds(3)), (8, "z", None, seconds(1))])
    assert sorted(r[1:] for r in got) == [(1, "new", 1), (2, "unchanged", 1), (3, "new", 1), (4, "updated", 2), (5, "unchanged", 1), (6, "new", 1), (7, "updated", 3), (8, "updated", 2)]


def test_late_rows_come_out_beside_windows(spark, tmp_path):
    fed = Fed(spark, tmp_path, "id long, key string, at timestamp_ntz", lambda s: keyed.windows_and_late(s, "key", "at", 10, "5 seconds"))
    fed.step([(1, "a", seconds(1)), (2, "a", seconds(2)), (3, "b", seconds(3)), (4, "a", seconds(12))])
    fed.step([(5, "b", seconds(40))])
    got = fed.step([(6, "a", seconds(4)), (7, "b", seconds(5)), (8, "b", seconds(41))])
    start = lambda n: int(seconds(n).value // 1000)
    windows, late = [g for g in got if g[1] == "window"], [g for g in got if g[1] == "late"]
    assert sorted(windows) == [("a", "window", start(0), 2), ("a", "window", start(10), 1), ("b", "window", start(0), 1)]
    assert sorted(late) == [("a", "late", start(0), 1), ("b", "late", start(0), 1)]
    assert sum(n for *_, n in got) + 2 == 8  # two rows are in a window that is open


def test_a_batch_reads_the_parts_of_its_documents(spark, tmp_path):
    sink = flows.Ingest(str(tmp_path / "out"))
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id long, source string, text string")
    sink(rows(*[(i, "s", f"text {i}") for i in range(300)]), 0)
    files = lambda: {p: os.listdir(tmp_path / "out/current" / p) for p in os.listdir(tmp_path / "out/current") if p.startswith("part=")}
    before = files()
    second = rows((5, "s", "other"), (6, "s", "text 6"), (900, "s", "new"))
    sink(second, 1)
    assert len([p for p in files() if files()[p] != before.get(p)]) <= 2
    now = {r.doc_id: r.version_number for r in sink.current(spark).collect()}
    assert (now[5], now[6], now[900], len(now)) == (2, 1, 1, 301)
    versions = sorted(tuple(r) for r in sink.table(spark, "versions").where("batch = 1").select("doc_id", "version_number").collect())
    sink(second, 1)  # a batch that is repeated sees what it saw
    assert sorted(tuple(r) for r in sink.table(spark, "versions").where("batch = 1").select("doc_id", "version_number").collect()) == versions == [(5, 2), (900, 1)]
    assert {r.doc_id: r.version_number for r in sink.current(spark).collect()} == now
    sink(rows((5, "s", "third")), 2)
    assert sink.current(spark, of=rows((5, "", ""))).where("doc_id = 5").first().version_number == 3


class Server(http.server.BaseHTTPRequestHandler):
    asked: list[str] = []

    def do_GET(self):  # noqa: N802
        Server.asked.append(self.path)
        if self.path == "/short":
            self.send_response(200)
            self.send_header("Content-Length", "100")
            self.end_headers()
            self.wfile.write(b"less")
        elif self.path == "/gone":
            self.send_error(404)
        elif self.path == "/slow" and Server.asked.count("/slow") == 1:
            self.send_response(429)
            self.send_header("Retry-After", "7")
            self.send_header("Content-Length", "0")
            self.end_headers()
        else:
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"<p>ok")

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def host():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_bad_addresses_and_answers_are_errors_of_their_rows(spark, host):
    crawl.register(spark)
    urls = [f"{host}/good", f"{host}/short", f"{host}/a b", "http://[bad/x", f"{host}/gone", "nonsense"]
    got = {r.url: r for r in spark.read.format("portal").option("fetcher", "http").option("rate", "1000").option("urls", "\n".join(urls)).load().collect()}
    assert got[urls[0]].content == b"<p>ok" and all(got[u].error and got[u].content is None for u in urls[1:])
    assert "IncompleteRead" in got[urls[1]].error and "InvalidURL" in got[urls[2]].error and "ValueError" in got[urls[3]].error and "404" in got[urls[4]].error
    same = crawl.fetched(spark.createDataFrame([(u,) for u in urls], "url string"), rate=1000, fetcher="http").collect()
    assert {r.url: bool(r.error) for r in same} == {u: u != urls[0] for u in urls}


def test_tries_take_tokens_and_mind_the_answer(host):
    taken, waits = [], []
    fetch = functools.partial(crawl.retried, crawl.from_http, sleep=waits.append, take=lambda: taken.append(1))
    with pytest.raises(OSError, match="404"):
        fetch(f"{host}/gone")
    assert len(taken) == 1 and not waits
    Server.asked.clear()
    assert fetch(f"{host}/slow") == b"<p>ok" and waits == [7.0] and len(taken) == 3
    with pytest.raises(OSError, match="IncompleteRead"):
        fetch(f"{host}/short")
    assert len(taken) == 6


def test_discovery_goes_on_where_it_was_stopped(spark, tmp_path):
    crawl.register(spark)
    for day, pages in (("2024-01-01", [3, 3, 1]), ("2024-01-02", [0]), ("2024-01-03", [2])):
        for p, n in enumerate(pages):
            names = []
            for k in range(n):
                name = f"{tmp_path}/doc-{day}-{p}-{k}.html"
                (tmp_path / name).write_text(f"<p>{day} {p} {k}")
                names.append(name)
            (tmp_path / f"list-{day}-{p}.json").write_text(json.dumps({"items": [*names, f"{tmp_path}/absent"] if (day, p) == ("2024-01-03", 0) else {"items": names}["items"]}))

    def run(until):
        stream = spark.readStream.format("discover").option("listings", f"{tmp_path}/list-{{day}}-{{page}}.json").option("from", "2024-01-01").option("until", until)
        stream = stream.option("pageSize", "3").option("items", "items").option("rate", "1").option("progress", str(tmp_path / "progress")).load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).start()
        query.processAllAvailable()
        query.stop()
        return spark.read.parquet(str(tmp_path / "out")).collect()

    first = run("2024-01-01")
    for _ in range(6):
        if len(first := run("2024-01-01")) >= 7:
            break
    assert len(first) == 7 and len({r.url for r in first}) == 7
    for _ in range(8):
        rows = run("2024-01-03")
        if len(rows) >= 11:
            break
    assert len({r.url for r in rows}) == len(rows) == 11  # a full page is followed by one that is not there
    assert {(r.day, r.page, r.place) for r in rows if r.day == "2024-01-01"} == {("2024-01-01", p, k) for p, n in enumerate([3, 3, 1]) for k in range(n)}
    assert [(r.page, r.error.split(":")[0]) for r in sorted(rows, key=lambda r: r.page) if r.content is None] == [(0, "FileNotFoundError"), (1, "FileNotFoundError")]
    assert len(run("2024-01-03")) == 11


def test_admission_follows_the_rate(tmp_path):
    for p in range(30):
        (tmp_path / f"l-2024-01-01-{p}.json").write_text(json.dumps(["a"] if p < 29 else []))
    now = [100.0]
    options = {"listings": f"{tmp_path}/l-{{day}}-{{page}}.json", "from": "2024-01-01", "until": "2024-01-01", "pageSize": "1", "rate": "4"}
    reader = discover.DiscoverReader(options, clock=lambda: now[0])
    pages = lambda: next(iter(reader.latestOffset().values()))["page"]
    assert pages() == 4
    now[0] += 2.5
    assert pages() == 14
    now[0] += 100
    assert reader.latestOffset()[options["listings"]] == {"day": "2024-01-01", "page": 30, "done": True}
    assert pages() == 30  # nothing is left
    start, end = reader.initialOffset(), reader.latestOffset()
    assert [p.page for p in reader.partitions(start, end)] == list(range(30)) and reader.partitions(end, end) == []


def test_sections_by_class(spark):
    page = """<h1>Gesetz</h1><div class="law-content"><script>x</script><div class="section"><span class="number">§ 1</span><h3 class="title">Zweck</h3><div>Der Text</div></div>
<section class="article">Ohne Kopf</section><footer>Fuss</footer></div><div class="section">outside</div>"""
    got = spark.createDataFrame([(page,), ("",), (None,)], "h string").select(markup.html_sections("h").alias("s")).collect()
    assert [tuple(s) for s in got[0].s.sections] == [("§ 1", "Zweck", "§ 1\nZweck\nDer Text"), ("", "", "Ohne Kopf")]
    assert got[0].s.title == "Gesetz" and got[0].s.full_text == "§ 1\nZweck\nDer Text\nOhne Kopf" and got[1].s.sections == [] == got[2].s.sections
