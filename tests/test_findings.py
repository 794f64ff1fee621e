"""Rows that the smallest tables do not have: queries against their SQL, and steps against plain forms of them."""

import duckdb
import pytest

from statuta.plans import catalog


@pytest.fixture
def cut_pages(spark, tmp_path):
    """Pages whose title was cut inside a reference."""
    page = "<!DOCTYPE html><html><head><title>{0}</title></head><body><nav>x</nav><article><h1>{0}</h1><p>{1}</p><p>a &amp; b</p></article></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(f"One&amp;two {cut}", f"{cut} and more")) for i, cut in enumerate(["&amp", "&am", "&lt", "&gt", "&quot", "&#x27", "&", "&amp;"])]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def same_as_sql(spark, name: str, sf_dir: str, table: str) -> int:
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    names = ", ".join(f'"{c}"' for c in columns)
    assert got == sorted(con.sql(f"SELECT {names} FROM ({catalog.ORACLE_SQL[name]})").fetchall(), key=repr)
    return len(got)


def test_references_that_were_cut_off_as_markdown_and_text(spark, cut_pages):
    assert same_as_sql(spark, "q39_markdown", cut_pages, "pages") == 8


def test_references_that_were_cut_off_in_whole_pages(spark, cut_pages):
    assert same_as_sql(spark, "q61", cut_pages, "pages") == 8


def test_pages_of_any_depth(spark, tmp_path):
    """Bold text that is never closed, more often than calls may be nested; the last one is bold, as no paragraph follows."""
    paragraphs = "<p><b>One two.<br><p>Three.</p>" * 1500
    rows = [(i, "http://h.example/", f"<html><body><article>{'<p>x</p><b>' * i}{paragraphs}<p><b>End<br></article></body></html>") for i in range(2)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    found = catalog.QUERIES["q39_markdown"](spark, str(tmp_path)).collect()
    assert [r["error"] for r in found] == [None, None] and all(r["markdown"].endswith("\n\nThree.\n\n**End**") for r in found)
    assert all(r["markdown"].count("One two.") == 1500 == r["text"].count("Three.") for r in found)


def test_state_of_windows_is_read_once_a_key(monkeypatch):
    """However many windows a key has: one read and one write in a batch, one timer that is set; rows without a time are in none."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    from statuta.streaming.keyed import _Windows

    calls, held, timers = [], [None], set()
    value = SimpleNamespace(get=lambda: calls.append("get") or held[0], update=lambda v: calls.append("update") or held.__setitem__(0, v), clear=lambda: held.__setitem__(0, None))
    steps = _Windows(10_000)
    steps.init(SimpleNamespace(getValueState=lambda *_: value, registerTimer=lambda t: calls.append("timer") or timers.add(t), deleteTimer=timers.discard))
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    rows = [Row(key="a", micros=m) for m in [*range(50_000, 5_000_000, 1000), None]]
    assert list(steps.handleInputRows(("a",), iter(rows), at(0))) == []
    assert calls == ["get", "update", "timer"] and timers == {60}
    assert list(steps.handleInputRows(("a",), iter([Row(key="a", micros=45_000)]), at(0))) == [] and timers == {50}
    timers.clear()
    out = list(steps.handleExpiredTimer(("a",), at(4999), None))
    assert len(out) == 495 and sum(r.n for r in out) == 4941 and timers == {5000}
    assert [tuple(r) for r in steps.handleInputRows(("a",), iter([Row(key="a", micros=1)]), at(4999))] == [("a", "late", 0, 1)]
    timers.clear()
    assert [tuple(r) for r in steps.handleExpiredTimer(("a",), at(5000), None)] == [("a", "window", 4_990_000, 10)] and held == [None] and not timers


def test_graph_leads_to_every_vector():
    """A hub that most vectors are nearest to has not room for links to all."""
    import numpy as np

    from statuta.operators import graph

    rng = np.random.default_rng(3)
    hub = rng.standard_normal(16)
    x = np.concatenate([hub[None], hub + 0.3 * rng.standard_normal((600, 16)), np.repeat(hub[None] + 0.01, 50, axis=0)]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links, seen = graph.linked(x), np.zeros(len(x), bool)
    graph.reach(links, graph.starts_of(len(x)), seen)
    assert seen.all()
    assert all(q in graph.walk(x, links, x[q]) for q in range(601))
    assert len(links) == 651 and graph.linked(x[:1]).tolist() == [[-1] * 32]


def test_exact_search_takes_any_number_of_queries_and_copies_come_by_key(spark, tmp_path, monkeypatch):
    from statuta.operators import graph

    monkeypatch.setattr(graph, "QUERIES", 7)
    rows = [(i, [1.0, 2.0, 0.5] if i >= 40 else [float(i % 7), 1.0, float(i)]) for i in range(400)]
    chunks = spark.createDataFrame([*rows, (400, None), (401, [0.0] * 3)], "id long, embedding array<float>")
    wanted = chunks.where("id % 20 = 0")
    graph.write(chunks, "id", str(tmp_path), cells=2)
    by = lambda df: sorted((r["query"], r["rank"], r["key"]) for r in df.collect())
    exact = by(graph.exact(chunks, "id", wanted, "id"))
    assert len(exact) == 20 * 10 and (380, 1, 40) in exact and (380, 10, 49) in exact
    assert by(graph.search(spark, str(tmp_path), wanted, "id", probes=2)) == exact
    assert graph.exact(chunks, "id", wanted.where("id < 0"), "id").count() == 0


def test_texts_go_through_chunks_in_pieces(spark):
    """Texts of one Arrow batch are not all Python's at once."""
    import pyarrow as pa

    from statuta.functions import chunk as ch

    texts = ["a " * 300_000, None, "", "b. " * 100, "c " * 600_000, "d"]
    cut = list(ch.pieces(pa.array(texts)))
    assert [t for part in cut for t in part.to_pylist()] == texts and [len(p) for p in cut] == [4, 1, 1]
    assert [len(p) for p in ch.pieces(pa.array([], pa.string()))] == [0]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)
    got = {r["id"]: [tuple(c) for c in r["c"]] for r in df.select("id", ch.semantic(16)("t").alias("c")).collect()}
    assert got == {i: [(c, ch.quarter(c)) for c in ch.bounded(t or "", 16, ch.quarter)] for i, t in enumerate(texts)}


def test_texts_are_cut_before_they_are_sent_to_a_model(spark):
    """A long text does not reach Python whole, and no more texts than a call takes are Python's at once."""
    from statuta.functions import embed

    df = spark.createDataFrame([(1, "e" * 50_000), (2, None), (3, "me")], "id long, t string")
    found = df.select("id", embed.embed("t", lambda texts: [[float(len(t)), 0.5] for t in texts], 2, batch=2).alias("v"))
    assert [tuple(r) for r in found.orderBy("id").collect()] == [(1, [20_000.0, 0.5]), (2, [0.0, 0.5]), (3, [2.0, 0.5])]
    assert "substring(t" in found._jdf.queryExecution().optimizedPlan().toString()


def test_lists_are_made_of_one_pass_and_shuffled_by_blocks(spark, tmp_path, monkeypatch):
    """Grams are made once for each row, and a gram is sent once for each block that has it, not for each row."""
    import random

    from pyspark.sql import functions as F

    from statuta.operators import postings

    monkeypatch.setattr(postings, "PART", 50)
    monkeypatch.setattr(postings, "BLOCK", 64, raising=False)
    rng, made = random.Random(4), spark.sparkContext.accumulator(0)
    grams = [["all", *rng.sample("abcdefgh", rng.randrange(4))] for _ in range(300)] + [None, [], ["x", None], [f"w{i}" for i in range(200)]]

    @F.udf("array<string>")
    def counted(found):
        made.add(1)
        return found

    table = spark.createDataFrame([(f"k{i}", g) for i, g in enumerate(grams)], "id string, g array<string>").repartition(3)
    postings.write(table, "id", counted("g"), str(tmp_path))
    assert made.value == len(grams)  # they were made again for each use
    lists = postings.opened(spark, str(tmp_path)).collect()
    got = sorted(((r["gram"], k, s) for r in lists for k, s in zip(r["keys"], r["sizes"], strict=True)), key=repr)
    assert got == sorted(((g, f"k{i}", len(gs)) for i, gs in enumerate(grams) for g in gs or []), key=repr)
    assert all(r["n"] == len(r["keys"]) for r in lists) and len({(r["gram"], r["part"]) for r in lists}) == len(lists)
    assert {r["part"] for r in lists if r["gram"] == "all"} == set(range(7))  # 304 rows, 50 a part
    assert {r["key"] for r in postings.having_any(postings.opened(spark, str(tmp_path)), ["a", "w7"]).collect()} == {f"k{i}" for i, gs in enumerate(grams) if {"a", "w7"} & set(gs or [])}


@pytest.mark.parametrize(("rows", "most", "blocks"), [(50, 64, 3), (2, 64, 5), (50, 2, 4)])
def test_blocks_of_lists_are_bounded(monkeypatch, rows, most, blocks):
    """A block ends after so many rows or before more grams than that; a row of more grams is a block."""
    import pyarrow as pa
    from types import SimpleNamespace

    from statuta.operators import postings

    monkeypatch.setattr(postings.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 5))
    grams = [["a"], ["b", "a"], None, [f"w{i}" for i in range(70)], ["a"], ["c"], []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7), pa.int64()), pa.array(grams, pa.list_(pa.string()))], ["key", "grams"])
    got = list(postings.block_lists(4, rows, most)(iter([batch])))
    assert len(got) == blocks and [set(b.column("part").to_pylist()) - {(5 + i) % 4} for i, b in enumerate(got)] == [set()] * blocks
    found = sorted((g, k, s) for b in got for g, ks, ss in zip(*(b.column(c).to_pylist() for c in ("gram", "keys", "sizes"))) for k, s in zip(ks, ss))
    assert found == sorted((g, k, len(gs)) for k, gs in enumerate(grams) for g in gs or [])
