import datetime as dt

import pytest
from pyspark.sql import functions as F

from statuta import schema
from statuta.operators import ann, feeds, search, state


@pytest.fixture(scope="module")
def chunks(spark):
    import random

    rng = random.Random(1)
    rows = [(i, i // 5, i % 5, [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    rows += [(900, 90, 0, [0.0] * 8), (901, 90, 1, None), (902, 91, 0, rows[7][3]), (903, 91, 1, rows[7][3])]
    return spark.createDataFrame(rows, "chunk_id int, parent int, chunk_index int, embedding array<float>").persist()


def test_page_orders_ties_by_id_and_skips_vectors_without_direction(chunks):
    q = search.vector_of(chunks, "chunk_id", 7)
    got = search.search(chunks, q, "chunk_id", limit=50).collect()
    assert [r.chunk_id for r in got[:3]] == [7, 902, 903] and {r.score for r in got[:3]} == {1.0}
    assert not {900, 901} & {r.chunk_id for r in got}
    assert [r.chunk_id for r in search.search(chunks, q, "chunk_id", limit=2, offset=1).collect()] == [902, 903]


def test_threshold_of_zero_is_a_threshold(chunks):
    q = search.vector_of(chunks, "chunk_id", 7)
    assert all(r.score >= 0 for r in search.search(chunks, q, "chunk_id", min_score=0.0, limit=50).collect())
    total = search.totals(chunks, q).first()
    assert total.total_matching == 402 and total.total_close < 402


def test_limits(chunks):
    assert search.clamp(None, 10, 1, 50) == 10 and search.clamp(0, 10, 1, 50) == 1 and search.clamp(99, 10, 1, 50) == 50
    with pytest.raises(ValueError, match="limit"):
        search.require_range("limit", 0, 1, 100)
    with pytest.raises(ValueError, match="empty"):
        search.require_text("  ")
    with pytest.raises(LookupError):
        search.vector_of(chunks, "chunk_id", -5)


def test_federated_half_of_one_is_none(chunks):
    q = search.vector_of(chunks, "chunk_id", 7)
    got = search.federated(chunks.where("parent < 40"), chunks.where("parent >= 40"), q, "chunk_id", limit=1).collect()
    assert [r.kind for r in got] == ["law"]


def test_related(chunks):
    got = search.related(chunks, "parent", 91).collect()
    assert got[0].parent == 1 and got[0].score == 1.0 and 91 not in {r.parent for r in got} and len(got) <= 5


def test_inverted_file_recall_and_layout(spark, chunks, tmp_path):
    centres = ann.fit(chunks, "chunk_id", 8)
    ann.assign(chunks, centres).where("cell is not null").write.partitionBy("cell").parquet(str(tmp_path / "ivf"))
    indexed = spark.read.parquet(str(tmp_path / "ivf"))
    assert indexed.count() == 403
    hits = []
    for i in range(0, 400, 20):
        q = search.vector_of(chunks, "chunk_id", i)
        hits.append(ann.recall(ann.probe(indexed, centres, q, "chunk_id", 6), search.search(chunks, q, "chunk_id"), "chunk_id"))
    assert sum(hits) / len(hits) >= 0.9
    plan = ann.probe(indexed, centres, q, "chunk_id", 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan


def test_upsert_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, content_hash string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (4, "d"), (3, None)], "id int, content_hash string")
    assert {r.id: r.status for r in state.classify(new, old, ["id"]).collect()} == {1: "unchanged", 2: "updated", 3: "unchanged", 4: "new"}
    now = state.upsert(old, new, ["id"])
    assert {r.status for r in state.classify(new, now, ["id"]).collect()} == {"unchanged"}
    assert state.violations(now, ["id"]).count() == 0


def test_children_go_also_without_new_ones(spark):
    kids = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc int, i int")
    got = state.replace_children(kids, spark.createDataFrame([(1,)], "doc int"), "doc", kids.limit(0))
    assert [tuple(r) for r in got.collect()] == [(2, 0)]


def test_versions_count_on(spark):
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "doc int, version_number long, h string")
    got = state.append_versions(log, spark.createDataFrame([(1, "c"), (2, "z")], "doc int, h string"), "doc", ["h"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "z")]
    numbered = state.number_versions(spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b")], "doc int, t int, h string"), "doc", ["t"], "h")
    assert [(r.version_number, r.changed) for r in numbered.orderBy("t").collect()] == [(1, True), (2, False), (3, True)]


def test_patch_insert_soft_delete_and_cascade(spark):
    t = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, name string, updated_at int")
    got = state.patch(t, spark.createDataFrame([(1, None), (2, "x")], "id int, name string"), "id", ["name"], F.lit(9))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", 9), (2, "x", 9)]
    assert state.insert_absent(t, t.unionByName(spark.createDataFrame([(3, "c", 1), (3, "c", 1)], t.schema)), ["name"]).count() == 3
    assert [r.updated_at for r in state.set_where(t, F.col("id") == 1, "updated_at", F.lit(0)).orderBy("id").collect()] == [0, 6]
    docs, kids = spark.createDataFrame([(1, "s"), (2, "t")], "id int, source string"), spark.createDataFrame([(10, 1), (20, 2)], "id int, doc int")
    left = state.survivors(spark.createDataFrame([("s",)], "source string"), [(docs, "id", "source"), (kids, "id", "doc")])
    assert [[r.id for r in x.collect()] for x in left] == [[2], [20]]
    assert state.orphans(kids, "doc", docs.where("id = 1"), "id").count() == 1


def test_feed_rules(spark):
    d = lambda *x: dt.date(2024, *x)
    laws = spark.createDataFrame([(1, d(5, 1), None, None), (2, d(1, 1), d(5, 2), d(4, 1)), (3, d(1, 1), d(5, 3), None), (4, d(1, 1), d(2, 1), None)], "id int, publication date, last_modified date, valid_until date")
    got = feeds.dated_changes(laws, F.lit("2024-04-15").cast("date"), F.lit("2024-06-01").cast("date"), "id").collect()
    assert [(r.id, r.change_type, str(r.change_date)) for r in got] == [(1, "new", "2024-05-01"), (3, "modified", "2024-05-03"), (2, "repealed", "2024-05-02")]


def test_keys(spark):
    t = dt.datetime
    rows = [("a", True, None, None), ("b", False, None, None), ("c", True, t(2020, 1, 1), None), ("d", True, t(2030, 1, 1), ["x.de"])]
    keys = spark.createDataFrame(rows, "key_hash string, enabled boolean, expires_at timestamp, allowed_origins array<string>")
    now = F.lit("2024-01-01").cast("timestamp")
    assert {r.key_hash for r in feeds.active_keys(keys, now).collect()} == {"a", "d"}
    assert {r.key_hash for r in feeds.allowed_origin(feeds.active_keys(keys, now), "y.de").collect()} == {"a"}


def test_injection_strings_are_data(spark):
    rows = [("'; DROP TABLE documents; --",), ("x",)]
    df = spark.createDataFrame(rows, "title string")
    assert df.where(search.all_of(title=rows[0][0])).count() == 1 and df.where(search.all_of(title="' OR '1'='1")).count() == 0


def test_schema(spark):
    for name in schema.TABLES:
        assert schema.empty(spark, name).count() == 0
    assert {r.domain for r in schema.resources(spark).collect()} == set(schema.DOMAINS)
    a, b = spark.createDataFrame([("s", "e"), ("s", "e")], "x string, y string").select(schema.natural_id("x", "y").alias("i")).collect()
    assert a.i == b.i and issubclass(schema.NotFound, schema.StatutaError) and schema.NotFound.status == 404
