import datetime as dt

import pytest
from pyspark.sql import functions as F

from statuta import schema, service
from statuta.functions import chunk, embed, register
from statuta.operators import feeds, state
from statuta.sources import crawl, objects

T = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def answers(spark):
    model = embed.FeatureHash(32)

    def rows(name, values):
        fields = [f.split()[0] for f in schema.TABLES[name].split(", ")]
        return spark.createDataFrame([tuple(v.get(f) for f in fields) for v in values], schema.TABLES[name])

    texts = {"d1": "rent and lease law", "d2": "tax code of the state", "d3": "rent control"}
    docs = [{"id": k, "source_id": "s1" if k != "d3" else "s2", "title": f"Act {k}", "url": f"u/{k}", "doc_type": "law", "jurisdiction": "DE" if k != "d2" else "EU", "language": "de", "content_md": t} for k, t in texts.items()]
    chunks = [{"id": f"c{k}", "document_id": k, "chunk_index": 0, "content": t, "embedding": model([t])[0]} for k, t in texts.items()]
    versions = [{"id": f"v{i}{k}", "document_id": k, "version_number": i, "content_hash": str(i), "changed_at": T + dt.timedelta(days=i)} for k in texts for i in (1, 2)]
    corpus = service.Corpus(rows("sources", [{"id": "s1", "name": "Portal", "jurisdiction": "DE"}, {"id": "s2", "name": "Other", "jurisdiction": "EU"}]), rows("documents", docs), rows("chunks", chunks), rows("document_versions", versions))
    return service.Answers(corpus, model)


def test_search_and_filters(answers):
    assert [r.document_id for r in answers.search("rent", 2).collect()][:1] == ["d3"]
    assert {r.jurisdiction for r in answers.search("rent", jurisdiction="DE").collect()} == {"DE"}
    assert answers.search("rent", jurisdiction=["EU", "DE"], language=None).count() == 3
    assert answers.totals("rent", source_name="Portal").first().total_matching == 2
    with pytest.raises(ValueError, match="empty"):
        answers.search(" ")


def test_lookups(answers):
    assert answers.document("d1").first().title == "Act d1" and answers.chunks_of("d1").count() == 1
    assert [r.version_number for r in answers.versions_of("d1").collect()] == [2, 1]
    assert [r.name for r in answers.sources().collect()] == ["Other", "Portal"] and "credentials_enc" not in answers.sources().columns
    with pytest.raises(schema.NotFound):
        answers.document("d9")
    assert answers.stats().first().n_chunks == 3


def test_feed_and_texts(answers):
    since = F.lit("2024-01-01").cast("timestamp")
    assert answers.changes(since).count() == 3 and answers.changes(since, "EU").count() == 1
    assert "(v2)" in answers.changes_text(since) and feeds.NO_SUMMARY in answers.changes_text(since)
    text = answers.search_text("rent", 2)
    assert text.startswith('Found 2 result(s) for "rent"') and "1. **Act d3** (DE)" in text


def test_prompt(spark, answers):
    talk = spark.createDataFrame([(i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(14)], "turn int, role string, text string")
    row = answers.prompt("rent law", talk, min_score=0.1).first()
    assert row.context.startswith("[1] Act") and [t.turn for t in row.history] == list(range(4, 14)) and {t.role for t in row.history} == {"user", "model"}
    assert answers.prompt("rent").first().history == []


def test_keys(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    keys, key = service.new_key(schema.empty(spark, "api_keys"), "me", now)
    row = keys.first()
    assert len(key) == 64 and key not in str(row) and row.key_prefix == key[:8]
    assert feeds.active_keys(keys, now).count() == 1 and feeds.active_keys(service.revoke(keys, row.id), now).count() == 0
    assert service.touch(keys, key, now).first().last_used_at is not None
    with pytest.raises(schema.NotFound):
        service.revoke(keys, "nope")


def test_run_log(spark):
    runs = state.started(schema.empty(spark, "crawl_runs"), "r1", "s1", F.lit("2024-01-01").cast("timestamp"))
    totals = spark.createDataFrame([(5, 2, 1, 2)], "discovered int, n_new int, n_updated int, n_unchanged int")
    done = state.finished(runs, "r1", totals, F.lit("2024-01-02").cast("timestamp")).first()
    assert (done.status, done.docs_discovered, done.docs_updated) == ("completed", 5, 1)
    assert state.finished(runs, "r1", totals, F.lit("2024-01-02").cast("timestamp"), "boom").first().status == "failed"
    table, row = state.inserted(spark.createDataFrame([(1, "a")], "id int, name string"), id=2)
    assert table.count() == 2 and tuple(row.first()) == (2, None)


def test_sql_functions(spark):
    register.register(spark)
    assert spark.sql("SELECT html_markdown_text('<h1>a</h1>') AS m, html_clean_text('<p>b</p>') AS t").first().m == "# a"
    assert spark.sql("SELECT * FROM bounded_chunks('one two three four', 2)").count() == 3


def test_blob_round_trip_and_breaker(spark, tmp_path):
    objects.put(spark, f"{tmp_path}/x/y.bin", b"\x00abc")
    assert objects.get(spark, f"{tmp_path}/x/y.bin") == b"\x00abc"
    now, broken = [0.0], crawl.CircuitBreaker(1, 10, lambda: now[0])

    def fail():
        raise OSError("down")

    for _ in range(2):
        with pytest.raises(OSError, match="down"):
            broken.call(fail)
    with pytest.raises(ConnectionError, match="resting"):
        broken.call(fail)
    now[0] = 11
    assert broken.call(lambda: 1) == 1 and broken.failed == 0


def test_whole_first_line_and_bpe_sizes(spark, tmp_path):
    import base64

    law = "Artikel 5 - Freiheit\n" + "x" * 60
    got = spark.createDataFrame([(law,)], "t string").select(chunk.paragraphs(F.col("t"), whole_line=True).alias("p")).first().p
    assert got[0].reference == "Artikel 5 - Freiheit"
    (tmp_path / "r").write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)))
    assert chunk.bpe_sizer(str(tmp_path / "r"), r"\S+|\s+")("abc d") == 5
