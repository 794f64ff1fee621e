import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statuta.functions import chunk, embed, markup, text, vector


def one(spark, make, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("dirty", "clean"),
    [("MÃ¼nchen  ist\xa0schÃ¶n – ja", "München ist schön - ja"), ("a\n\n\n\nb", "a\n\nb"), ("„so“", '"so“'), (" x  \ny ", "x\ny"), (None, ""), ("", "")],
)
def test_normalise(spark, dirty, clean):
    assert one(spark, text.normalise, dirty) == clean


def test_normalise_curly_quotes_on_demand(spark):
    assert one(spark, lambda c: text.normalise(c, curly=True), "„so“ ‘a’") == "\"so\" 'a'"


@pytest.mark.parametrize(("cited", "found"), [("Gemäß § 1 BGB", "§ 1"), ("Art. 5 und § 12a Abs. 3", "§ 12a Abs. 3"), ("siehe abs. 4, ART. 9b", "ART. 9b"), ("nichts", None)])
def test_section_reference_by_form_not_place(spark, cited, found):
    assert one(spark, text.section_reference, cited) == found


@pytest.mark.parametrize(("celex", "kind"), [("32016R0679", "regulation"), ("32022L2555", "directive"), ("32021D0001", "decision"), ("short", "unknown")])
def test_celex_kind(spark, celex, kind):
    assert one(spark, text.celex_kind, celex) == kind


def test_small_text_functions(spark):
    assert one(spark, text.content_hash, "") == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert one(spark, text.abbreviation, "Grundgesetz (GG)") == "GG"
    assert one(spark, lambda c: text.url_id(c, "bayern_"), "https://x.de/Content/Document/Norm/BayPO.1") == "bayern_BayPO_1"
    assert one(spark, text.link_id, "/bgb/xml.zip") == "bgb"
    assert one(spark, text.token_estimate, "äöüß1") == 2
    assert [one(spark, text.sniff, x) for x in ("<?xml v", "<gesetz>", "%PDF-1", "<html>")] == ["xml", "xml", "pdf", "html"]
    assert one(spark, lambda c: text.highlight(c, ["a.b"]), "A.B aXb") == "<mark>A.B</mark> aXb"
    assert one(spark, lambda c: text.contains_any(c, ["100%"]), "1000") is False
    assert one(spark, lambda c: text.shortened(c, 3, "..."), "abcd") == "abc..."
    assert str(one(spark, text.safe_date, "2024-02-30")) == "None" and str(one(spark, text.safe_date, "2024-02-03")) == "2024-02-03"
    assert one(spark, lambda c: text.resolve(F.lit("https://x.de/a/b"), c), "c?d") == "https://x.de/c?d"
    assert one(spark, lambda c: text.titled_markdown(c, F.lit("body")), "T") == "# T\n\nbody"


def test_vectors(spark):
    rows = [([3.0, 4.0],), ([0.0, 0.0],), (None,), ([1.0],), ([-3.0, -4.0],)]
    df = spark.createDataFrame(rows, "v array<float>")
    for engine in ("arrow", "jvm"):
        assert [r.s for r in df.select(F.round(vector.score(F.col("v"), [3, 4], engine), 6).alias("s")).collect()] == [1.0, None, None, None, -1.0]
    assert [r.u for r in df.select(vector.unit(F.col("v")).alias("u")).collect()][:3] == [pytest.approx([0.6, 0.8]), None, None]
    with pytest.raises(Exception, match="expected 2 dimensions"):
        df.select(vector.checked(F.col("v"), 2)).collect()


def sections(body):
    import re

    for form in chunk.SECTION_OPENINGS:
        at = [m.start() for m in re.finditer(form, body)]
        if at:
            at = at[1:] if at[0] == 0 else at
            return [s for a, b in zip(at, [*at[1:], len(body)], strict=True) if (s := body[a:b].strip())]
    return [p.strip() for p in body.split("\n\n") if p.strip()]


@pytest.mark.parametrize("body", ["Vor\n§ 1 eins\n § 2a zwei\n(3) drei", "\n§ 1 eins\n§ 2 zwei\n§ 3 drei", "Vor\nArtikel 1 a\nArtikel 2 b", "x\n\ny\n\n", "a\n(1) b\n\n(2) c", "", "§ 1 nur"])
def test_sections(spark, body):
    assert one(spark, chunk.sections, body) == sections(body)


def test_paragraphs(spark):
    law = "kurz\n\nArtikel 5 - Freiheit\n" + "x" * 60 + "\n\n" + "y" * 6000
    got = one(spark, chunk.paragraphs, law)
    assert [(len(c.content), c.reference, c.tokens) for c in got] == [(81, "Artikel 5", 21), (5000, None, 1500)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2000), st.integers(2, 600), st.integers(0, 100))
def test_windows_cover_all_and_overlap(spark, n, size, overlap):
    overlap = min(overlap, size - 1)
    got = [(w.start, w.end) for w in spark.range(1).select(chunk.windows(F.lit(n), size, overlap).alias("w")).first().w]
    if n == 0:
        assert got == []
        return
    assert got[0][0] == 0 and got[-1][1] == n and all(e - s <= size for s, e in got)
    assert all(b[0] == a[1] - overlap for a, b in zip(got, got[1:], strict=False))


def test_char_windows(spark):
    assert [(w.start, w.content) for w in one(spark, lambda c: chunk.char_windows(c, 4, 1), "abcdefgh")] == [(0, "abcd"), (3, "defg"), (6, "gh")]
    assert one(spark, chunk.char_windows, "   ") == [] and one(spark, chunk.char_windows, "") == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400), st.integers(1, 20))
def test_bounded_chunks(body, most):
    got = chunk.bounded(body, most, chunk.quarter)
    assert all(c.strip() == c and c and chunk.quarter(c) <= most for c in got)
    assert "".join("".join(got).split()) == "".join(body.split())


def test_semantic_chunks(spark):
    df = spark.createDataFrame([(1, "legal " * 3000), (2, "short"), (3, " "), (4, None)], "id int, t string")
    rows = chunk.exploded(df, chunk.semantic()(F.col("t")), "id").collect()
    many = [r for r in rows if r.id == 1]
    assert len(many) > 1 and [r.chunk_index for r in many] == list(range(len(many))) and max(r.tokens for r in many) <= 512
    assert [(r.id, r.content) for r in rows if r.id != 1] == [(2, "short")]


def test_sections_parsed_before(spark):
    df = spark.createDataFrame([("d", [("1", "A", "w " * 600), ("2", "B", " ")])], "doc string, s array<struct<number:string,title:string,text:string>>")
    rows = chunk.sectioned(df, "s", "doc").collect()
    assert [(r.section_number, r.part, r.start, r.end) for r in rows] == [("1", 0, 0, 512), ("1", 1, 462, 600)]


PAGE = """<html><head><title> T\n</title><style>x{}</style></head><body><nav>menu <a href="/n">n</a></nav><main><h1>Law</h1><p>One <b>two</b> &amp; <a href="/x">three</a>.</p>
<ul><li>a<li>b</ul><script>no()</script></main><footer>foot</footer></body></html>"""


def test_html(spark):
    df = spark.createDataFrame([(PAGE,), ("",), (None,), ("<p>",)], "h string")
    md = [r.m for r in df.select(markup.html_markdown("h").alias("m")).collect()]
    assert md[0].text == "# Law\n\nOne **two** & [three](/x).\n\n- a\n\n- b" or "# Law" in md[0].text and "menu" not in md[0].text and "no()" not in md[0].text
    assert [m.error for m in md] == [None, "empty HTML", "empty HTML", "no text content"]
    plain = df.select(markup.html_text("h").alias("t")).first().t.text
    assert "Law" in plain and "menu" not in plain and "foot" not in plain
    assert one(spark, markup.html_title, PAGE) == "T"
    assert df.select(markup.html_links("h", F.lit("https://x.de/a")).alias("l")).first().l == ["https://x.de/n", "https://x.de/x"]


def test_html_content_of_articles():
    assert markup.markdown("<header>h</header><article><p>inside</p></article><footer>f</footer>") == "inside"
    assert markup.markdown('<div>out</div><div id="content">in</div>') == "in"


def test_xml(spark):
    law = "<norm><metadaten><jurabk>BGB</jurabk><titel>Second</titel></metadaten><text><P>Erster Satz.</P><x>mehr</x></text></norm>"
    got = spark.createDataFrame([(law,), ("<a>",), ("",), ("<a/>",)], "x string").select(markup.xml_text("x").alias("d")).collect()
    assert (got[0].d.title, got[0].d.content, got[0].d.error) == ("BGB", "Erster Satz. mehr", None)
    assert got[1].d.error.startswith("ParseError") and got[2].d.error == "empty XML" and got[3].d.error
    assert one(spark, markup.xml_flat, law) == "BGB\n\nSecond\n\nErster Satz.\n\nmehr"


def test_structured_page(spark):
    page = "<h1>Title</h1><p>32016R0679</p><main><h2>Art 1</h2><p>a</p><p>b</p><h3>Art 2</h3><p>c</p></main>"
    got = spark.createDataFrame([(page,)], "h string").select(markup.html_sections("h").alias("s")).first().s
    assert got.title == "Title" and got.celex == "2016R0679" and [(s.title, s.text) for s in got.sections] == [("Art 1", "a\nb"), ("Art 2", "c")]


def test_embedders_keep_order_and_length(spark):
    df = spark.createDataFrame([(i, f"word{i} law") for i in range(600)] + [(600, "")], "id int, t string")
    model = embed.FeatureHash(16)
    rows = df.select("id", embed.embed(F.col("t"), model, 16).alias("v")).collect()
    assert all(r.v == pytest.approx(model([f"word{r.id} law"])[0], abs=1e-6) for r in rows if r.id < 600) and rows[-1].v is None
    assert embed.Zeros(4)(["a"]) == [[0.0] * 4]
    with pytest.raises(Exception, match="expected vectors of 8"):
        df.select(embed.embed(F.col("t"), model, 8)).collect()
