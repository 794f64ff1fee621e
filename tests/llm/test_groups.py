"""Similarity join, window removal and components against brute force."""

import hashlib
import random

import numpy as np
import pytest

from statuta.llm import components, ngram_join, substring_dedup


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def groups(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if a and k and 100 * k >= 90 * (len(a) + len(sets[j]) - k):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def joined(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar(df, n=3, num=90).collect()}


@pytest.mark.parametrize("few", [1, 16])
def test_join_links_what_brute_force_links(frame, edges, corpus, monkeypatch, few):
    monkeypatch.setattr(ngram_join, "FEW", few)
    rows = [(i + 5000, x) for i, x in edges] + corpus
    assert joined(frame(rows)) == groups(rows)


def test_join_exhausts_pairs_that_no_centre_linked(frame, monkeypatch):
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    monkeypatch.setattr(ngram_join, "FEW", 2)
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    rng = random.Random(5)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    rows = []
    for k in range(40):  # a chain: neighbours link, ends do not
        base[rng.randrange(150)] = f"y{k}"
        rows.append((k * 7 % 41, " ".join(base)))
    assert joined(frame(rows)) == groups(rows)


def test_join_edges(frame):
    assert joined(frame([])) == {} and joined(frame([(4, None)])) == {4: (0, 4)}
    got = ngram_join.similar(frame([(2, "a b c d"), (2, "a b c d"), (1, "a b c d"), (None, "a b c d")]), n=3, num=90).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got if r.doc_id) == [(1, 1), (2, 1), (2, 1)]
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_rows_that_link_share_one_of_their_first(frame):
    rng = np.random.default_rng(6)
    linked = 0
    for _ in range(400):
        grams = np.unique(rng.integers(0, 2**62, rng.integers(1, 60)).astype(np.uint64))
        frequent = np.sort(rng.choice(grams, rng.integers(0, len(grams))))
        other = np.unique(np.concatenate((rng.choice(grams, rng.integers(1, len(grams) + 1), False), rng.integers(0, 2**62, rng.integers(0, 6)).astype(np.uint64))))
        k = len(np.intersect1d(grams, other))
        if 10 * k >= 8 * (len(grams) + len(other) - k):
            linked += 1
            assert len(np.intersect1d(*(ngram_join.prefix(x, frequent, 8, 10) for x in (grams, other))))
    assert linked > 40


def test_bitmaps_lose_no_link():
    rng = np.random.default_rng(9)
    base = np.unique(rng.integers(0, 2**63, 700).astype(np.uint64) * np.uint64(2))
    rows = [np.sort(np.concatenate((rng.permutation(base)[: rng.integers(400, len(base))], rng.integers(0, 2**63, rng.integers(0, 100)).astype(np.uint64)))) for _ in range(80)]
    rows += [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in rng.integers(1, 900, 80)] + [base[:1], base[:2]]
    n, bits = np.array(list(map(len, rows))), [ngram_join.bitmap(r) for r in rows]
    may = set(zip(*(x.tolist() for x in ngram_join.possible(n, bits, n, bits, 80, 100)), strict=True))
    link = {(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if (k := len(np.intersect1d(a, b))) * 100 >= 80 * (len(a) + len(b) - k)}
    assert link <= may and len(link) > 200 and len(may) < 2 * len(link)


def test_a_passage_that_many_share(frame, monkeypatch):
    monkeypatch.setattr(ngram_join, "SOME", 1)
    rng = random.Random(8)
    words = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    passage = words(60)
    rows = [(k, " ".join(words(rng.choice((5, 9, 60))) + passage + words(rng.choice((1, 5, 40))))) for k in range(120)]
    assert joined(frame(rows)) == groups(rows)


def test_product_counts_right_in_blocks(monkeypatch):
    monkeypatch.setattr(ngram_join, "COLUMNS", 64)
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**60, 800).astype(np.uint64))
    rows = [np.sort(np.concatenate((rng.permutation(base)[: rng.integers(300, len(base))], np.unique(rng.integers(0, 2**60, rng.integers(0, 120)).astype(np.uint64))))) for _ in range(300)]
    rows += [base, base[:1], np.empty(0, np.uint64)]
    k = [len(np.intersect1d(base, r)) for r in rows]
    want = [100 * n >= 80 * (len(base) + len(r) - n) for n, r in zip(k, rows, strict=True)]
    assert ngram_join.product(base, rows, 80, 100).tolist() == want and 20 < sum(want) < 280


def test_hot_signatures_are_dealt_into_parts(frame, monkeypatch):
    monkeypatch.setattr(ngram_join, "SOME", 1)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(150):
        near = list(base)
        near[rng.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(near)))
    rows += [(200 + k, " ".join(f"z{k}x{i}" for i in range(30))) for k in range(20)]
    assert joined(frame(rows)) == groups(rows)
    monkeypatch.setattr(ngram_join, "SALTS", 7)
    assert joined(frame(rows + [(500, None)])) == groups(rows + [(500, None)])


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(50, 40), (40, 50), (60, 60), (5, 20)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {40: 40, 50: 40}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed(rows):
    first, words = {}, {}
    for d, t in rows:
        w = words[d] = (t or "").encode().split()
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, w in words.items():
        gone = {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()
    return out


def test_windows_go_as_brute_force_says(frame, edges, corpus):
    rows = [(i + 5000, x) for i, x in edges] + corpus
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.report(frame(rows)).collect()}
    assert got == removed(rows) and sum(n > 0 for _, n, _ in got.values()) > 20


def test_dedup_keeps_other_columns_and_clean_texts(frame, corpus):
    df = frame(corpus)
    got = {r.doc_id: r for r in substring_dedup.dedup(df).collect()}
    want = removed(corpus)
    assert substring_dedup.dedup(df).columns == df.columns
    for d, t in corpus:
        n, gone, digest = want[d]
        if gone == n:
            assert d not in got
        else:
            assert got[d].node == "n" and got[d]._starts == 2
            assert got[d].text == t if not gone else hashlib.sha256(got[d].text.encode()).hexdigest() == digest


def test_dedup_repeated_rows_and_rows_without_id(frame):
    text = " ".join(f"w{i}" for i in range(60))
    got = substring_dedup.report(frame([(3, text), (3, text), (9, text), (None, text)])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 0), (3, 0), (3, 0), (9, 60)]
    assert substring_dedup.report(frame([])).count() == 0


@pytest.mark.parametrize("n", [49, 50, 51, 120])
def test_equal_windows_have_equal_anchors(n):
    rng = np.random.default_rng(n)
    draw = lambda k: rng.integers(0, 2**16, k).astype(np.uint16)
    shared = draw(50)
    for _ in range(20):
        a, b = (np.concatenate([draw(rng.integers(0, n)), shared, draw(rng.integers(0, n))]) for _ in range(2))
        assert {tuple(x) for x in substring_dedup.anchors(a, 50)} & {tuple(x) for x in substring_dedup.anchors(b, 50)}


def test_automata_locate_what_goes(frame, corpus, monkeypatch):
    """Without what the automata find nothing but whole copies goes."""
    rows = dict(corpus)
    some = {d for d, (n, gone, _) in removed(corpus).items() if 0 < gone < n}
    assert len(some) > 5
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", 500)  # several blocks
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.report(frame(corpus)).collect()}
    assert got == removed(corpus)
    monkeypatch.setattr(substring_dedup, "windows_around", lambda *_: np.empty(0, np.int64))
    assert not {r.doc_id for r in substring_dedup.report(frame(corpus)).collect() if r.n_removed} & some and rows


def thue_morse(a, b, n=1024):
    """Words that polynomial hashes modulo a power of two take for one."""
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_different_words_are_different(frame):
    for x, y in (thue_morse("a", "b"), thue_morse("q", "z", 4096)):
        assert joined(frame([(1, x), (2, y)])) == {1: (1, 1), 2: (1, 2)}
        tail = [f"w{i}" for i in range(59)]
        rows = [(1, " ".join([x, *tail])), (2, " ".join([y, *tail]))]
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.report(frame(rows)).collect()}
        assert got == removed(rows) and got[2][1] == 59


def test_very_long_texts(frame):
    """A million words, and one word of 20 MB, beside a copy with another beginning."""
    rng = random.Random(1)
    words = [f"{rng.randrange(10**6)}" for _ in range(1_000_000)]
    rows = [(1, " ".join(words)), (2, " ".join(["other", *words[1:]])), (3, "x" * 20_000_000), (4, "x" * 20_000_000)]
    assert joined(frame(rows)) == {1: (999_998, 1), 2: (999_998, 1), 3: (1, 3), 4: (1, 3)}
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.report(frame(rows)).collect()}
    assert got == {1: (1_000_000, 0), 2: (1_000_000, 999_999), 3: (1, 0), 4: (1, 0)}


def test_blocks_give_spanning_links_only(spark, frame, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 10)
    words = [f"v{i}" for i in range(400)]
    docs = frame([(i, " ".join([*words, f"own{i}"])) for i in range(10)])
    rows = [(i, len(s), ngram_join.bitmap(s), s.tobytes()) for i, s in ((i, ngram_join.shingle_sets([t.encode()], 3)[0]) for i, t in docs.select("doc_id", "text").collect())]
    nodes = spark.createDataFrame(rows, "node long, n long, bits binary, grams binary")
    labelled = nodes.selectExpr("7L as sig", "node", "node as component")
    found = ngram_join.products(labelled, nodes.select("node", "n", "bits"), lambda some: some.join(nodes.select("node", "grams"), "node"), 90, 100, "long").collect()
    assert len(found) == 9  # of 45 pairs that link
    parts = {i: i for i in range(10)}
    for a, b in found:
        old, new = parts[a], parts[b]
        parts = {k: new if v == old else v for k, v in parts.items()}
    assert len(set(parts.values())) == 1
