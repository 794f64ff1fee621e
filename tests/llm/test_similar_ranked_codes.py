"""MinHash classes, ranked search and vector codes against brute force; what operators leave behind."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from statuta.llm import common, minhash, ngram_join, ranked, substring_dedup, vector_codes


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def groups(rows, n=2, num=80):
    """Classes by all pairs; rows that share an id are linked."""
    sets, parent = [shingles(t, n) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if a and sets[j] and (rows[i][0] == rows[j][0] or k and 100 * k >= num * (len(a) + len(sets[j]) - k)):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def classes(df, **how):
    rows = minhash.similar(df, **{"n": 2, "num": 80} | how).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows)


def test_classes_are_those_of_all_pairs(frame, edges, corpus):
    rows = [(i + 5000, x) for i, x in edges] + corpus + [(9000, "word " * 400_000), (9001, "z9 " + "word " * 400_000)]
    assert classes(frame(rows)) == groups(rows)
    assert classes(frame(corpus), n=5) == groups(corpus, 5)


def test_many_copies_with_all_similarities_and_hot_bands(frame, monkeypatch):
    monkeypatch.setattr(minhash, "SOME", 1)
    monkeypatch.setattr(minhash, "SALTS", 3)
    monkeypatch.setattr(minhash, "PIECE", 64)
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    rng = random.Random(8)
    base, rows = [f"w{rng.randrange(4000)}" for _ in range(120)], []
    for k in range(150):  # by how many words are new, near copies from 0.98 down to 0.6 like each other
        near = list(base)
        for _ in range(rng.randrange(12)):
            near[rng.randrange(120)] = f"x{rng.randrange(9999)}"
        rows.append((k * 7 % 151, " ".join(near)))
    for k in range(40):  # a chain: neighbours link, ends do not
        base[3 * k] = f"y{k}"
        rows.append((1000 + k * 7 % 41, " ".join(base)))
    rows += [(2000 + k, " ".join(base)) for k in range(60)]
    want = groups(rows)
    assert 1 < len({c for _, _, c in want}) < 100
    assert classes(frame(rows)) == want


def test_classes_of_shared_ids_nulls_and_empty_tables(frame, corpus):
    assert classes(frame([])) == [] and classes(frame([(4, None)])) == [(4, 0, 4)]
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (5, b), (3, a), (7, b + " end"), (9, c), (8, c)]
    assert classes(frame(rows)) == groups(rows)
    got = minhash.similar(frame([(2, a), (None, a), (None, a), (1, a)]), n=2, num=80).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 0, True), (1, 1, True), (2, 1, False)]


def test_minima_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(4)
    a, b = minhash.functions(64 * minhash.rows_of_band(0.8))
    assert len(a) == 320 and (1 - 0.8**5) ** 64 <= minhash.MISS
    for share in (0.2, 0.5, 0.8):
        agree = []
        for _ in range(30):
            both, own = rng.integers(0, 2**63, int(300 * share), dtype=np.uint64), rng.integers(0, 2**63, (2, int(150 * (1 - share))), dtype=np.uint64)
            x, y = (minhash.minima(np.unique(np.append(both, o)), a, b) for o in own)
            agree.append((x == y).mean())
        assert abs(np.mean(agree) - share) < 0.03


def best_documents(docs, items, k=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    terms = [(d, cut(t)) for d, t in docs]
    n_docs, total = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df, out = {}, []
    for _, t in terms:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for i, text in items:
        asked.setdefault(i, set()).update(cut(text))
    for i, query in asked.items():
        scores = []
        for d, t in terms:
            m = 10 + 90 * len(t) * n_docs // total if t else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in query if x in t)
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:k], 1)]
    return out


def test_ranking_equals_all_scores(spark, frame, edges, corpus, monkeypatch):
    monkeypatch.setattr(ranked, "SHARD", 5000)
    monkeypatch.setattr(ranked, "ITEMS", 3)
    docs = [(i, t) for i, t in edges] + corpus + [(7000 + i, "tied same terms") for i in range(30)] + [(3, "Tied same É"), (None, "tied")] * 2 + [(8000, "tie " * 300_000)]
    items = [(1, corpus[3][1]), (2, "same, TIED!"), (3, "x É ε\xa0z"), (4, None), (5, ""), (6, "nowhere"), (2, "v17 tied"), (7, "a"), (8, "word tie"), (9, corpus[80][1])]
    got = ranked.ranked(frame(docs), spark.createDataFrame([(i, t, 1, "s") for i, t in items], "item_id long, text string, score int, id string"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda r: (r[0], r[1])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(best_documents(docs, items), key=key)


def test_ranking_of_empty_tables(spark, frame):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked.ranked(frame([]), items).collect() == [] and ranked.ranked(frame([(1, None)]), items).collect() == []
    assert ranked.ranked(frame([(1, "a")]), items.limit(0)).collect() == []


def lloyd(rows, parts=8, entries=16, rounds=6):
    """(id, label, vector) of one length, kept ones only."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    x = np.floor(4096 * np.array([v for _, _, v in rows], float)).astype(np.int64)
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % parts))).reshape(len(x), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    far = lambda: np.stack([((x[:, p, None] - books[p][None]) ** 2).sum(axis=2) for p in range(parts)], 1)
    for _ in range(rounds):
        own = far().argmin(axis=2)
        for p in range(parts):
            for e in range(books.shape[1]):
                if (own[:, p] == e).any():
                    mine = x[own[:, p] == e, p]
                    books[p, e] = mine.sum(axis=0) // len(mine)
    own, error = far().argmin(axis=2), far().min(axis=2).sum(axis=1)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    total = {}
    for (_, label, _), e in zip(rows, error.tolist(), strict=True):
        total[label] = total.get(label, 0) + e
    return [(i, bytes(o).hex(), e, total[label], digest) for (i, label, _), o, e in zip(rows, own.astype(np.uint8), error.tolist(), strict=True)]


def coded(spark, rows, **how):
    df = spark.createDataFrame([(i, label, v, "c", 0) for i, label, v in rows], "vec_id long, label int, embedding array<float>, code string, error int").repartition(3)
    return [tuple(r) for r in vector_codes.codes(df, **how).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]


NOT_KEPT = [(900, 1, None), (901, 1, [0.5] * 31 + [None]), (902, 2, [float("nan")] * 32), (903, 2, [float("inf")] + [0.0] * 31)]


@pytest.mark.parametrize("block", [7, 8192])
def test_codes_equal_a_plain_iteration(spark, monkeypatch, block):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 32))
    rows = [(i * 3 % 601, None if i % 5 == 0 else i % 4, [float(v) for v in (centres[i % 20] + rng.normal(size=32) * 0.4).astype(np.float32)]) for i in range(300)]
    rows += [(700 + i, 1, [0.25] * 32) for i in range(90)] + [(-5, 1, [0.25] * 32), (-4, 1, [0.25] * 32), (2, 3, [-1e-5] * 32)] + [(None, 2, [0.5] * 32)] + rows[:4]
    assert sorted(coded(spark, rows + NOT_KEPT), key=str) == sorted(lloyd(rows), key=str)


def test_few_parts_are_compared_again(monkeypatch):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c * 400, 30, (200, 1, 4)) for c in range(6)]).astype(np.int32)
    block, books, gathered = vector_codes.Block(x, 1, 6), x[::200].transpose(1, 0, 2).astype(np.int64), np.zeros((1, 6))
    block.assign(np.arange(1200), books, gathered)
    for step in range(4):
        new = books + rng.integers(-2, 3, books.shape)
        gathered, books = gathered + vector_codes.drift(books, new), new
        due = block.due(gathered)
        assert len(due) < 120
        block.assign(due, books, gathered)
        assert (block.own[:, 0] == ((x - books[0][None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_codes_of_odd_tables(spark):
    assert coded(spark, []) == [] and coded(spark, NOT_KEPT) == []
    few = [(1, 1, [1.0, 2.0, 3.0]), (2, 1, [1.0, 2.5, 3.0])]
    got = sorted(coded(spark, [*few, (3, 1, [1.0] * 8)]), key=str)
    assert [g for g in got if g[0] != 3] == sorted(lloyd(few), key=str) and got[2][:3] == (3, None, None)
    assert coded(spark, [(4, None, []), (5, 2, [])])[0][1:4] == ("00" * 8, 0, 0)
    with pytest.raises(Exception, match="too large"):
        coded(spark, [(1, 1, [1e30] * 8)])


def test_operators_leave_what_their_results_read(frame, corpus):
    for operator in (minhash.similar, ngram_join.similar, substring_dedup.report, substring_dedup.dedup):
        before = set(common.scratch_tables())
        out = operator(frame(corpus))
        left = [p for p in common.scratch_tables() if p not in before]
        assert len(left) <= 6 and all(any(p.rpartition("/")[2] in f for f in out.inputFiles()) for p in left)
        assert out.count() > 50
