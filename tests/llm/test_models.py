"""Learned operators: toxicity, byte contexts, quality, benchmark search."""

import collections
import functools
import math
import random
import re
import zlib

import numpy as np
import pytest

from statuta.llm import decontaminate, ppm, quality, toxicity


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        text = rng.choices(words, k=rng.randrange(20, 60)) + (rng.sample(["scum", "idiot", "vile"], 2) if bad else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        if i % 2 == 0 or bad:
            labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_on_rows_that_it_has_not_seen(spark, frame, talk):
    rows, labels = talk
    got = toxicity.toxicity(frame(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(r.score, r.doc_id % 5 == 0) for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum((s >= 0.5) == y for s, y in held) / len(held) > 0.95


def test_toxicity_without_labels_and_edges(spark, frame, edges):
    none = toxicity.toxicity(frame(edges), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {r.score for r in none} == {0.5} and len(none) == len(edges)
    one = toxicity.toxicity(frame(edges), spark.createDataFrame([(i, 0) for i, _ in edges] + [(1, None)], "doc_id long, toxic int")).collect()
    assert max(r.score for r in one) < 0.01
    assert toxicity.toxicity(frame([]), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0


def unigram(rows):
    c = collections.Counter()
    for d, t in rows:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            c.update((t or "").encode().lower().split())
            c[None] += 1
    n, v = sum(c.values()), len(c)
    out = {}
    for d, t in rows:
        w = [*(t or "").encode().lower().split(), None]
        out[d] = zlib.crc32(str(d).encode()) % 7 == 2, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
    return out


def test_language_score(frame, edges, corpus):
    rows = [(i + 5000, x) for i, x in edges] + corpus
    got = ppm.language_score(frame(rows + [rows[3]])).collect()
    want = unigram(rows + [rows[3]])
    assert len(got) == len(rows) + 1
    for r in got:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    assert ppm.language_score(frame([])).count() == 0


def slow_ppm(train, order=ppm.ORDER):
    """Escape method C with exclusion, symbol by symbol, from plain dictionaries: a function text -> log10 probability."""
    seen = collections.defaultdict(collections.Counter)
    spell = lambda t: [256] * order + [*t, 256]
    for t in train:
        s = spell(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen[tuple(s[i - k : i])][s[i]] += 1

    @functools.cache
    def p(context, symbol):
        if context is None:
            return 1 / 257
        shorter = context[1:] if context else None
        found = seen.get(context)
        if not found:
            return p(shorter, symbol)
        kinds = len(found) if len(found) < 257 else 0
        total = sum(found.values()) + kinds
        if symbol in found:
            return found[symbol] / total
        return kinds / total * p(shorter, symbol) / (1 - math.fsum(p(shorter, x) for x in found))

    def score(t):
        s = spell(t)
        return math.fsum(math.log10(p(tuple(s[i - order : i]), s[i])) for i in range(order, len(s)))

    return score, p


def test_scores_are_those_of_a_slow_model_with_all_ngrams(frame, edges, corpus, monkeypatch):
    """Several blocks and many more n-grams than a block adds up at a time."""
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(ppm, "HELD", 3_000)
    monkeypatch.setattr(ppm, "BUCKET_BYTES", 1_000)
    rng = random.Random(11)
    rows = [(i + 5000, x) for i, x in edges] + corpus[::5] + [(9000 + i, "".join(rng.choices("abcdefghijklmnop ", k=900))) for i in range(40)]
    score, _ = slow_ppm([(t or "").encode() for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2])
    for r in ppm.language_score(frame(rows)).collect():
        assert r.score == pytest.approx(score((dict(rows)[r.doc_id] or "").encode()), rel=1e-8), r.doc_id


def test_messages_grow_with_the_blocks(frame, monkeypatch):
    """Ten times the text sends ten times the messages, once there are as many buckets as there may be."""
    for name, value in (("BLOCK_BYTES", 5_000), ("BUCKET_BYTES", 1_000), ("BUCKETS", 100)):
        monkeypatch.setattr(ppm, name, value)
    rng, sent = random.Random(2), []
    for n in (60, 600):
        rows = [(i, "".join(rng.choices("abcdefgh ", k=2_000))) for i in range(n)]
        docs = frame(rows).selectExpr("doc_id AS id", "text", "true AS train").coalesce(1)
        gathered = ppm.gather(docs, "bigint", ppm.bucket_count(n * 2_000))
        sent.append(gathered.where(gathered["kind"].isin(ppm.WORDS, ppm.GRAMS)).count())
        top = ppm.trie_top(gathered)
        assert len(top) == ppm.DEALT and len(top[-1][0]) <= 10**ppm.DEALT  # what is broadcast: nine letters and the end
    assert sent[1] <= 11 * sent[0]


def test_model_probabilities_sum_to_one_and_follow_the_texts():
    texts = [b"abracadabra", b"abba", b""]
    score, p = slow_ppm(texts)
    for context in ((256,) * 5, tuple(b"racad"), tuple(b"zzzza"), tuple(b"zzzzz")):
        assert sum(p(context, s) for s in range(257)) == pytest.approx(1)
    seen, other, empty = map(score, (b"abracadabra", b"qwertyuiopx", b""))
    assert seen > other and empty > other and seen < 0
    code, n = np.unique(ppm.codes(texts), return_counts=True)
    levels = [ppm.added([(ppm.cut(code, k), n)]) for k in range(ppm.ORDER + 1)]
    for text in (b"abracadabra", b"qwertyuiopx", b"abbx", b""):
        assert ppm.logs(ppm.codes([text]), levels).sum() == pytest.approx(score(text), rel=1e-12)


def slow_ppm_step(text, i, order=ppm.ORDER):
    """log10 probability of symbol i of a text after those before it, by counts with exclusion made anew."""
    s = [256] * order + [*text, 256]
    at, gone, p = order + i, set(), 1.0
    for k in range(order, -1, -1):
        after = collections.Counter(s[j] for j in range(order, at) if s[j - k : j] == s[at - k : at] and s[j] not in gone)
        if after:
            weight = sum(after.values()) + len(after)
            if s[at] in after:
                return math.log10(p * after[s[at]] / weight)
            p *= len(after) / weight
            gone |= set(after)
    return math.log10(p / (257 - len(gone)))


def test_adaptive_model_is_a_distribution_and_learns():
    short = [b"", *(bytes([a]) for a in range(256))]
    assert sum(10 ** ppm.adaptive(t, 0) for t in short) < 1
    text = b"the cat sat on the mat, the cat"
    score = lambda i: slow_ppm_step(text, i)
    assert ppm.adaptive(text) == pytest.approx(sum(map(score, range(len(text) + 1))))
    assert ppm.adaptive(b"ab" * 50) > 2 * ppm.adaptive(b"ab" * 10)


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = collections.Counter(tri)
    covered = {j for i, t in enumerate(tri) if c[t] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality_measures(frame, edges, corpus):
    rows = [(i + 5000, x) for i, x in edges] + corpus + [(1, "a b c a b c a b c d")]
    got = {r.doc_id: r for r in quality.quality(frame(rows)).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), t
        assert r.kept <= (not r.base_failed) and 0 <= r.posterior <= 1
    assert quality.quality(frame([])).count() == 0


def test_quality_keeps_prose_and_drops_noise(frame):
    rng = random.Random(4)
    rows = []
    for i in range(200):
        w = [f"{rng.choice('abcdefg')}word{rng.randrange(3000)}" for _ in range(120)]
        if i % 10 == 0:
            w = [x + rng.choice(["###", "%%%"]) for x in w]
        elif i % 10 == 1:
            w = [x for a in w for x in (a, "|")]
        else:
            w = [x + "." if k % 9 == 8 else x for k, x in enumerate(w)]
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.kept for r in quality.quality(frame(rows)).collect()}
    assert all(got[i] == (i % 10 > 1) for i, _ in rows)
    kept = quality.keep(frame(rows))
    assert kept.count() == 160 and kept.columns == frame(rows).columns


@pytest.fixture(scope="module")
def leaks(spark, frame):
    rng = random.Random(8)
    words = [f"{rng.choice('klmnop')}{rng.randrange(2000)}" for _ in range(2000)]
    prose = lambda n: rng.choices(words, k=n)
    items = [prose(rng.randrange(15, 60)) for _ in range(12)]
    rows, want = [(i, " ".join(prose(300))) for i in range(60)], set()
    for k, item in enumerate(items):
        a, b = prose(rng.randrange(80)), prose(rng.randrange(80))
        rows.append((100 + k, " ".join(a + item + b)))
        changed = [w if i % 6 else rng.choice(words) for i, w in enumerate(item)]
        rows.append((200 + k, " ".join(a + [w.upper() + "," for w in changed] + b)))
        want |= {(100 + k, k), (200 + k, k)}
    rows += [(300, None), (301, ""), (302, " ".join(items[0][:6]))]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(50, None), (51, "")], "item_id long, text string")
    return rows, bench, want


def test_benchmark_items_are_found_also_when_changed(frame, leaks):
    rows, bench, want = leaks
    got = decontaminate.leaks(frame(rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    clean = decontaminate.decontaminated(frame(rows), bench)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in want} and clean.columns == frame(rows).columns


def test_last_sentence_is_no_answer_unless_one_is_given(spark, frame):
    words = [f"q{i}" for i in range(38)]
    rows = [(i, " ".join(f"z{i}x{k}" for k in range(60))) for i in range(20)] + [(100, " ".join(words[:-1] + ["other"]))]
    item = " ".join(words[:-1]) + ". " + words[-1]
    bench = spark.createDataFrame([(1, item, words[-1])], "item_id long, text string, answer string")
    assert [(r.doc_id, r.lcs) for r in decontaminate.leaks(frame(rows), bench).collect()] == [(100, 37)]
    assert decontaminate.leaks(frame(rows), bench, answer_col="answer").count() == 0


def test_every_item_with_the_subsequence_is_found(frame, spark):
    rng = random.Random(12)
    words = [f"v{int(400 * rng.random() ** 2)}" for _ in range(3000)]
    prose = lambda n: rng.choices(words, k=n)
    items = [prose(n) for n in (1, 2, 3, 5, 8, 12, 20, 35, 50, 80)]
    items[:3] = [["solo"], ["two", "parts"], ["of", "three", "words"]]
    docs = [prose(rng.choice((10, 90, 400))) for _ in range(120)]
    for i, doc in enumerate(docs[:100]):
        item = items[i % 10]
        gone = set(rng.sample(range(len(item)), int(0.38 * len(item)) if len(item) > 3 else 0))
        at = rng.randrange(len(doc))
        doc[at:at] = [f"n{i}x{k}" if k in gone else w for k, w in enumerate(item)]
    docs += [["two", "and", "parts"], ["solo"]]
    want = set()
    for d, doc in enumerate(docs):
        for k, item in enumerate(items):
            n = len(item)
            around = [doc[max(0, s - n) : s + 40 + n] for s in range(0, len(doc), 20)]
            if n < 4:
                hit = any(item == doc[s : s + n] for s in range(len(doc)))
            else:
                hit = any(decontaminate.subsequence(item, x) >= math.ceil(0.6 * n) for x in around)
            want |= {(d, k)} if hit else set()
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame([(d, " ".join(x)) for d, x in enumerate(docs)]), bench).collect()}
    assert got == want and len(want) >= 100


@pytest.mark.parametrize("few", [{"QUERIES": 3, "HALVES": 2, "HITS": 5}, {"ITEMS": 4}, {"ITEM_BYTES": 400}])
def test_blocks_and_passes_change_nothing(frame, leaks, monkeypatch, few):
    rows, bench, want = leaks
    for name, n in few.items():
        monkeypatch.setattr(decontaminate, name, n)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(rows), bench).collect()} == want


def test_documents_are_read_once_for_all_items(spark, frame, monkeypatch):
    rng = random.Random(14)
    words = [f"u{i}" for i in range(3000)]
    items = [" ".join(rng.choices(words, k=12)) for _ in range(5000)]
    passes, run = [], decontaminate.search
    monkeypatch.setattr(decontaminate, "search", lambda *x: passes.append(len(x[1].ids)) or run(*x))
    rows = [(i, " ".join(rng.choices(words, k=60)) + " " + items[i * 50]) for i in range(100)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.leaks(frame(rows), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(i, i * 50) for i in range(100)} and passes == [5000]


def test_items_in_a_very_long_text(frame, leaks):
    rows, bench, want = leaks
    text = " ".join("x y z and the".split() * 150_000)
    held = [rows[60 + 2 * k][1] for k in range(12)]
    got = decontaminate.leaks(frame([(7, " ".join([text, *held, text])), (8, text)]), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(7, k) for k in range(12)}


@pytest.mark.parametrize("hits", [3, 10**6])
def test_windows_are_those_of_a_count(monkeypatch, hits):
    monkeypatch.setattr(decontaminate, "HITS", hits)
    rng = np.random.default_rng(3)
    for size, words, n in ((1, 2, 4), (5, 6, 9), (9, 12, 40)):
        holds = rng.random((words, size)) < 0.4
        reach, bounds = rng.integers(1, 4, size), rng.integers(1, 6, size)
        at, where = rng.integers(0, words, 5 * n), np.sort(rng.integers(0, n, 5 * n))
        pairs = np.array([w * size + i for w, i in zip(*np.nonzero(holds), strict=True)], np.int64)
        items = decontaminate.Items(*[range(size) if f == "ids" else pairs if f == "pairs" else bounds if f == "bounds" else None for f in decontaminate.Items._fields])
        got = decontaminate.windows(items, reach, at, where, n, 0, size).tolist()
        want = [p * size + i for p in range(n) for i in range(size) if sum(holds[w, i] and p - reach[i] <= h <= p + 1 + reach[i] for w, h in zip(at, where, strict=True)) >= bounds[i]]
        assert sorted(got) == want


def test_benchmark_edges(spark, frame, edges):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(frame(edges), empty).count() == 0
    assert decontaminate.leaks(frame([]), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).count() == 0


def test_subsequence_is_the_longest():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev, row = row, [0]
            for j, y in enumerate(b):
                row.append(prev[j] + 1 if x == y else max(row[-1], prev[j + 1]))
        return row[-1]

    rng = random.Random(2)
    for _ in range(100):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(20))] for _ in range(2))
        assert decontaminate.subsequence(a, b) == slow(a, b)
