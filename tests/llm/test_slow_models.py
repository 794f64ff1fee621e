"""Learned operators against plain models of one coordinate or one document at a time, and operators on a very long text."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from statuta.llm import byte_bpe, chat, ppm, quality, token_counts, toxicity, wavelet


class SlowFtrl:
    """FTRL-proximal with weights in dictionaries, by feature names, not hashed; L1 spares the bias."""

    def __init__(self):
        self.z, self.n = {}, {}

    def weight(self, f):
        z, l1 = self.z.get(f, 0.0), 0.0 if f == "bias" else toxicity.L1
        if abs(z) <= l1:
            return 0.0
        return -(z - math.copysign(l1, z)) / ((toxicity.BETA + math.sqrt(self.n.get(f, 0.0))) / toxicity.ALPHA + toxicity.L2)

    def score(self, features):
        return 1 / (1 + math.exp(-sum(self.weight(f) for f in features)))

    def learn(self, features, label):
        g = self.score(features) - label
        for f, w in [(f, self.weight(f)) for f in features]:
            n = self.n.get(f, 0.0)
            self.z[f] = self.z.get(f, 0.0) + g - (math.sqrt(n + g * g) - math.sqrt(n)) / toxicity.ALPHA * w
            self.n[f] = n + g * g


def named(text):
    w = text.lower().split()
    return {*w, *(("pair", *x) for x in zip(w, w[1:], strict=False)), *(("skip", *x) for x in zip(w, w[2:], strict=False)), "bias"}


def test_toxicity_scores_are_those_of_a_slow_model(spark, frame):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(14)]  # few features, so that none share a coordinate by chance
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(4, 12)) + (["Vile", "scum"] if i % 3 == 0 else []))) for i in range(250)]
    texts = dict(rows)
    at = {}
    for text in texts.values():
        for f in named(text) - {"bias"}:
            part = [f] if isinstance(f, str) else list(f[1:]) if f[0] == "pair" else [f[1], "between", f[2]]
            found = toxicity.coordinates([" ".join(part).encode()])[0].tolist()
            at[f] = found[-1]
    assert len(set(at.values())) == len(at)  # no two of these features share a coordinate
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in texts], "doc_id long, toxic int")
    order = [r.doc_id for r in labels.orderBy(F.xxhash64("doc_id")).collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    slow = SlowFtrl()
    for _ in range(toxicity.EPOCHS):
        for i in order:
            slow.learn(named(texts[i]), int(i % 3 == 0))
    got = {r.doc_id: r.score for r in toxicity.toxicity(frame([*rows, (999, None)]), labels).collect()}
    want = {i: slow.score(named(t)) for i, t in [*rows, (999, "")]}
    assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in want) < 1e-9
    assert len({round(x, 6) for x in want.values()}) > 5


def slow_votes(text):
    """The rules' votes, from their thresholds as stated."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, windows = len(words), {}
    for i in range(n - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = len({i + k for found in windows.values() if len(found) > 1 for i in found for k in range(3)})
    chars, symbols = sum(map(len, words)), sum(c in "#*$%&|<>" for c in text)
    marked, ends = (sum(w[-1] in marks for w in words) for marks in ("#*$%&|<>", ".!?"))
    dup, different = len(lines) - len(set(lines)), len(set(words))

    def vote(bad, good=False):
        return -1 if bad else int(good)

    return (
        vote(n < 30),
        vote(chars < 2 * n or chars > 20 * n),
        vote(symbols * 10 > n, symbols * 100 <= n),
        vote(marked * 20 > n, marked * 200 <= n),
        vote(ends * 200 < n, ends * 50 > n),
        vote(dup > 2 and dup * 10 > 3 * len(lines)),
        vote(repeated * 10 > 3 * n, repeated * 10 <= n),
        vote(different * 5 < n and n < 2000),
    ), n < 50 or 100 * repeated > 50 * n


def slow_posteriors(votes):
    """Expectation-maximisation that goes through the documents one by one, in products of probabilities."""
    share, odds = quality.GOOD_AT_FIRST, [[dict(side) for side in rule] for rule in quality.RULES]

    def good(v):
        bad_p, good_p = 1 - share, share
        for rule, x in zip(odds, v, strict=True):
            bad_p, good_p = bad_p * rule[0][x], good_p * rule[1][x]
        return good_p / (good_p + bad_p)

    for _ in range(quality.ROUNDS):
        p = [good(v) for v in votes]
        new = []
        for k, rule in enumerate(quality.RULES):
            sides = []
            for side, weight in ((0, [1 - x for x in p]), (1, p)):
                mass = {x: quality.HOLD * rule[side][x] + sum(w for w, v in zip(weight, votes, strict=True) if v[k] == x) for x in (-1, 0, 1)}
                sides.append({x: m / sum(mass.values()) for x, m in mass.items()})
            new.append(sides)
        share, odds = (quality.GOOD_AT_FIRST * quality.HOLD + sum(p)) / (quality.HOLD + len(votes)), new
    return [good(v) for v in votes]


def test_quality_posteriors_are_those_of_a_slow_estimation(frame, corpus, edges):
    rng = random.Random(22)
    words = [f"word{i}" for i in range(900)]
    rows = [(i + 5000, x) for i, x in edges] + corpus
    for i in range(300):
        w = [x + "." * (rng.random() < 0.08) + "#" * (rng.random() < 0.3 * (i % 7 == 0)) for x in rng.choices(words[: 20 if i % 11 == 0 else None], k=rng.randrange(20, 200))]
        line = " ".join(w[:9]) + "\n"
        rows.append((10_000 + i, " ".join(w) + ("\n" + line * 6 if i % 13 == 0 else "")))
    judged = [slow_votes(t or "") for _, t in rows]
    want = {i: (x, failed) for (i, _), x, (_, failed) in zip(rows, slow_posteriors([v for v, _ in judged]), judged, strict=True)}
    got = {r.doc_id: r for r in quality.quality(frame(rows)).collect()}
    for i, (x, failed) in want.items():
        assert abs(got[i].posterior - x) < 1e-9 and got[i].base_failed == failed, i
        assert got[i].kept == (not failed and x >= 0.5) or abs(x - 0.5) < 1e-9
    assert {r.kept for r in got.values()} == {True, False}


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(23)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(5000)]
    return "\n".join(" ".join(rng.choices(words, k=12)) + "." for _ in range(60_000))


def test_very_long_text_in_tokens(frame, long_text):
    rows = [(1, long_text), (2, "short"), (3, None)]
    ids = [*Tokenizer.from_file(P.path("word_bpe_49k.json")).encode(long_text, add_special_tokens=False).ids, 1]
    got = {r.doc_id: r for r in wavelet.round_trip(frame(rows)).collect()}
    assert (got[1].start, got[1].n_tokens, got[1].ids_crc32) == (0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and got[2].start == len(ids)
    got = {r.doc_id: r for r in token_counts.token_counts(frame(rows)).collect()}
    n = len(sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")).encode(long_text))
    assert (got[1].n_bytes, got[1].n_tokens, got[1].over_limit) == (len(long_text), n, True)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    ids = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(long_text)
    got = {r.doc_id: r for r in byte_bpe.encode_decode(frame(rows)).collect()}
    assert (got[1].n_tokens, got[1].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert got[1].decoded_sha256 == hashlib.sha256(long_text.encode()).hexdigest()


def test_very_long_text_in_models(spark, frame, long_text):
    rows = [(1, long_text + "\nvile"), (2, "a vile text"), *((i, "a kind text") for i in range(3, 40))]
    labels = spark.createDataFrame([(i, int(i < 3)) for i, _ in rows], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(frame(rows), labels).collect())
    got = {r.doc_id: r for r in quality.quality(frame(rows)).collect()}
    n = len(long_text.split()) + 1
    assert got[1].n_words == n and got[1].kept and not got[2].kept
    got = {r.doc_id: r for r in ppm.language_score(frame(rows)).collect()}
    assert got[1].n_tokens == n + 1 and -8 * len(long_text) < got[1].score < got[1].n_tokens * -1
    talk = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", long_text)], "conv_id long, turn long, role string, text string")
    back = chat.read_back(*chat.build(talk)).first()
    assert back.loss_chars == len(long_text) and back.loss_sha256 == hashlib.sha256(long_text.encode()).hexdigest()
