"""Operators on tokens against the libraries: wavelet shards, counts, encoding and decoding."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from statuta.llm import byte_bpe, token_counts, wavelet


def u32(ids):
    return np.array(ids, "<u4").tobytes()


def test_wavelet_files_hold_the_ids_in_order(frame, edges, corpus):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = [(i + 5000, x) for i, x in edges] + corpus
    got = {r.doc_id: r for r in wavelet.round_trip(frame(rows)).collect()}
    start = 0
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(u32(ids))), text
        start += len(ids)
    assert len(got) == len(rows)


def test_wavelet_takes_repeated_rows_and_no_rows(frame):
    got = wavelet.round_trip(frame([(1, "a b"), (1, "a b"), (None, "c")])).collect()
    assert sorted(r.start for r in got) == [0, 2, 5] and wavelet.round_trip(frame([])).count() == 0


def test_wavelet_shards_are_split_and_joined(frame):
    got = wavelet.round_trip(frame([(i, "one two three") for i in range(40)]), shard_tokens=5).collect()
    assert sorted(r.start for r in got) == [4 * i for i in range(40)]


def test_words_whose_hashes_agree_are_told_apart(corpus, edges, monkeypatch):
    t, spans = Tokenizer.from_file(P.path("word_bpe_49k.json")), wavelet.word_spans
    monkeypatch.setattr(wavelet, "word_spans", lambda *a, **k: (lambda h, *rest: (h & np.uint64(15), *rest))(*spans(*a, **k)))
    words = wavelet.WordIds(P.path("word_bpe_49k.json"), 1)
    texts = [(x or "").encode() for _, x in [*corpus, *edges]]
    for some in (texts[:50], texts[50:], texts[:20]):
        ids, lens = words.encode(some)
        want = [[*t.encode(x.decode(), add_special_tokens=False).ids, 1] for x in some]
        assert lens.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_a_tokenizer_that_keeps_no_word_borders_encodes_whole_texts(tmp_path):
    from tokenizers import models, normalizers

    t = Tokenizer(models.BPE({"a": 0, " ": 1, "b": 2, "a b": 3, "a ": 4}, [("a", " "), ("a ", "b")]))
    t.normalizer = normalizers.NFC()
    t.save(str(tmp_path / "t.json"))
    ids, lens = wavelet.WordIds(str(tmp_path / "t.json"), 9).encode([b"a b", b"", b"b a b"])
    assert ids.tolist() == [3, 9, 9, 2, 1, 3, 9] and lens.tolist() == [2, 1, 4]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=300))
def test_wavelet_matrix_answers_like_a_list(values):
    parts = [np.array(x, np.int64) for x in (values[: len(values) // 2], values[len(values) // 2 :])]
    m, head = wavelet.load(wavelet.dump(wavelet.Shard([wavelet.WaveletMatrix.build(x) for x in parts]), {"part": 3}))
    assert m.tokens().tolist() == values and head["part"] == 3
    assert [m.access(i) for i in range(len(values))] == values
    for v in {*values[:5], 17, 2**20}:
        assert m.count(v) == values.count(v) and list(m.occurrences(v)) == [i for i, x in enumerate(values) if x == v]
        assert m.select(v, values.count(v)) == -1 and m.rank(v, len(values) // 2) == values[: len(values) // 2].count(v)


def test_token_counts_are_the_models(frame, edges, corpus):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rows = [(i + 5000, x) for i, x in edges] + corpus
    got = {r.doc_id: r for r in token_counts.token_counts(frame(rows), limit=100).collect()}
    for i, text in rows:
        n = len(sp.encode(text or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 100), text
    assert token_counts.token_counts(frame([])).count() == 0


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 3)
    lengths = token_counts.Lengths(P.path("piece_bpe_32k.model"), {})
    text = " ".join(f"w{i}" for i in range(50)).encode()
    assert lengths.count(text) == len(lengths.model.encode(text.decode()))


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_round_trip(frame, edges, corpus, encoding):
    rows = [(i + 5000, x) for i, x in edges] + corpus + [(7, "twice"), (7, "twice"), (None, "no id")]
    got = [tuple(r) for r in byte_bpe.encode_decode(frame(rows)).collect()]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(ids := encoding.encode_ordinary(t or "")), sha(u32(ids)), sha((t or "").encode())) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    whole = {r.doc_id: r for r in byte_bpe.encode_decode(frame(rows[:30]), digests=False).collect()}
    assert all(encoding.decode(whole[i].token_ids) == (t or "") == bytes(whole[i].decoded).decode() for i, t in rows[:30])
    assert byte_bpe.encode_decode(frame([])).count() == 0


def test_full_buckets_and_small_blocks_change_nothing(frame, corpus, encoding, monkeypatch):
    for name, value in (("BLOCK_BYTES", 5_000), ("BUCKET_BYTES", 100), ("BUCKETS", 70), ("KNOWN", 3)):
        monkeypatch.setattr(byte_bpe, name, value)
    assert byte_bpe.bucket_count(10**9) == 70 and byte_bpe.bucket_count(0) == 64
    for r in byte_bpe.encode_decode(frame(corpus), digests=False).collect():
        assert r.token_ids == encoding.encode_ordinary(dict(corpus)[r.doc_id])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1' \n\t\r\xa0\u3000é.-s\x1c"), max_size=40))
def test_pieces_split_like_the_whole(encoding, text):
    splitter = byte_bpe.Splitter(P.PATTERN)
    at = splitter.split(text)
    words = list(splitter.words)
    assert [words[i] for i in at] == splitter.find(text)


@pytest.mark.parametrize("values", [[], [0], [239, 240, 65535, 65536, 2**20 - 1, 3], [2**20, 5, 2**31]])
def test_packed_integers_come_back(values):
    x = np.array(values, np.int64)
    assert byte_bpe.unplanes(byte_bpe.planes(x)).tolist() == values


def test_a_block_that_changed_is_noticed():
    a, b = byte_bpe.Block(P.PATTERN), byte_bpe.Block(P.PATTERN)
    a.add(1, "one two")
    b.add(1, "one three")
    assert a.close(4)[0] != b.close(4)[0]
