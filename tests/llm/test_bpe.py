from __future__ import annotations

import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import ODD_TEXTS, empty, odd_rows, sha
from tidemark.llm import bpe
from tidemark.llm.queries import op5, vocabulary


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(vocabulary())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_query_equals_the_library(spark, sf, texts, library):
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op5(spark, sf).collect()}
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_all_code_points(library):
    codec = bpe.Codec(bpe.read_vocabulary(vocabulary()))
    chars = [chr(i) for i in range(0x12000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(f"a{c} {c}1" for c in chars[i : i + 500]) for i in range(0, len(chars), 500)]
    texts += ["a<|endoftext|>b  c\n\n d", "<|endoftext|>", "<|endoftext", "   ", "aaaaaaaaaaaaaaaaaaaaa", "I'LL don't 's", "x" * 5000, "á 　y\x1c\x1d z\x85"]
    for group in bpe.groups(texts, 2000):
        ids, counts = codec.encode(group)
        at = 0
        for text, n, piece in zip(group, counts.tolist(), codec.pieces_of(ids, counts)):
            own = ids[at : at + n].tolist()
            at += n
            assert own == library.encode(text, add_special_tokens=False).ids
            assert piece.decode() == text == codec.decode(own)


def test_words_forgotten_between_groups(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    codec = bpe.Codec(bpe.read_vocabulary(vocabulary()))
    for text in ("one two three four five six seven", "eight nine ten <|endoftext|>", "one ten eleven twelve thirteen fourteen"):
        assert codec.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_round_trip_of_odd_rows(spark):
    rows = odd_rows(spark).withColumnRenamed("lang", "ids")
    encoded = bpe.encode(rows, vocabulary())
    assert encoded.columns == ["doc_id", "text", "source", "n_chars", "ids"]
    back = bpe.decode(encoded, vocabulary(), out="again").collect()
    assert len(back) == len(ODD_TEXTS) + 2
    assert all(r["again"] == (r["text"] or "") for r in back)
    assert bpe.encode(empty(spark), vocabulary()).collect() == []
    assert bpe.digests(empty(spark), vocabulary()).collect() == []


def test_decode_of_cut_characters_and_null(spark, library):
    ids = library.encode("東京 \U0001f600", add_special_tokens=False).ids
    rows = [(k, ids[:k]) for k in range(len(ids) + 1)] + [(99, None)]
    got = {r["k"]: r["text"] for r in bpe.decode(spark.createDataFrame(rows, "k int, ids array<int>"), vocabulary()).collect()}
    assert got.pop(99) is None
    assert got == {k: library.decode(own, skip_special_tokens=False) for k, own in rows[:-1]}


def test_decoded_digest_of_the_same_pass(spark):
    rows = odd_rows(spark)
    got = bpe.encode(rows.selectExpr("*", "7 AS sha"), vocabulary(), decoded="sha").collect()
    plain = {repr(r["text"]): r["ids"] for r in bpe.encode(rows, vocabulary()).collect()}
    assert len(got) == rows.count()
    assert all(r["sha"] == sha(r["text"] or "") and r["ids"] == plain[repr(r["text"])] for r in got)


def test_a_worker_keeps_a_bounded_table_of_words():
    """230,000 different words pass through: fewer than 200,000 stay known, and ids are those of a fresh codec."""
    data = bpe.read_vocabulary(vocabulary())
    codec = bpe.Codec(data)
    texts = [" ".join(f"q{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}{chr(97 + k // 17576)}x" for k in range(lo, lo + 2000)) for lo in range(0, 230_000, 2000)]
    most = 0
    for own in bpe.groups(texts):
        ids, counts = codec.encode(own)
        most = max(most, len(codec.known))
    assert most <= 200_000
    again, sizes = bpe.Codec(data).encode(own)
    assert ids.tolist() == again.tolist() and counts.tolist() == sizes.tolist()
