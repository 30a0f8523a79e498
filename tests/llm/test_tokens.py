"""Encoding and packing against the plain libraries, on awkward texts and on whole tables."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from barloom.llm import bpe, packing
from barloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
AWKWARD = [
    "", None, " ", "a", "  a  b", "a \n b\n\n c  ", "don't we'll 12 34x", "a\n \nb", "tab\t tab \t x", "x  y  z", "né 　日本 語",
    "<|endoftext|> in a text", "🙂 🙂🙂", "\x1c \x1d a", "a" * 5000, "a b" * 3000, " \n" * 500, "ab\n" * 500, "é" * 1000, "x\x00y \x00",
]


def noise(seed: int, n: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice("ab AB1 2.'s\n\t  é日!?  ") for _ in range(n))


ALL = AWKWARD + [noise(i, 400) for i in range(60)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, t, i) for i, t in enumerate(ALL)] + [(None, "a b", 0), (1, None, 0)], "doc_id long, text string, ids int")


def test_blocks_do_not_change_ids():
    enc = bpe.encoding(RANKS, P.PATTERN)
    for text in ALL:
        for size in (1, 7, 50):
            assert bpe.encode(enc, text or "", size).tolist() == enc.encode_ordinary(text or "")
            assert "".join(bpe.blocks(text or "", size)) == (text or "")


def test_encode_and_decode_columns(frame):
    enc = bpe.encoding(RANKS, P.PATTERN)
    rows = bpe.decode_column(bpe.encode_column(frame, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert len(rows) == len(ALL) + 2
    want = sorted((np.asarray(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for t in [*ALL, "a b", None])
    assert sorted((bytes(r.ids), bytes(r.decoded)) for r in rows) == want


def test_decode_of_part_of_a_character():
    enc = bpe.encoding(RANKS, P.PATTERN)
    ids = enc.encode_ordinary("🙂")
    assert len(ids) > 1 and bpe.decode(enc, ids[:1]) == "🙂".encode()[: len(bpe.decode(enc, ids[:1]))]


def test_ids_are_those_of_the_library():
    """An untouched tokenizer: strings of special tokens are special tokens."""
    t, (enc, shown) = Tokenizer.from_file(JSON), bpe.of_tokenizer_file(JSON)
    texts = [t or "" for t in ALL] + ["a <|endoftext|> b", "<|endoftext|><|endoftext|>  x", "a <|endoftext|", "w " * 40_000 + "<|endoftext|> 1"]
    assert bpe.encode(enc, "a <|endoftext|> b", special=True).tolist() == [64, 220, 50256, 275]
    for text in texts:
        ids = t.encode(text, add_special_tokens=False).ids
        assert bpe.encode(enc, text, special=True).tolist() == ids
        assert b"".join(shown[i] for i in ids) == text.encode()


def test_files_of_another_kind_are_an_error():
    with pytest.raises(ValueError):
        bpe.of_tokenizer_file(P.path("word_bpe_49k.json"))


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 4095, 10_000])
def test_lengths(n):
    parts = packing.lengths(n)
    assert sum(parts) == n and all(k & (k - 1) == 0 and k <= 2048 for k in parts) and len(parts) <= n // 2048 + 11


def test_pieces_put_documents_together_again(frame):
    t = Tokenizer.from_file(JSON)
    rows = packing.pack(frame, JSON, most=64).collect()
    assert [r.length for r in sorted(rows, key=lambda r: r.sequence_id)] == sorted(r.length for r in rows)  # by bucket
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    by = {}
    for r in sorted(rows, key=lambda r: r.start):
        by.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(ALL):
        if i == 1:
            continue  # two rows have this id
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        assert b"".join(r.ids for r in by[i]) == np.asarray(ids, "<u4").tobytes()
        assert [r.start for r in by[i]] == [sum(x.length for x in by[i][:k]) for k in range(len(by[i]))] and {r.doc_tokens for r in by[i]} == {len(ids)}
    assert len(by[1]) == 2 and len(by[None]) >= 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, JSON).count() == 0
    assert bpe.decode_column(bpe.encode_column(none, RANKS, P.PATTERN), RANKS, P.PATTERN).count() == 0


def test_buckets_on_disk(spark, frame, tmp_path):
    packing.write_buckets(packing.pack(frame, JSON), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.where("bucket != length").count() == 0 and back.count() == packing.pack(frame, JSON).count()


def test_queries_over_whole_tables(spark):
    enc, t = bpe.encoding(RANKS, P.PATTERN), Tokenizer.from_file(JSON)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op6_byte_bpe"](spark, SF).collect():
        ids = np.asarray(enc.encode_ordinary(docs[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    seen = 0
    for r in QUERIES["op7_power_of_two_packing"](spark, SF).collect():
        ids = np.asarray(t.encode(docs[r.doc_id], add_special_tokens=False).ids + [1], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids)
        seen += r.length
    assert seen == sum(len(t.encode(x, add_special_tokens=False).ids) + 1 for x in docs.values())
