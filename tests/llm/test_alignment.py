"""Token alignment against a plain comparison of byte ranges."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from barloom.llm import alignment
from barloom.llm.common import table
from barloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def sides(text):
    """[(id, from byte, to byte)] of both sides, or nothing where the bytes differ from a space and the text."""
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    want, out = b" " + (text or "").encode(), []
    if not text:
        return [], []
    byte_of = {c: b for b, c in byte_letters().items()}
    for ids, shown in (
        (t.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(byte_of[c] for c in t.id_to_token(i))),
        (sp.encode(text), lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()),
    ):
        tokens, at = [], 0
        for i in ids:
            tokens.append((i, at, at + len(shown(i))))
            at += len(shown(i))
        if b"".join(map(shown, ids)) != want:
            return [], []
        out.append(tokens)
    return out


def byte_letters():
    """Byte -> letter of a byte-level vocabulary, as published with it."""
    keep = list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1)) + list(range(ord("®"), ord("ÿ") + 1))
    out, n = {b: chr(b) for b in keep}, 0
    for b in range(256):
        if b not in out:
            out[b], n = chr(256 + n), n + 1
    return out


def brute(rows):
    found, pairs = [], Counter()
    for i, text in rows:
        a, b = sides(text)
        links = []
        for x, s, e in a:
            links += [(x, y) for y, s2, e2 in b if s < e2 and s2 < e]
        ends = {e for _, _, e in a} & {e for _, _, e in b}
        groups, lo = [], 0
        for hi in sorted(ends):
            groups.append(",".join(str(x) for x, s, e in a if lo <= s < hi) + "|" + ",".join(str(y) for y, s, e in b if lo <= s < hi))
            lo = hi
        pairs.update(links)
        found.append((i, len(a), len(b), groups, links))
    most = Counter()
    for (_, y), n in pairs.items():
        most[y] = max(most[y], n)
    return sorted(
        ((i, a, b, len(g), len(links), ";".join(g), sum(pairs[p] == most[p[1]] for p in links), sum(pairs[p] for p in links)) for i, a, b, g, links in found), key=repr
    )


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, links int, n_best string")
    aligned = alignment.align(df, A, B).cache()
    got = alignment.with_counts(aligned, alignment.pair_counts(aligned, A, B), A, B).drop("links")
    return sorted((tuple(r) for r in got.collect()), key=repr)


ODD = ["a", "bc", " ", "  ", "é", "\n", "\t", "①", "ﬁ", "<s>", "</s>", "<0x0A>", "　", "\xa0", "▁", "漢字", "🙂", "\x00", "ing", "\r", "<|endoftext|>", "<unk>", "1234", "don't", "é"]


@pytest.mark.parametrize("most", [0, 4_000_000])
def test_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", most)
    r = random.Random(4)
    rows = [(i, "".join(r.choice(ODD) for _ in range(r.randrange(25)))) for i in range(120)]
    rows += [(None, None), (500, ""), (500, "same text"), (500, "same text"), (501, " "), (502, "word " * 3)]
    assert run(spark, rows) == brute(rows)


def test_blocks_change_nothing(spark, monkeypatch):
    rows = [(r.doc_id, (r.text or "")[:400]) for r in table(spark, SF, "documents").limit(60).collect()]
    whole = run(spark, rows)
    monkeypatch.setattr(alignment, "BLOCK", 100)
    monkeypatch.setattr(alignment, "HELD", 50)
    assert run(spark, rows) == whole == brute(rows)


def test_long_text_and_nothing(spark):
    r = random.Random(5)
    text = " ".join(r.choice(["alpha", "bêta", "gamma7", "naïve"]) + str(r.randrange(9)) for _ in range(40_000))
    (got,) = run(spark, [(1, text)])
    assert got[1] > 80_000 and got[4] == got[1] + got[2] - got[3]  # each shared end saves one link
    assert run(spark, []) == [] and run(spark, [(1, None)]) == [(1, 0, 0, 0, 0, "", 0, 0)]


def test_query_over_the_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").where("length(text) < 700").collect()]
    got = QUERIES["op13_arrow_token_alignment"](spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    got = {r.doc_id: r for r in got.collect()}
    for i, a, b, g, links, groups, _, _ in brute(rows):  # counts are over all texts, so they are checked on fixtures
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (a, b, g, links)
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
    assert len(got) == table(spark, SF, "documents").count()
