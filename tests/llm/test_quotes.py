"""Quotation linking on small conversations and against a brute-force reading of random ones."""

import random

import pytest

from barloom.llm import quotes
from barloom.llm.common import table
from barloom.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, position int"


def run(spark, rows):
    return quotes.linked(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)).collect()


def test_nested_levels():
    text = "Hi\n\nAnn wrote:\n> first\n> second\n>> deep one\n> > deep two\n\n>third\nmine\n > odd"
    assert quotes.passages(text) == [(0, ["Hi", ""]), (1, ["first", "second"]), (2, ["deep one", "deep two"]), (1, ["third"]), (0, ["mine"]), (1, ["odd"])]
    assert quotes.without_quotes(text) == "Hi\nmine" and quotes.without_quotes("") == "" and quotes.without_quotes("> a") == ""


def test_links_and_order(spark):
    a, b = "Shall we meet on Monday?\nOr is Tuesday better?", "Monday is fine."
    rows = [
        (1, 0, "user", a), (1, 1, "user", "Another matter."), (1, 2, "user", f"> {a.splitlines()[0]}\n{b}"), (1, 3, "user", f"X wrote:\n>  {b.upper()}\n> > Shall we meet\n> > on Monday?\nGood."),
        (1, 4, "user", "> Another matter.\nWhich?"), (1, 5, "user", "> nobody said this\nHello"), (2, 1, "user", f"> {b}\nother conversation"),
        (1, None, "user", "> Another matter."), (None, 0, "user", None), (None, 3, "user", "> a"),
    ]
    got = {(r.conv_id, r.turn): r for r in run(spark, rows)}
    assert len(got) == len(rows)
    assert [got[1, t].parent for t in range(6)] == [None, None, 0, 2, 1, None] and [got[1, t].depth for t in range(6)] == [0, 0, 1, 2, 1, 0]
    assert [got[1, t].thread for t in range(6)] == [0, 1, 0, 0, 1, 5] and got[2, 1].parent is None
    order = [r.turn for r in sorted(got.values(), key=lambda r: r.position) if r.conv_id == 1 and r.turn is not None]
    assert order == [0, 2, 3, 1, 4, 5] and got[1, 3].text == "Good." and got[1, 2].text == b
    assert sorted(r.position for r in got.values() if r.conv_id == 1) == list(range(7)) and sorted(r.position for r in got.values() if r.conv_id is None) == [0, 1]


def test_the_last_earlier_holder_counts(spark):
    rows = [(1, t, "u", "same words") for t in (0, 5, 9)] + [(1, 7, "u", "> same words\nyes"), (1, 20_000, "u", "> same words\nlate"), (1, 0, "u", "same words")]
    got = run(spark, rows)
    assert len(got) == 6 and {r.turn: r.parent for r in got if r.parent is not None} == {7: 5, 20_000: 9}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(quotes, "SPAN", 4)
    r, rows, said = random.Random(seed), [], {}
    for turn in range(40):
        for conv in range(4):
            own = f"line {r.randrange(30)} here\nand {r.randrange(5)} too"
            earlier = said.setdefault(conv, [])
            quoted = r.choice(earlier).split("\n") if earlier and r.random() < 0.6 else []
            if quoted and r.random() < 0.4:
                quoted = quoted[:1]
            earlier.append(own)
            rows.append((conv, turn, "u", "\n".join(f"> {x}" for x in quoted) + ("\n" if quoted else "") + own))
    want = {}
    for conv, turn, _, text in rows:
        votes = {}
        for level, lines in quotes.passages(text):
            for key, weight in quotes.keys(lines).items() if level == 1 else ():
                holders = [t for c, t, _, x in rows if c == conv and t < turn and any(key in quotes.keys(ls) for lv, ls in quotes.passages(x) if lv == 0)]
                if holders:
                    votes[max(holders)] = votes.get(max(holders), 0) + weight
        want[conv, turn] = max(votes, key=lambda t: (votes[t], t)) if votes else None
    got = {(r.conv_id, r.turn): r for r in run(spark, rows)}
    assert {k: r.parent for k, r in got.items()} == want and any(r.depth > 2 for r in got.values())
    for r in got.values():
        assert r.parent is None or got[r.conv_id, r.parent].position < r.position and got[r.conv_id, r.parent].depth + 1 == r.depth


def test_formatting_and_empty_table(spark):
    rows = quotes.linked(spark.createDataFrame([(1, t, "u", str(t), 0) for t in range(10)], SCHEMA))
    pieces = sorted(quotes.formatted(rows, 4).collect(), key=lambda r: r.piece)
    assert [[m.turn for m in p.messages] for p in pieces] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    assert quotes.linked(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {(r.conv_id, r.turn): r.text for r in table(spark, sf, "conversations").collect()}
    rows = QUERIES["op3_quotation_linking"](spark, sf).collect()
    assert len(rows) == len(texts)
    assert all(r.text == quotes.without_quotes(texts[r.conv_id, r.turn] or "") for r in rows)
