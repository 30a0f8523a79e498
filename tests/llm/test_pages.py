"""Main text and url rules: small pages, and brute force over whole tables."""

import re
from html import unescape
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from barloom.llm import host_paths, url_rules
from barloom.llm.common import table
from barloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def body(inner, **attrs):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><p>Head of site</p></header><nav><ul><li><a href=/>Home</a></ul></nav>{inner}<footer>Foot &copy;</footer></body></html>"


LONG = "Some words of the story that go on for a while, enough of them."
CASES = [
    (body(f"<article><h1>A &amp; B</h1><p>{LONG}</p><p>x<br>y  \n z&nbsp;q</p></article>"), f"A & B\n{LONG}\nx y z q"),
    (body(f"<div class='post-12'><p>{LONG}<p>Two<div class=ad>Buy this now, really, now</div><aside>Side</aside><form><p>Mail</p></form></div>"), f"{LONG}\nTwo"),
    (body(f"<main><p>{LONG}</p><script>if (a < b) document.write('<p>no</p>')</script><!-- <p>no</p> --><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></main>"), f"{LONG}\none\ntwo\na\nb"),
    (body(f"<div id='content'><p>{LONG}</p></div><div id='comments'><p>{LONG} {LONG} a reader wrote</p></div>"), LONG),
    (body(f"<div class='cookie-notice'><p>{LONG} {LONG}</p></div><section><p>{LONG}</p></section>"), LONG),
    (body(f"<article><p><b>{LONG}<br><p>next</p></article>"), f"{LONG}\nnext"),
    (f"plain text\n without tags {LONG}", f"plain text without tags {LONG}"),
    ("", ""), (None, ""), ("<p>", ""), ("<article><p>open &lt; end &#8364; &nosuch; a < b", "open < end € &nosuch; a < b"),
]


@pytest.mark.parametrize("html,want", CASES)
def test_single_pages(html, want):
    assert host_paths.Page(html or "").text(None)[0] == want


@pytest.mark.parametrize("html,want", [
    (body(f"<article><header class='entry-header'><h1>Title</h1></header><p>{LONG}</p></article>"), f"Title\n{LONG}"),
    (body(f"<article><h2 id='related-work'>Related work</h2><p class='notice'>{LONG}</p><h2 id='follow-the-money'>Follow</h2><p>a <span class='search'>b</span> c</p></article>"), f"Related work\n{LONG}\nFollow\na b c"),
    (body(f"<article><p>{LONG}</p><div id='legal-history'><p>old</p></div><ul id='discussion-points'><li>one</ul><div class='social-share'>Share</div><ul id='toc'><li>two</ul><div role='search'>Find</div></article>"), f"{LONG}\nold\none"),
])
def test_marks_are_for_containers(html, want):
    """Headings, paragraphs, inline elements and the header of an article stay whatever their names; ids and roles count as a whole."""
    assert host_paths.Page(html).text(None)[0] == want


def test_the_host_decides(spark):
    """A page whose longest text is a teaser list follows the other pages of its host; a page of another shape goes by itself."""
    plain = [(i, "http://A.example/x", f"<body><div class='c{i}'><p>{LONG} {i}</p></div><section><p>short</p></section></body>") for i in range(5)]
    odd = (9, "https://a.example?q", f"<body><div class='c7'><p>Brief.</p></div><section><p>{LONG}</p><p>{LONG}</p></section></body>")
    other = (10, "http://a.example/y", f"<body><td><p>{LONG}</p></td></body>")
    rows = [*plain, odd, other, (11, None, f"<body><p>{LONG}</p></body>"), (None, "no host", None), (9, *odd[1:])]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, path string")
    got = host_paths.extract(pages).collect()
    assert len(got) == len(rows) and {r.text for r in got if r.page_id == 9} == {"Brief."}
    assert {r.page_id: r.path for r in got}[2] == "#/body/div.c0" and {r.page_id: r.text for r in got}[10] == LONG
    assert {r.page_id: (r.text, r.n_chars) for r in got}[None] == ("", 0) and {r.page_id: r.text for r in got}[11] == LONG
    assert host_paths.extract(pages.limit(0)).count() == 0


def test_title_and_siblings_stay():
    """The best container stands for the article or main around it."""
    inner = f"<h1>Title</h1><div class='entry-content'><p>{LONG}</p></div><p>End</p>"
    for tag in ("article", "main"):
        assert host_paths.Page(body(f"<{tag}>{inner}</{tag}><div><p>Other</p></div>")).text(None) == (f"Title\n{LONG}\nEnd", f"#/html/body/{tag}")


def test_two_templates_of_a_host(spark):
    """Pages of the rarer template, on which the leading path holds a short text, keep their own."""
    often = [(i, "http://h.example/x", f"<body><div class='a'><p>{LONG} {i}</p></div><section><p>short</p></section></body>") for i in range(6)]
    rare = [(i, "http://h.example/y", f"<body><div class='a'><p>Brief.</p></div><section><p>{LONG}</p><p>{LONG} {i}</p></section></body>") for i in range(6, 9)]
    got = {r.page_id: r for r in host_paths.extract(spark.createDataFrame(often + rare, "page_id long, url string, html string")).collect()}
    assert all(got[i].text == f"{LONG} {i}" for i in range(6)) and all(got[i].text == f"{LONG}\n{LONG} {i}" for i in range(6, 9))


def test_extraction_over_the_whole_table(spark):
    html = {r.page_id: r.html or "" for r in table(spark, SF, "pages").collect()}
    rows = QUERIES["op1_consensus_host_paths"](spark, SF).collect()
    assert len(rows) == len(html)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        blocks = (" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]


def plain_rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


URLS = [
    "http://EXAMPLE.org/es/1", "http://a.example.org/en/12", "http://notexample.org/es/", "http://x.com/fr/", "https://com/de/a?b=c", "http://x.com/de", "ftp://x.org",
    "http://x.org#/es/", "no host", "", None, "http://É.org/x", "a://b://c/d", "http://org/", "http://example.org?/es/", "http:///path", "x://h\n.org/\nq",
]


def test_fixed_rules(spark):
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(URLS)] + [(None, URLS[0], "z")] * 2, "page_id long, url string, host string")
    none = spark.createDataFrame([], "items array<string>, item string, bad bigint, labelled bigint, confidence double")
    rows = url_rules.judge(pages, none).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        url = URLS[0 if r.page_id is None else r.page_id]
        rule, verdict = plain_rule(*plain_parts(url))
        assert (r.host, r.path, r.rule, r.verdict) == (*plain_parts(url), rule, verdict or "allow"), url
    assert url_rules.judge(pages.limit(0), none).count() == 0


def brute_rules(rows, support, confidence, least):
    """Every combination of tokens counted by itself; rows are (tokens, bad)."""
    need, bad, both = max(least, support * len(rows)), {}, {}
    for tokens, is_bad in rows:
        for k in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), k):
                both[c] = both.get(c, 0) + 1
                bad[c] = bad.get(c, 0) + is_bad
    sure = {c for c, n in bad.items() if n >= need and n / both[c] >= confidence}
    return {c: (bad[c], both[c]) for c in sure if not any(set(d) < set(c) for d in sure)}


@pytest.fixture(scope="module")
def urls(spark):
    rows = []
    for i in range(400):
        spam = i % 4 == 0
        host = ("www.pills" if i % 8 == 0 else "blog.news") + f"{i % 3}.net"
        rows.append((i, f"http://{host}/{'buy' if spam and i % 3 else 'en'}/{i}" + ("?ref=1&page=2" if spam else "#top" if i % 5 else ".html"), int(not (spam and i % 7))))
    pages = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, "nothing")], "page_id long, url string")
    return pages, spark.createDataFrame([(r[0], r[2]) for r in rows] + [(900, 0), (901, 0), (0, 1), (None, 0), (5, 4)], "doc_id long, quality int")


def test_mined_rules_against_every_combination(spark, urls):
    pages, labels = urls
    label = {}
    for r in labels.collect():
        if r.quality in (0, 1):
            label[r.doc_id] = min(label.get(r.doc_id, 1), r.quality)
    sets = {r.page_id: r.t for r in pages.select("page_id", url_rules.tokens(F.col("url")).alias("t")).collect()}
    assert sets[900] == sets[901] == [] and all(len(t) <= 11 for t in sets.values())
    want = brute_rules([(t, 1 - label[i]) for i, t in sets.items() if t and i in label], 0.02, 0.7, 5)
    mined = url_rules.mine(pages, labels, support=0.02, confidence=0.7)
    assert want and {tuple(r["items"]): (r.bad, r.labelled) for r in mined.collect()} == want
    for r in url_rules.judge(pages, mined).collect():
        hit = any(set(c) <= set(sets[r.page_id]) for c in want)
        assert r.rule or r.verdict == ("block" if hit else "allow") and hit == (r.mined is not None)


@pytest.mark.parametrize("part,bad", [
    ("k:ref", lambda i: f"http://a{i}.x{i}.org/{i}?ref=1&q{'abcdefgh'[i % 8]}{'xyz'[i % 3]}=2"),
    ("p:casino", lambda i: f"http://a{i}.x{i}.org/{'/'.join('abc'[: i % 3])}/casino/{'uvw'[i % 3]}"),
    ("w:pills", lambda i: f"http://a{i}.x{i}.org/{'abcdefgh'[i % 8]}-pills-{'xyz'[i % 3]}.html"),
    ("s:bets", lambda i: f"http://a{i}.bets.x{i}.org/"),
    ("d:spam.x.org", lambda i: f"http://{'abcdefgh'[i % 8]}{i}.spam.x.org/" if i else "http://spam.x.org/"),
])
def test_tokens_that_bad_urls_share(spark, part, bad):
    """One key, segment, word, label or suffix among varying others is found and blocks."""
    n = 24
    rows = [(i, bad(i), 0) for i in range(n)] + [(100 + i, re.sub("ref|casino|pills|bets|spam", f"fine{'abc'[i % 3]}", bad(i)), 1) for i in range(n)]
    frame = spark.createDataFrame(rows, "page_id long, url string, quality int")
    mined = url_rules.mine(frame, frame.withColumnRenamed("page_id", "doc_id"), confidence=0.9)
    assert [part] in [r["items"] for r in mined.collect()]
    got = {r.page_id: r for r in url_rules.judge(frame, mined, ()).collect()}
    assert all(got[i].verdict == "block" for i in range(n)) and all(got[100 + i].verdict == "allow" for i in range(n))


def test_without_bad_urls(spark, urls):
    pages, labels = urls
    assert url_rules.mine(pages, labels.where("quality = 1")).count() == 0 and url_rules.mine(pages.limit(0), labels).count() == 0


def test_url_query_over_the_whole_table(spark):
    pages = {r.page_id: r.url for r in table(spark, SF, "pages").collect()}
    rows = QUERIES["op8_association_url_rules"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        rule, verdict = plain_rule(*plain_parts(pages[r.page_id]))
        assert (r.host, r.path, r.rule) == (*plain_parts(pages[r.page_id]), rule) and verdict in (None, r.verdict)
