"""Main text of web pages by paths that the pages of a host agree on.

Every page scores its containers, a container inside an article or main for that one; the tag-class paths of the best ones, with
numbers in class names generalised, are votes that Spark adds up per host. A host has a leading path and further templates, the paths
that several of its pages put first. The text is taken from the element at the first of them that holds enough of the page's own
score, else at the leading path, or, on a page that has no such element, from the page's own best container.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import url_parts, written

#: Containers of a page that vote, the best first.
VOTES = 3
#: Pages that must put a path first for it to be a template of its host beside the leading one.
TEMPLATE_PAGES = 3
#: Share of a page's own score that a path must hold to be taken before the host's other ones.
TEMPLATE_SHARE = 0.3
#: More winning paths than this are joined by a shuffle instead of being sent to every task.
BROADCAST_HOSTS = 200_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html body div article section main td blockquote center fieldset details dd".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt table thead tbody tfoot tr th caption pre figure figcaption address hr header footer nav aside form summary hgroup menu".split()
)
#: Elements whose whole content is left out.
LEFT_OUT = frozenset(
    "head script style noscript template nav footer aside form menu iframe object svg canvas select button textarea dialog audio video title".split()
)
#: Elements that are left out where they are marked; headings, paragraphs, inline elements and what else holds text itself never are.
MARKED = frozenset("div section ul ol dl table td center fieldset details".split())
#: Words in class, or whole ids or roles, that mark menus, adverts, notices, sidebars and reader comments.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion banner banners popup modal overlay "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc sidebar sidebars aside widget widgets "
    "header masthead topbar footer footers copyright legal cookie cookies consent gdpr notice notices alert alerts "
    "comment comments commentlist disqus replies respond reply discussion "
    "share sharing social follow subscribe subscription newsletter signup login related recommended recommendations contentinfo complementary search".split()
)
_WORD = re.compile(r"[a-z]+")
_NUMBER = re.compile(r"\d+")
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"}),
}
_HOLDS_P = frozenset("html body div article section main td th blockquote li table button dd form".split())


def _left_out(tag: str, attrs: dict[str, str | None], inside: bool) -> bool:
    """Whether an element and all in it is none of the main text; `inside`: it lies in an article."""
    if tag in LEFT_OUT or tag == "header" and not inside or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    if tag not in MARKED:
        return False
    names = [(attrs.get(a) or "").strip().lower() for a in ("id", "role")]
    return not MARKS.isdisjoint(names) or not MARKS.isdisjoint(_WORD.findall((attrs.get("class") or "").lower()))


class Page(HTMLParser):
    """Containers (path, parent) and text blocks (container or block it stands in, text, characters in links) of a page, in order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.paths, self.parents, self.holds = ["#"], [-1], [True]  # per element: path, parent element, is a container
        self.blocks: list[tuple[int, str, int]] = []
        self.stack: list[tuple[str, int, bool, bool]] = []  # tag, element, left out, inside an article
        self.pending, self.linked = [], 0
        self.feed(html)
        self.close()
        self._flush()

    def _at(self) -> tuple[int, bool, bool]:
        return self.stack[-1][1:] if self.stack else (0, False, False)

    def _flush(self) -> None:
        if self.pending:
            text = " ".join("".join(self.pending).split())
            if text:
                self.blocks.append((self._at()[0], text, self.linked))
            self.pending, self.linked = [], 0

    def _pop_to(self, tags: frozenset | set, barrier: frozenset | set = frozenset()) -> None:
        """Closes the innermost element of `tags`, with what is open in it, unless a barrier lies between."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in tags:
                if any(x[0] in BLOCKS for x in self.stack[k:]):
                    self._flush()
                del self.stack[k:]
                return
            if self.stack[k][0] in barrier:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("br", "hr", "img"):
            self.pending.append(" ")
        if tag in BLOCKS:
            self._flush()
            if tag not in ("html", "body"):
                self._pop_to({"p"}, _HOLDS_P)
        if tag in _CLOSES:
            self._pop_to(*_CLOSES[tag])
        if tag in VOID:
            return
        element, out, inside = self._at()
        named = dict(attrs)
        out = out or _left_out(tag, named, inside)
        if tag in BLOCKS:
            classes = "".join(f".{_NUMBER.sub('0', c)}" for c in sorted(set((named.get("class") or "").lower().split())))
            self.paths.append(f"{self.paths[element]}/{tag}{classes}")
            self.parents.append(element)
            self.holds.append(tag in CONTAINERS)
            element = len(self.paths) - 1
        self.stack.append((tag, element, out, inside or tag in ("article", "main")))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash in a start tag of HTML means nothing

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        self._pop_to({tag}, frozenset() if tag in BLOCKS or tag in LEFT_OUT else BLOCKS)

    def handle_data(self, data: str) -> None:
        if self._at()[1]:
            return
        self.pending.append(data)
        if any(x[0] == "a" for x in self.stack[-4:]):
            self.linked += len(data.strip())

    def unknown_decl(self, data: str) -> None:
        pass

    def _containers(self, element: int) -> Iterator[int]:
        while element >= 0:
            if self.holds[element]:
                yield element
            element = self.parents[element]

    def _widened(self) -> list[int]:
        """Per element the innermost article around or at it, else the innermost main, else itself."""
        article, main = [-1], [-1]  # parents come before their children
        for i in range(1, len(self.paths)):
            tag, parent = self.paths[i].rsplit("/", 1)[-1].split(".", 1)[0], self.parents[i]
            article.append(i if tag == "article" else article[parent])
            main.append(i if tag == "main" else main[parent])
        return [a if a >= 0 else m if m >= 0 else i for i, (a, m) in enumerate(zip(article, main))]

    def scores(self) -> dict[int, float]:
        """Per container: characters outside links of its own blocks, and half of those one container further in.

        Containers in an article or main count for that one, so that title and siblings stay together.
        """
        found: dict[int, float] = {}
        for element, text, linked in self.blocks:
            value = max(len(text) - 2 * linked, 0)
            if value:
                for container, share in zip(self._containers(element), (1.0, 0.5)):
                    found[container] = found.get(container, 0.0) + share * value
        widened, out = self._widened() if found else [], {}
        for container, value in found.items():
            out[widened[container]] = out.get(widened[container], 0.0) + value
        return out

    def best(self) -> list[tuple[str, float]]:
        """Paths of the best containers with their share of the page's score; equal scores go to the outer one."""
        scores = self.scores()
        total = sum(scores.values())
        top = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:VOTES]
        return [(self.paths[c], s / total) for c, s in top]

    def _under(self, path: str) -> list[str]:
        """The blocks under the elements at the path."""
        under = set()
        for i, p in enumerate(self.paths):  # parents come before their children
            if p == path or self.parents[i] in under:
                under.add(i)
        return [t for element, t, _ in self.blocks if element in under]

    def text(self, paths: list[str] | None) -> tuple[str, str | None]:
        """The blocks under the first of the host's paths with enough of the score, else its leading one, else the page's best container; with the path used."""
        scores, held = self.scores(), {}
        for c, value in scores.items():
            held[self.paths[c]] = held.get(self.paths[c], 0.0) + value
        need = TEMPLATE_SHARE * sum(scores.values())
        first = [p for p in paths or () if held.get(p, 0.0) >= need and p in held][:1]
        own = [self.paths[min(scores, key=lambda c: (-scores[c], c))]] if scores else []
        for wanted in (*first, *(paths or ())[:1], *own):
            blocks = self._under(wanted)
            if blocks:
                return "\n".join(blocks), wanted
        return "\n".join(t for _, t, _ in self.blocks), None


def votes(pages: DataFrame) -> DataFrame:
    """`host, path, pages, weight, first`: pages whose best containers lie at the path, their shares of the scores, and how many put it first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, p, w, k == 0) for h, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, (p, w) in enumerate(Page(html or "").best())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64(), pa.bool_()))], ["host", "path", "weight", "first"])

    each = pages.select(url_parts(F.col("url"))[0].alias("host"), "html").mapInArrow(run, "host string, path string, weight double, first boolean")
    return each.groupBy("host", "path").agg(
        F.count("*").alias("pages"), F.sum(F.round("weight", 6).cast("decimal(20,6)")).alias("weight"), F.count_if("first").alias("first")
    )


def winners(pages: DataFrame) -> DataFrame:
    """`host, paths`: the path with the most weight, then the templates, in the same order: ties go to more pages, then to the path that sorts first."""
    found = written(votes(pages), "votes")
    order = F.struct((-F.col("weight")).alias("w"), (-F.col("pages")).alias("n"), "path")
    leading = found.groupBy("host").agg(F.min(order).alias("v"))
    others = found.where(F.col("first") >= TEMPLATE_PAGES).select("host", order.alias("v"))
    return leading.unionByName(others).groupBy("host").agg(F.array_sort(F.collect_set("v"))["path"].alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """`page_id, url, text, n_chars, host, path` for every row of `pages(page_id, url, html)`.

    A null or empty page gives an empty text and a null path; a null url or one without :// votes with the empty host. Repeated rows
    are extracted one by one (each has its vote). Other columns are not looked at; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [Page(html or "").text(paths) for html, paths in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array([t for t, _ in found], pa.string()), pa.array([p for _, p in found], pa.string())], ["page_id", "url", "host", "text", "path"]
                )

    paths = written(winners(pages), "paths")
    small = (paths.agg(F.sum(F.size("paths"))).first()[0] or 0) <= BROADCAST_HOSTS
    rows = pages.select("page_id", "url", url_parts(F.col("url"))[0].alias("host"), "html").join(F.broadcast(paths) if small else paths, "host", "left")
    rows = rows.select("page_id", "url", "host", "html", "paths")
    kind = rows.schema["page_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"page_id {kind}, url string, host string, text string, path string")
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "host", "path")
