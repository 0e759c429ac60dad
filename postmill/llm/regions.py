"""Main text of HTML pages by the maximum-scoring contiguous region.

A page becomes a sequence of tokens, words and tags. Words score by where they stand (the block
they are in, whether in a link, whether in an element that is marked as a menu, an advert and so on); tags score
below zero, so a region pays for markup it takes in. One linear scan (Kadane) finds the region with the highest sum; its
blocks, without those in marked elements, are the text.

The weights are log odds learned from labelled pages: pages that mark their article themselves, by ``article``,
``main`` or the like. All of them are counted, in the map tasks first, over a bounded set of features, so the
model is a small table whatever the number of pages. Places that no labelled page has fall back to a prior.
On a page that marks its article, a strong prior for words inside and against words outside is added.

Blocks are what block-level tags and line breaks part; character references are decoded, white space inside a block
becomes one space, empty blocks go, and the others are joined by a line feed in page order.

Behaviour: null and empty pages, and pages without a positive word, give the empty text; text without any tag is one block; repeated
rows are treated alike; unclosed and stray tags are taken as browsers take them, roughly; without labelled pages
the priors alone decide. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .registry import query

# Elements of HTML by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes noscript".split())
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are no part of an article, whatever they hold.
MARKED = {
    "nav": "menu", "menu": "menu", "footer": "footer", "aside": "side", "form": "form", "select": "form", "button": "form", "datalist": "form",
    "fieldset": "form", "dialog": "notice", "search": "form", "template": "code", "svg": "code", "object": "code", "canvas": "code", "audio": "code",
    "video": "code", "map": "code", "head": "head", "header": "header",
}
#: Words of class, id and role that say the same of any element.
MARKS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toolbar pagination pager paging toc skip",
    "ad": "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted",
    "side": "sidebar side aside rail complementary related recommended recommendations widget widgets",
    "notice": "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay disclaimer",
    "comments": "comment comments commentlist disqus respond reply replies discussion",
    "form": "form newsletter subscribe subscription signup login search",
    "share": "share sharing social",
    "header": "header masthead topbar",
    "footer": "footer copyright contentinfo colophon",
}
MARK_OF = {word: kind for kind, words in MARKS.items() for word in words.split()}
ARTICLE_ROLES = ("main", "article")
#: Whole names of class and id that boxes around an article often have; they count where no element says it by its tag or role.
ARTICLE_NAMES = set("content main main-content maincontent article article-body article-content entry entry-content post post-body post-content story story-body".split())
#: Tags that end an open element of their own kind, up to the element that bounds it.
CLOSED_BY = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("thead", "tbody", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select", "datalist", "optgroup")), "optgroup": (("option", "optgroup"), ("select",)),
}
ENDS_P = BLOCK - {"br", "body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup"}

MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+>?|</[^a-zA-Z>][^>]*+>?|</>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>",
    re.S,
)
MARKING = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS_OF_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
END_OF = {name: re.compile(f"</{name}(?=[\\s/>]|$)", re.I) for name in RAW}

PSEUDO = 20.0  # words that a prior counts for
CLAMP = 4.0
INSIDE, OUTSIDE = 6.0, -6.0
DIP = 2.0  # what a marked element costs a region that goes across it
TAG_LEAST, TAG_MOST = 0.1, 2.0
DEPTH = 512  # elements open at a time, as in browsers; what is opened beyond counts as part of the one around it


class Element:
    """An open element: what it is marked as, and whether it is a link."""

    __slots__ = ("link", "mark", "name", "number")

    def __init__(self, name: str, number: int, mark: str | None, link: bool):
        self.name, self.number, self.mark, self.link = name, number, mark, link


class Page:
    """Blocks and tags of a page in order.

    ``blocks`` holds (text, words, innermost block tag, words in links, element); ``elements`` holds (parent, mark, name, how surely
    it is the article) of every element, parents first; ``tokens`` holds a tag's name or a block's index.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, str, int, int]] = []
        self.elements: list[tuple[int, str | None, str, int]] = [(-1, None, "", 0)]
        self.tokens: list[str | int] = []
        self.parse(source)

    def parse(self, source: str) -> None:
        stack = [Element("", 0, None, False)]
        texts: list[tuple[str, bool]] = []

        def flush():
            if texts:
                words = "".join([t for t, _ in texts]).split()
                if words:
                    linked = sum(len(t.split()) for t, link in texts if link)
                    block = next((e.name for e in reversed(stack) if e.name in BLOCK), "")
                    self.tokens.append(len(self.blocks))
                    self.blocks.append((" ".join(words), len(words), block, min(linked, len(words)), stack[-1].number))
                texts.clear()

        def close(names, bounds) -> None:
            """Close the outermost open element of ``names`` above the innermost of ``bounds``."""
            found = None
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in names:
                    found = i
                elif stack[i].name in bounds:
                    break
            if found is not None:
                del stack[found:]

        at, n = 0, len(source)
        while at < n:
            match = MARKUP.search(source, at)
            start = match.start() if match else n
            if start > at:
                texts.append((entities.unescape(source[at:start]), stack[-1].link))
            if match is None:
                break
            at = match.end()
            name = match["name"]
            if name is None:
                continue
            name = name.lower()
            if name in BLOCK:
                flush()
            self.tokens.append(name)
            if match["close"]:
                if name == "p" and all(e.name != "p" for e in stack):
                    continue
                close((name,), ()) if name in ("body", "html", "article", "main") else self.close_last(stack, name)
                continue
            rest = match["rest"]
            if name in RAW:
                end = END_OF[name].search(source, at)
                stop = end.start() if end else n
                tail = source.find(">", stop) if end else -1
                at = tail + 1 if tail >= 0 else n
                continue
            if name in VOID or (rest.endswith("/") and name not in BLOCK):
                continue
            if name == "body":
                close(("head",), ())
            if name in ENDS_P:
                close(("p",), ("div", "section", "article", "main", "td", "th", "li", "blockquote", "button", "object"))
            if name in CLOSED_BY:
                close(*CLOSED_BY[name])
            if len(stack) > DEPTH:
                continue
            mark, article = self.marked(name, rest)
            above = stack[-1]
            self.elements.append((above.number, mark, name, article))
            stack.append(Element(name, len(self.elements) - 1, mark, above.link or name == "a"))
        flush()

    @staticmethod
    def close_last(stack: list[Element], name: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name == name:
                del stack[i:]
                return
            if stack[i].name in ("article", "main", "body"):
                return  # a stray end tag does not reach beyond these

    @staticmethod
    def marked(name: str, rest: str) -> tuple[str | None, int]:
        """What an element is marked as, and whether it says that it holds the article: 2 by tag or role, 1 by a name."""
        mark, article = MARKED.get(name), 2 if name in ("article", "main") else 0
        if name in ("html", "body"):
            return None, 0
        if rest:
            for key, *values in MARKING.findall(rest):
                value = "".join(values)
                if name in ("article", "main"):  # only a whole name marks these, not a part of one
                    words = value.lower().split()
                else:
                    words = [w.lower() for w in WORDS_OF_NAME.findall(value)]
                if key.lower() == "itemprop":
                    article = 2 if value.lower() == "articlebody" else article
                elif key.lower() == "role":
                    article = 2 if len(words) == 1 and words[0] in ARTICLE_ROLES else article
                    mark = mark or next((MARK_OF[w] for w in words if w in MARK_OF), None)
                else:
                    mark = mark or next((MARK_OF[w] for w in words if w in MARK_OF), None)
                    article = article or int(not ARTICLE_NAMES.isdisjoint(value.lower().split()))
        if name in ("article", "main") and mark not in ("comments", "ad", "side"):
            mark = None
        return mark, article if mark is None else 0

    def read(self) -> tuple[list[str | None], list[bool], bool]:
        """For every element its mark or that of what it lies in, and whether it lies in the page's article; whether there is one."""
        count = len(self.elements)
        own = [0] * count
        depth = [0] * count  # marks around an element, of those that an article never has around it
        hard = ("comments", "ad", "side", "menu", "footer", "code", "form")
        for k, (parent, mark, _, _) in enumerate(self.elements):
            depth[k] = (depth[parent] if k else 0) + (mark in hard)
        for _, words, _, _, element in self.blocks:
            own[element] += words
        for k in range(count - 1, 0, -1):
            parent = self.elements[k][0]
            if depth[parent] == depth[k]:
                own[parent] += own[k]
        best = None
        surest = max(e[3] for e in self.elements)
        named = [k for k in range(count) if 0 < self.elements[k][3] == surest]
        if named:
            least = min(depth[k] for k in named)
            found = [k for k in named if depth[k] == least]
            best = max(found, key=lambda k: (own[k], k))
            inner = [k for k in found if self.elements[k][2] == "article" and 2 * own[k] >= own[best]]
            best = max(inner, key=lambda k: (own[k], -k)) if inner else best
        holds, k = set(), best
        while k is not None and k > 0:  # what lies around the article is no advert
            holds.add(k)
            k = self.elements[k][0]
        marks: list[str | None] = [None] * count
        inside = [False] * count
        for k in range(1, count):
            parent, mark, name, _ = self.elements[k]
            inside[k] = k == best or inside[parent]
            if k in holds or (name == "header" and inside[k]):
                mark = None
            marks[k] = marks[parent] or mark
        return marks, inside, best is not None


def places(page: Page, marks: list[str | None]) -> list[str]:
    """The feature of each block's words: mark, block tag, mostly link or not."""
    return [f"{marks[e] or ''}|{name}|{'a' if 2 * linked > n else ''}" for _, n, name, linked, e in page.blocks]


def known(name: str) -> str:
    return name if name in BLOCK or name in VOID or name in MARKED or name in ("a", "b", "i", "em", "strong", "span") else "other"


def prior(feature: str) -> float:
    """The share of words that lie in articles, for a place no labelled page has."""
    mark, name, link = feature.split("|")
    if mark:
        return 0.05
    if link:
        return 0.15
    return 0.9 if name in ("p", "h1", "h2", "h3", "pre", "blockquote", "figcaption") else 0.75


def learn(pages: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of words by place, and costs of tags by name, from all pages that mark their article.

    Features are combinations of fixed names, so the counts that reach the driver are bounded.
    """

    def run(batches):
        counts: dict[tuple[str, bool], list[int]] = {}
        for batch in batches:
            for source in batch.column(0).to_pylist():
                if not source:
                    continue
                page = Page(source)
                marks, inside, labelled = page.read()
                if not labelled:
                    continue
                found = places(page, marks)
                within = False
                for token in page.tokens:
                    if isinstance(token, int):
                        within = inside[page.blocks[token][4]]
                        counts.setdefault((found[token], True), [0, 0])[within] += page.blocks[token][1]
                    else:
                        counts.setdefault((known(token), False), [0, 0])[within] += 1
        yield pa.RecordBatch.from_pydict({
            "feature": pa.array([f for f, _ in counts], pa.string()), "word": pa.array([w for _, w in counts], pa.bool_()),
            "outside": pa.array([n[0] for n in counts.values()], pa.int64()), "inside": pa.array([n[1] for n in counts.values()], pa.int64()),
        })

    counted = pages.select("html").mapInArrow(run, "feature string, word boolean, outside long, inside long")
    rows = counted.groupBy("feature", "word").agg(F.sum("outside").alias("outside"), F.sum("inside").alias("inside")).collect()
    words, tags = {}, {}
    for feature, word, outside, inside in rows:
        if word:
            words[feature] = log_odds(inside, outside, prior(feature))
        else:
            tags[feature] = TAG_LEAST + (TAG_MOST - TAG_LEAST) * (outside + 1) / (inside + outside + 2)
    return words, tags


def log_odds(inside: int, outside: int, share: float) -> float:
    odds = math.log((inside + PSEUDO * share) / (outside + PSEUDO * (1 - share)))
    return max(-CLAMP, min(CLAMP, odds))


def region(scores: list[float]) -> tuple[int, int]:
    """First and one past the last of the run with the highest sum, the first and longest of equals; (0, 0) if none is above zero."""
    best, where, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += score
        if total > best or (total == best > 0 and where[0] == start):
            best, where = total, (start, i + 1)
    return where


def main_text(source: str | None, weights: tuple[dict[str, float], dict[str, float]]) -> str:
    if not source:
        return ""
    words, tags = weights
    page = Page(source)
    marks, inside, labelled = page.read()
    scores = []
    within = False
    found = places(page, marks)
    titled = any(name == "h1" and inside[e] and not marks[e] for _, _, name, _, e in page.blocks)
    for token in page.tokens:
        if isinstance(token, int):
            _, n, name, _, element = page.blocks[token]
            within = inside[element]
            weight = words.get(found[token])
            weight = log_odds(0, 0, prior(found[token])) if weight is None else weight
            if marks[element]:
                scores.append(-DIP if within or not labelled else min(weight, 0.0) * n)
            elif within:
                scores.append((weight + INSIDE) * n)
            else:  # a headline may stand before an article that has none itself
                scores.append((weight + (OUTSIDE if labelled and (titled or name != "h1") else 0.0)) * n)
        else:
            scores.append(-TAG_LEAST if within else -tags.get(known(token), (TAG_LEAST + TAG_MOST) / 2))
    first, end = region(scores)
    taken = [page.blocks[t] for t in page.tokens[first:end] if isinstance(t, int) and not marks[page.blocks[t][4]]]
    return "\n".join([text for text, *_ in taken])


def extracted(pages: DataFrame, weights: tuple[dict[str, float], dict[str, float]] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; ``weights`` from ``learn`` on these or other pages."""
    weights = learn(pages) if weights is None else weights

    def run(batches):
        for batch in batches:
            texts = [main_text(source, weights) for source in batch.column(2).to_pylist()]
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), lengths], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


@query()
def op12_html_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
