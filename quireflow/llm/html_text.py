"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page becomes a sequence of words and tags. Words score positive, tags and
words in boilerplate (menus, headers, footers, sidebars, notices, adverts,
forms, reader comments) negative; the weights come from labelled pages: those
with an article or main element, whose inside is content. What is boilerplate
inside such an element scores 0, and elsewhere a boilerplate element costs at
most BOILERPLATE_COST, so that a long form doesn't cut an article in two. A
linear scan finds the contiguous region of the highest sum. Its text, without
what lies in boilerplate containers, is the page's: character references decoded, white
space inside a block turned to one space, blocks joined by a line feed.

Null pages count as empty; an empty page, or one without a positive region, has
an empty text. Pages without any labelled page take DEFAULT_WEIGHTS. Repeated
rows are extracted each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages that weights are fitted on, at most.
MAX_PAGES = 2_000
#: Elements whose content is no text of the page.
RAW = {"script", "style", "noscript", "template", "iframe", "title", "textarea", "svg", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Inline elements: their tags end no block and leave no space.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Tags that are white space inside a block.
SPACES = {"br", "td", "th", "rt", "rp", "input"}
#: Elements that a tag closes where they are innermost, as their end tags may be left out.
IMPLIED = {"li": {"li", "p"}, "p": {"p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "option": {"option"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}}
BOILERPLATE_TAGS = {"nav", "footer", "aside", "form", "menu", "button", "select", "dialog"}
BOILERPLATE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form", "alertdialog"}
BOILERPLATE_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "social", "share", "sharing", "comment", "comments", "disqus", "respond", "related", "recommended", "widget", "pagination", "pager", "masthead"}
#: Other words of a class or id that is boilerplate by one of the names above; with any other word it isn't.
NEUTRAL_NAMES = {"site", "page", "global", "main", "top", "bottom", "left", "right", "primary", "secondary", "box", "bar", "container", "wrapper", "wrap", "area", "block", "section", "list", "slot", "unit", "links", "buttons", "form", "header", "thread", "js", "dialog", "panel"}
#: Words of a class or id that names readers' comments, whatever stands beside them; and words that negate.
COMMENT_NAMES = {"comment", "comments", "disqus"}
NEGATIONS = {"no", "has", "with", "without", "not", "non", "is", "hide", "show"}
CONTENT_TAGS = {"article", "main"}
KNOWN_TAGS = ["a", "article", "body", "div", "form", "h1", "h2", "h3", "header", "footer", "li", "main", "nav", "p", "section", "span", "table", "td", "tr", "ul"]
BOILERPLATE_COST = 15.0
DEFAULT_WEIGHTS = {"word": 1.0, "link": 0.3, "boilerplate": -0.4, "tag": -0.3}
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"/?([A-Za-z][^\s/>]*)")
_RAW_END = {tag: re.compile(f"</{tag}(?![A-Za-z0-9])", re.I | re.A) for tag in RAW}


def _boilerplate(tag: str, attributes: str, inside: bool) -> bool:
    if tag in BOILERPLATE_TAGS or tag == "header" and not inside:
        return True
    if not attributes or tag in ("body", "html", *CONTENT_TAGS):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            parts = set(re.split(r"[_\-]+", name))
            if m[1].lower() == "role":
                if name in BOILERPLATE_ROLES:
                    return True
            elif not parts & NEGATIONS and (parts & COMMENT_NAMES or parts & BOILERPLATE_NAMES and parts <= BOILERPLATE_NAMES | NEUTRAL_NAMES):
                return True
    return False


def tokens(page: str) -> Iterator[tuple[str, str, bool, bool, bool]]:
    """(kind, value, in boilerplate, in a link, in a content element) of texts (kind "text") and tags (kind "tag", value: its name)."""
    stack: list[tuple[str, bool, bool]] = []  # name, boilerplate, content
    n_open: Counter = Counter()  # of each name
    at, n = 0, len(page)
    bad = links = content = 0
    no_quote = False

    def pop() -> str:
        nonlocal bad, links, content
        popped, was_bad, was_content = stack.pop()
        n_open[popped] -= 1
        bad, content, links = bad - was_bad, content - was_content, links - (popped == "a")
        return popped

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            yield "text", page[at:lt], bad > 0, links > 0, content > 0
        if lt >= n:
            return
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        following = page[lt + 1 : lt + 2]
        if following in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        name = _NAME.match(page, lt + 1)
        if not name:
            yield "text", "<", bad > 0, links > 0, content > 0
            at = lt + 1
            continue
        gt = page.find(">", name.end())
        if gt < 0:
            return
        if not no_quote and page.count('"', name.end(), gt) % 2:  # a > inside a quoted value
            quote = page.find('"', gt)
            no_quote = quote < 0
            longer = page.find(">", quote) if quote >= 0 else -1
            gt = longer if longer >= 0 and "<" not in page[gt:quote] else gt
        tag, closes, attributes = name[1].lower(), following == "/", page[name.end() : gt]
        at = gt + 1
        if not closes and tag in RAW:
            last = _RAW_END[tag].search(page, at)
            if not last:
                return
            end = page.find(">", last.end())
            at = n if end < 0 else end + 1
            continue
        if closes:
            if n_open[tag]:
                while pop() != tag:
                    pass
            yield "tag", tag, bad > 0, links > 0, content > 0
            continue
        if tag in CONTENT_TAGS:  # an advert that was never closed doesn't hold the article
            while stack and stack[-1][1] and stack[-1][0] not in BOILERPLATE_TAGS:
                pop()
        closed = IMPLIED.get(tag, ())
        while stack and stack[-1][0] in closed:
            if pop() == tag:
                break
        if tag not in VOID and not attributes.endswith("/"):
            is_bad, is_content = _boilerplate(tag, attributes, content > 0), tag in CONTENT_TAGS
            stack.append((tag, is_bad, is_content))
            n_open[tag] += 1
            bad, content, links = bad + is_bad, content + is_content, links + (tag == "a")
        yield "tag", tag, bad > 0, links > 0, content > 0


def _feature(kind: str, value: str, bad: bool, link: bool) -> str:
    if kind == "tag":
        return value if value in KNOWN_TAGS else "tag"
    return "boilerplate" if bad else "link" if link else "word"


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end (exclusive) of the contiguous region of the highest sum; (0, 0) if none is positive."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for k, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += x
        if total > best:
            best, span = total, (start, k + 1)
    return span


def _scores(found: list[tuple[str, str, bool, bool, bool]], weights: dict[str, float]) -> list[float]:
    scores, cost = [], 0.0  # what the boilerplate element has cost so far
    for kind, value, bad, link, content in found:
        score = weights.get(_feature(kind, value, bad, link), weights["tag"]) * (len(value.split()) if kind == "text" else 1)
        if bad:
            score = 0.0 if content else max(score, -BOILERPLATE_COST - cost)
            cost += score
        else:
            cost = 0.0
        scores.append(score)
    return scores


def main_text(page: str, weights: dict[str, float]) -> str:
    """The page's main text."""
    found = list(tokens(page))
    start, end = best_region(_scores(found, weights))
    blocks, block = [], []

    def flush() -> None:
        if text := " ".join("".join(block).split()):
            blocks.append(text)
        block.clear()

    for kind, value, bad, _, _ in found[start:end]:
        if kind == "text":
            if not bad:
                block.append(unescape(value))
        elif value in SPACES:
            block.append(" ")
        elif value not in INLINE:
            flush()
    flush()
    return "\n".join(blocks)


def fit_weights(pages: DataFrame, *, id_column: str = "page_id", html_column: str = "html") -> dict[str, float]:
    """Weights of words by context and of tags, from at most MAX_PAGES labelled pages (those of the least hashes)."""
    labelled = pages.where(F.lower(html_column).rlike("<(?:article|main)[ >]")).select(id_column)
    wanted = labelled.orderBy(F.xxhash64(id_column), id_column).limit(MAX_PAGES)
    sample = pages.select(id_column, html_column).join(F.broadcast(wanted), id_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inside, outside = Counter(), Counter()
            for page in batch.column(0).to_pylist():
                for kind, value, bad, link, content in tokens(page):
                    (inside if content and not bad else outside)[_feature(kind, value, bad, link)] += len(value.split()) if kind == "text" else 1
            names = sorted(inside.keys() | outside.keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([inside[x] for x in names], pa.int64()), pa.array([outside[x] for x in names], pa.int64())], ["name", "inside", "outside"])

    counted = sample.select(html_column).mapInArrow(run, "name string, inside long, outside long").groupBy("name").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).collect()
    weights = dict(DEFAULT_WEIGHTS)
    for r in counted:
        share = (r["i"] + 1) / (r["i"] + r["o"] + 2)
        if r["name"] in ("word", "link"):
            weights[r["name"]] = max(0.1, 2 * share - 1)
        elif r["name"] == "boilerplate":
            weights[r["name"]] = -0.5 * (1 - share)
        else:  # tags: from -0.05 for those of contents to -1
            weights[r["name"]] = -0.05 - 0.95 * (1 - share)
    return weights


def extracted(pages: DataFrame, weights: dict[str, float], *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, weights) if x else "" for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), html_column).mapInArrow(run, "page_id long, url string, text string, n_chars long")
