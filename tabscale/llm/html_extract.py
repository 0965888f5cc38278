"""Main text of web pages by two passes over text blocks.

Pass one cuts the page into blocks at block-level tags and decides each from
its own numbers: length, link density (share of characters inside links) and
stop-word density, with the containers it stands in. Blocks in menus, page
headers, footers, sidebars, forms, notices, adverts or comments are dropped;
long blocks with enough stop words and few links are kept; the others are
ambiguous. Where hardly any word of a page's long blocks is a known stop word
(another language), length and links decide alone. A container known as furniture
only by its name is not furniture when most of the page's long text is in it
(comments always are), and an article that holds little of the kept text (a teaser)
does not speak for the page. Pass two gives each ambiguous block the label of the
nearest decided neighbour on either side, neighbours in the same article first;
between a kept and a dropped one at equal distance the block is kept inside an
article only. The time is in proportion to the page's length.

Defined cases: null, empty and tag-less html work (bare text is one block);
unclosed and stray tags follow the open-element stack; a page without a kept
block has the text ''; repeated pages get equal rows; an empty table gives an
empty result; extra columns play no part.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 25         # characters a block needs to be decided by itself
STOP_DENSITY = 0.2
LINK_DENSITY = 0.5
LONG = 80               # characters of a block that length and links may decide
FEW_LINKS = 0.2
UNKNOWN = 0.08          # stop-word density of long blocks below which the language is not one of the lists
MOST = 0.5              # share of a page's long text that a container named as furniture cannot hold
TEASER = 2.0            # times its own kept text that may stand outside the articles

# Common function words of the four languages.
STOP_WORDS = frozenset("""
the and of to in is that for it as was with be on by are this at from or an not but have has had which you we they his her
der die das und ist nicht mit sich den von zu ein eine im auf des dem als auch es an werden aus er hat dass sie nach bei
le la les de des et est en un une que qui dans pour pas sur avec au du ce par il elle plus ne se sont ou mais nous vous
el los las y en que del se por con para su al lo como más pero sus una fue ha son entre está sin sobre ser
""".split())

# Tags.
_RAW = "script|style|title|textarea|xmp|noembed|noframes"
_BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROP_TAG = frozenset("""nav footer aside form head script style noscript template iframe object svg canvas select option button
label menu dialog audio video map textarea title""".split())
_HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_DROP_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
# Words of class and id names that mark page furniture.
_DROP_NAME = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side
nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices alert popup
modal overlay newsletter subscribe subscription signup login register share sharing social related recommended comment comments
commentlist reply replies respond discussion disqus widget toolbar pagination pager paywall skip""".split())

# The part of those names that stays furniture at any length, and words that turn a name around.
_COMMENT_NAME = frozenset("comment comments commentlist reply replies respond discussion disqus".split())
_HEAD_NAME = frozenset(("header",))
_MODIFIER = frozenset("with has no without is hide".split())

_TAG = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_TAG_END = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_RAW_END = {t: re.compile("</" + t, re.I) for t in _RAW.split("|")}
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+")   # words of one name
_WORD = re.compile(r"[^\W\d_]+")

# what a container makes of its text
PLAIN, ARTICLE, HEAD, DROP = 0, 1, 2, 3


def tokens_of(page: str):
    """(text, closing, tag, attributes) in page order: tag is None for text. Comments, declarations and raw
    elements give nothing. A tag ends at the first ``>`` outside quotes; once the quotes of a page do not
    close, at the first ``>``; without one the rest is text. Every character is passed at most twice."""
    at, quotes = 0, True
    while True:
        lt = page.find("<", at)
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            if lt > at:
                yield page[at:lt], False, None, ""
            at = end + 3 if end >= 0 else len(page)
            continue
        m = _TAG.match(page, lt + 1)
        if not m and page[lt + 1:lt + 2] not in ("!", "?"):
            yield page[at:lt + 1], False, None, ""
            at = lt + 1
            continue
        begin = m.end() if m else lt + 1
        found = _TAG_END.match(page, begin) if m and quotes else None
        if found:
            end = found.end() - 1
        else:
            quotes = quotes and not m
            end = page.find(">", begin)
        if end < 0:
            break
        if lt > at:
            yield page[at:lt], False, None, ""
        at = end + 1
        if not m:
            continue
        tag = m[2].lower()
        if tag in _RAW_END and not m[1]:
            stop = _RAW_END[tag].search(page, at)
            end = page.find(">", stop.end()) if stop else -1
            at = end + 1 if end >= 0 else len(page)
            continue
        yield "", bool(m[1]), tag, page[begin:end]
    if at < len(page):
        yield page[at:], False, None, ""


def _names(value: str, among: frozenset) -> bool:
    """Whether a class or id attribute has a name with one of the words, not turned around by a modifier."""
    for name in value.split():
        words = _NAME.findall(name)
        if words and words[0] not in _MODIFIER and any(w in among for w in words):
            return True
    return False


def _kind(tag: str, attrs: str, inside: int) -> tuple[int, int]:
    """(what the element makes of its text, 1 if its name alone marks furniture, 2 if it marks comments)."""
    if tag in _DROP_TAG:
        return DROP, 0
    if tag == "header":
        return HEAD, 0
    named = 0
    if attrs:
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in _DROP_ROLE:
                return DROP, 0
            if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
                if _names(value, _COMMENT_NAME):
                    named = 2
                elif _names(value, _DROP_NAME):
                    named = max(named, 1)
                elif _names(value, _HEAD_NAME):
                    return HEAD, named
    if tag in ("article", "main"):
        return ARTICLE, 0
    return inside, named


class _Element:
    """An open element: what it makes of its text, its article, and the innermost container named as furniture."""
    __slots__ = ("tag", "kind", "art", "named")

    def __init__(self, tag, kind, art, named):
        self.tag, self.kind, self.art, self.named = tag, kind, art, named


_TOP = _Element("", PLAIN, 0, -1)


def blocks_of(page: str) -> tuple[list[tuple[str, float, int, int, int]], list[tuple[int, bool]]]:
    """Blocks in page order, (text, link density, container kind, article number, container named as furniture or -1),
    and those containers as (the one around it or -1, whether it is named as comments)."""
    out: list[tuple[str, float, int, int, int]] = []
    named: list[tuple[int, bool]] = []
    stack: list[_Element] = []
    opened: dict[str, int] = {}
    articles, links = 0, False
    parts: list[str] = []
    linked: list[str] = []

    def top() -> _Element:
        return stack[-1] if stack else _TOP

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                inner = " ".join(html.unescape(" ".join(linked)).split())
                x = top()
                out.append((text, min(1.0, len(inner) / len(text)), x.kind, x.art, x.named))
            parts.clear()
            linked.clear()

    def push(tag: str, kind: int, mark: int) -> None:
        nonlocal articles
        x = top()
        if x.kind == DROP:
            kind = DROP
        elif kind == HEAD:  # a heading inside an article's own header is text, the rest of a header is not
            kind = DROP if not x.art else ARTICLE if tag in _HEADING else HEAD
        art, inside = x.art, x.named
        if kind == ARTICLE and not art:
            articles += 1
            art = articles
        if mark:
            named.append((inside, mark == 2))
            inside = len(named) - 1
        stack.append(_Element(tag, kind, art, inside))
        opened[tag] = opened.get(tag, 0) + 1

    def pop() -> _Element:
        x = stack.pop()
        opened[x.tag] -= 1
        return x

    for text, closing, tag, attrs in tokens_of(page):
        if tag is None:
            parts.append(text)
            if links:
                linked.append(text)
        elif tag == "a":
            links = not closing
        elif tag == "br":
            parts.append(" ")
        elif closing:
            if opened.get(tag):
                gone = [pop()]
                while gone[-1].tag != tag:
                    gone.append(pop())
                x = top()
                if not stack or any(g.tag in _BLOCK or g.kind != x.kind or g.named != x.named for g in gone):
                    stack.extend(reversed(gone))  # the block ends inside the element
                    flush()
                    del stack[len(stack) - len(gone):]
            elif tag in _BLOCK:
                flush()
        elif tag in _BLOCK:
            flush()
            links = False
            while stack and (stack[-1].tag == "p" or stack[-1].tag not in _BLOCK and stack[-1].tag not in _DROP_TAG
                             or tag in ("li", "dt", "dd", "td", "th", "tr", "option") and stack[-1].tag == tag):
                pop()  # an open paragraph or inline element ends at the next block
            if tag not in _VOID:
                push(tag, *_kind(tag, attrs, top().kind))
        elif tag not in _VOID and not attrs.endswith("/"):
            kind, mark = _kind(tag, attrs, top().kind)
            if kind != top().kind or mark:
                flush()
                push(tag, kind, mark)
    flush()
    return out, named


def _furniture(blocks, named) -> list[bool]:
    """Which of the containers named as furniture are: all but those that hold most of the page's long text, in
    several blocks, with every article of the page among it."""
    held = [[0, 0, 0] for _ in named]       # characters, long blocks, blocks of an article
    total = [0, 0, 0]
    for text, links, kind, art, at in blocks:
        if kind not in (DROP, HEAD):
            long_ = len(text) >= LONG and links <= FEW_LINKS
            for x in (total, held[at]) if at >= 0 else (total,):
                x[0] += len(text) * long_
                x[1] += long_
                x[2] += art > 0
    for i in range(len(named) - 1, -1, -1):   # a container comes after the one around it
        if named[i][0] >= 0:
            held[named[i][0]] = [a + b for a, b in zip(held[named[i][0]], held[i])]
    out: list[bool] = []
    for (around, comments), (n, many, art) in zip(named, held):
        out.append(comments or n <= MOST * total[0] or many < 2 or art < total[2] or around >= 0 and out[around])
    return out


def main_text(page: str | None) -> str:
    """The kept blocks, joined by an empty line."""
    blocks, named = blocks_of(page or "")
    drop = _furniture(blocks, named)
    blocks = [(text, links, DROP if at >= 0 and drop[at] else kind, art) for text, links, kind, art, at in blocks]
    density: list[float | None] = []
    for text, links, kind, _ in blocks:
        if kind in (DROP, HEAD) or links > LINK_DENSITY:
            density.append(None)
            continue
        words = _WORD.findall(text.lower())
        density.append(sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0)
    long_ = [(len(b[0]), d) for b, d in zip(blocks, density) if d is not None and len(b[0]) >= LONG and b[1] <= FEW_LINKS]
    known = sum(n * d for n, d in long_) >= UNKNOWN * sum(n for n, _ in long_)
    label: list[bool | None] = []
    for (text, links, _, _), d in zip(blocks, density):
        if d is None:
            label.append(False)
        elif len(text) >= MIN_LENGTH and d >= STOP_DENSITY or not known and len(text) >= LONG and links <= FEW_LINKS:
            label.append(True)
        else:
            label.append(None)
    inside = sum(len(b[0]) for b, x in zip(blocks, label) if x and b[3])
    outside = sum(len(b[0]) for b, x in zip(blocks, label) if x and not b[3])
    if any(b[3] and b[2] != DROP for b in blocks) and outside <= TEASER * inside:
        # the page marks its article: text outside it is furniture
        label = [x if b[3] else False for x, b in zip(label, blocks)]
    n = len(blocks)
    before, after = [None] * n, [None] * n
    for order, near in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[int, tuple[int, bool]] = {}
        for i in order:
            art = blocks[i][3]
            near[i] = last.get(art)
            # furniture inside an article says nothing about the article's own short blocks
            if label[i] is not None and not (art and blocks[i][2] in (DROP, HEAD)):
                last[art] = (i, label[i])
    kept = []
    for i, (text, _, _, art) in enumerate(blocks):
        use = label[i]
        if use is None:
            near = [(abs(i - j), x) for j, x in filter(None, (before[i], after[i]))]
            if not near:
                use = bool(art) or n == 1
            else:
                least = min(d for d, _ in near)
                votes = {x for d, x in near if d == least}
                use = votes.pop() if len(votes) == 1 else bool(art)
        if use:
            kept.append(text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches):
        for rb in batches:
            text = [main_text(x) for x in rb.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(text, pa.string()),
                                              pa.array([len(t) for t in text], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
