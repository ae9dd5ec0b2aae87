"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags.  Words score positive and tags
negative, and one linear scan finds the contiguous region of the highest score:
the article has many words between few tags, menus and lists of links have not.
What a word and each kind of tag score is learned from labelled pages, so that
the region of the highest score is the main text of as many of them as can be
(an averaged perceptron over whole regions, begun from log odds).

Where a page has an article element, words and tags inside it have scores of
their own, and so have entries that begin or end with a link; so long tables and
lists of short entries in an article are told from menus, and readers' comments
after it from its text, whatever their names.

The region may hold an advert, a form or a box between two paragraphs.  Such an
element is a negative subtree: what is learned of its names and its kind is
added to what a logistic fit has learned of its share of the page's words, of the
headings and articles in it and of its words to a tag, and it is left out where the
sum is negative.  So a name
alone decides nothing: an element that is named after a sidebar or is a form,
but holds the page's text, stays and is left to the scan.  A left-out element
costs the scan what boxes have been found to cost, whatever is in it.  Only
elements that never hold text, such as scripts and form controls, go by kind.

The labelled pages are written by a seeded generator in several layouts, from
semantic elements to nested divisions whose names say nothing; nothing of the
corpus is used.

Character references are decoded, white space inside a block becomes one space,
blocks are joined by a line feed.  Defined results: a null or empty page, and
one without words, has an empty text; repeated rows give equal results; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treesift.llm.common import bound_batches, record_batch

#: HTML elements by what they are.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER_TEXT = frozenset(
    "script style noscript template head title button select option optgroup textarea input label legend iframe frame object embed svg canvas "
    "audio video map datalist meter progress applet noframes".split()
)
RAW_TEXT = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose kind says what they are for; of others only the names tell.
TELLING = frozenset("nav footer aside form header menu dialog fieldset".split())
#: Names in class and id of what surrounds an article, and of articles; the labelled pages use them.
AROUND = (
    "ad ads adv advert adverts advertisement advertising adsbox sponsor sponsored sponsors promo promotion banner banners "
    "nav navbar navigation navigate menu menus breadcrumb breadcrumbs pagination pager toc sidebar side aside widget widgets rail "
    "footer foot bottom copyright colophon masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login register paywall "
    "comment comments commentlist disqus respond reply replies discussion "
    "share sharing social follow related recommended recommendations popular trending more outbrain taboola tags taglist "
    "form search searchbox hidden print skip"
).split()
WITHIN = "content post entry article story body text main prose document".split()

_SPLIT_NAMES = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_MARKUP = re.compile(r"<(?=[A-Za-z/!?])")
_STYLE_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

TEXT, OPEN, CLOSE = 0, 1, 2
WORD, BOX = "#word", "#box"
#: Before a tag's feature: it stands in the article element; it is beside a link.
INSIDE, LINKED = "in:", "a:"
#: A word outside the article element of a page that has one.
OUTER_WORD = "out:#word"


def pieces(page: str) -> list[tuple[int, str, tuple[str, ...]]]:
    """(TEXT, text, ()), (OPEN, tag, names) and (CLOSE, tag, ()) in order; comments
    and the contents of scripts, styles and the like are left out.  A name of class,
    id or role is written ``.site-footer``, its parts ``~site`` and ``~footer``."""
    out: list[tuple[int, str, tuple[str, ...]]] = []
    at, n, tag_of = 0, len(page), _TAG
    while at < n:
        m = _MARKUP.search(page, at)
        start = m.start() if m else n
        if start > at:
            out.append((TEXT, page[at:start], ()))
        if not m:
            break
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else n
            continue
        tag = tag_of.match(page, start)
        if not tag and tag_of is _TAG and page[start + 1] not in "!?":
            tag = _PLAIN_TAG.match(page, start)
            if tag and page.find('"', tag.end()) < 0:
                tag_of = _PLAIN_TAG
        if not tag:  # a declaration, an end tag without name, or a tag that the page's end cuts
            end = page.find(">", start)
            at = end + 1 if end >= 0 else n
            continue
        at, name = tag.end(), tag[2].lower()
        if tag[1]:
            out.append((CLOSE, name, ()))
            continue
        attributes = tag[3]
        names: list[str] = []
        if "=" in attributes:
            for value in " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).split():
                parts = [x for x in _SPLIT_NAMES.split(_CAMEL.sub("-", value).lower()) if x]
                names.append("." + "-".join(parts))
                if len(parts) > 1:
                    names += [f"~{x}" for x in parts]
            if _STYLE_HIDDEN.search(attributes):
                names.append(".hidden")
        if re.search(r"\shidden(?:\s|=|/?$)", attributes):
            names.append(".hidden")
        out.append((OPEN, name, tuple(names)))
        if name in RAW_TEXT:
            close = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            at = close.start() if close else n
        elif attributes.endswith("/") and name not in BLOCKS:
            out.append((CLOSE, name, ()))
    return out


Item = tuple[int, str, tuple[str, ...]]


@dataclass
class Model:
    """What is learned: of each tag, of words and of a box for the scan; of names and
    kinds, shares of words and headings for elements that may be boxes."""

    tags: dict[str, float]
    word: float
    outer_word: float
    box: float
    unknown: float
    names: dict[str, float]
    shares: list[float]
    heads: list[float]
    prose: list[float]

    def feature(self, kind: int, name: str, names: tuple[str, ...]) -> str:
        """The most telling of what is known of a tag."""
        if kind == CLOSE:
            return f"/{name}"
        return min((k for k in (*names, name) if k in self.tags), key=self.tags.__getitem__, default="")


@dataclass
class Element:
    """An element that holds words, and what tells whether it is a box."""

    start: int
    end: int
    names: tuple[str, ...]
    share: int
    heads: int
    prose: int


def _ends(items: list[Item]) -> list[int]:
    """For each piece that opens an element, just after the element's end.  One that is
    never closed ends where the main text's own element opens, or at the end."""
    ends = [0] * len(items)
    opened: dict[str, list[int]] = {}
    for i, (kind, name, _) in enumerate(items):
        if kind == OPEN:
            if name in VOID:
                ends[i] = i + 1
            else:
                opened.setdefault(name, []).append(i)
        elif kind == CLOSE and opened.get(name):
            ends[opened[name].pop()] = i + 1
    stop = len(items)
    for i in range(len(items) - 1, -1, -1):
        if items[i][0] == OPEN:
            ends[i] = max(i + 1, ends[i] or stop)
            if items[i][1] in ("article", "main", "h1"):
                stop = i
    return ends


def elements(items: list[Item], ends: list[int]) -> Iterator[Element]:
    """The elements whose names or kind may tell that they are boxes, in order.
    ``share``: up to a twentieth of the page's words, up to half, or more.
    ``heads``: no heading and article in it, some, many articles without a main
    heading, or some where others stand outside.  ``prose``: words to a tag, in steps."""
    words, articles, main, heads, tags = ([0] for _ in range(5))  # numbers before each piece
    for kind, value, _ in items:
        tags.append(tags[-1] + (kind == OPEN))
        words.append(words[-1] + (len(value.split()) if kind == TEXT else 0))
        articles.append(articles[-1] + (kind == OPEN and value == "article"))
        main.append(main[-1] + (kind == OPEN and value in ("article", "main")))
        heads.append(heads[-1] + (kind == OPEN and value == "h1"))
    for i, (kind, name, names) in enumerate(items):
        if kind != OPEN or name in NEVER_TEXT or not names and name not in TELLING or name in ("html", "body"):
            continue
        end = ends[i]
        own_words, own_main, own_heads, own_articles, own_tags = (x[end] - x[i] for x in (words, main, heads, articles, tags))
        density = own_words / own_tags
        prose = (0 if density < 5 else 1 if density < 15 else 2 if density < 30 else 3) if own_tags > 2 else 0
        share = 0 if 20 * own_words <= words[-1] else 1 if 2 * own_words <= words[-1] else 2
        if not own_main + own_heads:
            of = 0
        elif own_articles > 1 and own_articles == own_main and not own_heads:
            of = 2
        else:
            of = 3 if heads[-1] > own_heads or main[-1] > own_main + (name in ("article", "main")) else 1
        yield Element(i, end, (*names, *([name] if name in TELLING else ())), share, of, prose)


def is_box(e: Element, model: Model) -> bool:
    own = min((model.names[k] for k in e.names if k in model.names), default=0.0)
    return own < 0.0 and own + model.shares[e.share] + model.heads[e.heads] + model.prose[e.prose] < 0.0


def box_marks(items: list[Item], model: Model) -> list[bool]:
    """For each piece, whether it lies in an element that never holds text or is a negative subtree."""
    marks = [False] * len(items)
    ends = _ends(items)
    boxes = {e.start for e in elements(items, ends) if is_box(e, model)}
    i = 0
    while i < len(items):
        if items[i][0] == OPEN and (items[i][1] in NEVER_TEXT or i in boxes):
            marks[i : ends[i]] = [True] * (ends[i] - i)
            i = ends[i]
        else:
            i += 1
    return marks


def article_at(items: list[Item], boxes: list[bool]) -> tuple[int, int]:
    """The pieces inside the article element, or else main element, with the most words outside
    boxes; of nested ones the outermost.  None: an empty range."""
    words = [0]
    for (kind, value, _), box in zip(items, boxes, strict=True):
        words.append(words[-1] + (0 if box or kind != TEXT else len(value.split())))
    ends = _ends(items)
    for name in ("article", "main"):
        found = [(words[ends[i]] - words[i], -i) for i, (kind, value, _) in enumerate(items) if kind == OPEN and value == name and not boxes[i]]
        if found and max(found)[0]:
            i = -max(found)[1]
            return i + 1, ends[i] - 1
    return 0, 0


def scan_features(items: list[Item], boxes: list[bool], model: Model) -> list[tuple[str, int]]:
    """(feature, how often) of each piece for the scan.  Tags inside the article element are
    told from others, and so are those of entries that begin with a link.  Boxes in a row count
    once, by the tag that comes after them: a paragraph, or the end of what they stand in."""
    out = []
    known: dict[Item, str] = {}
    after = ""
    first, last = article_at(items, boxes)
    for i in range(len(items) - 1, -1, -1):
        item = items[i]
        kind, value, _ = item
        if boxes[i]:
            out.append((BOX, 0) if i and boxes[i - 1] else (BOX + after, 1))
        elif kind == TEXT:
            n = len(value.split())
            out.append((WORD if first <= i < last or not last else OUTER_WORD, n))
            after = WORD if n else after
        else:
            feature = known.get(item)
            if feature is None:
                feature = known[item] = model.feature(*item)
            linked = kind == OPEN and after == "a" or kind == CLOSE and i and items[i - 1][:2] == (CLOSE, "a")
            out.append((f"{INSIDE if first <= i < last else ''}{LINKED if linked and value != 'a' else ''}{feature}", 1))
            after = f"/{value}" if kind == CLOSE else value
    out.reverse()
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous pieces with the highest sum, of equals the longest that begins first."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0.0:
            total, start = 0.0, i
        total += score
        if total >= best and total > 0:
            best, best_at = total, (start, i + 1)
    return best_at


def _scores(features: list[tuple[str, int]], model: Model) -> list[float]:
    known = {**dict.fromkeys({f for f, _ in features if f.startswith(BOX)}, model.box), **model.tags, WORD: model.word, OUTER_WORD: model.outer_word}
    return [n * _weight(known, f, model.unknown) for f, n in features]


def _weight(known: dict[str, float], feature: str, unknown: float) -> float:
    """What is known of a feature, or else of the tag in whatever place, or else of its place."""
    for f in (feature, feature.removeprefix(INSIDE).removeprefix(LINKED)) if not feature.startswith(INSIDE) else (feature, feature.replace(LINKED, ""), INSIDE):
        if f in known:
            return known[f]
    return unknown


def text_of(items: list[Item], boxes: list[bool]) -> str:
    """The text of pieces that are in no box, block by block."""
    blocks: list[str] = []
    held: list[str] = []

    def close() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                blocks.append(text)

    for (kind, value, _), skip in zip(items, boxes, strict=True):
        if kind != TEXT and value in BLOCKS:
            close()
        elif not skip:
            if kind == TEXT:
                held.append(value)
            elif value == "br":
                held.append(" ")
    close()
    return "\n".join(blocks)


def main_text(page: str | None, model: Model) -> str:
    items = pieces(page or "")
    boxes = box_marks(items, model)
    begin, end = best_region(_scores(scan_features(items, boxes, model), model))
    return text_of(items[begin:end], boxes[begin:end])


# --- training ------------------------------------------------------------------------------------


def labelled_page(rng: random.Random) -> list[tuple[str, bool]]:
    """A generated page as runs of html, each with whether it is main text.  A third
    of the layouts name what surrounds the article, the rest is divisions or tables
    whose names say nothing; some wrap the page in an element named after a box."""

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choice(("ba", "to", "ri", "en", "sol", "mar")) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(a, b)))

    def links(n: int, wrap: str) -> str:
        return "".join(f'<{wrap}><a href="/{words(1, 1)}">{words(1, 2)}</a></{wrap}>' for _ in range(n))

    layout = rng.randrange(6)
    named, semantic = layout < 4, layout < 2
    hashed = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(6))

    def name(of: str) -> str:
        """A name for an element, plain or as part of a longer one."""
        if not named:
            return rng.choice((f"c{hashed()}", f"css-{hashed()}"))
        shape = rng.randrange(6)
        return of if shape < 3 else f"{rng.choice(('site', 'page', 'main', 'top', 'left', 'right', 'post', 'entry', 'js'))}-{of}" if shape == 3 else f"{of}-{rng.choice(('box', 'list', 'wrap', 'area', 'inner', '1', 'block'))}" if shape == 4 else f"{of} {hashed()}"

    def box(of: str, inner: str) -> str:
        return f'<div {rng.choice(("class", "class", "class", "id"))}="{name(of)}">{inner}</div>'

    boxed = lambda a, b: f"<p>{words(a, b)}</p>" if rng.random() < 0.4 else words(a, b)
    out: list[tuple[str, bool]] = []
    wrapper = rng.random()
    page_head = f"<html><head><title>{words(3, 9)}</title><style>p{{}}</style><script>x()</script></head><body>"
    opened, closed = "", ""
    if wrapper < 0.18:
        of, with_ = rng.choice(AROUND), rng.choice(("has", "with", "no", "show", "layout", "page"))
        value = rng.choice((f"{with_}-{of}", f"{of}-{rng.choice(('open', 'enabled', 'visible', 'layout', 'page', 'area', 'content'))}", f"layout {with_}-{of}", f"{rng.choice(WITHIN)} {of}-{rng.choice(('open', 'closed', 'ready'))}"))
        opened, closed = f'<div class="{value}">', "</div>"
    elif wrapper < 0.28:
        opened, closed = f'<form method="post" id="{rng.choice(("aspnetForm", "form1", "mainForm", hashed()))}">', "</form>"
    elif wrapper < 0.5:
        opened, closed = f'<div class="{rng.choice(("wrapper", "container", "page", "site", "outer", hashed()))}">', "</div>"
    wrap = "li" if rng.random() < 0.6 else rng.choice(("div", "span", "td"))
    nav = links(rng.randint(4, 12), wrap)
    nav = f"<ul>{nav}</ul>" if wrap == "li" else nav
    nav = f"<nav>{nav}</nav>" if semantic else box(rng.choice(("menu", "nav", "navbar", "navigation", "topbar")), nav)
    before = [nav]
    if rng.random() < 0.5:
        inner = f"<h2>{words(1, 3)}</h2>{words(1, 4)}"
        before.append(f"<header>{inner}</header>" if semantic else box("masthead", f"<div>{inner}</div>"))
    for of in rng.sample(AROUND, rng.randint(0, 3)):
        before.append(box(of, boxed(2, 25) if named else f"<div>{words(1, 4)}</div><button>{words(1, 1)}</button>"))
    content = rng.choice(WITHIN)
    begin, finish = (("<article>", "</article>"), ("<main><article>", "</article></main>"), (f'<div class="{name(content)}">', "</div>"), (f'<section id="{name(content)}">', "</section>"),
                     (f'<div class="{name(content)}"><div>', "</div></div>"), (f'<table><tr><td class="{name("x")}">{links(rng.randint(2, 5), "div")}</td><td>', "</td></tr></table>"))[layout]
    out.append((page_head + opened + "".join(before) + begin, False))
    title = f"<h1>{words(3, 10)}</h1>"
    parts = [rng.choice((title, title, f"<header>{title}</header>" if semantic else title))] if rng.random() < 0.9 else []
    in_divs = layout == 3 or layout == 4 and rng.random() < 0.5
    for _ in range(rng.randint(2, 14)):
        p = words(1, 90)
        if rng.random() < 0.2:
            p = rng.choice((f"<b>{p}</b>", f"<b>{p}", f"<strong>{p}</strong>", f"<span>{p}</span>", f"<i>{p}</i>"))
        if rng.random() < 0.3:
            p += f' <a href="#">{words(1, 3)}</a> <em>{words(1, 3)}</em> {words(2, 20)}'
        if rng.random() < 0.2:
            p += rng.choice((f"<br>{words(1, 20)}", "<br>", f" <code>{words(1, 2)}</code>", '<img src="x">', f"<br/>{words(1, 9)}<br/>"))
        parts.append(rng.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<h3>{}</h3>", "<ul><li>{}</li></ul>", "<ol><li>{}</li></ol>", "<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>", "<figure><figcaption>{}</figcaption></figure>", "<table><tr><td>{}</td></tr></table>")).format(p) if not in_divs else f"<div>{p}</div>")
    rows = lambda: rng.choice((3, 8, 20, 60))
    if rng.random() < 0.35 and not in_divs:
        lists = rng.choice((
            lambda: "<table>" + "".join(f"<tr><td>{words(1, 2)}</td><td>{words(1, 3)}</td></tr>" for _ in range(rows())) + "</table>",
            lambda: "<ul>" + "".join(f"<li>{words(1, 2)}</li>" for _ in range(rows())) + "</ul>",
            lambda: "<dl>" + "".join(f"<dt>{words(1, 2)}</dt><dd>{words(1, 4)}</dd>" for _ in range(rows())) + "</dl>",
            lambda: f"<p>{words(1, 9)} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> {words(1, 9)}</p>",
        ))
        for _ in range(rng.choice((1, 1, 2))):
            parts.insert(rng.randint(min(1, len(parts)), len(parts)), lists())
    if named and rng.random() < 0.4:
        long = "".join(f"<p>{words(30, 110)}</p>" for _ in range(rng.randint(2, 4)))
        of = rng.choice([x for x in AROUND if not re.match("comment|disqus|respond|repl|discussion|foot|copy|colophon|nav|menu|cookie|ad|sponsor|subscr|login|sign|register", x)])
        parts.insert(rng.randint(min(1, len(parts)), len(parts)), f'<section class="{name(of)}"><h2>{words(1, 4)}</h2>{long}</section>')
    for i, part in enumerate(parts):
        out.append((part, True))
        if named and 0 < i < len(parts) - 1 and rng.random() < 0.06:
            out.append((rng.choice((box(rng.choice(AROUND), boxed(2, 20)), f"<aside>{words(3, 20)}</aside>", f"<form>{words(1, 4)}<input><button>{words(1, 2)}</button></form>")), False))
    after = [finish]
    if named:
        for of in rng.sample(AROUND, rng.randint(0, 3)):
            after.append(box(of, f"<ul>{links(rng.randint(2, 6), 'li')}</ul>{words(1, 8)}" if rng.random() < 0.5 else boxed(3, 30)))
        if rng.random() < 0.3:
            reader = rng.choice(("<li><article><p>{}</p></article></li>", "<li><p>{}</p></li>", "<div><p>{}</p></div>"))
            after.append(f'<{rng.choice(("ol", "ul", "div", "section"))} class="{name(rng.choice(("comments", "comment", "commentlist", "replies", "discussion", *([f"x{hashed()}"] * 5 if semantic else []))))}">' + "".join(reader.format(words(3, 40)) for _ in range(rng.choice((1, 3, 6, 30)))) + "</section>")
            after[-1] = after[-1].replace("</section>", f"</{re.match('<([a-z]+)', after[-1])[1]}>")
        if rng.random() < 0.3:
            after.append(f"<aside>{words(5, 30)}</aside>")
        if rng.random() < 0.3:
            after.append(f'<form><label>{words(1, 3)}</label>{words(1, 4)}<input type="text"><button>{words(1, 1)}</button></form>')
    else:
        after += [box("x", f"<div>{links(rng.randint(3, 9), 'div')}</div>") for _ in range(rng.randint(0, 2))]
    after.append(f"<footer>&copy; {words(2, 15)}</footer>" if semantic else box("footer", words(3, 15) if named else f"<div>{links(3, 'span')}</div><div>{words(1, 4)}</div>"))
    out.append(("".join(after) + closed + "</body></html>", False))
    return out


def parsed(page: list[tuple[str, bool]]) -> tuple[list[Item], list[bool]]:
    """The pieces of a labelled page and their labels."""
    items: list[Item] = []
    labels: list[bool] = []
    for part, is_main in page:
        own = pieces(part)
        items += own
        labels += [is_main] * len(own)
    return items, labels


def _odds(yes: float, no: float) -> float:
    return math.log((yes + 0.5) / (no + 0.5))


def _box_scores(pages: list[tuple[list[Item], list[bool]]]) -> tuple[dict[str, float], list[float], list[float], list[float]]:
    """Log odds of names and kinds to hold main text; and what shares of words, headings and
    words to a tag add to these for elements whose names are of boxes, by a logistic fit."""
    holds, not_ = Counter(), Counter()
    seen = []
    for items, labels in pages:
        before = [0]
        for (kind, value, _), label in zip(items, labels, strict=True):
            before.append(before[-1] + (label and kind == TEXT and bool(value.split())))
        for e in elements(items, _ends(items)):
            main = before[e.end] > before[e.start]
            (holds if main else not_).update(set(e.names))
            seen.append((e, main))
    names = {k: _odds(holds[k], not_[k]) for k in holds.keys() | not_.keys() if holds[k] + not_[k] >= 3}
    rows, right = [], []
    for e, main in seen:
        own = min((names[k] for k in e.names if k in names), default=0.0)
        if own < 0.0:
            row = np.zeros(12)
            row[[0, 1 + e.share, 4 + e.heads, 8 + e.prose]] = own, 1, 1, 1
            rows.append(row)
            right.append(main)
    x, y, w = np.array(rows), np.array(right, float), np.zeros(12)
    w[0] = 1.0
    for _ in range(30):  # Newton steps with a small penalty
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(12), x.T @ (p - y) + 0.1 * w)
    scaled = (w[1:] / max(0.1, w[0])).tolist()
    return names, scaled[:3], scaled[3:7], scaled[7:]


@lru_cache(1)
def model(seed: int = 11, n_pages: int = 800, rounds: int = 5) -> Model:
    """Learn from labelled pages; the same pages and order in every process."""
    rng = random.Random(seed)
    pages = [parsed(labelled_page(rng)) for _ in range(n_pages)]
    names, shares, heads, prose = _box_scores(pages)
    tags_in, tags_out = Counter(), Counter()
    words = [0, 0]
    for items, labels in pages:
        for (kind, value, own), label in zip(items, labels, strict=True):
            if kind == TEXT:
                words[label] += len(value.split())
            else:
                (tags_in if label else tags_out).update((f"/{value}",) if kind == CLOSE else (*own, value))
    tags = {k: min(-0.01, _odds(tags_in[k], tags_out[k])) for k in tags_in.keys() | tags_out.keys() if tags_in[k] + tags_out[k] >= 3}
    out = Model(tags, max(0.05, _odds(words[1], words[0])), 0.05, -1.0, min(-0.01, _odds(tags_in.total(), tags_out.total())), names, shares, heads, prose)

    # regions of the highest score should be the labelled ones
    weights = {**out.tags, WORD: out.word, OUTER_WORD: out.outer_word, BOX: out.box, "": out.unknown}
    box_in, box_out, tag_in, tag_out = (Counter() for _ in range(4))
    late, steps = Counter(), 0  # each change times the steps before it, for the mean over all steps
    ready = []
    for items, labels in pages:
        features = scan_features(items, box_marks(items, out), out)
        first, last = labels.index(True), len(labels) - labels[::-1].index(True)
        ready.append((features, first, last))
        for i, (f, n) in enumerate(features):
            if n and f.startswith(BOX):
                (box_in if first <= i < last else box_out)[f] += 1
            elif f.startswith((INSIDE, LINKED)):
                (tag_in if labels[i] else tag_out).update((f, INSIDE) if f.startswith(INSIDE) else (f,))
    weights |= {f: min(-0.01, _odds(box_in[f], box_out[f])) for f in box_in.keys() | box_out.keys()}
    weights |= {f: min(-0.01, _odds(tag_in[f], tag_out[f])) for f in tag_in.keys() | tag_out.keys()}
    weights[BOX] = min(-0.01, _odds(box_in.total(), box_out.total()))
    for _ in range(rounds):
        for features, first, last in ready:
            begin, end = best_region([n * _weight(weights, f, weights[""]) for f, n in features])
            lost, gained = features[first:last], features[begin:end]
            change = Counter()
            for f, n in lost:
                change[f] += n
            for f, n in gained:
                change[f] -= n
            for f, n in change.items():
                if n:
                    k = f if f in weights else ""
                    moved = weights[k] + 0.02 * max(-5, min(5, n))
                    moved = max(0.05, moved) if k == WORD else max(0.01, moved) if k == OUTER_WORD else min(-0.01, moved)
                    late[k] += steps * (moved - weights[k])
                    weights[k] = moved
            steps += 1
    mean = {k: w - late[k] / max(1, steps) for k, w in weights.items()}
    out.word, out.outer_word, out.box, out.unknown = mean.pop(WORD), mean.pop(OUTER_WORD), mean.pop(BOX), mean.pop("")
    out.tags = mean
    return out


def page_report(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    bound_batches(pages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    learned = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, learned) for h in batch.column("html").to_pylist()]
            yield record_batch(schema, batch.column("page_id"), batch.column("url"), texts, [len(t) for t in texts])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
