"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. A word scores by the block that holds it, by whether it lies in a link, and
by the containers around it: elements that are no plain structure, class tokens and ids. A tag scores by its name,
below zero. The weights are log odds counted on labelled pages, which mark their article themselves (an `article` or
`main` element). One linear scan finds the contiguous stretch with the largest sum. Of that stretch, parts whose
containers weigh below zero are left out. Character references are decoded, white space becomes one space, block
elements are joined by one space.

Names that are usual for menus, headers, footers, sidebars, notices, adverts, forms and comments are a prior: they
count like PRIOR words seen outside of articles, which the labelled pages can outweigh; a name that nobody has listed
is learned as well. Words that such a name holds inside of an article are no evidence for or against it. Scripts,
styles and hidden elements are never text.

Null and empty pages, and pages without a stretch above zero, give the empty text. A page that breaks off
is read up to there; an unfinished tag at its end is dropped. Elements deeper than DEEPEST are read as siblings.
Rows are judged each by its own html, so repeated rows and ids give equal texts.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, runs

#: Labelled pages that the weights are counted on, about; they are chosen by a hash of page_id.
SAMPLE = 400
#: Weight of tags that no labelled page has shown, and bounds of all weights.
TAG_WEIGHT, BOUND = -0.2, 4.0
#: Words that a prior counts for: unlinked ones count as three inside for one outside, linked ones the other way.
PRIOR = 20
#: Least weight of a tag inside an article or main element.
IN_ARTICLE = -0.05
#: Open elements at most.
DEEPEST = 512

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea noscript template iframe svg math object".split())
ASIDE = frozenset("nav footer aside form menu dialog button select fieldset head title".split()) | RAW
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Elements of which a text is built; they say nothing about what it is.
PLAIN = INLINE | frozenset("html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tfoot tr td th caption blockquote pre section figure figcaption center hr br img".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[a-zA-Z/!?](?>(?:[^"'>]|"[^"]*"|'[^']*')*)>|<[a-zA-Z/!?][^>]*>|<[a-zA-Z/!?][^>]*\Z|[^<]+|<""", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
#: Whole class tokens and ids of what is not the article.
APART = re.compile(r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|notification|alert|popup|modal|newsletter|subscribe|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|footer|header|masthead|comments?|commentlist|disqus|respond|replies|reply|share|sharing|social|related|recommend\w*|widget|toolbar|pagination|pager|login|signup|search)", re.I)
#: Those of reader comments, which may well be longer than the article.
COMMENTS = re.compile(r"(?:comments?|commentlist|disqus|respond|replies|reply)", re.I)
#: Ends of raw elements, found in the text itself: lower() may change its length.
RAW_END = {name: re.compile("</" + name, re.I | re.A) for name in RAW}


def containers(name: str, tag: str) -> list[str]:
    """Features of an element that may set its words apart: its name if it is no plain structure, class tokens and ids."""
    out = [] if name in PLAIN else [name]
    if "=" in tag:
        for key, value in ATTR.findall(tag):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "class":
                out += ["." + x for x in value.split()]
            elif key == "id" and value.strip():
                out.append("#" + value.strip())
            elif key == "role":
                out.append("@" + value.strip())
    return out


def usual(feature: str) -> int:
    """What a prior says of a container: -1 usual for what is not the article, 1 the article, 0 nothing."""
    if feature in ("article", "main"):
        return 1
    if feature[0] in ".#":
        return -1 if APART.fullmatch(feature[1:]) else 0
    return -1 if feature in ASIDE or feature == "header" or (feature[0] == "@" and feature[1:] in ROLES) else 0


def odds(feature: str, inside: float, outside: float) -> float:
    """Log odds of a feature with its prior."""
    if "|" in feature:
        a, b = (PRIOR * 3 / 4, PRIOR / 4) if feature.endswith("|") else (PRIOR / 4, PRIOR * 3 / 4)
    else:
        a, b = {-1: (PRIOR / 20, PRIOR * 19 / 20), 0: (PRIOR / 2, PRIOR / 2), 1: (PRIOR * 19 / 20, PRIOR / 20)}[usual(feature)]
    return max(-BOUND, min(BOUND, log((inside + a) / (outside + b))))


def weight(feature: str, weights: dict[str, float]) -> float:
    w = weights.get(feature)
    return odds(feature, 0, 0) if w is None else w


def is_hidden(tag: str) -> bool:
    for key, value in ATTR.findall(tag):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return True
    return False


def apart(name: str, tag: str, inside: bool, weights: dict[str, float]) -> str | None:
    """Why the element with this tag is not part of an article, or None. inside: an article or main element holds it."""
    if name in RAW:
        return name
    if name in ("article", "main", "body", "html"):
        return None
    if "=" in tag or " " in tag:
        if is_hidden(tag):
            return "hidden"
    found = [x for x in containers(name, tag) if not (x == "header" and inside)]
    if sum(weight(x, weights) for x in found) >= 0:
        return None
    if any(x[0] in ".#" and COMMENTS.fullmatch(x[1:]) for x in found):
        return "comments"
    return name if name in ASIDE or name == "header" else "apart"


def tokens(html: str, weights: dict[str, float]) -> list[tuple]:
    """(kind, features, text, inside, held apart): kind 0 a text run, 1 an inline tag, 2 a block tag; inside an article or main element.

    A part that its class or id sets apart stays if it holds more than half of the page's words, reader comments only
    if they hold an article or main element too.
    """
    parts: list[list] = []
    seen = list(_tokens(html, frozenset(), parts, weights))
    kept = frozenset(at for at, why, words, marks, whole in parts if 2 * words > whole and (why == "apart" or marks))
    return list(_tokens(html, kept, [], weights)) if kept else seen


def _tokens(html: str, kept: frozenset, parts: list[list], weights: dict[str, float]):
    """The tokens, of which elements that begin at `kept` are not set apart by name.

    parts gets [place, why, words, article and main elements, words of the page] of those that are; words of raw elements do not count.
    """
    stack: list[tuple[str, str | None, tuple[str, ...], str]] = []  # name, why apart, features of its words, its block
    opened: Counter = Counter()
    words = marks = raw_n = links = 0
    open_parts: dict[int, list] = {}  # by depth
    apart_n = inside_n = 0

    def pop() -> str:
        """Ends the innermost element."""
        nonlocal raw_n, links, apart_n, inside_n
        part = open_parts.pop(len(stack) - 1, None)
        if part:
            part[2:4] = words - part[2], marks - part[3]
        x, why, _, _ = stack.pop()
        opened[x] -= 1
        raw_n -= x in RAW
        links -= x == "a"
        apart_n -= why is not None
        inside_n -= x in ("article", "main")
        return x

    at, n = 0, len(html)
    while at < n:
        m = TOKEN.match(html, at)
        at = m.end()
        t = m.group()
        if t[0] != "<" or t == "<":
            words += 0 if raw_n else len(t.split())
            block, around = (stack[-1][3], stack[-1][2]) if stack else ("", ())
            yield 0, (block + ("|a" if links else "|"), *around), t, inside_n > 0, apart_n > 0
            continue
        found = NAME.match(t)
        if not found or t[-1] != ">":
            continue
        name = found.group(1).lower()
        if t[1] == "/":
            if opened[name] > 0:
                while pop() != name:
                    pass
            yield 1 + (name not in INLINE), "/" + name, "", inside_n > 0 or name in ("article", "main"), apart_n > 0
            continue
        if name in CLOSES_P or name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            ends = "p" if name in CLOSES_P else name
            for k in range(len(stack) - 1, -1, -1) if opened[ends] > 0 else ():
                if stack[k][0] == ends:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] not in INLINE and stack[k][0] != "p":
                    break
        yield 1 + (name not in INLINE), name, "", inside_n > 0, apart_n > 0
        if name in VOID or t[-2] == "/":
            continue
        if name in RAW:
            end = RAW_END[name].search(html, at)
            at, begin = (end.start() if end else n), at
            yield 0, (name + "|raw", name), html[begin:at], inside_n > 0, True
        if len(stack) >= DEEPEST:
            continue
        why, own = apart(name, t, inside_n > 0, weights), containers(name, t)
        if why in ("apart", "comments"):
            if m.start() in kept:
                why, own = None, []  # what holds most of the page says nothing about its words
            else:
                open_parts[len(stack)] = part = [m.start(), why, words, marks, 0]
                parts.append(part)
        raw_n += name in RAW
        links += name == "a"
        marks += name in ("article", "main")
        around = stack[-1][2] if stack else ()
        stack.append((name, why, (*around, *own), (stack[-1][3] if stack else "") if name in INLINE else name))
        opened[name] += 1
        apart_n += why is not None
        inside_n += name in ("article", "main")
    while stack:
        pop()
    for part in parts:
        part[4] = words


def word_weight(features: tuple[str, ...], weights: dict[str, float]) -> float:
    """Weight of one word: its block and link, and the containers around it, the same one once."""
    return max(-BOUND, min(BOUND, sum(weight(x, weights) for x in dict.fromkeys(features))))


def scores(seen: list[tuple], weights: dict[str, float]) -> list[float]:
    """The score of each token; that of a text run is the sum over its words."""
    out, known = [], {}
    for kind, features, text, held, off in seen:
        if kind:
            w = min(weights.get("<" + features, TAG_WEIGHT), IN_ARTICLE)
            out.append(max(w, IN_ARTICLE) if held else w)
        elif held and off:
            out.append(0.0)  # left out of the text anyway, so it shall not cut the article
        else:
            w = known.get(features)
            if w is None:
                w = known[features] = word_weight(features, weights)
            out.append(len(text.split()) * (min(w, -IN_ARTICLE) if off else w))
    return out


def best_stretch(values: list[float]) -> tuple[int, int]:
    """[begin, end) of the stretch with the largest sum, the first one of equals; (0, 0) if none is above zero."""
    best, at, total, begin = 0.0, (0, 0), 0.0, 0
    for i, w in enumerate(values):
        if total <= 0:
            total, begin = 0.0, i
        total += w
        if total > best:
            best, at = total, (begin, i + 1)
    return at


def scored(html: str, weights: dict[str, float]) -> str:
    """The text of the best stretch."""
    seen = tokens(html, weights)
    lo, hi = best_stretch(scores(seen, weights))
    parts = []
    for kind, _, text, _, off in seen[lo:hi]:
        if kind == 2:
            parts.append(" ")
        elif not kind and not off:
            parts.append(unescape(text))
    return " ".join("".join(parts).split())


def counted(pages: list[str]) -> dict[str, float]:
    """Weights from labelled pages: log odds of a feature inside against outside of the article; tags at most -0.05.

    Counts outside are scaled to the words inside, so that long menus do not make every word unlikely.
    """
    inside, outside = Counter(), Counter()
    tags = {True: Counter(), False: Counter()}
    a = b = 0
    for html in pages:
        seen = list(_tokens(html, frozenset(), [], {}))
        if not any(x[3] for x in seen):
            continue  # marks no article
        for kind, features, text, held, off in seen:
            if kind:
                tags[held and not off][features] += 1
                continue
            k = len(text.split())
            if held and off:
                continue  # says nothing: part of the article or not
            for x in dict.fromkeys(features):
                (inside if held else outside)[x] += k
            a, b = a + (k if held else 0), b + (0 if held else k)
    if not a:
        return {}
    scale = min(1.0, a / b) if b else 1.0
    out = {k: odds(k, inside[k], outside[k] * scale) for k in {*inside, *outside}}
    ta, tb = sum(tags[True].values()), sum(tags[False].values())
    for k in {*tags[True], *tags[False]}:
        w = max(-BOUND, min(BOUND, log((tags[True][k] + 1) / (ta + 2)) - log((tags[False][k] + 1) / (tb + 2))))
        out["<" + k] = min(w, -0.05) / 2
    return out


def fit(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights counted on about `sample` pages that carry an article or main element, whole, chosen by a hash of page_id and html; 2 * sample at most."""
    spread = F.pmod(F.xxhash64("page_id", "html"), F.lit(max(pages.count(), 1)))
    labelled = pages.where(F.col("html").rlike(r"(?i)<(article|main)[\s>]")).select(F.col("page_id"), F.col("html"), spread.alias("_spread"))
    near = labelled.where(F.col("_spread") < sample).orderBy("_spread", "page_id", F.xxhash64("html")).limit(2 * sample)
    return counted([r["html"] for r in near.select("html").collect()])


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page."""
    weights = fit(pages) if weights is None else weights
    schema = "page_id long, url string, text string, n_chars long"

    def make(batches):
        for b in batches:
            ids, urls, html = (b.column(c).to_pylist() for c in ("page_id", "url", "html"))
            for lo, hi in runs([len(x or "") for x in html]):
                out = [scored(x or "", weights) for x in html[lo:hi]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi], pa.int64()), pa.array(urls[lo:hi], pa.string()), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return in_arrow(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), make, schema)
