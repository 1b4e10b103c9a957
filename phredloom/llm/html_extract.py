"""Main-text extraction from HTML by line-block distribution.

Markup is stripped into lines (one per block element), each line gets an
effective length (its text without link text, and 0 if all that stands outside of
its links are separators), lengths are summed over a sliding window of lines, and
the text between a surge and the following dive of these sums is kept.

The surge level is ``SURGE`` characters, or the page's highest sum where no sum
is that high, so that a page of short paragraphs keeps them; a dive is a sum under
the surge level's ``DIVE``th part. Lines without length at the ends of what is kept
go. So a menu of three lines or more parts the text, and one or two linked lines
inside a text stay.

Three kinds of knowledge enter before the sums. Elements that never hold
article text (scripts, menus, forms, footers, adverts, comment lists, ...) give
no lines at all, and neither do short lines that are notices by their words
(cookies, headings of teasers; outside of a marked article copyright lines too). Where the page marks its article
(``article``, ``main`` or ``itemprop=articleBody``), the mark is a weight of the line
lengths: a line inside counts ``INSIDE``-fold (a heading its links too), and one
outside counts the less, the more of the page's text the mark holds. So the surge and
the dive fall on the article's own edges, while a mark around a teaser does not hide
a long text beside it: a line outside stays if it still counts ``OUTSIDE`` and lies
between surge and dive.

A class or id names such an element by its head word (``site-header``,
``related-posts``; not ``has-sidebar`` or ``related-work``). ``main`` or
``articleBody`` inside an element known by class or id alone is the article all
the same. So is ``article`` there, unless the element holds comments, teasers or
adverts, if it gives more text than the page without it. A class that names a
place in the layout (header, sidebar, ...) does not drop an element that holds
most of the text of a page without a mark. After a heading that announces
readers' comments, the rest of the heading's parent element goes.

Defined results: null or empty html gives ''; an unclosed element ends where an
enclosing one ends or at the end of the page; an unclosed comment or script
swallows the rest; ``br`` and block tags end a line; a page with link text only
gives ''. A null page_id or url is returned as null. Row order, repeats and
extra columns do not matter. Every scan is linear in the page, whatever quotes,
tags or comments it leaves open.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 86
DIVE = 32
INSIDE = 2
OUTSIDE = SURGE // 2
NOTICE_CHARS = 200  # a longer line is no notice

# HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SKIP = frozenset("head nav footer aside form button select option script style noscript template svg math canvas iframe object audio video dialog menu label textarea title noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img".split())
MAIN = frozenset(["article", "main"])
ROOTS = frozenset(["html", "body", "article", "main"])
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget widgets comment comments respond disqus reply replies share sharing social related recommended newsletter subscribe subscription signup login search pagination pager toc skip".split()
)
OTHERS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments respond disqus reply replies related recommended".split())
LAYOUT = frozenset("header masthead topbar sidebar aside widget widgets nav navigation navbar menu skip".split())
# Words after the head word that name a part or place, and words before it that say where it is not.
PARTS = frozenset("area articles bar block body bottom box button buttons card cards center column container content desktop feed form group icon icons info inner item items label law left link links list main message mobile outer panel pane post posts primary right secondary section slot slots sticky thread title top unit wrap wrapper zone".split())
AWAY = frozenset("has no not with without hide content article".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

_OPEN = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_VALUE = re.compile(r">|=\s*(?:([\"'])|[^\s>\"'][^\s>]*)")
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_WORDS = re.compile(r"[A-Za-z]+")
# Headings above readers' comments.
_COMMENTS = re.compile(r"(?:[0-9]+ |(?:the |all |reader |readers[’'] |reader[’']s |user )?)comments?(?: ?\([0-9]+\))?:?|(?:leave|post|write|add) (?:a|your) (?:comment|reply)", re.I)
# Short lines that are notices or stand above teasers; those of page feet, which an article may quote.
_NOTICE = re.compile(r"(?:we|this (?:site|website|page)) uses? cookies\b.*|(?:related|recommended|more) (?:stories|articles|posts|links|news|reading):?|you (?:may|might) also like:?|share this(?: (?:article|story|page|post))?:?|advertisement|sponsored content", re.I)
_FOOT = re.compile(r"(?:©|\(c\) ?[0-9]{4}|copyright\b).*|.*\ball rights reserved\.?|contact us\b.{0,60}", re.I)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())


def _head(token: str) -> str:
    """The word of a class or id that says what the element is; '' if it only says what is near it."""
    words = [w for w in _WORDS.findall(token) if len(w) > 1]
    while len(words) > 1 and words[-1] in PARTS:
        words.pop()
    return words[-1] if words and AWAY.isdisjoint(words[:-1]) else ""


def _boilerplate(tag: str, attrs: str, in_main: bool) -> str:
    """Why an element goes: 'sure', 'layout' or 'class' (by a class), 'others' (a class of comments, teasers or adverts), or '' (it stays)."""
    if tag in SKIP or tag == "header" and not in_main:
        return "sure"
    if not attrs or tag in ROOTS:
        return ""
    why = ""
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return "sure"
        if name == "style" and "display:none" in value.replace(" ", ""):
            return "sure"
        if name == "role" and value in ROLES:
            return "sure"
        if name in ("class", "id"):
            heads = BOILERPLATE.intersection(map(_head, value.split())) - ({"header"} if in_main else set())
            if not OTHERS.isdisjoint(heads):
                why = "others"
            elif heads and why != "others":
                why = "layout" if heads <= LAYOUT and why != "class" else "class"
    return why


def _article_body(attrs: str) -> bool:
    return "articleBody" in attrs and any(n.lower() == "itemprop" and "articleBody" in (a or b or c).split() for n, a, b, c in _ATTR.findall(attrs))


class _Tags:
    """Tags and comments of a page in turn; a quoted value may hold ``>`` and be of any length.

    A quote without a partner before the page's last ``>`` opens nothing, and
    is looked up once, so that quotes left open cost no repeated scans.
    """

    def __init__(self, page: str) -> None:
        self.page, self.last, self.open = page, page.rfind(">"), set[str]()

    def after(self, at: int) -> tuple[int, int, str | None, bool, str] | None:
        """Start, end, name (None: a comment or declaration), whether it closes, and attributes of the first tag from ``at``."""
        m = _OPEN.search(self.page, at)
        while m and m[0] != "<!--" and m.start() > self.last:
            m = _OPEN.search(self.page, m.end())
        if not m or m[0] == "<!--":
            return m and (m.start(), m.end(), None, False, "")
        if m[2] is None:
            return m.start(), self.page.index(">", m.end()) + 1, None, False, ""
        end = m.end()
        while (v := _VALUE.search(self.page, end)) and v[0] != ">":
            end = v.end()
            if v[1] and v[1] not in self.open:
                close = self.page.find(v[1], end)
                if 0 <= close < self.last:
                    end = close + 1
                else:
                    self.open.add(v[1])
        return m.start(), v.end(), m[2], bool(m[1]), self.page[m.end() : v.start()]


def _text_end(page: str, at: int) -> int:
    """Where the text after the last tag ends: before a tag that the end of the page cuts off."""
    cut = page.rfind("<", at)
    broken = cut >= 0 and page.find(">", cut) < 0 and (page[cut + 1 : cut + 2].isalpha() or page[cut + 1 : cut + 2] in ("/", "!"))
    return cut if broken else len(page)


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """(text, characters of link text, kind) of each non-empty line.

    Kind is 1 inside the marked article, 2 inside an article of a skipped
    element, from 3 on in an element skipped for its place in the layout (one
    number each), else 0.
    """
    out: list[tuple[str, int, int]] = []
    stack: list[str] = []  # open elements
    n_open: Counter[str] = Counter()
    parts: list[str] = []
    linked, loose = 0, False  # characters of link text; whether letters or digits stand outside of links
    skip_at = main_at = link_at = mute_at = -1  # stack depth at which such an element opened
    why, outer, kind, place = "", (-1, ""), 1, 2  # of the skipped element, of the one around the article, of the article, of the layout
    deep = -1, ""  # an element in a skipped one that goes for a stronger reason

    def flush(heading: bool = False) -> str:
        nonlocal linked, loose
        text = ""
        if parts:
            text = " ".join("".join(parts).split())
            if text and not (len(text) <= NOTICE_CHARS and (_NOTICE.fullmatch(text) or main_at < 0 and _FOOT.fullmatch(text))):
                without = 0 if heading and main_at >= 0 else linked if loose else len(text)
                out.append((text, without if linked else 0, kind if main_at >= 0 else place if skip_at >= 0 else 0))
            parts.clear()
        linked, loose = 0, False
        return text

    def close_to(depth: int) -> None:
        nonlocal skip_at, main_at, link_at, mute_at, why, outer, deep
        if skip_at >= depth or 0 <= mute_at >= depth:
            flush()
        for name in stack[depth:]:
            n_open[name] -= 1
        del stack[depth:]
        skip_at, link_at, mute_at = (-1 if x >= depth else x for x in (skip_at, link_at, mute_at))
        if deep[0] >= depth:
            deep = -1, ""
        if main_at >= depth:
            main_at = -1
            if 0 <= outer[0] < depth:
                skip_at, why = outer
            outer = -1, ""

    at, n, tags = 0, len(page), _Tags(page)
    while at < n:
        found = tags.after(at)
        end = found[0] if found else _text_end(page, at)
        if end > at and (skip_at < 0 or why == "layout" and mute_at < 0):
            text = htmllib.unescape(page[at:end])
            parts.append(text)
            if link_at >= 0:
                linked += len(" ".join(text.split()))
            else:
                loose = loose or any(map(str.isalnum, text))
        if not found:
            break
        start, at, tag, closing, attrs = found
        if tag is None:
            if page.startswith("<!--", start):
                at = page.find("-->", at)
                at = n if at < 0 else at + 3
            continue
        tag = tag.lower()
        line = "" if tag in INLINE else flush(closing and tag in _HEADINGS)
        if closing:
            if not n_open[tag]:
                continue
            depth = len(stack) - 1
            while stack[depth] != tag:
                depth -= 1
            close_to(depth)
            if tag in _HEADINGS and line and skip_at < 0 and _COMMENTS.fullmatch(line):
                out.pop()  # a line that announces comments is no notice
                skip_at, why = max(0, depth - 1), "others"
            continue
        if n_open["p"]:
            if tag in _CLOSES_P and stack[-1] == "p":
                close_to(len(stack) - 1)
            elif tag == "p" or tag in _CLOSES_P:  # a paragraph left open around inline elements
                depth = len(stack) - 1
                while depth and stack[depth] != "p" and stack[depth] in INLINE:
                    depth -= 1
                if stack[depth] == "p":
                    close_to(depth)
        if tag in VOID or attrs.endswith("/"):
            continue
        body = main_at < 0 and (skip_at < 0 or "sure" not in (why, deep[1])) and (tag in MAIN or _article_body(attrs))
        if skip_at >= 0 and body and (tag != "article" or why in ("class", "layout") and not deep[1]) and not _boilerplate(tag, attrs, False):
            flush()
            outer, kind = (skip_at, why), 2 if tag == "article" else 1
            skip_at, main_at = -1, len(stack)
        elif skip_at >= 0:
            reason = "" if why == "sure" or tag in RAW else _boilerplate(tag, attrs, False)
            if reason in ("sure", "others") and not deep[1]:
                deep = len(stack), reason
            if why == "layout" and mute_at < 0 and (reason or tag in RAW):
                flush()
                mute_at = len(stack)
            elif tag == "a" and link_at < 0:
                link_at = len(stack)
        elif reason := _boilerplate(tag, attrs, main_at >= 0):
            flush()
            skip_at, why, place = len(stack), reason, place + (reason == "layout")
        elif body:
            flush()
            main_at, kind = len(stack), 1
        elif tag == "a" and link_at < 0:
            link_at = len(stack)
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at, tags.last + 1)
            at = close.end() if close else n
            skip_at, mute_at = (-1 if x == len(stack) else x for x in (skip_at, mute_at))
            continue
        stack.append(tag)
        n_open[tag] += 1
    flush()
    return out


def main_text(page: str | None) -> str:
    """The main text of one page: the lines between surge and dive, joined by newlines."""
    lines = lines_of(page or "")
    own = [x for x in lines if x[2] < 2]
    if any(k == 1 for _, _, k in own):
        return _between(own)
    mass = Counter()
    for t, linked, k in lines:
        mass[k] += max(0, len(t) - linked)
    most = max((k for k in mass if k > 2), key=mass.__getitem__, default=0)
    if most and 2 * mass[most] > mass.total():
        own = [(t, linked, 0) for t, linked, k in lines if k in (0, most)]
    return max(_between(own), _between([(t, linked, 1) for t, linked, k in lines if k == 2]), key=len)


def effective_lengths(lines: list[tuple[str, int, int]]) -> list[int]:
    """What each line counts: its text without link text and separators, weighted by the mark."""
    raw = [max(0, len(t) - linked) for t, linked, _ in lines]
    inside = sum(n for n, (_, _, m) in zip(raw, lines, strict=True) if m)
    if not any(m for _, _, m in lines):
        return raw
    weight = (1 - inside / max(1, sum(raw))) ** 4
    return [n * INSIDE if m else int(n * weight) for n, (_, _, m) in zip(raw, lines, strict=True)]


def _between(lines: list[tuple[str, int, int]]) -> str:
    marked, length = any(m for _, _, m in lines), effective_lengths(lines)
    n, half = len(lines), WINDOW // 2
    block = [sum(length[max(0, i - half) : i + half + 1]) for i in range(n)]
    surge = min(SURGE, max(block, default=0))
    low = [not b or b * DIVE < surge for b in block]
    keep: list[str] = []
    i = 0
    while i < n:
        if low[i]:
            i += 1
            continue
        dive = i
        while dive < n and not low[dive]:
            dive += 1
        if max(block[i:dive]) >= surge:
            first, last = i, dive - 1
            while first <= last and not length[first]:
                first += 1
            while last >= first and not length[last]:
                last -= 1
            keep += [t for j, (t, _, m) in enumerate(lines[first : last + 1], first) if m or not marked or length[j] >= OUTSIDE]
        i = dive
    return "\n".join(keep)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` (code points) of every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(x if isinstance(x, str) else None) for x in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").alias("url"), F.col(html_col).alias("html"))
    out = rows.mapInPandas(run, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast("long"))
