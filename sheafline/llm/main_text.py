"""Main text of HTML pages as a maximum-scoring subsequence.

A page is read as a sequence of words and tags. Every word scores by where it stands (the role of
its nearest landmark element, inside a link or not), every tag by its name and whether it stands in a
content element; the scores are log odds learned from labelled pages, tags never above a small negative value. Page furniture (menus,
adverts, comments, forms and the like, and what is hidden) is transparent: its words and tags score
nothing, those of its own element included, so it neither joins nor parts what stands around it. One linear scan finds the contiguous
stretch with the largest total; its words outside furniture are joined in page order.

Defined results: a null or empty page, or one without a positive word, gives an empty text; of two
stretches with equal scores the first wins; unclosed elements end with their parent; of the elements
that are skipped whole, a self-closed one (`<svg/>`) is empty and an unclosed one ends with its parent too,
but an unclosed script, style, title or comment runs to the end of the page, as does an unclosed quoted
attribute; pages may
be very long or deeply nested, the time is linear in their length; rows are independent, so repeated
pages and extra columns need no care.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm.labelled_pages import labelled_pages

# HTML element names by what they do.
SKIPPED = frozenset("script style noscript template svg math iframe object canvas audio video title head select option datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
LANDMARKS = {
    "article": "content", "main": "content", "nav": "menu", "menu": "menu", "header": "header", "footer": "footer",
    "aside": "aside", "form": "form", "button": "form", "textarea": "form", "fieldset": "form", "dialog": "notice",
}
#: Names in class, id and role attributes that tell what an element is for, most telling first.
NAMED = [
    ("comment", "comment comments commentlist disqus respond reply replies discussion"),
    ("advert", "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted adsense"),
    ("menu", "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager tabs sitemap"),
    ("notice", "notice cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup paywall toast banner"),
    ("aside", "sidebar aside related recommended widget widgets share sharing social tags recirc complementary"),
    ("footer", "footer copyright colophon contentinfo legal"),
    ("header", "masthead topbar branding"),
    ("form", "form search searchbox login"),
    ("content", "article content main post entry story body text"),
]
ROLE_OF = {word: role for role, names in reversed(NAMED) for word in names.split()}
#: Parts of names that tell nothing of their own.
GENERIC = frozenset("site page top bottom left right primary secondary global inner outer list box block wrapper wrap container area bar section item items links posts reader user".split())
#: As the last part of a name, these tell enough whatever stands before.
TELLING = frozenset("comment comments commentlist ad ads advert nav navbar navigation menu breadcrumb breadcrumbs pagination sidebar footer".split())
HIDDEN = "hidden"
ROLES = ("plain", "content", "comment", "advert", "menu", "notice", "aside", "footer", "header", "form", HIDDEN)
FURNITURE = frozenset(r + s for r in ROLES[2:] for s in ("", "/link"))

# Quotes count only after an equals sign; possessive, so that a tag is read once.
LEXER = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|</?([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))?|=)*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]*+)))?")
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
#: What these hold is no markup, so that only their own end tag ends them.
RAW = frozenset("script style title".split())
CLOSING = {name: re.compile(rf"</{name}(?![a-z0-9])", re.I | re.A) for name in RAW}
ANY_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)[^>]*+")


def role_of_name(name: str) -> str | None:
    """The role told by one name; other parts than furniture and generic ones make it tell nothing."""
    if name in ROLE_OF:
        return ROLE_OF[name]
    parts = re.split(r"[-_]+", name)
    if len(parts) > 1:
        if parts[-1] in TELLING:
            return ROLE_OF[parts[-1]]
        told = [p for p in parts if p not in GENERIC]
        if told and all(p in ROLE_OF for p in told):
            roles = {ROLE_OF[p] for p in told}
            if roles == {"content"} or "content" not in roles:
                return next(role for role, _ in NAMED if role in roles)
    return None


def role_by_name(attributes: dict[str, str]) -> str | None:
    """The role told by class, id and role attributes."""
    found = {role_of_name(name) for key in ("class", "id", "role") for name in attributes.get(key, "").lower().split()}
    return next((role for role, _ in NAMED if role in found), None)


def attributes_of(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)}


def hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(NOT_SHOWN.search(attributes.get("style", "")))


def ends_of(page: str) -> dict[int, int]:
    """Start of each start tag -> start of its end tag, by name alone, in one pass."""
    waiting: dict[str, list[int]] = {}
    out = {}
    for m in ANY_TAG.finditer(page):
        name = m[2].lower()
        if m[1]:
            if waiting.get(name):
                out[waiting[name].pop()] = m.start()
        elif not m[0].endswith("/"):
            waiting.setdefault(name, []).append(m.start())
    return out


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("tag", name, role) and ("text", raw text, role) in page order; scripts and the like are left out.

    The role is that of the nearest element that has one, with "/link" added inside a link. Content
    elements keep what they hold, save furniture named inside them; a header of an article is content.
    """
    stack: list[tuple[str, str, bool]] = []  # element, role, in a link
    opened: Counter[str] = Counter()  # elements of the stack by name, so that a stray end tag costs nothing
    role, link = "plain", False
    pos, end = 0, len(page)
    places: list[int] = []  # where the elements of the stack start
    ends: dict[int, int] | None = None

    def pop() -> tuple[str, str]:
        nonlocal role, link
        name, was, _ = stack.pop()
        places.pop()
        opened[name] -= 1
        role, link = (stack[-1][1], stack[-1][2]) if stack else ("plain", False)
        return name, was

    while pos < end:
        m = LEXER.search(page, pos)
        text_to = m.start() if m else end
        if text_to > pos:
            yield "text", page[pos:text_to], role + "/link" * link
        if not m:
            return
        pos = m.end()
        if not m[1]:
            continue
        name = m[1].lower()
        if m[0][1] == "/":
            ended, was = "", role
            while opened[name] and ended != name:
                ended, was = pop()
            yield "tag", name, was
            continue
        if name in SKIPPED:
            closed = page[m.end() - 2 : m.end()] == "/>"
            if name in RAW:
                close = CLOSING[name].search(page, pos)
                pos = close.start() if close else pos if closed else end
            elif not closed:
                ends = ends_of(page) if ends is None else ends
                pos = max(pos, ends.get(m.start(), ends.get(places[-1], pos) if places and name != "head" else pos))
            yield "tag", name, role
            continue
        attributes = attributes_of(m[2]) if m[2] else {}
        if name not in VOID:
            if name not in INLINE and stack and stack[-1][0] == "p":  # a block ends an open paragraph
                pop()
            if name == "li" and stack and stack[-1][0] == "li":
                pop()
        unseen = bool(attributes) and name not in ("html", "body") and hidden(attributes)
        if name in VOID or (name in INLINE and name != "a" and not unseen):
            yield "tag", name, role
            continue
        own = LANDMARKS.get(name)
        if attributes and name not in ("html", "body", "article", "main", "a"):
            own = role_by_name(attributes) or own
        if own == "header" and name == "header" and role == "content":
            own = "content"
        if own == "content" and role not in ("plain", "content", "header"):
            own = role  # content of a comment is a comment
        if unseen or role == HIDDEN:
            own = HIDDEN
        role, link = own or role, link or name == "a"
        yield "tag", name, role
        stack.append((name, role, link))
        places.append(m.start())
        opened[name] += 1


MARK = re.compile(r"\[\[|\]\]")
#: A tag never scores above this.
TAG_TOP = -0.05
CLIP = 4.0


def tag_feature(name: str, role: str) -> str:
    return f"<{name}@content" if role.startswith("content") else f"<{name}"


def features(page: str) -> Iterator[tuple[str, bool]]:
    """(feature, is in the main text) for each word and tag of a labelled page."""
    inside = False
    for kind, what, role in events(page):
        if role in FURNITURE:
            continue
        if kind == "tag":
            yield tag_feature(what, role), inside
            continue
        for part in re.split(r"(\[\[|\]\])", what):
            if MARK.fullmatch(part):
                inside = part == "[["
            else:
                yield from ((role, inside) for _ in part.split())


def fit(labelled: list[str] | None = None) -> dict[str, float]:
    """Log odds of words by role and of tags by name and place, from a bounded list of labelled pages."""
    labelled = labelled_pages() if labelled is None else labelled
    counts = Counter(x for page in labelled for x in features(page))
    total = {kind: {b: sum(n for (f, x), n in counts.items() if x == b and f.startswith("<") == kind) for b in (True, False)} for kind in (True, False)}
    names = {f for f, _ in counts} | {r + s for r in ROLES[:2] for s in ("", "/link")}
    weights = {}
    for f in names:
        tag = f.startswith("<")
        odds = math.log((counts[f, True] + 0.5) / (total[tag][True] + 1) * (total[tag][False] + 1) / (counts[f, False] + 0.5))
        weights[f] = max(-CLIP, min(CLIP, min(odds, TAG_TOP) if tag else odds))
    weights["content/link"] = max(weights["content/link"], 0.0)  # links in running text are text
    return weights


def extract(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    best, best_from, best_to = 0.0, 0, 0
    run, run_from = 0.0, 0
    found = list(events(page))
    for i, (kind, what, role) in enumerate(found):
        if role in FURNITURE:
            continue
        # words between two tags share a score, so the scan moves from tag to tag
        score = weights.get(tag_feature(what, role), TAG_TOP) if kind == "tag" else weights[role] * len(what.split())
        if run <= 0:
            run, run_from = 0.0, i
        run += score
        if run > best:
            best, best_from, best_to = run, run_from, i + 1
    parts = []
    for kind, what, role in found[best_from:best_to]:
        if kind == "tag":
            if what not in INLINE:
                parts.append(" ")
        elif role not in FURNITURE:
            parts.append(html.unescape(what))
    return " ".join("".join(parts).split())


def main_text(pages: DataFrame, column: str = "html", *, weights: dict[str, float] | None = None) -> DataFrame:
    """`pages` with `text`, the main text of each page. `weights` has a few hundred entries at most."""
    known = fit() if weights is None else weights

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        return pd.Series([extract(x, known) for x in column], dtype=object)

    return pages.withColumn("text", text_of(F.col(column)))


def op1(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
