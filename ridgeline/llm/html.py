"""Main text of web pages: flat text blocks classified by a small decision tree.

A page is cut into flat blocks at block-level tags. A block's features are its word count and link density, those of
the blocks before and after it, and where it stands: inside an article, inside a menu, header, footer, sidebar, notice,
advert, form or comment section, in a heading. A tag or a class made of such words alone says so outright (2); one that
only contains such a word, as "ad-hoc" or "footer-notes" do, is a hint (1), and then it depends on words and links of the
block and its neighbours. A decision tree (Gini, grown in numpy) is trained on the small labelled table below; blocks that
it takes for content are joined in page order.

Null and empty html: empty text. Markup that is cut off or not closed: the rest of the page counts as far as it goes; an
unfinished tag or comment at the end is markup, an unfinished character reference stays as html.unescape leaves it.
Very long pages: parsed whole in one pass. Repeated rows: each extracted. Ties in the tree: the smaller feature, then
the smaller limit, wins. Columns besides those named are dropped, so their names can't clash. Rows without a key: extracted, with a null key. Empty table: empty result. Lists of links inside an article stay unless a tag or class says that they are menus.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import map_rows

# Fixed values of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead tr ul".split()
)
#: Their contents are no text of the page.
RAW_TAGS = frozenset("script style textarea title iframe template noembed noframes desc metadata".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Containers, and words of class, id or role, that hold no main text.
SIDE_TAGS = frozenset("nav footer aside form menu dialog button fieldset search select noscript".split())
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promoted nav navbar navigation menu menus breadcrumb breadcrumbs sidebar header footer masthead topbar cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login comment comments disqus replies sharing widget toolbar pagination pager complementary contentinfo".split()
)
#: Words that do so alone, or with one of the companions: "related" and "related-posts", but not "related-work"; never on a paragraph.
WEAK_WORDS = frozenset("side related recommended share social promo banner notice alert search reply respond".split())
COMPANIONS = frozenset("bar box block area section container wrapper panel col column content list links items posts post articles stories news buttons button icons form nav message media".split())
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>""")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Words that add nothing to a side word, and those of an article itself, which do so for all but its header.
PLAIN_WORDS = frozenset(
    "top bottom left right main inner outer wrap site page global primary secondary mobile desktop sticky fixed slot unit zone body title text label toggle icon btn link item row grid policy settings banner field count thread feed author user reader js sm md lg xl wide small large first last new".split()
)
OWN_WORDS = frozenset("post article story entry".split())
PART = re.compile(r"[_-]+")

#: words, links, words before, links before, words after, links after, article (1 inside, -1 outside of one, 0 none), side (2, hint 1), heading -> content
LABELLED = [
    # fixed table: an article's paragraphs, titles and lists, short ones included
    (120, 0.0, 40, 0.0, 90, 0.0, 1, 0, 0, 1), (3, 0.0, 80, 0.0, 60, 0.0, 1, 0, 0, 1), (9, 0.0, 3, 0.1, 70, 0.0, 1, 0, 1, 1),
    (60, 0.2, 10, 0.0, 0, 0.0, 1, 0, 0, 1), (1, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 1), (14, 1.0, 50, 0.0, 44, 0.0, 1, 0, 0, 1),
    (25, 0.4, 6, 1.0, 8, 0.0, 1, 0, 0, 1), (6, 0.0, 2, 1.0, 3, 0.0, 1, 0, 1, 1), (400, 0.0, 12, 0.0, 12, 0.2, 1, 0, 0, 1),
    (5, 0.6, 30, 0.0, 30, 0.0, 1, 0, 0, 1), (2, 0.0, 1, 1.0, 1, 1.0, 1, 0, 0, 1), (33, 0.1, 5, 0.0, 7, 0.5, 1, 0, 0, 1),
    (4, 0.0, 9, 0.0, 2, 0.0, 1, 0, 0, 1), (3, 0.0, 4, 0.0, 6, 0.0, 1, 0, 0, 1), (4, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 1), (3, 0.0, 1, 1.0, 1, 1.0, 1, 0, 1, 1),
    (4, 0.25, 30, 0.0, 5, 0.0, 1, 0, 0, 1), (2, 1.0, 9, 0.0, 9, 0.0, 1, 0, 0, 1), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 1), (7, 0.9, 2, 0.0, 1, 0.0, 1, 0, 0, 1),
    (4, 0.0, 30, 0.0, 41, 0.0, 1, 0, 1, 1), (3, 0.3, 8, 0.5, 4, 1.0, 1, 0, 0, 1), (30, 0.9, 4, 0.0, 3, 0.0, 1, 0, 0, 1), (4, 0.0, 2, 1.0, 3, 1.0, 1, 0, 0, 1),
    # inside an article, yet a menu, form, advert, notice or comment
    (40, 0.0, 60, 0.0, 50, 0.0, 1, 2, 0, 0), (5, 1.0, 60, 0.0, 5, 1.0, 1, 2, 0, 0), (3, 0.0, 90, 0.0, 80, 0.0, 1, 2, 1, 0),
    (12, 0.3, 70, 0.0, 0, 0.0, 1, 2, 0, 0), (150, 0.0, 100, 0.0, 20, 0.0, 1, 2, 0, 0), (1, 0.0, 0, 0.0, 0, 0.0, 1, 2, 0, 0),
    # outside the article of a page that has one
    (10, 0.0, 1, 1.0, 9, 0.0, -1, 2, 0, 0), (40, 0.0, 5, 1.0, 9, 0.0, -1, 0, 0, 0), (3, 1.0, 2, 1.0, 2, 1.0, -1, 0, 0, 0),
    (15, 0.2, 200, 0.0, 0, 0.0, -1, 2, 0, 0), (90, 0.0, 60, 0.0, 60, 0.0, -1, 0, 0, 0), (6, 0.0, 0, 0.0, 20, 0.0, -1, 0, 1, 0),
    (1, 1.0, 0, 0.0, 1, 1.0, -1, 2, 0, 0), (220, 0.0, 30, 0.0, 3, 0.0, -1, 2, 0, 0), (30, 0.7, 2, 0.0, 2, 0.0, -1, 0, 0, 0),
    # pages without an article: long blocks, short ones between long ones, headings before them
    (80, 0.0, 60, 0.0, 70, 0.0, 0, 0, 0, 1), (45, 0.1, 3, 1.0, 50, 0.0, 0, 0, 0, 1), (30, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1),
    (20, 0.1, 40, 0.0, 2, 1.0, 0, 0, 0, 1), (7, 0.0, 50, 0.0, 60, 0.0, 0, 0, 0, 1), (8, 0.0, 2, 1.0, 60, 0.0, 0, 0, 1, 1),
    (5, 0.0, 30, 0.0, 30, 0.0, 0, 0, 1, 1), (2, 0.0, 70, 0.0, 40, 0.0, 0, 0, 0, 1), (14, 0.0, 20, 0.0, 16, 0.0, 0, 0, 0, 1),
    (12, 0.0, 12, 0.0, 11, 0.0, 0, 0, 0, 1), (9, 0.0, 0, 0.0, 40, 0.0, 0, 0, 1, 1), (25, 0.3, 30, 0.0, 28, 0.1, 0, 0, 0, 1),
    (1, 0.0, 2, 1.0, 80, 0.0, 0, 0, 1, 1), (3, 0.0, 1, 1.0, 45, 0.0, 0, 0, 1, 1), (2, 0.0, 5, 0.9, 30, 0.0, 0, 0, 1, 1), (4, 0.0, 3, 1.0, 20, 0.1, 0, 0, 1, 1),
    (88, 0.0, 88, 0.0, 1, 1.0, 0, 0, 0, 1), (90, 0.0, 1, 0.0, 88, 0.0, 0, 0, 0, 1), (200, 0.05, 3, 1.0, 150, 0.1, 0, 0, 0, 1),
    (130, 0.0, 4, 1.0, 3, 1.0, 0, 0, 0, 1), (60, 0.0, 90, 0.0, 4, 1.0, 0, 0, 0, 1), (300, 0.1, 200, 0.0, 1, 1.0, 0, 0, 0, 1),
    (70, 0.1, 1, 1.0, 2, 1.0, 0, 0, 0, 1), (16, 0.0, 90, 0.0, 1, 1.0, 0, 0, 0, 1), (110, 0.2, 6, 0.0, 30, 0.0, 0, 0, 0, 1),
    (88, 0.0, 88, 0.0, 1, 1.0, 0, 2, 0, 0), (90, 0.0, 1, 0.0, 88, 0.0, 0, 2, 0, 0), (16, 0.0, 90, 0.0, 80, 0.0, 0, 2, 0, 0),
    (200, 0.0, 100, 0.0, 90, 0.0, 1, 2, 0, 0), (20, 0.0, 40, 0.0, 30, 0.0, 1, 2, 0, 0), (300, 0.1, 2, 0.0, 5, 0.0, 1, 2, 0, 0),
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0), (1, 1.0, 1, 1.0, 60, 0.0, 0, 0, 0, 0), (6, 0.8, 50, 0.0, 5, 0.9, 0, 0, 0, 0),
    (4, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0), (30, 0.9, 20, 0.8, 25, 0.9, 0, 0, 0, 0), (18, 0.6, 4, 1.0, 3, 1.0, 0, 0, 0, 0),
    (3, 0.0, 4, 0.7, 2, 0.5, 0, 0, 1, 0), (40, 0.0, 50, 0.0, 60, 0.0, 0, 2, 0, 0), (6, 0.0, 30, 0.0, 0, 0.0, 0, 2, 0, 0),
    (2, 1.0, 0, 0.0, 2, 1.0, 0, 2, 0, 0), (100, 0.1, 5, 0.0, 5, 0.0, 0, 2, 0, 0), (4, 0.0, 3, 1.0, 80, 0.0, 0, 2, 1, 0),
    # a class hints at a side part: prose and titles stay, links and what stands among links go
    (40, 0.0, 60, 0.0, 50, 0.0, 1, 1, 0, 1), (6, 0.0, 30, 0.0, 40, 0.0, 1, 1, 0, 1), (3, 0.0, 0, 0.0, 70, 0.0, 1, 1, 1, 1), (120, 0.1, 5, 0.0, 0, 0.0, 1, 1, 0, 1),
    (15, 0.2, 20, 0.0, 16, 0.1, 1, 1, 0, 1), (2, 0.0, 9, 0.0, 12, 0.0, 1, 1, 0, 1), (60, 0.3, 4, 0.0, 3, 0.0, 1, 1, 0, 1), (9, 0.0, 80, 0.0, 0, 0.0, 1, 1, 0, 1), (30, 0.1, 2, 1.0, 40, 0.0, 1, 1, 0, 1),
    (3, 1.0, 60, 0.0, 3, 1.0, 1, 1, 0, 0), (5, 0.8, 3, 1.0, 4, 1.0, 1, 1, 0, 0), (12, 0.9, 40, 0.0, 0, 0.0, 1, 1, 0, 0), (2, 1.0, 2, 1.0, 50, 0.0, 1, 1, 0, 0), (25, 0.7, 9, 0.0, 8, 0.0, 1, 1, 0, 0),
    (2, 0.0, 3, 1.0, 2, 1.0, 1, 1, 0, 0), (4, 0.0, 70, 0.0, 3, 1.0, 1, 1, 0, 0), (3, 0.0, 50, 0.0, 2, 0.9, 1, 1, 1, 0), (1, 0.0, 4, 0.8, 6, 0.9, 1, 1, 0, 0),
    (40, 0.0, 60, 0.0, 50, 0.0, 0, 1, 0, 1), (25, 0.1, 30, 0.0, 28, 0.1, 0, 1, 0, 1), (90, 0.0, 3, 1.0, 50, 0.0, 0, 1, 0, 1), (4, 1.0, 30, 0.0, 5, 0.9, 0, 1, 0, 0), (3, 0.0, 4, 0.7, 2, 0.8, 0, 1, 0, 0), (6, 0.8, 20, 0.0, 30, 0.0, 0, 1, 0, 0),
    (40, 0.0, 60, 0.0, 50, 0.0, -1, 1, 0, 0), (8, 0.0, 3, 1.0, 9, 0.0, -1, 1, 0, 0),
]


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 8) -> tuple | int:
    """A tree as nested (feature, limit, at most, above), a leaf as its class."""
    ones = int(labels.sum())
    if depth == 0 or ones in (0, len(labels)):
        return int(2 * ones > len(labels))
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] <= limit
            impurity = sum(len(y) * 2 * y.mean() * (1 - y.mean()) for y in (labels[low], labels[~low]))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(limit), low)
    if best is None:
        return int(2 * ones > len(labels))
    _, f, limit, low = best
    return (f, limit, grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1))


def train(table: list[tuple] = LABELLED) -> tuple | int:
    data = np.asarray(table, float)
    return grow(data[:, :-1], data[:, -1])


def decide(tree: tuple | int, row: tuple) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def _side(tag: str, attributes: str, inside_article: bool) -> int:
    """2: a side part, 1: a class, id or role hints at one."""
    if tag in SIDE_TAGS or tag == "header" and not inside_article:
        return 2
    hint = 0
    for name, a, b, c in ATTRIBUTE.findall(attributes) if attributes.strip(" /") else ():
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return 2
        for word in value.split() if name in ("class", "id", "role") else ():
            parts = {p for p in PART.split(word) if p and not p.isdigit()}
            if tag not in ("p", "li") and parts & WEAK_WORDS and (len(parts) == 1 or parts & COMPANIONS):
                return 2
            if side := parts & SIDE_WORDS:
                rest = parts - SIDE_WORDS - WEAK_WORDS - COMPANIONS - PLAIN_WORDS
                if not rest or rest <= OWN_WORDS and side != {"header"}:
                    return 2
                hint = 1
    return hint


@cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>?", re.I)


def blocks(html: str) -> list[tuple[str, int, int, int, int, int]]:
    """Text, words, linked words, article (1 inside, else 0), side (2, hint 1) and heading of each flat block with text."""
    out: list[tuple[str, int, int, int, int, int]] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, int]] = []  # open containers: tag, whether article, side
    open_tags: Counter[str] = Counter()  # so that an end tag without a start isn't looked for
    article = heading = linked = 0
    sides = [0, 0, 0]  # open containers of each kind of side
    at, n = 0, len(html)

    def close() -> None:
        text = " ".join(unescape("".join([t for t, _ in parts])).split())
        if text:
            links = sum(len(unescape(t).split()) for t, a in parts if a)
            out.append((text, text.count(" ") + 1, links, int(article > 0), 2 if sides[2] else 1 if sides[1] else 0, int(heading > 0)))
        parts.clear()

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            parts.append((html[at:], linked > 0))
            break
        if lt > at:
            parts.append((html[at:lt], linked > 0))
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        follows = html[lt + 1 : lt + 3]
        if not (follows[:1].isascii() and follows[:1].isalpha() or follows[:1] == "/" and follows[1:].isascii() and follows[1:].isalpha()):
            if follows[:1] == "/" :
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                parts.append(("<", linked > 0))
                at = lt + 1
            continue
        m = TAG.match(html, lt)
        if m is None:  # an open quote or no end: markup up to the next bracket
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        ending, tag, attributes, at = m[1], m[2].lower(), m[3], m.end()
        if tag == "br":
            parts.append((" ", False))
        elif tag == "a":
            linked = 0 if ending else 1
        elif tag in RAW_TAGS:
            if not ending and not attributes.endswith("/"):
                end = _end_of(tag).search(html, at)
                at = n if end is None else end.end()
            if tag in BLOCK_TAGS:
                close()
        elif tag in BLOCK_TAGS:
            close()
            if tag in HEADINGS:
                heading = 0 if ending else 1
            elif ending:
                if open_tags[tag] and tag not in ("p", "li"):
                    name = ""
                    while name != tag:
                        name, a, s = stack.pop()
                        open_tags[name] -= 1
                        article -= a
                        sides[s] -= 1
                    linked = heading = 0
            elif tag not in VOID_TAGS:
                is_article = tag in ("article", "main")
                is_side = _side(tag, attributes, article > 0)
                if tag not in ("p", "li") or is_side:
                    if tag in ("p", "li") :  # closed by the next one at latest
                        tag = "p "
                    stack.append((tag, is_article, is_side))
                    open_tags[tag] += 1
                    article += is_article
                    sides[is_side] += 1
            if tag in ("p", "li"):
                while stack and stack[-1][0] == "p ":
                    open_tags["p "] -= 1
                    sides[stack.pop()[2]] -= 1
    close()
    return out


def main_text(html: str | None, tree: tuple | int) -> str:
    found = blocks(html or "")
    has_article = any(b[3] for b in found)
    shape = [(0, 0.0), *((b[1], b[2] / b[1]) for b in found), (0, 0.0)]
    return "\n\n".join(
        b[0] for i, b in enumerate(found) if decide(tree, (*shape[i + 1], *shape[i], *shape[i + 2], 1 if b[3] else -1 if has_article else 0, b[4], b[5]))
    )


def extract(df: DataFrame, key: str, html: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the string columns in keep, text. Raises ValueError if one of keep has the name of another column of the result."""
    if len({key, "text", *keep}) < 2 + len(keep):
        raise ValueError("names of the result would clash")
    tree = train()

    def make():
        def step(batch, rows) -> None:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for k, page, *rest in zip(*columns):
                text = main_text(page, tree)
                rows.add(k, *rest, text, size=4 * len(text) + 64)

        return step

    names = "".join(f",{c} string" for c in keep)
    return map_rows(df.select(F.col(key).cast("long"), html, *keep), f"{key} long{names},text string", make)
