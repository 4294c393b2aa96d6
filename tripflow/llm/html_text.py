"""Main text of web pages from flat text blocks.

A page is cut into blocks at block-level tags. Each block has its word count and link density, those of its
neighbours, and whether its tags say boilerplate or article. A decision tree, trained on the small labelled
table ``LABELLED``, tells main text from the rest.

Defined cases: a null, blank or text-free page gives the empty string; unclosed and crossed tags close with the
element around them; text without any block tag is one block; repeated rows give a row each; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A comment, a declaration, or a tag with its name and attributes.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
#: Text up to the end tag, or to the end of the page.
RAW = ("script", "style", "textarea", "title")
#: Elements without shown text; they end like others. A head also ends at the first thing that cannot stand in it.
HIDDEN = {"head", "noscript", "template", "svg", "iframe"}
IN_HEAD = {"head", "html", "base", "link", "meta", "noscript", "template", *RAW}
RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "menu", "button", "select", "dialog"}
MAIN = {"article", "main"}
BLOCK = BOILERPLATE | MAIN | {
    "address", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4",
    "h5", "h6", "hr", "html", "li", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr",
    "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ATTRIBUTE = re.compile(r"(?i)\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
HINT = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|breadcrumbs?|comments?|comment-?list|cookies?|disqus|footer|header|masthead|"
    r"menu|modal|nav|navbar|navigation|newsletter|notice|popup|promo|related|replies|share|sharing|sidebar|social|sponsor(?:ed)?|"
    r"subscribe|toolbar|widget|complementary|contentinfo)(?=$|[\s_-])"
)
#: Class names that speak of a part elsewhere, or of an article's own header.
NO_HINT = re.compile(r"(?i)(?:has|with|without|no)[_-]|(?:post|entry|article|story)[_-]header$")
SPACE = re.compile(r"\s+")
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "boilerplate", "article")
# The labelled table, fixed values: the features above and 1 for main text.
LABELLED = (
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0), (3, 1.0, 1, 1.0, 2, 1.0, 1, 0, 0),
    (9, 0.0, 1, 1.0, 8, 0.0, 1, 0, 0), (8, 0.0, 60, 0.0, 0, 0.0, 1, 0, 0), (12, 0.2, 40, 0.0, 0, 0.0, 1, 0, 0),
    (25, 0.0, 30, 0.0, 14, 0.0, 1, 0, 0), (60, 0.0, 70, 0.0, 20, 0.0, 1, 0, 0), (2, 0.0, 50, 0.0, 3, 0.0, 1, 0, 0),
    (30, 0.0, 20, 0.1, 5, 0.0, 1, 1, 0), (4, 1.0, 40, 0.0, 4, 1.0, 1, 1, 0), (90, 0.0, 40, 0.0, 30, 0.0, 1, 1, 0),
    (2, 0.5, 6, 0.0, 1, 0.0, 1, 1, 0), (15, 0.0, 4, 0.0, 15, 0.0, 1, 1, 0), (1, 0.0, 80, 0.0, 70, 0.0, 1, 1, 0),
    (1, 0.0, 60, 0.0, 40, 0.0, 0, 1, 1), (2, 0.0, 8, 0.0, 30, 0.0, 0, 1, 1), (9, 0.0, 7, 0.0, 45, 0.0, 0, 1, 1),
    (50, 0.0, 9, 0.0, 60, 0.0, 0, 1, 1), (120, 0.05, 60, 0.0, 1, 0.0, 0, 1, 1), (6, 1.0, 40, 0.0, 50, 0.0, 0, 1, 1),
    (5, 0.6, 0, 0.0, 30, 0.0, 0, 1, 1), (3, 0.0, 2, 0.0, 10, 0.0, 0, 1, 1), (300, 0.0, 1, 0.0, 8, 0.0, 0, 1, 1),
    (14, 0.0, 90, 0.0, 12, 1.0, 0, 1, 1), (7, 0.0, 3, 1.0, 22, 0.0, 0, 1, 1), (1, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1),
    (40, 0.0, 70, 0.0, 6, 1.0, 0, 1, 1), (2, 0.0, 3, 1.0, 5, 1.0, 0, 1, 1), (9, 1.0, 4, 1.0, 7, 1.0, 0, 1, 1),
    (11, 0.0, 5, 0.0, 10, 0.0, 0, 1, 1), (4, 0.0, 2, 0.0, 3, 0.0, 0, 1, 1), (1, 1.0, 5, 0.8, 2, 0.9, 0, 1, 1),
    (3, 0.4, 1, 1.0, 4, 0.3, 0, 1, 1), (20, 0.3, 6, 0.0, 2, 0.5, 0, 1, 1), (7, 0.0, 12, 0.0, 9, 0.4, 0, 1, 1),
    (55, 0.0, 4, 0.0, 48, 0.0, 0, 0, 1), (40, 0.1, 60, 0.0, 70, 0.0, 0, 0, 1), (80, 0.0, 2, 1.0, 3, 0.0, 0, 0, 1),
    (22, 0.0, 50, 0.0, 60, 0.0, 0, 0, 1), (150, 0.15, 30, 0.0, 2, 1.0, 0, 0, 1), (18, 0.0, 40, 0.0, 35, 0.0, 0, 0, 1),
    (6, 0.0, 45, 0.0, 52, 0.0, 0, 0, 1), (4, 0.0, 30, 0.0, 80, 0.0, 0, 0, 1), (9, 0.0, 70, 0.0, 30, 0.0, 0, 0, 1),
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0), (4, 1.0, 0, 0.0, 3, 1.0, 0, 0, 0), (6, 0.8, 5, 0.9, 4, 1.0, 0, 0, 0),
    (30, 0.9, 4, 1.0, 20, 0.8, 0, 0, 0), (12, 0.7, 60, 0.0, 5, 1.0, 0, 0, 0), (3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0),
    (5, 0.0, 1, 1.0, 3, 0.0, 0, 0, 0), (8, 0.0, 3, 0.0, 0, 0.0, 0, 0, 0), (2, 0.0, 4, 0.0, 5, 0.5, 0, 0, 0),
    (45, 0.6, 10, 0.5, 12, 0.9, 0, 0, 0), (3, 0.0, 1, 0.0, 2, 0.0, 0, 0, 0), (7, 0.0, 2, 0.0, 4, 0.0, 0, 0, 0),
    (10, 0.0, 3, 0.0, 2, 0.0, 0, 0, 0), (4, 0.0, 5, 1.0, 6, 0.0, 0, 0, 0), (1, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0),
)


def grow(rows: np.ndarray, labels: np.ndarray, depth: int) -> tuple | int:
    """A decision tree by Gini impurity: (feature, threshold, below, above) or a label."""
    ones = int(labels.sum())
    majority = int(2 * ones >= len(labels))
    if depth == 0 or ones in (0, len(labels)):
        return majority
    best = (np.inf, 0, 0.0)
    for feature in range(rows.shape[1]):
        values = np.unique(rows[:, feature])
        for threshold in (values[1:] + values[:-1]) / 2:
            below = rows[:, feature] < threshold
            impurity = sum(
                len(side) * (1 - (side.mean() ** 2 + (1 - side.mean()) ** 2)) for side in (labels[below], labels[~below])
            )
            if impurity < best[0] - 1e-12:
                best = (impurity, feature, float(threshold))
    if best[0] == np.inf:
        return majority
    below = rows[:, best[1]] < best[2]
    return (
        best[1], best[2], grow(rows[below], labels[below], depth - 1), grow(rows[~below], labels[~below], depth - 1),
    )


@cache
def tree(depth: int = 6) -> tuple | int:
    table = np.array(LABELLED, float)
    return grow(table[:, :-1], table[:, -1], depth)


def is_main(features: tuple) -> bool:
    node = tree()
    while isinstance(node, tuple):
        node = node[2] if features[node[0]] < node[1] else node[3]
    return bool(node)


def is_hint(value: str) -> bool:
    return any(HINT.search(name) and not NO_HINT.match(name) for name in value.split())


def blocks_of(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """Text, words, linked words, boilerplate and article flags of each block, in page order."""
    found: list[tuple[str, int, int, bool, bool]] = []
    open_tags: list[tuple[str, bool, bool]] = []
    begun = False
    parts: list[tuple[str, bool]] = []
    boiler = main = hidden = links = at = 0

    def close() -> None:
        text = SPACE.sub(" ", "".join(part for part, _ in parts)).strip()
        if text:
            linked = sum(len(part.split()) for part, in_link in parts if in_link)
            found.append((text, len(text.split()), linked, boiler > 0, main > 0))
        parts.clear()

    def pop() -> str:
        nonlocal boiler, main, hidden
        name, was_boiler, was_main = open_tags.pop()
        hidden -= name in HIDDEN
        boiler -= was_boiler
        main -= was_main
        return name

    while at < len(page):
        mark = MARKUP.search(page, at)
        stop = mark.start() if mark else len(page)
        if open_tags and open_tags[-1][0] == "head" and page[at:stop].strip():
            pop()
        if stop > at and not hidden:
            begun = begun or bool(page[at:stop].strip())
            parts.append((html.unescape(page[at:stop]), links > 0))
        if not mark:
            break
        at = mark.end()
        if not mark[2]:
            continue
        name, closing = mark[2].lower(), bool(mark[1])
        if name in RAW_END and not closing:
            end = RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if not closing and any(tag == "head" for tag, _, _ in open_tags[:2]):
            if name == "body" or (open_tags[-1][0] == "head" and name not in IN_HEAD):
                while pop() != "head":
                    pass
        begun = begun or (not hidden and name not in ("html", "head"))
        if name in HIDDEN and not closing:
            if not (name == "svg" and mark[3].endswith("/")) and not (name == "head" and (begun or hidden)):
                open_tags.append((name, False, False))
                hidden += 1
            continue
        if hidden or name in HIDDEN:
            # Tags within a hidden element, and its end, leave the block around it as it is.
            if not closing:
                if name in BLOCK and name not in VOID:
                    open_tags.append((name, False, False))
                continue
            last = max((nth for nth, one in enumerate(open_tags) if one[0] == name), default=-1)
            first = next((nth for nth, one in enumerate(open_tags) if one[0] in HIDDEN), len(open_tags))
            if last < 0 or last >= first:
                while last >= 0 and pop() != name:
                    pass
                continue
        if name == "a":
            links = 0 if closing else 1
        elif name == "br":
            parts.append((" ", False))
        if name in BLOCK or (not closing and name in BOILERPLATE):
            close()
            links = 0
        hinted = False
        if not closing and name not in ("html", "body", *MAIN):
            hinted = any(is_hint(" ".join(filter(None, value))) for value in ATTRIBUTE.findall(mark[3]))
        if name not in BLOCK and not hinted and not (closing and any(tag == name for tag, _, _ in open_tags)):
            continue
        if closing:
            if any(tag == name for tag, _, _ in open_tags):
                if name not in BLOCK:
                    close()
                while pop() != name:
                    pass
        elif name not in VOID and not mark[3].endswith("/"):
            if hinted and name not in BLOCK:
                close()
            flag = name in BOILERPLATE or hinted
            # A header inside an article is its title, not the page's.
            flag = flag and not (name == "header" and main > 0 and not hinted)
            open_tags.append((name, flag, name in MAIN))
            boiler += flag
            main += name in MAIN
    close()
    return found


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    words = [0, *(block[1] for block in blocks), 0]
    density = [0.0, *(block[2] / max(1, block[1]) for block in blocks), 0.0]
    kept = [
        block[0]
        for at, block in enumerate(blocks, 1)
        if is_main((words[at], density[at], words[at - 1], density[at - 1], words[at + 1], density[at + 1], block[3], block[4]))
    ]
    return "\n\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""

    def rows(batches):
        for batch in batches:
            texts = [main_text(page) for page in batch["html"]]
            frame = pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts})
            yield frame.assign(n_chars=[len(text) for text in texts])

    source = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")
    )
    return source.mapInPandas(rows, "page_id long, url string, text string, n_chars long")
