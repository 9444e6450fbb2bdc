"""The main text of web pages by maximum-scoring subsequence.

A page is read as a row of words and tags. Words score positive, tags negative, and one linear scan finds the stretch of
highest sum: the content region. Blocks with a word in it are the text, but for those under furniture (menus, headers, footers,
sidebars, notices, adverts, forms, comments), which may stand in the middle of an article too.

Furniture neither adds nor parts, as it goes anyway.

Weights come from labelled pages. These are a seeded list made here (``labelled_pages``; ``LABELLED`` pages, no more), as
no table has any: pages of several layouts in which each word is known to be content or not. From them are counted the
log-odds of what names an element (its tag, role, and words of class and id), by which an element is furniture or not;
and a structured perceptron fits the scores of words and tags, its weights held to their signs.

Markup: comments, scripts, styles and the like go with all they hold; character references are decoded in text; white space of
any kind inside a block, and what stands between cells or at a line break, becomes one space; blocks are joined in page
order by two line ends. A list of two items or more that are links throughout is a menu. Unclosed elements end with what
holds them, paragraphs and items with the next. The first article or main element is content even where an element
before it was left open. If nothing is left so, names of classes are taken to mean nothing, and the page is read again.

Defined cases: a null or empty page, and one without words outside furniture, has an empty text; the page is read whole,
however long; repeated rows get a row each; an empty table gives no rows; columns besides ``page_id``, ``url`` and ``html``
are not read. Pages are read one by one, in batches within tasks; nothing is shuffled.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from folio.llm.common import ship, table

LABELLED, EPOCHS, SEED = 400, 6, 13

#: Fixed values of the markup language: elements whose content is no markup, that make blocks, that have no end.
RAW = "script|style|title|textarea|iframe|noembed|noframes|xmp"
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CELLS = frozenset("br td th".split())
#: Names that elements of pages have in class and id, by what they begin with: of content, of frames, and of furniture.
CONTENT_NAMES = "content article post entry story body main text prose blog news".split()
FRAME_NAMES = "page container wrapper layout column row grid inner section site box block".split()
FURNITURE_NAMES = (
    "ads advert adsense sponsor promo banner cookie consent gdpr notice alert newsletter subscri signup share sharing social related recommend sidebar widget menu navi navbar nav breadcrumb header "
    "masthead topbar footer copyright legal comment disqus respond reply replies login search popup modal overlay skip pagination pager paywall rail teaser toolbar tagcloud feedback form"
).split()
SHORT_NAMES = frozenset("ad nav".split())
NAMES = re.compile("|".join(sorted((n for n in CONTENT_NAMES + FRAME_NAMES + FURNITURE_NAMES if n not in SHORT_NAMES), key=len, reverse=True)))
FURNITURE_TAGS = "nav aside footer form button select noscript template svg canvas dialog menu object audio video datalist search head".split()
ROLES = "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status tooltip".split()

#: Lengths are bounded so that many tags without an end cost no more than their number; a longer tag ends at its first ``>``.
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]{{0,100000}}+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-z][^\s/>]{0,99}+)((?:[^>\"']{1,400}+|\"[^\"]{0,4000}+\"|'[^']{0,4000}+'){0,200}+)>|</?[a-z][^>]{0,100000}+>|<[!?][^>]{0,100000}+>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def marks(tag: str, attributes: str) -> list[str]:
    """What names an element: its tag where that tells something, its role, and known words of its class and id."""
    out = [f"<{tag}>"] if tag in FURNITURE_TAGS else []
    if not attributes.strip():
        return out
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "role" and value.lower() in ROLES:
            out.append(f"role={value.lower()}")
        elif key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            out.append("hidden")
        elif key in ("class", "id"):
            before = ""
            for w in map(str.lower, NAME.findall(value)):
                if before not in ("has", "no", "with", "without"):
                    if w in SHORT_NAMES:
                        out.append(w)
                    elif n := NAMES.match(w):
                        out.append(n[0])
                before = w
    return out


class Run:
    """Words between two tags. ``gap``: the tags before it, those in furniture by one name; ``names``: the marks of all elements around it."""

    __slots__ = ("text", "words", "gap", "block", "tag", "link", "landmark", "furniture", "names")

    def __init__(self, text, words, gap, block, tag, link, landmark, furniture, names):
        self.text, self.words, self.gap, self.block, self.tag, self.link, self.landmark, self.furniture, self.names = text, words, gap, block, tag, link, landmark, furniture, names


def runs(page: str, odds: dict[str, float] | None, by_name: bool = True) -> list[Run]:
    """The runs of words of a page; ``odds`` tell furniture by marks (None while they are learned)."""
    out: list[Run] = []
    gap: list[str] = []
    # an open element: tag, furniture, landmark, link, its marks
    stack: list[tuple[str, bool, bool, bool, list[str]]] = [("", False, False, False, [])]
    block, block_tag, landed, end, space = 0, "", False, 0, ""

    def words(upto):
        nonlocal gap, space
        text = space + page[end:upto]
        space = ""
        if text and not text.isspace():
            text = html.unescape(text)
            n = len(text.split())
            if n:
                _, furniture, landmark, link, _ = stack[-1]
                out.append(Run(text, n, gap, block, block_tag, link, landmark, furniture, [m for s in stack for m in s[4]] if odds is None else ()))
                gap = []
                return
        space = " " if text else ""

    def close(k):
        del stack[k:]

    for m in TOKEN.finditer(page):
        words(m.start())
        end = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS:
            block, block_tag, space = block + 1, tag, ""
        elif tag in CELLS:
            space = " "
        if m[2]:
            gap.append("inside" if stack[-1][1] else f"/{tag}" if tag in ("article", "main") else tag)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        gap.append("inside" if stack[-1][1] else tag)
        if tag in BLOCKS and stack[-1][0] == "p":
            close(len(stack) - 1)
        if tag in ("li", "a"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in (("ul", "ol", "menu") if tag == "li" else BLOCKS):
                    break
        if tag in VOID or m[4].endswith("/") and tag not in BLOCKS:
            continue
        _, furniture, landmark, link, _ = stack[-1]
        named = marks(tag, m[4])
        if tag == "header" and not landmark:
            named.append("<header>")
        own = [x for x in named if by_name or x[0] == "<" or x == "hidden"]
        if landmark:  # an article's own header holds its title
            own = [x for x in own if x != "header"]
        if tag in ("html", "body") or tag[0] == "h" and tag[1:].isdigit():
            own = []
        if tag in ("article", "main") and not (odds and sum(odds.get(x, 0.0) for x in own) < 0):
            if not landed:
                furniture = False
            landmark = landed = True
        elif odds and own and sum(odds.get(x, 0.0) for x in own) < 0:
            furniture = True
        stack.append((tag, furniture, landmark, link or tag == "a", own))
    words(len(page))
    menus(out)
    return out


def menus(found: list[Run]) -> None:
    """Lists of which two items or more stand together and are links throughout are furniture."""
    items: list[list[Run]] = []
    last = None
    for r in found:
        if r.block != last:
            items.append([])
            last = r.block
        items[-1].append(r)
    k = 0
    while k < len(items):
        e = k
        while e < len(items) and items[e][0].tag == "li" and all(r.link for r in items[e]):
            e += 1
        if e - k >= 2:
            for r in (r for i in items[k:e] for r in i):
                r.furniture = True
        k = max(e, k + 1)


def features(r: Run) -> list[str]:
    """The features of each word of a run; ``word`` itself is the unit."""
    return ["furniture"] if r.furniture else ["word", *(["landmark"] if r.landmark else []), *(["link"] if r.link else [])]


def best_region(found: list[Run], weights: dict[str, float]) -> tuple[int, int]:
    """The stretch of highest sum, as (first run, run after the last); of equal ones the first, and the longest from there."""
    best, region, total, first = 0.0, (0, 0), 0.0, 0
    for k, r in enumerate(found):
        total += sum(weights.get(t, weights["other"]) for t in r.gap)
        if total <= 0:
            total, first = 0.0, k
        total += r.words * sum(weights.get(f, 0.0) for f in features(r))
        if total > 0 and total >= best:
            best, region = total, (region[0] if total == best and region[1] else first, k + 1)
    return region


def main_text(page: str | None, model: tuple[dict[str, float], dict[str, float]]) -> str:
    weights, odds = model
    for by_name in (True, False):
        found = runs(page or "", odds, by_name)
        a, b = best_region(found, weights)
        chosen = {r.block for r in found[a:b] if not r.furniture}
        blocks: dict[int, list[str]] = {}
        for r in found:
            if r.block in chosen and not r.furniture:
                blocks.setdefault(r.block, []).append(r.text)
        if blocks or not found:
            break
    return "\n\n".join(" ".join("".join(parts).split()) for parts in blocks.values())


def labelled_pages(n: int = LABELLED, seed: int = SEED) -> list[str]:
    """Pages of several layouts; each word of content begins with q, and no other does."""
    rng = random.Random(seed)

    def word(content):
        return ("q" if content else rng.choice("abdkmt")) + "".join(rng.choice(["la", "ne", "ri", "so", "tu"]) for _ in range(rng.randint(1, 4)))

    def words(content, low, high):
        return " ".join(word(content) for _ in range(rng.randint(low, high)))

    def paragraph(content):
        inner = words(content, 1, 60)
        if rng.random() < 0.2:
            inner += f' <a href="/x">{words(content, 1, 4)}</a> {words(content, 3, 20)}'
        return rng.choice([f"<p>{inner}</p>", f"<p>{inner}", f"<p><b>{inner}<br>", f"<blockquote>{inner}</blockquote>", f"<h2>{words(content, 1, 8)}</h2>", f"<div>{inner}</div>"])

    def named(tag, names):
        return f'<{tag} {rng.choice(["class", "id"])}="{"-".join(names)}">'

    def links():
        return "<ul>" + "".join(f'<li><a href="/y">{words(False, 1, 4)}</a></li>' for _ in range(rng.randint(2, 9))) + "</ul>"

    def furniture():
        kind = rng.random()
        inside = rng.choice([links(), words(False, 2, 40), "".join(paragraph(False) for _ in range(rng.randint(1, 4)))])
        if kind < 0.35:
            tag = rng.choice(FURNITURE_TAGS[:-1])
            return f"<{tag}>{inside}</{tag}>"
        if kind < 0.45:
            return f'<div role="{rng.choice(ROLES)}">{inside}</div>'
        if kind < 0.5:
            return f"<div {rng.choice(['hidden', 'style="display:none"'])}>{inside}</div>"
        tag = rng.choice(["div", "section", "div", "ul"])
        names = [rng.choice(FURNITURE_NAMES + ["ad"]), *rng.sample(CONTENT_NAMES + FRAME_NAMES, rng.choice([0, 0, 1]))]
        return named(tag, names) + inside + f"</{tag}>"

    def page():
        body = f"<h1>{words(True, 1, 10)}</h1>" if rng.random() < 0.8 else ""
        for _ in range(rng.randint(1, 12)):
            body += paragraph(True) + (furniture() if rng.random() < 0.08 else "")
        tag = rng.choice(["article", "article", "main", "div", "section", ""])
        if tag in ("div", "section"):
            body = named(tag, rng.sample(CONTENT_NAMES, rng.choice([1, 2]))) + body + f"</{tag}>"
        elif tag:
            body = f"<{tag}>{body}</{tag}>"
        if rng.random() < 0.4:
            body = named("div", [rng.choice(FRAME_NAMES)]) + body + "</div>"
        loose = [f"<div>{words(False, 1, 6)}</div>", links(), f"<div><span>{words(False, 1, 3)}</span> <a href='/z'>{words(False, 1, 3)}</a></div>"]
        before = "".join(rng.choice([furniture(), furniture(), rng.choice(loose)]) for _ in range(rng.randint(0, 4)))
        before += "<header>" + rng.choice([links(), words(False, 1, 12)]) + "</header>" if rng.random() < 0.5 else ""
        after = "".join(rng.choice([furniture(), furniture(), rng.choice(loose)]) for _ in range(rng.randint(0, 4)))
        return f"<html><head><title>{words(False, 2, 9)}</title></head><body>{before}{body}{after}</body></html>"

    return [page() for _ in range(n)]


@functools.lru_cache(1)
def trained() -> tuple[dict[str, float], dict[str, float]]:
    """(weights of words and tags, log-odds of marks)."""
    pages = labelled_pages()
    content, other = Counter(), Counter()
    for p in pages:
        for r in runs(p, None):
            for m in set(r.names):
                (content if r.text.split()[0][0] == "q" else other)[m] += 1
    odds = {m: math.log((content[m] + 0.5) / (other[m] + 0.5)) for m in [*content, *other]}
    weights = {"word": 1.0, "landmark": 0.0, "link": -0.5, "furniture": 0.0, "inside": 0.0, "other": -0.2}
    total, steps = Counter(), 0
    known = [(f, [r.text.split()[0][0] == "q" and not r.furniture for r in f]) for f in (runs(p, odds) for p in pages)]
    for _ in range(EPOCHS):
        for found, is_content in known:
            at = [k for k, c in enumerate(is_content) if c]
            if at:
                want, got = (at[0], at[-1] + 1), best_region(found, weights)
                if want != got:
                    moved = Counter()
                    for sign, (a, b) in ((1, want), (-1, got)):
                        for k, r in enumerate(found[a:b]):
                            for t in r.gap if k else ():
                                moved[t] += sign
                            for f in features(r):
                                moved[f] += sign * r.words
                    for f, n in moved.items():
                        if f not in ("word", "furniture", "inside"):
                            step = weights.get(f, weights["other"]) + 0.02 * max(-10, min(10, n))
                            low, high = {"landmark": (0.0, 9.0), "link": (-0.9, 0.0)}.get(f, (-9.0, -0.001))
                            weights[f] = max(low, min(high, step))
            total.update(weights)
            steps += 1
    return {f: total[f] / steps for f in weights}, odds


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    ship(pages.sparkSession)
    model = trained()

    def run(batches):
        for b in batches:
            texts = [main_text(p, model) for p in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op13_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return extracted(table(spark, folder, "pages"))
