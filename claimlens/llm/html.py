"""Main text of web pages by a maximum-scoring subsequence of words and tags.

A page is a row of tokens: words score positive, tags negative, by weights learnt from
labelled pages, and one linear scan finds the contiguous region with the highest sum.
Labelled pages are those whose authors marked the content (`<article>` or `<main>`); the
weights are log-odds of kinds of tokens inside and outside of that markup, from a
bounded sample (`SAMPLE_ROWS`). A kind is the tag's name, or for a word the nearest
structural element around it; the stated prior speaks for kinds that the sample lacks.
Pages without such markup are handled by the same scan, but their words have weights of
their own: labelled pages are counted a second time as if the markup were absent, and
elements that hold the content of any page (`GENERIC`) weigh no less than by the prior. Elements inside the region that are
not article text (menus, forms, adverts, comments, scripts) are left out, then
blocks are joined. An `<article>` that is itself marked as a comment or advert, or stands in
comments, side bars and the like, is no content. End tags may be left out where HTML allows
it; a tag with a quote too many ends at the next angle bracket.

Pages are handled where they are read; nothing is shuffled but the sample's counts.

Defined results: a null or empty page, or one without words, has an empty text; of regions
with equal sums the first is taken; long pages are read whole, in linear time; repeated rows give repeated results; an empty table gives an empty one; input columns other than
the named ones are not passed on.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, replace
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from claimlens.llm import arrays as A

SAMPLE_ROWS = 2_000
# Largest weight of a word and least cost of a tag; unseen kinds weigh half as much.
# A piece of text outside of the content costs at most as much as a sentence can make up for.
WORD_WEIGHT, TAG_COST, TEXT_COST = 3.0, 0.5, 6.0
# Cost of a tag in marked content, small enough that short headings and cells stay in the region.
INSIDE, INSIDE_COST = "in:", 0.01
# Words of elements that are left out of a marked article: the scan passes over them.
LEFT_OUT = "w:left out"
# What the kinds of words of a page without marked content start with.
UNMARKED = "w:unmarked "

# Element names by role.
CONTENT = frozenset("article main".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
ASIDE = frozenset(
    "nav header footer aside form menu dialog button select option fieldset svg canvas object "
    "audio video map head".split()
)
STRUCTURE = frozenset("section div ul ol dl table td figure details a body".split()) | CONTENT | ASIDE
# Elements that content stands in wherever it is not marked; "none" is a word outside of all.
GENERIC = frozenset("section div td body none".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol "
    "optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words that start or end a class, id or role of what is not article text, and
# those that also hold for an `<article>` of its own and for one further inside.
MARKS = frozenset(
    "banner notice alert popup modal menu breadcrumb breadcrumbs footer header masthead share sharing social "
    "login signup search toolbar pagination pager contentinfo complementary navigation navbar nav widget "
    "cookie cookies consent gdpr".split()
)
STRONG_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion "
    "newsletter subscribe sidebar comment comments reply replies respond disqus recommended recommendations".split()
)
# A class that starts so tells of a page's layout; one with these beside `header` heads an article.
LAYOUT = frozenset("with has no without is not hide show js".split())
HEADED = frozenset("article post entry story content page section chapter title".split())
# What `related` and `side` are joined to where they mark something.
RELATED = frozenset("posts articles links stories items content news topics products reading list videos".split())
SIDE = frozenset("bar column col panel box rail nav menu".split())
# Elements whose names of this kind describe the element itself, and those that hold a whole page.
TEXT_PARTS = frozenset("td th tr thead tbody tfoot caption h1 h2 h3 h4 h5 h6 dt dd label code pre".split())
PART_NAMES = frozenset("header footer search share banner notice alert".split())
WHOLE = frozenset("html body main".split())

_TAG = r"<(/?)([A-Za-z][^\s/><]*)"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</(?![A-Za-z])[^>]*>?"
    rf"|{_TAG}((?:[^<>\"']|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))*+)>"
    # A tag with a quote too many or without an end stops at the next angle bracket.
    rf"|{_TAG}([^<>]*)(?:>|(?=<)|\Z)",
    re.DOTALL,
)
_NAMED = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.IGNORECASE) for name in RAW}

# Elements whose end tag may be left out, each with a bit; what ends them, and within what they are looked for.
P, ITEM, TERM, CELL, ROW = 1, 2, 4, 8, 16
_BIT = {"p": P, "li": ITEM, "dt": TERM, "dd": TERM, "td": CELL, "th": CELL, "tr": ROW}
_ENDED_BY = {name: P for name in BLOCKS if name not in ("li", "td", "th", "tr")} | {
    "li": P | ITEM, "dt": P | TERM, "dd": P | TERM, "td": P | CELL, "th": P | CELL, "tr": P | CELL | ROW,
    "tbody": P | CELL | ROW, "thead": P | CELL | ROW, "tfoot": P | CELL | ROW,
}
_WITHIN = {name: ITEM | TERM for name in STRUCTURE if name not in ("div", "a", "p")} | {
    "table": P | ITEM | TERM | CELL | ROW, "td": P | ITEM | TERM, "th": P | ITEM | TERM, "caption": P,
    "button": P, "object": P,
}
_CROSSED_BY = CONTENT | frozenset("table tr tbody thead tfoot body html".split())


def mark(name: str, attributes: str) -> int:
    """0, or 1 if class, id or role of an element say that it is no article text, 2 if strongly so."""
    if name in WHOLE:
        return 0
    found = 0
    for value in _NAMED.findall(attributes):
        for token in value.strip("\"'").lower().split():
            parts = [p for p in re.split(r"[-_]+", token) if p]
            if not parts or parts[0] in LAYOUT:
                continue
            ends = {parts[0], parts[-1]}
            if ends & STRONG_MARKS or "related" in parts and (len(parts) == 1 or RELATED & set(parts)):
                return 2
            if parts[0] == "side" and (len(parts) == 1 or len(parts) == 2 and parts[1] in SIDE):
                return 2
            weak = ends & MARKS
            if name in TEXT_PARTS:
                weak -= PART_NAMES
            if HEADED & set(parts):
                weak.discard("header")
            found = found or int(bool(weak))
    return found


@dataclass(slots=True)
class _Open:
    """An open element, with what holds for the text in it."""

    name: str = ""
    # Elements open in here that a start tag may end; place of the nearest table cell or the like.
    may_end: int = 0
    scope: int = 0
    # No article text; so whatever content is marked inside; in which content, beside which element, in a link.
    aside: bool = False
    strong: bool = False
    content: str = ""
    near: str = "none"
    link: str = ""
    # The same if the content were not marked.
    plain_near: str = "none"
    plain_aside: bool = False

    def inside(self, name: str, marked: int, place: int) -> _Open:
        """An element that is opened within this one, as the place-th of the open ones."""
        bounds = _WITHIN.get(name, 0)
        may_end = self.may_end & ~bounds | _BIT.get(name, 0)
        new = replace(self, name=name, may_end=may_end, scope=place if bounds & P else self.scope)
        if name == "a":
            new.link = "+a"
        if name in CONTENT:
            # Content inside of menus, comments and the like is none, but a page has one `main`.
            new.strong = name != "main" and (self.strong or marked == 2)
            new.aside, new.content = new.strong, name
            new.plain_aside = self.plain_aside or new.strong
            return new
        # An article's own header holds its heading.
        heading = name == "header" and self.content != "" and not marked
        beside = bool(marked) or name in ASIDE and not heading
        new.aside = self.aside or beside
        new.strong = self.strong or marked == 2 or name in ("aside", "nav", "footer")
        new.plain_aside = self.plain_aside or bool(marked) or name in ASIDE and name != "header"
        if name in STRUCTURE and name != "a" or marked:
            new.near = "marked" if marked else name
            new.plain_near = self.plain_near if heading else name
        return new

    def kind(self) -> str:
        if self.content:
            return LEFT_OUT if self.aside else f"w:{self.content}"
        return f"w:{self.near}{self.link}"

    def plain_kind(self) -> str | None:
        return None if self.aside or self.plain_aside else f"{UNMARKED}{self.plain_near}{self.link}"


def tokens(page: str):
    """(kind, tag name or None, text, aside) of a page in order.

    Text tokens have the kind of their words; `aside` tells text that is no article text.
    """
    for kind, name, text, aside, _ in _walk(page):
        yield kind, name, text, aside


def _walk(page: str):
    """Tokens and, for text that is article text, its kind if the content were not marked.

    Every open element carries what holds inside of it, so the time is linear in the page.
    """
    stack = [_Open()]
    # Places of the open elements of each name.
    places: dict[str, list[int]] = {}
    at, end = 0, len(page)

    def close(to: int) -> None:
        while len(stack) > to:
            places[stack.pop().name].pop()

    while at < end:
        found = _TOKEN.search(page, at)
        stop = found.start() if found else end
        if stop > at:
            here = stack[-1]
            yield here.kind(), None, page[at:stop], here.aside, here.plain_kind()
        if not found:
            return
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            # A comment or a declaration.
            continue
        attributes = found[3] or found[6] or ""
        if found[1] or found[4]:
            yield f"{INSIDE if stack[-1].content else ''}/{name}", name, "", False, None
            open_ = places.get(name)
            # An end tag in a table cell ends nothing around the table.
            if open_ and (open_[-1] >= stack[-1].scope or name in _CROSSED_BY):
                close(open_[-1])
            continue
        ends = _ENDED_BY.get(name, 0)
        while stack[-1].may_end & ends:
            close(len(stack) - 1)
        marked = mark(name, attributes) if attributes else 0
        kind = f"{name}!" if marked else name
        yield (f"{INSIDE}{kind}" if stack[-1].content else kind), name, "", False, None
        if name in RAW:
            close_tag = _ENDS[name].search(page, at)
            at = close_tag.end() if close_tag else end
        elif name not in VOID and (marked or name in STRUCTURE or name in _BIT) and not attributes.endswith("/"):
            places.setdefault(name, []).append(len(stack))
            stack.append(stack[-1].inside(name, marked, len(stack)))


def prior(kind: str) -> float:
    """Weight of a kind of token of which no labelled page has an example."""
    if not kind.startswith("w:"):
        return -INSIDE_COST if kind.startswith(INSIDE) else -TAG_COST
    if kind == LEFT_OUT:
        return 0.0
    near = kind[2:].removesuffix("+a")
    outside = near == "marked" or near in ASIDE or kind.endswith("+a")
    return -WORD_WEIGHT / 2 if outside else WORD_WEIGHT / 2


def weight(kind: str, inside: int, outside: int) -> float:
    """Log-odds of a kind, positive for words of the content and negative for all tags."""
    from math import log

    odds = log((inside + 1) / (outside + 1))
    if kind.startswith("w:"):
        odds = max(-WORD_WEIGHT, min(WORD_WEIGHT, odds))
        near = kind.removeprefix(UNMARKED)
        return max(odds, prior(f"w:{near}")) if near in GENERIC else odds
    return -TAG_COST - max(0.0, min(WORD_WEIGHT, -odds))


def is_labelled(page: str) -> bool:
    return re.search(r"<(?:article|main)[\s>]", page, re.IGNORECASE) is not None


def count_kinds(page: str) -> tuple[Counter, Counter]:
    """Kinds inside and outside of the marked content; words count one by one.

    Words count under their kind and under the one that they have in unmarked pages.
    """
    inside, outside = Counter(), Counter()
    for kind, name, text, aside, unmarked in _walk(page):
        if name is not None:
            where = inside if kind.startswith(INSIDE) else outside
            where[kind.removeprefix(INSIDE)] += 1
            continue
        n = len(text.split())
        if n and kind != LEFT_OUT:
            where = inside if kind[2:] in CONTENT else outside
            where[kind] += n
            if unmarked:
                where[unmarked] += n
            elif where is outside:
                where[f"{UNMARKED}{kind[2:]}"] += n
    return inside, outside


def scores(row: list[tuple], weights: dict[str, float]) -> list[float]:
    """What each token of a page adds to the sum of a region."""
    marked = any(kind.startswith(INSIDE) for kind, *_ in row)
    out = []
    for kind, name, text, _ in row:
        key = kind if marked or name is not None else f"{UNMARKED}{kind[2:]}"
        w = weights.get(key)
        w = prior(kind) if w is None else w
        out.append(w if name is not None else max(-TEXT_COST, w * len(text.split())))
    return out


def best_region(score: list[float]) -> tuple[int, int]:
    """The first of the contiguous regions with the highest sum, empty if none is positive."""
    most, best = 0.0, (0, 0)
    total, first = 0.0, 0
    for i, w in enumerate(score):
        total += w
        if total <= 0:
            total, first = 0.0, i + 1
        elif total > most:
            most, best = total, (first, i + 1)
    return best


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """Text of the best region, blocks joined by line feeds."""
    if not page:
        return ""
    row = list(tokens(page))
    first, last = best_region(scores(row, weights))
    blocks: list[list[str]] = [[]]
    for kind, name, text, aside in row[first:last]:
        if name is None:
            if not aside:
                blocks[-1].append(text)
        elif name in BLOCKS:
            blocks.append([])
        elif name == "br":
            blocks[-1].append(" ")
    joined = (_SPACE.sub(" ", unescape("".join(b))).strip() for b in blocks)
    return "\n".join(b for b in joined if b)


def learn(pages: DataFrame, html_column: str, rows: int = SAMPLE_ROWS) -> dict[str, float]:
    """Weights from at most `rows` labelled pages, those whose contents have the smallest hashes."""
    html = F.col(html_column)
    labelled = pages.where(html.rlike(r"(?i)<(article|main)[\s>]"))
    chosen = labelled.select(F.xxhash64(html).alias("h")).orderBy("h").limit(rows).distinct()
    sample = labelled.select(F.xxhash64(html).alias("h"), html.alias("html")).join(F.broadcast(chosen), "h")

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        inside, outside = Counter(), Counter()
        for page in part.column("html").to_pylist():
            a, b = count_kinds(page or "")
            inside += a
            outside += b
        kinds = sorted(inside.keys() | outside.keys())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(kinds, pa.string()),
                pa.array([inside[k] for k in kinds], pa.int64()),
                pa.array([outside[k] for k in kinds], pa.int64()),
            ],
            names=["kind", "inside", "outside"],
        )

    counts = (
        sample.select("html")
        .mapInArrow(A.over_texts(kernel, "html"), "kind string, inside long, outside long")
        .groupBy("kind")
        .agg(F.sum("inside").alias("i"), F.sum("outside").alias("o"))
    )
    return {r["kind"]: weight(r["kind"], r["i"], r["o"]) for r in counts.collect()}


def extract(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    weights = learn(pages, html_column) if weights is None else weights
    rows = pages.select(
        F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("html")
    )
    schema = T.StructType(
        [
            T.StructField("id", rows.schema["id"].dataType),
            T.StructField("url", T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("n_chars", T.LongType()),
        ]
    )

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p, weights) for p in part.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["id", "url", "text", "n_chars"],
        )

    out = rows.mapInArrow(A.over_texts(kernel, "html"), schema)
    return out.select(F.col("id").alias(id_column), F.col("url").alias(url_column), "text", "n_chars")
