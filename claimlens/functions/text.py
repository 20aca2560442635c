"""Text standardisation, label rules and article text (built-in expressions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Unicode whitespace plus the four separators Java's class leaves out.
SPACE = r"[\s\x1c-\x1f]"
# Ordered label rules (label, any of these, none of these); first match wins.
LABEL_RULES: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("True", ("true",), ("mostly",)),
    ("Fake", ("false", "pants-fire", "barely-true"), ()),
)
DEFAULT_LABEL = "Uncertain"
# Article link prefix, snippet length, default news source.
ARTICLE_BASE_URL = "https://en.wikipedia.org/wiki/"
SNIPPET_CHARS = 1000
NEWS_SOURCE = "newsapi"


def clean_text(c: Column) -> Column:
    """Every run of whitespace becomes one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(c, f"(?U){SPACE}+", " "))


def strip(c: Column) -> Column:
    """Trim whitespace at both ends only.

    The look-behind lets the tail pattern start only where a run begins, so long
    inner runs cost linear time.
    """
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|(?<!{SPACE}){SPACE}+\z", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (clean_text(c) == "")


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """Plain substring tests, not word matches."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(c, F.lit(w))
    return hit


def normalize_label(raw: Column, rules=LABEL_RULES, default: str = DEFAULT_LABEL) -> Column:
    low = F.lower(raw)
    out = None
    for label, any_of, none_of in rules:
        cond = contains_any(low, any_of)
        if none_of:
            cond = cond & ~contains_any(low, none_of)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(default)


def article_url(title: Column, base: str = ARTICLE_BASE_URL) -> Column:
    return F.concat(F.lit(base), F.replace(title, F.lit(" "), F.lit("_")))


def lead_sentences(body: Column, n: int = 2) -> Column:
    """The first n sentences, or the whole text when no sentence end is found."""
    lead = F.trim(F.regexp_extract(body, rf"(?s)^((?:.*?[.!?](?:\s+|$)){{1,{n}}})", 1))
    return F.when(lead != "", lead).otherwise(F.trim(body))


def news_snippet(title: Column, description: Column) -> Column:
    joined = F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(description, F.lit("")))
    return F.left(joined, F.lit(SNIPPET_CHARS))


def has_token(c: Column) -> Column:
    """Whether a text has any of the `tokens`, without cutting it up."""
    return F.coalesce(F.lower(c).rlike(r"[\p{L}\p{N}]"), F.lit(False))


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits, in text order."""
    parts = F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_remove(parts, "")


def preview(c: Column, n: int = 80) -> Column:
    return F.left(c, F.lit(n))
