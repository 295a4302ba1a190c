"""Fields of pages by pattern, without a document tree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag_text(html: Column, tag: str) -> Column:
    """Trimmed text of the first such element without inner tags; empty if there is none."""
    return F.trim(F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>([^<]*)</{tag}>", 1))


def has_tag(html: Column, tag: str) -> Column:
    return html.rlike(rf"(?is)<{tag}(\s[^>]*)?>")


def count_tag(html: Column, tag: str) -> Column:
    return F.size(F.regexp_extract_all(F.lower(html), F.lit(f"<{tag}[\\s>]"), F.lit(0)))


def declared_language(html: Column) -> Column:
    return F.regexp_extract(html, r'(?i)<html[^>]*\slang="([^"]*)"', 1)


def body_text(html: Column) -> Column:
    """Text of the main part: scripts, styles and site furniture dropped, tags out, whitespace collapsed."""
    kept = F.regexp_replace(html, r"(?is)<(script|style|nav|footer|header|aside|iframe|noscript|svg)\b.*?</\1\s*>", " ")
    kept = F.regexp_replace(kept, r"(?is)<head\b.*?</head\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(kept, "<[^>]*>", " "), r"\s+", " "))


def links(html: Column) -> Column:
    """Distinct targets of anchors in order, without fragments, mail, telephone and script addresses."""
    found = F.regexp_extract_all(html, F.lit('(?i)<a\\s[^>]*href="([^"]*)"'), F.lit(1))
    return F.array_distinct(F.filter(found, lambda h: (h != "") & ~h.rlike("(?i)^(#|mailto:|tel:|javascript:)")))
