"""Text statistics as Column expressions; no Python runs on executors.

Whitespace is Unicode's, word boundaries are ASCII, so that engines agree: Java, RE2 and JavaScript differ on both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x0B\u00A0\uFEFF\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
_TEXT = rf"[^{SPACE[1:]}"
#: Blanks of ASCII and all letters, one by one: Java looks up such sets in a table, but asks ranges and unions one after the other.
_PLAIN, _LETTERS, _CONSONANTS = r" \t\n\x0B\f\r", "abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz"
WORD_LETTERS = _LETTERS.upper() + _LETTERS + "0123456789_"
_BLANKS = " \t\n\x0b\f\r\u00a0\ufeff\u1680" + "".join(chr(x) for x in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"


def bounded(pattern: str) -> str:
    """The pattern between ASCII word boundaries."""
    return rf"(?<![{WORD_LETTERS}])(?:{pattern})(?![{WORD_LETTERS}])"


def plain_blanks(text: Column) -> Column:
    """Whether the text can't hold other blanks than ASCII's; few do."""
    return (F.length(text) == F.octet_length(text)) | ~text.rlike(r"[\u00A0\u1680-\uFEFF]")


def _by_blanks(text: Column, of: Callable[[str], Column]) -> Column:
    """``of`` the blanks that can be in the text, as the inside of a class."""
    return F.when(plain_blanks(text), of(_PLAIN)).otherwise(of(SPACE[1:-1]))


def words(text: Column) -> Column:
    return F.filter(_by_blanks(text, lambda s: F.split(text, f"[{s}]+")), lambda w: w != "")


def word_count(text: Column) -> Column:
    return _by_blanks(text, lambda s: F.regexp_count(text, F.lit(f"[^{s}]++")))


def tokens_split(text: Column) -> Column:
    """Number of parts between runs of whitespace, 1 for an empty text."""
    return _by_blanks(text, lambda s: F.regexp_count(text, F.lit(f"[{s}]++"))) + 1


def sentences(text: Column, separator: str = "[.!?]+") -> Column:
    return F.filter(F.split(text, separator), lambda s: s.rlike(_TEXT))


def sentence_count(text: Column) -> Column:
    """How many stretches between full stops and the like have anything but whitespace."""
    return _by_blanks(text, lambda s: F.regexp_count(text, F.lit(f"[^.!?{s}][^.!?]*+")))


def syllable_count(text: Column) -> Column:
    """The sum of :func:`syllables` over all words, from two passes over the whole text: one for each word, and one for each group of vowels that
    follows another one in its word, but for an ``e`` at its end. What is neither letter nor blank is as if it weren't there."""
    low = F.lower(text)
    later = lambda s: f"[aeiouy][^{_LETTERS}{s}]*+[{_CONSONANTS}][^aeiouy{s}]*+(?=[aiouy]|e[^{_LETTERS}{s}]*+[{_LETTERS}])"
    return word_count(text) + _by_blanks(low, lambda s: F.regexp_count(low, F.lit(later(s))))


def syllables(word: Column) -> Column:
    letters = F.regexp_replace(F.lower(word), "[^a-z]", "")
    stem = F.regexp_replace(letters, "e$", "")
    return F.when(F.length(letters) <= 2, 1).otherwise(
        F.greatest(F.lit(1), F.size(F.regexp_extract_all(stem, F.lit("[aeiouy]+"), F.lit(0))))
    )


def flesch(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    """Reading ease from 0 to 100; 0 without words or sentences."""
    raw = F.lit(206.835) - 1.015 * (n_words / n_sentences) - 84.6 * (n_syllables / n_words)
    return F.when((n_words > 0) & (n_sentences > 0), F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))).otherwise(0.0)


def phrase_count(lowered: Column, phrases: tuple[str, ...]) -> Column:
    """Places of each phrase, not overlapping with itself."""
    found = lambda p: ((F.length(lowered) - F.length(F.replace(lowered, F.lit(p), F.lit("")))) / len(p)).cast("int")
    one = lambda p: F.when(lowered.contains(p), found(p)).otherwise(0)  # noqa: E731  most texts have few of them
    return sum((one(p) for p in phrases[1:]), one(phrases[0]))


def long_words(text: Column) -> Column:
    """Words of three ASCII letters or more, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(bounded("[a-z]{3,}")), F.lit(0))


def diversity(found: Column) -> Column:
    """Different words over all of :func:`long_words`; 1 under 50 of them."""
    return F.when(F.size(found) < 50, 1.0).otherwise(F.size(F.array_distinct(found)) / F.size(found))


def paragraphs(text: Column, separator: str = r"\n\s*\n") -> Column:
    return F.transform(F.split(text, separator), lambda p: F.trim(p, F.lit(_BLANKS)))


def paragraph_words(parts: Column) -> Column:
    """How many words each paragraph of more than 20 characters has."""
    return F.transform(F.filter(parts, lambda p: F.length(p) > 20), word_count)


def uniformity(counts: Column) -> Column:
    """0, 30, 70 or 100 by how alike the word counts of paragraphs are, given as a struct of ``n``, ``s`` and ``q``: how many, their sum
    and the sum of their squares; 0 under three of them."""
    mean = counts["s"] / counts["n"]
    spread = F.sqrt(counts["q"] / counts["n"] - mean * mean) / mean
    return F.when(counts["n"] < 3, 0).when(spread < 0.2, 100).when(spread < 0.3, 70).when(spread < 0.5, 30).otherwise(0)


def moments(counts: Column) -> Column:
    """The struct that :func:`uniformity` takes, in one fold."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    return F.aggregate(
        counts, zero, lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x * x.cast("double")).alias("q")),
    )
