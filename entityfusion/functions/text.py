"""Text functions as Columns. Regular expressions take \\s, \\w and \\d in their Unicode sense where ``(?U)`` is set.

They run over whole texts, so each begins with a class of characters that few places have, and looks behind only there; and it matches only what it
changes, as a text without a match is passed on as it is."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import bound

SPACE_EDGES = r"(?U)^\s+|\s+$"


@F.pandas_udf(T.StringType())
def _nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for p in parts:
        yield p.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Compatibility composition; Spark has no built-in for it, so it runs over Arrow batches."""
    return _nfkc(text)


def strip(text: Column) -> Column:
    """Without white space at either end, line breaks included."""
    return F.regexp_replace(text, SPACE_EDGES, "")


def replaced(text: Column, pattern: str, by: str, signs: tuple[str, ...]) -> Column:
    """regexp_replace for a pattern whose every match holds one of ``signs``: texts without any are found by a plain search, and stay as they are."""
    return bound(text, lambda t: F.when(reduce(Column.__or__, (t.contains(c) for c in signs)), F.regexp_replace(t, pattern, by)).otherwise(t))


def blank_to_null(text: Column) -> Column:
    return bound(text, lambda t: F.when(t != "", t))


def normalize_whitespace(text: Column) -> Column:
    """Stripped, with each run of white space as one space; null stays null."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s&&[^ ]]\s*| \s+", " "))


def split_multivalue(text: Column) -> Column:
    """Values between semicolons, commas, bars or line breaks: normalised, non-empty, each once, in order; null gives none."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[;,|\n]", -1), normalize_whitespace)
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def normalize_extracted_text(text: Column, compose: bool = True) -> Column:
    """Plain spaces and line ends, words rejoined over line breaks, bullets as line breaks, at most one empty line."""
    t = nfkc(text) if compose else text
    t = replaced(t, "[\u00a0\u2007\u202f]", " ", ("\u00a0", "\u2007", "\u202f"))
    t = replaced(t, "\r\n?", "\n", ("\r",))
    t = replaced(t, r"(?U)[-‐‑‒–—](?<=\w[-‐‑‒–—])\s*\n\s*(?=\w)", "", tuple("-‐‑‒–—"))
    t = replaced(t, "[•·●▪◦]", "\n", tuple("•·●▪◦"))
    t = replaced(t, r"[ \t]+\n", "\n", (" \n", "\t\n"))
    return replaced(t, r"\n{3,}", "\n\n", ("\n\n\n",))


def normalize_merged_words(text: Column, compose: bool = True) -> Column:
    """Spaces between lower and upper case, before the last capital of a run, and between letters and digits."""
    t = nfkc(text) if compose else text
    t = F.regexp_replace(t, "(?=[A-Z])(?:(?<=[a-z])|(?<=[A-Z])(?=[A-Z][a-z]))", " ")
    return normalize_whitespace(F.regexp_replace(t, r"(?U)(?=\d)(?<=[A-Za-z])|(?=[A-Za-z])(?<=\d)", " "))


#: Characters that recognition confuses, and what they stand for.
MISREAD = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "·": "-"}
#: Compounds that recognition splits.
COMPOUND = r"(?i)\b(Postgre|My|Micro|Type|Java|ECMA|Action)\s+(SQL|Script|Soft|Word|Office|Excel|Point|Server|Force|Sheet)\b"


#: Characters of words, as a regular-expression class body: in Unicode's sense, and in the sense of engines whose word edges are of ASCII.
WORD, ASCII_WORD = r"\p{L}\p{Mn}\p{N}_", "A-Za-z0-9_"


def repair_ocr_tokens(text: Column, compose: bool = True, word: str = WORD) -> Column:
    """Quotes and dashes, line-wrap hyphens, split compounds, an acronym and a short capitalised word after it on one line, split acronyms of two
    to six letters, spaced ordinals; white space within lines collapsed. What is left empty is null. ``word``: the characters between which no word ends;
    \\b is not used, as its sense depends on the version of Java."""
    edged = lambda pattern: pattern.replace(r"\b", f"(?<![{word}])", 1).replace(r"\b", f"(?![{word}])")
    t = nfkc(text) if compose else text
    t = bound(t, lambda t: F.when(reduce(Column.__or__, (t.contains(c) for c in MISREAD)), F.translate(t, "".join(MISREAD), "".join(MISREAD.values()))).otherwise(t))
    t = replaced(replaced(t, "…", "...", ("…",)), "\u00ad", "", ("\u00ad",))
    t = replaced(t, r"(?U)-(?<=\w-)\s+(?=[a-z])", "", ("-",))
    t = F.regexp_replace(t, edged(COMPOUND.replace("(?i)", "(?i)(?=[PMTJEA])", 1)), "$1$2")
    t = F.regexp_replace(t, edged(r"(?U)(?=[A-Z]{2})\b([A-Z]{2,})\s+([A-Z][a-z]{1,2})(?=\s|$)"), "$1 $2")
    # both parts of the pattern have at most five letters together, so every match is a plausible acronym
    t = F.regexp_replace(t, edged(r"(?=[A-Z])\b([A-Z][a-z]?)\s+([A-Z])\s+([A-Z])\b"), "$1$2$3")
    t = F.regexp_replace(t, edged(r"(?=[A-Z])\b([A-Z][a-z]?)\s+([A-Z])\b"), "$1$2")
    t = F.regexp_replace(t, edged(r"(?i)(?=\d)\b(\d{1,4})\s+(th|st|nd|rd)\b"), "$1$2")
    return blank_to_null(F.btrim(F.regexp_replace(t, r"(?U)[\s&&[^ \n]][^\S\n]*| [^\S\n]+", " "), F.lit(" \n")))


def normalize_company_name(name: Column, compose: bool = True) -> Column:
    """Words of joined capitals apart, dashes within words as spaces; what is left empty is null."""
    t = strip(nfkc(name) if compose else name)
    t = F.regexp_replace(t, "(?<=[a-z])(?=[A-Z])", " ")
    t = F.regexp_replace(t, "(?<=[A-Z])(?=[A-Z][a-z])", " ")
    t = F.regexp_replace(t, "([A-Za-z0-9])[‐‑‒–—-]([A-Za-z0-9])", "$1 $2")
    return blank_to_null(strip(F.regexp_replace(t, r"(?U)\s{2,}", " ")))


def company_key(name: Column, compose: bool = True) -> Column:
    return F.lower(normalize_company_name(name, compose))


def text_key(value: Column) -> Column:
    """Lower-cased, white space normalised, empty as null: how names and titles are compared."""
    return F.lower(blank_to_null(normalize_whitespace(value)))


def dedupe_keep_order(values: Column) -> Column:
    return F.array_distinct(F.array_compact(values))


#: Words and phrases that are no skills by themselves.
STOP_WORDS = (
    "design", "organization", "practices", "management", "development", "implementation", "integration", "engineering", "testing", "deployment",
    "maintenance", "support", "operations", "administration", "configuration", "analysis", "planning", "execution", "monitoring", "reporting",
    "documentation", "research", "evaluation", "assessment", "optimization", "architecture", "strategy", "consulting", "training", "coordination",
    "processing", "validation", "verification", "compliance", "backend system", "backend systems", "backend development", "frontend development",
    "web development", "software development", "system design", "systems design",
)


def is_skill_token(token: Column) -> Column:
    """At least two characters, no stop word, and not one lower-case word of 3 to 15 letters."""
    return (F.length(token) >= 2) & ~F.lower(token).isin(*STOP_WORDS) & ~token.rlike("^[a-z]{3,15}$")


def filter_skill_tokens(tokens: Column) -> Column:
    kept = F.filter(F.transform(tokens, normalize_whitespace), lambda t: (t != "") & is_skill_token(t))
    return dedupe_keep_order(kept)


def merge_text(left: Column, right: Column) -> Column:
    """Both texts' parts between `` | ``, each once, in order."""
    parts = lambda t: F.filter(F.transform(F.split(t, r" \| "), normalize_whitespace), lambda p: p != "")
    both = F.array_join(F.array_distinct(F.concat(parts(left), parts(right))), " | ")
    return F.when(left.isNull() | (left == ""), right).when(right.isNull() | (right == ""), left).otherwise(both)


def prefer_text(current: Column, incoming: Column) -> Column:
    """The longer text; the current one on a tie."""
    return F.when(F.coalesce(current, F.lit("")) == "", incoming).when(F.length(incoming) > F.length(current), incoming).otherwise(current)


def sha256_text(text: Column) -> Column:
    return F.sha2(text, 256)


def stable_id(*parts: Column) -> Column:
    """SHA-256 of the non-empty parts, stripped and lower-cased, between double colons; null if all are empty."""
    kept = F.filter(F.array(*(F.lower(strip(p)) for p in parts)), lambda p: p.isNotNull() & (p != ""))
    return F.when(F.size(kept) > 0, F.sha2(F.array_join(kept, "::"), 256))


def compact(values: Column) -> Column:
    """Distinct non-empty values joined by `` | ``."""
    return F.array_join(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != ""))), " | ")
