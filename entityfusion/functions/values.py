"""Contacts, addresses, dates and numbers as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bound
from .text import blank_to_null, normalize_whitespace, strip

#: Patterns of contacts in running text.
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PHONE = r"\+?\d[\d\s().-]{6,}\d"
LINK = r"https?://[\w\-./?&=%#]+|www\.[\w\-./?&=%#]+"


def extract_all(text: Column, pattern: str) -> Column:
    """Every match, each once, in order; null gives none."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)))


def extract_emails(text: Column) -> Column:
    return extract_all(text, EMAIL)


def extract_phones(text: Column) -> Column:
    return extract_all(text, f"(?U){PHONE}")


def extract_links(text: Column) -> Column:
    return extract_all(text, LINK)


def normalize_email(email: Column) -> Column:
    return F.lower(strip(blank_to_null(email)))


#: Calling codes of one and two digits; all others have three.
CALLING_1 = ("1", "7")
CALLING_2 = (
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58",
    "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
)


def normalize_phone(raw: Column) -> Column:
    """With a leading plus: plus and digits, without a trunk zero in brackets; otherwise the digits alone. Null without digits.

    Numbers with a plus whose calling code is followed by fewer than two digits are not numbers; they give their digits."""
    digits = F.regexp_replace(F.regexp_replace(raw, r"\(0\)", ""), "[^0-9]", "")
    plain = blank_to_null(F.regexp_replace(raw, "[^0-9]", ""))
    code = F.when(F.substring(digits, 1, 1).isin(*CALLING_1), 1).when(F.substring(digits, 1, 2).isin(*CALLING_2), 2).otherwise(3)
    valid = raw.rlike(r"^\s*\+") & F.length(digits).between(code + 2, F.lit(15)) & ~digits.startswith("0")
    return F.when(valid, F.concat(F.lit("+"), digits)).otherwise(plain)


def normalize_url(raw: Column) -> Column:
    """Lower-cased, with a scheme, without ``www.`` and without slashes at the path's end; query and fragment stay."""

    def cut(full: Column) -> Column:
        part = lambda i: F.regexp_extract(full, r"(?s)^(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$", i)
        host = F.regexp_replace(F.lower(part(2)), r"^www\.", "")
        path = F.regexp_replace(part(3), "/+$", "")
        query, fragment = (bound(part(i), lambda p: F.when(F.length(p) > 1, p).otherwise("")) for i in (4, 5))
        return F.lower(F.concat(part(1), F.lit("://"), host, path, query, fragment))

    full = lambda text: F.when(text.rlike("^https?://"), text).otherwise(F.concat(F.lit("https://"), F.regexp_replace(text, "^/+", "")))
    return bound(bound(blank_to_null(strip(raw)), full), cut)


def link_slot(url: Column) -> Column:
    """Which slot a normalised link belongs to by its host's name."""
    return F.when(url.contains("linkedin.com"), "linkedin").when(url.contains("github.com"), "github").otherwise("portfolio")


#: Dates that are understood, tried in order; those without a day get ``default_day``.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd MMM yyyy", "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "MM/dd/yyyy")
MONTH_FORMATS = ("MMM yyyy", "MMMM yyyy", "yyyy-MM", "MM/yyyy")


def _dated(text: Column, form: str) -> Column:
    """The date of a text in one format. A text without the format's separators in order is not tried: a failure costs an exception."""
    shape = "".join(f"%{c}" for c in form if not c.isalpha()) + "%"
    return F.when(text.like(shape), F.try_to_date(text, form))


def parse_date(text: Column, default_day: int = 1) -> Column:
    """The date of a text in one of the formats known; null for others."""

    def in_month(month: Column) -> Column:
        day = F.least(F.lit(default_day), F.dayofmonth(F.last_day(month)))
        return F.date_add(F.trunc(month, "month"), day - 1)

    def tried(t: Column) -> Column:
        month = F.coalesce(*(_dated(t, f) for f in MONTH_FORMATS))
        return F.coalesce(_dated(F.substring(t, 1, 10), DATE_FORMATS[0]), *(_dated(t, f) for f in DATE_FORMATS[1:]), bound(month, in_month))

    return bound(normalize_whitespace(text), tried)


def parse_year(text: Column) -> Column:
    return F.regexp_extract(text, r"\b(?:19|20)\d{2}\b", 0).try_cast("int")


def country_code(value: Column) -> Column:
    """Two or three letters in upper case; null for anything else."""
    return F.when(strip(value).rlike("^[A-Za-z]{2,3}$"), F.upper(strip(value)))


def location_string(city: Column, region: Column, country: Column) -> Column:
    return blank_to_null(F.concat_ws(", ", blank_to_null(city), blank_to_null(region), blank_to_null(country)))


def location_completeness(city: Column, region: Column, country: Column, code: Column) -> Column:
    """How many of city, region and country (or its code) are given."""
    given = lambda c: F.coalesce(strip(c) != "", F.lit(False))
    return given(city).cast("int") + given(region).cast("int") + (given(country) | given(code)).cast("int")


def date_ranges_overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Whether two periods may overlap; bounds that are not known are open."""
    apart = (F.coalesce(start_a, end_a) > end_b) | (F.coalesce(start_b, end_b) > end_a)
    return ~F.coalesce(F.coalesce(F.coalesce(start_a, end_a) > end_b, F.lit(False)) | F.coalesce(F.coalesce(start_b, end_b) > end_a, F.lit(False)), apart)


def education_period_match(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Whether years agree where both are known; a side without years agrees with any."""
    same = lambda a, b: a.isNull() | b.isNull() | (a == b)
    unknown = (start_a.isNull() & end_a.isNull()) | (start_b.isNull() & end_b.isNull())
    return unknown | (same(start_a, start_b) & same(end_a, end_b))


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def percent(value: Column) -> Column:
    return F.when(value.isNull(), "N/A").otherwise(F.format_string("%.1f%%", value * 100))


def grade(value: Column) -> Column:
    """Display grade of a score: high from 0.8, medium from 0.6."""
    return F.when(value >= 0.8, "high").when(value >= 0.6, "medium").otherwise("low")


def truncated(text: Column, length: int = 80) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length - 3), F.lit("..."))).otherwise(text)


def shown_list(values: Column, most: int = 5) -> Column:
    return F.array_join(F.slice(values, 1, most), ", ")
