"""Names: display cleaning, comparison keys, base names and labels, as column expressions.

Unicode composition has no built-in function, so it is an Arrow UDF that Spark only evaluates on the
values that contain a non-ASCII character; everything else stays in generated code.
"""

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# The invisible characters and the white space each rule recognises.
CONTROL_OR_FORMAT = r"[\p{Cc}\p{Cf}&&[^ \t\n\x0B\f\r]]"
UNICODE_SPACE = r"[ \t\n\x0B\f\r\x85\p{Z}]+"
AREA_INVISIBLE = r"[\p{Cc}\x{200B}-\x{200D}\x{2060}\x{FEFF}]"
AREA_SPACE = r"[ \t\n\x0B\f\r\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+"
LABEL_CONTROL = r"[\x00-\x1F\x7F-\x9F]"
TRAILING_NOTE = r"^(.*\S)\s*\(([^()]+)\)\s*$"


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfd(s: pd.Series) -> pd.Series:
    return s.map(lambda v: unicodedata.normalize("NFD", v), na_action="ignore")


def _needs_unicode(c: Column) -> Column:
    return c.rlike(r"[^\x00-\x7F]")


def _composed(c: Column, form) -> Column:
    # The UDF sees NULL for plain ASCII, which costs nothing to normalise.
    return F.coalesce(form(F.when(_needs_unicode(c), c)), c)


def nfc(c: Column) -> Column:
    return _composed(c, _nfc)


def nfd(c: Column) -> Column:
    return _composed(c, _nfd)


def display(raw: Column) -> Column:
    """Composed, control characters removed, white space collapsed; '' for NULL."""
    c = F.regexp_replace(nfc(F.coalesce(raw, F.lit(""))), CONTROL_OR_FORMAT, "")
    return F.trim(F.regexp_replace(c, UNICODE_SPACE, " "))


def no_text(raw: Column) -> Column:
    """Would :func:`display` be empty? Composition never empties a text, so this needs no UDF."""
    c = F.regexp_replace(F.coalesce(raw, F.lit("")), CONTROL_OR_FORMAT, "")
    return F.trim(F.regexp_replace(c, UNICODE_SPACE, " ")) == ""


def area_name(raw: Column) -> Column:
    c = F.regexp_replace(nfc(F.coalesce(raw, F.lit(""))), r"[\n\r\t]", " ")
    c = F.regexp_replace(c, AREA_INVISIBLE, "")
    return F.trim(F.regexp_replace(c, AREA_SPACE, " "))


def match_key(raw: Column) -> Column:
    """Comparison key of a station name: folded accents, no notes, no 'metro station' words, no punctuation."""
    c = F.regexp_replace(nfd(F.lower(display(raw))), r"\p{M}+", "")
    c = F.regexp_replace(c, r"\([^)]*\)", " ")
    c = F.replace(c, F.lit("&"), F.lit(" and "))
    for words in (r"\bmetro\s+station\b", r"\bstation\b", r"\bmetro\b"):
        c = F.regexp_replace(c, words, " ")
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))


def search_name(raw: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.trim(nfc(raw)), r"\s+", " ")))


def place_key(raw: Column) -> Column:
    """Name part of a place's identity on a route."""
    return F.lower(F.regexp_replace(F.trim(nfc(raw)), r"\s+", " "))


def match_quality(name: Column, term: Column) -> Column:
    return (F.when(name == term, "exact").when(name.startswith(term), "prefix")
            .when(F.contains(name, term), "contains"))


def base_name(name: Column) -> Column:
    return F.when(name.rlike(TRAILING_NOTE), F.trim(F.regexp_extract(name, TRAILING_NOTE, 1))).otherwise(
        F.coalesce(name, F.lit("")))


def branch_of(name: Column) -> Column:
    return F.when(name.rlike(TRAILING_NOTE), F.trim(F.regexp_extract(name, TRAILING_NOTE, 2)))


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def blank_to_null(c: Column) -> Column:
    return F.when(~blank(c), F.trim(c))


def clean_label(c: Column, longest: int | None = None) -> Column:
    label = F.trim(F.regexp_replace(F.regexp_replace(c, LABEL_CONTROL, " "), r"\s+", " "))
    fits = F.length(label) >= 1
    return F.when(fits if longest is None else fits & (F.length(label) <= longest), label)


def is_place_id(c: Column, longest: int | None = None) -> Column:
    ok = c.rlike(r"^[A-Za-z0-9_-]+\z")
    return F.coalesce(ok if longest is None else ok & (F.length(c) <= longest), F.lit(False))
