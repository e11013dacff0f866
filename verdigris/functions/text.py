"""Text functions as column expressions: folding, cleaning, numbers, units, excerpts."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Results depend on each of them.
NULL_WORDS = ("", "-", "--", "n/a", "na", "nil", "none", "not applicable", "not found", "not specified", "not stated", "null", "unspecified")
LEGAL_SUFFIXES = ("incorporated", "corporation", "company", "limited", "inc", "llc", "llp", "lllp", "pllc", "plc", "ltd", "corp", "gmbh", "ag", "nv", "bv", "sa", "spa", "srl", "pty", "lp", "pc", "co")
ARTICLES = ("the", "a", "an")
HONORIFICS = ("mr", "mrs", "ms", "mx", "miss", "dr", "prof", "professor", "sir", "dame", "rev", "hon")
CREDENTIALS = ("phd", "md", "jd", "esq", "mba", "cpa", "dds", "llm", "msc", "bsc")
TRUE_WORDS = ("true", "t", "yes", "y", "1", "affirmative", "present")
FALSE_WORDS = ("false", "f", "no", "n", "0", "negative", "absent")
MAGNITUDES = {"k": 1e3, "thousand": 1e3, "m": 1e6, "mm": 1e6, "million": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9, "t": 1e12, "trillion": 1e12}
UNIT_MAGNITUDES = {"thousand": 1e3, "thousands": 1e3, "million": 1e6, "millions": 1e6, "mm": 1e6, "billion": 1e9, "billions": 1e9, "bn": 1e9, "trillion": 1e12, "trillions": 1e12}
CURRENCY_SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}
CURRENCY_NAMES = {
    "us dollar": "USD", "us dollars": "USD", "u.s. dollars": "USD", "us$": "USD", "usd": "USD",
    "canadian dollar": "CAD", "canadian dollars": "CAD", "cad": "CAD", "c$": "CAD",
    "australian dollar": "AUD", "australian dollars": "AUD", "aud": "AUD", "a$": "AUD",
    "euro": "EUR", "euros": "EUR", "eur": "EUR",
    "pound sterling": "GBP", "pounds sterling": "GBP", "british pounds": "GBP", "gbp": "GBP",
    "yen": "JPY", "japanese yen": "JPY", "jpy": "JPY",
}
TIME_UNITS = {
    "day": "days", "days": "days", "calendar day": "days", "calendar days": "days", "d": "days",
    "business day": "business days", "business days": "business days", "working day": "business days", "working days": "business days",
    "week": "weeks", "weeks": "weeks", "wk": "weeks", "wks": "weeks",
    "month": "months", "months": "months", "mo": "months", "mos": "months", "calendar month": "months", "calendar months": "months",
    "year": "years", "years": "years", "yr": "years", "yrs": "years",
}
DOLLAR_CODES = ("USD", "CAD", "AUD", "NZD", "SGD", "HKD")
#: Typographic signs and what they fold to.
SINGLE_QUOTES, DOUBLE_QUOTES, DASHES, SPACES = "‘’‚‛", "“”„", "‐‑‒–—―", "   "
ELLIPSIS, TRUNCATED = "…", "\n\n[... truncated ...]\n\n"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it; keeps nested expressions small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fold_table(c: Column) -> Column:
    signs = SINGLE_QUOTES + DOUBLE_QUOTES + DASHES + SPACES
    plain = "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(DASHES) + " " * len(SPACES)
    return F.replace(F.translate(c, signs, plain), F.lit(ELLIPSIS), F.lit("..."))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def fold_unicode(c: Column, compatibility: bool = False) -> Column:
    """Typographic quotes, dashes, spaces and the ellipsis as ASCII.

    ``compatibility`` also applies NFKC, which Spark lacks: an Arrow batch function, for texts with ligatures, full-width
    forms or split accents.
    """
    return _fold_table(_nfkc(c) if compatibility else c)


def collapse(c: Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean(c: Column, compatibility: bool = False) -> Column:
    return collapse(fold_unicode(c, compatibility))


def lowered(c: Column) -> Column:
    """Case folded; the sharp s, which lower-casing keeps, is ss."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def strip_quotes(c: Column) -> Column:
    """Without one matched pair of quotes around the whole; as it was if there is none."""
    return let(c, _without_quotes)


def _without_quotes(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.rlike(r"""(?s)^(["'`]).+\1$"""), F.trim(F.substr(t, F.lit(2), F.length(t) - 2))).otherwise(c)


def is_null_word(c: Column, words: tuple[str, ...] | None = None) -> Column:
    """Null, or a word that means no answer."""
    given = [w.strip().lower() for w in words] if words else NULL_WORDS
    return c.isNull() | lowered(clean(c)).isin(*given)


def join_dotted(c: Column) -> Column:
    """``l.l.c.`` as ``llc``; a lone initial keeps its dot.  Lower case in."""
    return F.regexp_replace(c, r"(?<=\b[a-z])\.(?=[a-z]\b)|(?<=\b[a-z]\.[a-z])\.", "")


def drop_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"""[.,;:()\[\]{}'"`/\\]""", " ")


def strip_legal_suffixes(c: Column) -> Column:
    return F.regexp_replace(c, f"( ({'|'.join(LEGAL_SUFFIXES)}))+$", "")


def number_parts(c: Column) -> Column:
    """STRUCT<number, scale, before, after> of the first number in a text; number is null if there is none.

    A magnitude word counts only as a whole word behind the number, the longest first.
    """
    pattern = r"(?s)^(.*?)(-?\d[\d,_\s]*\.?\d*)(.*)$"
    digits = F.regexp_replace(F.regexp_extract(c, pattern, 2), r"[,\s_]", "")
    return let(F.trim(F.regexp_extract(c, pattern, 3)), lambda rest: _number_parts(c, pattern, digits, rest))


def _number_parts(c: Column, pattern: str, digits: Column, rest: Column) -> Column:
    words = sorted(MAGNITUDES, key=lambda w: (-len(w), w))
    found = F.regexp_extract(rest, rf"(?U)^({'|'.join(words)})(?!\p{{L}})", 1)
    scales = F.create_map(*(x for w in words for x in (F.lit(w), F.lit(MAGNITUDES[w]))))
    return F.struct(
        F.when(c.rlike(r"\d"), digits.try_cast("double")).alias("number"),
        F.coalesce(F.try_element_at(scales, found), F.lit(1.0)).alias("scale"),
        F.regexp_extract(c, pattern, 1).alias("before"),
        F.substr(rest, F.length(found) + 1).alias("after"),
    )


def unit_words(c: Column) -> Column:
    return collapse(F.regexp_replace(c, r"^[\s.,;:()\[\]\-]+|[\s.,;:()\[\]\-]+$", ""))


def split_unit_magnitude(amount: Column, unit: Column) -> Column:
    """STRUCT<amount, unit>: ``million USD`` gives its million to the amount."""
    words = F.split(lowered(clean(unit)), " ")
    scales = F.create_map(*(x for w, v in UNIT_MAGNITUDES.items() for x in (F.lit(w), F.lit(v))))
    scale = F.aggregate(words, F.lit(1.0), lambda acc, w: acc * F.coalesce(F.try_element_at(scales, w), F.lit(1.0)))
    kept = F.array_join(F.filter(words, lambda w: F.try_element_at(scales, w).isNull()), " ")
    scaled = F.coalesce(scale, F.lit(1.0)) != 1.0
    return F.struct(F.when(scaled, amount * scale).otherwise(amount).alias("amount"), F.when(scaled, F.nullif(kept, F.lit(""))).otherwise(unit).alias("unit"))


def canonical_unit(unit: Column, declared: str | None = None, aliases: dict[str, str] | None = None) -> Column:
    """A unit's code: the task's aliases, then currencies, periods and symbols; the declared unit if none is written."""
    names = CURRENCY_NAMES | TIME_UNITS | CURRENCY_SYMBOLS
    dollars = declared if declared in DOLLAR_CODES else "USD"
    names |= {"dollar": dollars, "dollars": dollars}
    names |= {" ".join(k.split()).lower(): v for k, v in (aliases or {}).items()}
    known = F.create_map(*(x for k, v in names.items() for x in (F.lit(k), F.lit(v))))
    return let(lowered(clean(unit)), lambda text: F.when(text.isNull() | (text == ""), F.lit(declared)).otherwise(F.coalesce(F.try_element_at(known, text), text)))


def truncate_iso(iso: Column, parts: Column | int) -> Column:
    """The first ``parts`` parts of an ISO date."""
    return F.array_join(F.slice(F.split(iso, "-"), 1, parts), "-")


def truncate(c: Column, limit: int | None, head_share: float = 0.7) -> Column:
    """A text over ``limit`` as its head and tail around a marker."""
    if limit is None:
        return c
    head = int(limit * head_share)
    tail = limit - head
    cut = F.concat(F.substr(c, F.lit(1), F.lit(head)), F.lit(TRUNCATED), F.right(c, F.lit(tail)) if tail else F.lit(""))
    return F.when(F.length(c) <= limit, c).otherwise(cut)


def context_window(doc: Column, needle: Column, around: int = 200) -> Column:
    """The text ``around`` the first place of ``needle``, upper and lower case alike, on one line; null if it isn't there."""
    at = F.instr(F.lower(doc), F.lower(needle))
    first = F.greatest(at - around, F.lit(1))
    return F.when((F.length(needle) > 0) & (at > 0), F.translate(F.substr(doc, first, at + F.length(needle) + around - first), "\n", " "))


def doc_id_of(name: Column) -> Column:
    """A document's id from its file name: ends trimmed, one .pdf in any case dropped."""
    return F.trim(F.regexp_replace(F.trim(name), r"(?i)\.pdf$", ""))


def is_pdf(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return name.rlike(r"(?i)\.pdf$") & ~name.startswith(".")


def render(c: Column, kind: str) -> Column:
    """A value as a person writes it in a sheet: yes or no, lists by ;, numbers with their unit."""
    if kind == "binary":
        return F.when(c.isNull(), "").otherwise(F.when(c, "yes").otherwise("no"))
    if kind in ("multilabel", "extract_list"):
        return F.coalesce(F.array_join(c, "; "), F.lit(""))
    if kind == "extract_numeric":
        whole = c["value"] == F.floor(c["value"])
        n = F.when(whole, F.floor(c["value"]).cast("string")).otherwise(c["value"].cast("string"))
        return F.when(c.isNull(), "").otherwise(F.concat_ws(" ", n, c["unit"]))
    if kind == "extract_date":
        return F.coalesce(c["iso"], F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def field_of(df, column: str, field: str) -> Column:
    """A task's value from a struct or a map; null where there is no such field."""
    kind = df.schema[column].dataType
    if kind.typeName() == "map":
        return F.try_element_at(F.col(column), F.lit(field))
    return F.col(f"{column}.{field}") if field in kind.names else F.lit(None)
