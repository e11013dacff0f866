"""Normalizers: a raw answer as its canonical value.

Null is an abstention.  A value that is given but can't be read stays as text: ``text`` of a struct, or the folded string
itself, so that it counts as wrong and not as silence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdigris.functions import text as T

Normalizer = Callable[[Column, dict], Column]
_registered: dict[str, Normalizer] = {}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


class UnknownName(ValueError):
    """A normalizer or matcher that nobody registered."""


def register_normalizer(name: str) -> Callable[[Normalizer], Normalizer]:
    def add(f: Normalizer) -> Normalizer:
        _registered[name] = f
        return f

    return add


def normalizer(name: str) -> Normalizer:
    if name not in _registered:
        raise UnknownName(f"no normalizer {name!r}; there are {', '.join(sorted(_registered))}")
    return _registered[name]


def registered_normalizers() -> list[str]:
    return sorted(_registered)


def _compat(p: dict) -> bool:
    return bool(p.get("compatibility"))


def _given(c: Column, p: dict, value: Column) -> Column:
    return F.when(~T.is_null_word(c, p.get("null_tokens")), value)


@register_normalizer("passthrough")
def passthrough(c: Column, p: dict) -> Column:
    return c


@register_normalizer("free_string")
def free_string(c: Column, p: dict) -> Column:
    return _given(c, p, T.lowered(T.collapse(T.strip_quotes(T.clean(c, _compat(p))))))


@register_normalizer("boolean")
def boolean(c: Column, p: dict) -> Column:
    """``true``, ``false`` or the folded text."""
    read = lambda t: F.when(t.isin(*T.TRUE_WORDS), "true").when(t.isin(*T.FALSE_WORDS), "false").otherwise(t)
    return _given(c.cast("string"), p, T.let(T.lowered(T.clean(c.cast("string"), _compat(p))), read))


def _squash(s: str) -> str:
    for sign in " \t\n_-.":
        s = s.replace(sign, "")
    return s


@register_normalizer("enum")
def enum(c: Column, p: dict) -> Column:
    """The member that a value names: as written, by synonym, by case, by letters alone; only then may it be a null word."""
    return T.let(T.clean(c.cast("string"), _compat(p)), lambda t: T.let(T.lowered(t), lambda low: _member(t, low, p)))


def _member(t: Column, low: Column, p: dict) -> Column:
    members: list[str] = list(p.get("enum") or [])
    steps = [({m: m for m in members}, t), ({" ".join(k.split()).lower(): v for k, v in (p.get("synonyms") or {}).items()}, low)]
    by_case: dict[str, str] = {}
    by_letters: dict[str, str] = {}
    for m in members:
        by_case.setdefault(m.lower(), m)
        by_letters.setdefault(_squash(m.lower()), m)
    steps += [(by_case, low), (by_letters, F.regexp_replace(low, r"(?U)[\s_\-.]+", ""))]
    found = [F.try_element_at(F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v)))), key) for table, key in steps if table]
    words = [w.strip().lower() for w in p["null_tokens"]] if p.get("null_tokens") else T.NULL_WORDS
    return F.coalesce(*found, F.when(~low.isin(*words), low))


@register_normalizer("controlled_code")
def controlled_code(c: Column, p: dict) -> Column:
    """Enum over a vocabulary of surface forms and their codes."""
    vocabulary = dict(p.get("vocabulary") or {})
    return enum(c, p | {"enum": p.get("enum") or sorted(set(vocabulary.values())), "synonyms": vocabulary | dict(p.get("synonyms") or {})})


@register_normalizer("entity_name")
def entity_name(c: Column, p: dict) -> Column:
    t = T.join_dotted(F.replace(T.lowered(T.clean(c, _compat(p))), F.lit("&"), F.lit(" and ")))
    t = T.collapse(F.regexp_replace(T.drop_punctuation(t), r"(?U)\s*-\s*", " "))
    t = F.regexp_replace(t, f"^({'|'.join(T.ARTICLES)}) ", "")
    return _given(c, p, T.collapse(T.strip_legal_suffixes(t)))


@register_normalizer("person_name")
def person_name(c: Column, p: dict) -> Column:
    t = T.drop_punctuation(T.join_dotted(T.lowered(T.clean(c, _compat(p)))))
    t = T.collapse(F.regexp_replace(t, r"(?U)\s*-\s*", "-"))
    t = F.regexp_replace(t, f"^(({'|'.join(T.HONORIFICS)})( |$))+", "")
    t = F.regexp_replace(t, f"((^| )({'|'.join(T.CREDENTIALS)}))+$", "")
    return _given(c, p, F.nullif(F.trim(t), F.lit("")))


def quantity(value: Column, unit: Column) -> Column:
    return F.struct(value.cast("double").alias("value"), unit.cast("string").alias("unit"), F.lit(None).cast("string").alias("text"))


def _no_quantity(t: Column) -> Column:
    return F.struct(F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("unit"), t.alias("text"))


@register_normalizer("numeric")
def numeric(c: Column, p: dict) -> Column:
    """STRUCT<value, unit, text> of a number written as text."""
    return _given(c.cast("string"), p, T.let(T.clean(c.cast("string"), _compat(p)), lambda t: _amount(t, p)))


def _amount(t: Column, p: dict) -> Column:
    symbol = F.coalesce(*(F.when(F.contains(t, F.lit(s)), F.lit(s)) for s in T.CURRENCY_SYMBOLS))
    code = F.coalesce(*(F.when(F.contains(t, F.lit(s)), F.lit(v)) for s, v in T.CURRENCY_SYMBOLS.items()))
    bare = F.when(symbol.isNotNull(), F.replace(t, symbol, F.lit(" "))).otherwise(t)
    percent = F.contains(t, F.lit("%"))
    plain = T.lowered(T.collapse(F.replace(bare, F.lit("%"), F.lit(" "))))

    def read(x: Column) -> Column:
        negative = F.when(x.startswith("(") & x.endswith(")"), -1.0).otherwise(1.0)

        def value(parts: Column) -> Column:
            words = F.coalesce(F.nullif(T.unit_words(parts["after"]), F.lit("")), F.nullif(T.unit_words(parts["before"]), F.lit("")))
            unit = F.when(percent, "percent").otherwise(F.coalesce(code, words))
            amount = quantity(parts["number"] * parts["scale"] * negative, T.canonical_unit(unit, p.get("unit"), p.get("unit_aliases")))
            return F.when(parts["number"].isNull(), _no_quantity(x)).otherwise(amount)

        return T.let(T.number_parts(F.regexp_replace(x, r"^[()]+|[()]+$", "")), value)

    return T.let(plain, read)


def numeric_of(value: Column, unit: Column, p: dict) -> Column:
    """STRUCT<value, unit, text> of a number that came with its unit apart."""
    text = value.cast("string")

    def read(parts: Column) -> Column:
        amount = lambda s: quantity(s["amount"], T.canonical_unit(s["unit"], p.get("unit"), p.get("unit_aliases")))
        return F.when(parts["number"].isNull(), _no_quantity(T.lowered(T.collapse(text)))).otherwise(T.let(T.split_unit_magnitude(parts["number"] * parts["scale"], unit), amount))

    return F.when(value.isNotNull(), T.let(T.number_parts(T.lowered(T.clean(text))), read))


def partial_date(iso: Column, parts: int) -> Column:
    return F.when(iso.isNotNull(), F.struct(iso.alias("iso"), F.lit(parts).alias("parts"), F.lit(None).cast("string").alias("text")))


@register_normalizer("date")
def date(c: Column, p: dict) -> Column:
    """STRUCT<iso, parts, text>: a date keeps how exactly it was given: 1 year, 2 month, 3 day."""
    plain = T.collapse(F.replace(T.lowered(T.clean(c.cast("string"), _compat(p))), F.lit(","), F.lit(" ")))
    return _given(c.cast("string"), p, T.let(plain, lambda t: _read_date(t, p)))


def _read_date(t: Column, p: dict) -> Column:
    months = F.create_map(*(x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(f"{i:02d}"))))
    month = lambda name: F.try_element_at(months, F.substr(name, F.lit(1), F.lit(3)))
    unread = F.struct(F.lit(None).cast("string").alias("iso"), F.lit(None).cast("int").alias("parts"), t.alias("text"))
    exactly = lambda iso, parts: T.let(iso, lambda x: F.coalesce(partial_date(x, parts), unread))
    named, yearly, year_month = r"^([a-z]{3,9})\.?\s*\s(\d{4})$", r"^(\d{4})\s+([a-z]{3,9})$", r"^(\d{4})-(\d{1,2})$"
    part = lambda pattern, g: F.regexp_extract(t, pattern, g)
    number = part(year_month, 2).try_cast("int")
    monthly = F.when(number.between(1, 12), F.concat(part(year_month, 1), F.lit("-"), F.lpad(number.cast("string"), 2, "0")))
    # a text goes the way of its shape, so that each is read by the patterns that it can match
    return (
        F.when(t.rlike(r"^\d{4}$"), partial_date(t, 1))
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), T.let(t.try_cast("date"), lambda d: F.coalesce(partial_date(F.date_format(d, "yyyy-MM-dd"), 3), unread)))
        .when(t.rlike(year_month), exactly(monthly, 2))
        .when(t.rlike(named), exactly(F.concat(part(named, 2), F.lit("-"), month(part(named, 1))), 2))
        .when(t.rlike(yearly), exactly(F.concat(part(yearly, 1), F.lit("-"), month(part(yearly, 2))), 2))
        .otherwise(exactly(F.date_format(_whole_date(t, p), "yyyy-MM-dd"), 3))
    )


def _whole_date(t: Column, p: dict) -> Column:
    slashed = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$"
    at = lambda g: F.lpad(F.regexp_extract(t, slashed, g), 2, "0")
    as_date = lambda m, d: F.concat_ws("-", F.regexp_extract(t, slashed, 3), at(m), at(d)).try_cast("date")
    # month first unless the task says otherwise; the other way round if that is no date
    numbers = F.coalesce(as_date(2, 1), as_date(1, 2)) if p.get("dayfirst") else F.coalesce(as_date(1, 2), as_date(2, 1))
    plain = F.regexp_replace(t, r"^([a-z]{3})[a-z]*\.? ", "$1 ")
    plain = F.initcap(F.regexp_replace(plain, r"^(\d{1,2}) ([a-z]{3})[a-z]*\.? ", "$1 $2 "))
    forms = ("yyyy-M-d", "yyyy/M/d", "MMM d yyyy", "d MMM yyyy", "yyyy-M-d HH:mm:ss")
    spelled = T.let(plain, lambda x: F.coalesce(*(F.to_date(F.try_to_timestamp(x, F.lit(f))) for f in forms)))
    stamp = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}t"), F.substr(t, F.lit(1), F.lit(10)).try_cast("date"))
    # without a digit there is no whole date
    return F.when(t.rlike(slashed), numbers).when(t.rlike(r"\d"), F.coalesce(spelled, stamp))


@register_normalizer("span")
def span(c: Column, p: dict) -> Column:
    """STRUCT<start, stop, text> from STRUCT<start, stop, text>: an empty or negative span is an abstention."""
    bad = (c["stop"] <= c["start"]) | (c["start"] < 0)
    read = F.struct(c["start"].cast("int").alias("start"), c["stop"].cast("int").alias("stop"), F.lit(None).cast("string").alias("text"))
    unread = F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("stop"), T.lowered(T.collapse(c["text"])).alias("text"))
    return F.when(c["start"].isNotNull() & c["stop"].isNotNull(), F.when(~bad, read)).when(~T.is_null_word(c["text"], p.get("null_tokens")), unread)
