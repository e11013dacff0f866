"""Normalizers and matchers as SQL functions, so that a plan in SQL text uses them; no Python workers run.

:func:`register` makes ``norm_free_string``, ``norm_boolean``, ``norm_entity_name``, ``norm_person_name``, ``match_exact``,
``match_identity`` and what they are made of, as temporary functions of the session.  With a registry each of its tasks whose
answers are single texts gets ``norm_<task>(answer)`` and ``match_<task>(gold, predicted)`` by its own declaration.  They give
what the column functions of the same names give; a test holds them together.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from verdigris.functions import text as T
from verdigris.functions.normalize import UnknownName
from verdigris.plans.registry import Registry, Task

COUNTS = "STRUCT<tp: BIGINT, fp: BIGINT, fn: BIGINT, tn: BIGINT, correct: BOOLEAN>"


def literal(value: str) -> str:
    """A SQL text, whatever it holds."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def words(values) -> str:
    return "(" + ", ".join(literal(v) for v in values) + ")"


def pattern(text: str) -> str:
    """A regular expression as a raw SQL text; a quote in it is written as its code."""
    return "r'" + text.replace("'", r"\x27") + "'"


def _function(spark: SparkSession, name: str, arguments: str, returns: str, body: str) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION `{name}`({arguments}) RETURNS {returns} RETURN {body}")


def _text_function(spark: SparkSession, name: str, body: str, returns: str = "STRING") -> None:
    _function(spark, name, "c STRING", returns, body)


def register(spark: SparkSession, registry: Registry | None = None) -> list[str]:
    """Creates the functions; the names of those that stand for normalizers and matchers."""
    signs = T.SINGLE_QUOTES + T.DOUBLE_QUOTES + T.DASHES + T.SPACES
    plain = "'" * len(T.SINGLE_QUOTES) + '"' * len(T.DOUBLE_QUOTES) + "-" * len(T.DASHES) + " " * len(T.SPACES)
    alternatives = "|".join
    make = lambda name, body, returns="STRING": _text_function(spark, name, body, returns)
    make("collapse_text", f"trim(regexp_replace(c, {pattern(r'(?U)\s+')}, ' '))")
    make("clean_text", f"collapse_text(replace(translate(c, {literal(signs)}, {literal(plain)}), {literal(T.ELLIPSIS)}, '...'))")
    make("lower_text", "replace(lower(c), 'ß', 'ss')")
    make("is_null_word", f"c IS NULL OR lower_text(clean_text(c)) IN {words(T.NULL_WORDS)}", "BOOLEAN")
    quoted = pattern(r"""(?s)^(["'`]).+\1$""")
    make("strip_quotes", f"CASE WHEN trim(c) RLIKE {quoted} THEN trim(substr(trim(c), 2, length(trim(c)) - 2)) ELSE c END")
    dotted = pattern(r"(?<=\b[a-z])\.(?=[a-z]\b)|(?<=\b[a-z]\.[a-z])\.")
    make("join_dotted", f"regexp_replace(c, {dotted}, '')")
    marks = pattern(r"""[.,;:()\[\]{}'"`/\\]""")
    make("drop_punctuation", f"regexp_replace(c, {marks}, ' ')")
    given = lambda value: f"CASE WHEN NOT is_null_word(c) THEN {value} END"

    make("norm_passthrough", "c")
    make("norm_free_string", given("lower_text(collapse_text(strip_quotes(clean_text(c))))"))
    low = "lower_text(clean_text(c))"
    make("norm_boolean", given(f"CASE WHEN {low} IN {words(T.TRUE_WORDS)} THEN 'true' WHEN {low} IN {words(T.FALSE_WORDS)} THEN 'false' ELSE {low} END"))
    hyphen = pattern(r"(?U)\s*-\s*")
    spaced = f"collapse_text(regexp_replace(drop_punctuation(join_dotted(replace({low}, '&', ' and '))), {hyphen}, ' '))"
    article, suffixes = pattern(f"^({alternatives(T.ARTICLES)}) "), pattern(f"( ({alternatives(T.LEGAL_SUFFIXES)}))+$")
    make("norm_entity_name", given(f"collapse_text(regexp_replace(regexp_replace({spaced}, {article}, ''), {suffixes}, ''))"))
    person = f"collapse_text(regexp_replace(drop_punctuation(join_dotted({low})), {hyphen}, '-'))"
    titles, degrees = pattern(f"^(({alternatives(T.HONORIFICS)})( |$))+"), pattern(f"((^| )({alternatives(T.CREDENTIALS)}))+$")
    make("norm_person_name", given(f"nullif(trim(regexp_replace(regexp_replace({person}, {titles}, ''), {degrees}, '')), '')"))

    same = "g IS NOT NULL AND p IS NOT NULL AND g = p"
    count = lambda condition: f"CAST({condition} AS BIGINT)"
    _function(spark, "scalar_counts", "g STRING, p STRING", COUNTS, f"""named_struct('tp', {count(same)}, 'fp', {count(f"p IS NOT NULL AND NOT ({same})")}, 'fn', {count(f"g IS NOT NULL AND NOT ({same})")},
        'tn', {count("g IS NULL AND p IS NULL")}, 'correct', ({same}) OR (g IS NULL AND p IS NULL))""")  # fmt: skip
    _match(spark, "match_exact", "norm_free_string")
    _match(spark, "match_identity", "norm_passthrough")
    names = ["norm_passthrough", "norm_free_string", "norm_boolean", "norm_entity_name", "norm_person_name", "match_exact", "match_identity"]
    for task in registry or ():
        if task.params["matcher"] in ("exact", "identity"):
            make(f"norm_{task.id}", _task_body(task))
            _match(spark, f"match_{task.id}", f"norm_{task.id}")
            names += [f"norm_{task.id}", f"match_{task.id}"]
    return names


def _match(spark: SparkSession, name: str, normal: str) -> None:
    _function(spark, name, "gold STRING, predicted STRING", COUNTS, f"scalar_counts(`{normal}`(gold), `{normal}`(predicted))")


def _task_body(task: Task) -> str:
    """A task's normalizer over ``c``."""
    kind, p = task.params["normalizer"], task.params
    if p.get("compatibility"):
        raise UnknownName(f"task {task.id}: Spark's SQL has no compatibility folding")
    if kind in ("passthrough", "free_string", "boolean", "entity_name", "person_name") and not p.get("null_tokens"):
        return f"norm_{kind}(c)"
    if kind == "enum":
        return _enum_body(p)
    raise UnknownName(f"task {task.id}: no SQL function for the normalizer {kind!r} as it is declared")


def _enum_body(p: dict) -> str:
    """A member as written, by synonym, by case, by letters alone; else the folded text, unless it means no answer."""
    squash = lambda s: "".join(ch for ch in s.lower() if ch not in " \t\n_-.")
    members = list(p.get("enum") or [])
    by_case: dict[str, str] = {}
    by_letters: dict[str, str] = {}
    for m in members:
        by_case.setdefault(m.lower(), m)
        by_letters.setdefault(squash(m), m)
    synonyms = {" ".join(k.split()).lower(): v for k, v in (p.get("synonyms") or {}).items()}
    given, low = "clean_text(c)", "lower_text(clean_text(c))"
    letters = f"regexp_replace({low}, {pattern(r'(?U)[\s_\-.]+')}, '')"
    steps = [({m: m for m in members}, given), (synonyms, low), (by_case, low), (by_letters, letters)]
    found = [f"CASE {key} " + " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in table.items()) + " END" for table, key in steps if table]
    silent = [w.strip().lower() for w in p["null_tokens"]] if p.get("null_tokens") else T.NULL_WORDS
    return f"coalesce({', '.join([*found, f'CASE WHEN {low} NOT IN {words(silent)} THEN {low} END'])})"
