"""Matchers: a gold and a predicted value as counted outcomes.

A matcher gives STRUCT<tp, fp, fn, tn, correct, strict STRUCT<same counts>, measure, threshold, gold, pred, gold_items,
pred_items, note>.  ``strict`` is filled by fuzzy matchers alone; labels are null for an abstention; item arrays are filled by
sets and lists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdigris.functions import similarity as S
from verdigris.functions.normalize import UnknownName, normalizer
from verdigris.functions.text import let

Matcher = Callable[[Column, Column, dict], Column]
_registered: dict[str, Matcher] = {}
NULL_LABEL = "(null)"


def register_matcher(name: str) -> Callable[[Matcher], Matcher]:
    def add(f: Matcher) -> Matcher:
        _registered[name] = f
        return f

    return add


def matcher(name: str) -> Matcher:
    if name not in _registered:
        raise UnknownName(f"no matcher {name!r}; there are {', '.join(sorted(_registered))}")
    return _registered[name]


def registered_matchers() -> list[str]:
    return sorted(_registered)


def counts(tp: Column, fp: Column, fn: Column, tn: Column, correct: Column) -> Column:
    return F.struct(*(x.cast("long").alias(n) for n, x in (("tp", tp), ("fp", fp), ("fn", fn), ("tn", tn))), correct.alias("correct"))


def scalar_counts(gold_null: Column, pred_null: Column, equal: Column) -> Column:
    """Both silent is a true negative; one silent a miss or an invention; a wrong value is both at once."""
    one = lambda c: F.when(c, 1).otherwise(0)
    same = ~gold_null & ~pred_null & equal
    return counts(one(same), one(~pred_null & ~same), one(~gold_null & ~same), one(gold_null & pred_null), same | (gold_null & pred_null))


def outcome(c: Column, strict: Column | None = None, measure: Column | None = None, threshold: Column | None = None, gold: Column | None = None, pred: Column | None = None, gold_items: Column | None = None, pred_items: Column | None = None, note: Column | None = None, gold_null: Column | None = None, pred_null: Column | None = None) -> Column:
    nothing = F.lit(None)
    blank = F.lit(None).cast("struct<tp:bigint,fp:bigint,fn:bigint,tn:bigint,correct:boolean>")
    label = lambda c: (nothing if c is None else c).cast("string")
    items = lambda c: nothing.cast("array<string>") if c is None else c
    return F.struct(
        *(c[n].alias(n) for n in ("tp", "fp", "fn", "tn", "correct")), (blank if strict is None else strict).alias("strict"),
        (nothing if measure is None else measure).cast("double").alias("measure"), (nothing if threshold is None else threshold).cast("double").alias("threshold"),
        label(gold).alias("gold"), label(pred).alias("pred"), items(gold_items).alias("gold_items"), items(pred_items).alias("pred_items"), label(note).alias("note"),
        (gold.isNull() if gold_null is None else gold_null).alias("gold_null"), (pred.isNull() if pred_null is None else pred_null).alias("pred_null"),
    )


def _pair(g: Column, p: Column, params: dict, default: str) -> tuple[Column, Column]:
    f = normalizer(params.get("normalizer", default))
    return f(g, params), f(p, params)


def _bound(a: Column, b: Column, body: Callable[[Column, Column], Column], c: Column | None = None) -> Column:
    """``body`` of values that are computed once."""
    fields = [a.alias("a"), b.alias("b")] + ([] if c is None else [c.alias("c")])
    return let(F.struct(*fields), lambda s: body(s["a"], s["b"]) if c is None else body(s["a"], s["b"], s["c"]))


def _equal(a: Column, b: Column) -> Column:
    return outcome(scalar_counts(a.isNull(), b.isNull(), a == b), gold=a, pred=b)


@register_matcher("identity")
def identity(g: Column, p: Column, params: dict) -> Column:
    return _bound(*_pair(g, p, params, "enum"), _equal)


@register_matcher("exact")
def exact(g: Column, p: Column, params: dict) -> Column:
    return _bound(*_pair(g, p, params, "free_string"), _equal)


@register_matcher("entity_name")
def entity_name(g: Column, p: Column, params: dict) -> Column:
    """Accepted from ``theta`` on; what strict equality says stands beside it."""
    a, b = _pair(g, p, params, "entity_name")
    theta = F.lit(float(params["theta"]))

    def judged(a: Column, b: Column, score: Column) -> Column:
        strict = scalar_counts(a.isNull(), b.isNull(), a == b)
        return outcome(scalar_counts(a.isNull(), b.isNull(), score >= theta), strict, score, F.when(score.isNotNull(), theta), a, b)

    return _bound(a, b, judged, S.similarity(a, b))


@register_matcher("free_text")
def free_text(g: Column, p: Column, params: dict) -> Column:
    return entity_name(g, p, {"normalizer": "free_string"} | params)


def as_items(c: Column, params: dict, default: str) -> Column:
    """Items of an array, normalized, abstentions dropped."""
    f = normalizer(params.get("normalizer", default))
    return F.coalesce(F.filter(F.transform(c, lambda x: f(x, params)), lambda x: x.isNotNull()), F.array().cast("array<string>"))


@register_matcher("set")
def set_match(g: Column, p: Column, params: dict) -> Column:
    return _bound(*(F.array_sort(F.array_distinct(as_items(c, params, "enum"))) for c in (g, p)), _sets)


def _sets(a: Column, b: Column) -> Column:
    tp, fp, fn = F.size(F.array_intersect(a, b)), F.size(F.array_except(b, a)), F.size(F.array_except(a, b))
    empty = (F.size(a) == 0) & (F.size(b) == 0)
    return outcome(counts(tp, fp, fn, F.when(empty, 1).otherwise(0), (fp == 0) & (fn == 0)), gold_items=a, pred_items=b, gold_null=F.size(a) == 0, pred_null=F.size(b) == 0)


@register_matcher("list")
def list_match(g: Column, p: Column, params: dict) -> Column:
    """Items paired best first, each once, from ``theta`` on; duplicates count."""
    theta = float(params.get("theta", 1.0))
    gold, pred = (as_items(c, params, "entity_name") for c in (g, p))
    if theta < 1.0:
        return _bound(gold, pred, lambda a, b, pairs: _greedy(a, b, pairs, theta), S.pair_scores(gold, pred))
    same = lambda x, y, i, j: F.struct(F.when(x == y, -1.0).otherwise(0.0).alias("s"), i.alias("i"), j.alias("j"))
    every = lambda a, b: F.flatten(F.transform(a, lambda x, i: F.transform(b, lambda y, j: same(x, y, i, j))))
    return _bound(gold, pred, lambda a, b: let(every(a, b), lambda pairs: _greedy(a, b, pairs, theta)))


def _greedy(a: Column, b: Column, pairs: Column, theta: float) -> Column:
    near = F.array_sort(F.filter(pairs, lambda q: -q["s"] >= theta))
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("i"), none.alias("j"))
    free = lambda acc, q: ~F.array_contains(acc["i"], q["i"]) & ~F.array_contains(acc["j"], q["j"])
    used = F.aggregate(near, start, lambda acc, q: F.when(free(acc, q), F.struct(F.concat(acc["i"], F.array(q["i"])).alias("i"), F.concat(acc["j"], F.array(q["j"])).alias("j"))).otherwise(acc))
    return let(F.size(used["i"]), lambda n: _paired(a, b, n, pairs, theta))


def _paired(a: Column, b: Column, n: Column, pairs: Column, theta: float) -> Column:
    best = F.transform(a, lambda x, i: F.coalesce(F.array_max(F.transform(F.filter(pairs, lambda q: q["i"] == i), lambda q: -q["s"])), F.lit(0.0)))
    closest = F.get(F.array_sort(F.transform(best, lambda s, i: F.struct(F.abs(s - theta).alias("d"), i.alias("i"), s.alias("s")))), F.lit(0))["s"]
    empty = (F.size(a) == 0) & (F.size(b) == 0)
    c = counts(n, F.size(b) - n, F.size(a) - n, F.when(empty, 1).otherwise(0), (n == F.size(a)) & (n == F.size(b)))
    return outcome(c, measure=F.when(~empty, closest), threshold=F.when(~empty, F.lit(theta)), gold_items=a, pred_items=b, gold_null=F.size(a) == 0, pred_null=F.size(b) == 0)


def _label(c: Column, value: Column) -> Column:
    return F.when(c.isNotNull(), F.coalesce(value.cast("string"), c["text"]))


@register_matcher("numeric")
def numeric(g: Column, p: Column, params: dict) -> Column:
    """Within a tolerance of gold; other units are wrong, never converted."""
    return _bound(*_pair(g, p, params, "numeric"), lambda a, b: _numeric(a, b, params))


def _numeric(a: Column, b: Column, params: dict) -> Column:
    tolerance = F.lit(float(params["tolerance"]))
    read = a["value"].isNotNull() & b["value"].isNotNull()
    units = a["unit"].eqNullSafe(b["unit"])
    delta = F.abs(a["value"] - b["value"])
    allowed = tolerance * F.abs(a["value"]) if params.get("tolerance_kind", "relative") == "relative" else tolerance
    equal = F.when(read, units & (delta <= allowed)).otherwise(a["text"].eqNullSafe(b["text"]) & a["text"].isNotNull())
    measure = F.when(read & units, F.when(allowed > 0, F.try_divide(delta, allowed)).when(delta == 0, 0.0))
    return outcome(scalar_counts(a.isNull(), b.isNull(), equal), None, measure, F.when(read & units, 1.0), _label(a, a["value"]), _label(b, b["value"]), note=F.when(read & ~units, "units differ"))


@register_matcher("date")
def date(g: Column, p: Column, params: dict) -> Column:
    """Compared as finely as the task and both dates allow; a prediction coarser than gold is wrong unless the task allows it."""
    return _bound(*_pair(g, p, params, "date"), lambda a, b: _date(a, b, params))


def _date(a: Column, b: Column, params: dict) -> Column:
    parts = F.lit({"year": 1, "month": 2, "day": 3}[params.get("granularity", "day")])
    read = a["parts"].isNotNull() & b["parts"].isNotNull()
    cut = F.least(parts, a["parts"], b["parts"])
    same = F.array_join(F.slice(F.split(a["iso"], "-"), 1, cut), "-") == F.array_join(F.slice(F.split(b["iso"], "-"), 1, cut), "-")
    coarse = (b["parts"] < F.least(parts, a["parts"])) & F.lit(not params.get("allow_coarser", False))
    equal = F.when(read, ~coarse & same).otherwise(a["text"].eqNullSafe(b["text"]) & a["text"].isNotNull())
    names = F.array(F.lit("year"), F.lit("month"), F.lit("day"))
    note = F.when(read & (a["parts"] != b["parts"]), F.concat(F.lit("granularity differs: gold "), F.get(names, a["parts"] - 1), F.lit(", predicted "), F.get(names, b["parts"] - 1)))
    return outcome(scalar_counts(a.isNull(), b.isNull(), equal), gold=_label(a, a["iso"]), pred=_label(b, b["iso"]), note=note)


@register_matcher("span")
def span(g: Column, p: Column, params: dict) -> Column:
    """Counts are characters; correct if the overlap is enough of the union."""
    return _bound(*_pair(g, p, params, "span"), lambda a, b: _span(a, b, params))


def _span(a: Column, b: Column, params: dict) -> Column:
    threshold = float(params.get("overlap_threshold", 0.5))
    read = a["start"].isNotNull() & b["start"].isNotNull()
    both = F.greatest(F.lit(0), F.least(a["stop"], b["stop"]) - F.greatest(a["start"], b["start"]))
    m, n = a["stop"] - a["start"], b["stop"] - b["start"]
    ratio = F.try_divide(both.cast("double"), (m + n - both).cast("double"))
    plain = scalar_counts(a.isNull(), b.isNull(), a["text"].eqNullSafe(b["text"]) & a["text"].isNotNull())
    c = F.when(read, counts(both, n - both, m - both, F.lit(0), ratio >= threshold)).otherwise(plain)
    place = lambda x: F.when(x.isNotNull(), F.coalesce(F.concat_ws(":", x["start"], x["stop"]), x["text"]))
    return outcome(c, None, F.when(read, ratio), F.when(read, F.lit(threshold)), place(a), place(b))
