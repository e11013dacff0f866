"""Quality rules as a short-circuit cascade.

Every rule rejects a document by counts of its text.  :func:`plan_cascade` makes every count on a bounded sample, measures what
each costs beside those it builds on, and orders the rules greedily: next comes the rule that rejects most of what the rules
before it leave, per cost of the counts that they have not made yet.  :func:`quality_filter` then stops at a document's first
rejection, so dear counts are made only for what cheap rules left.  The order never changes a verdict, only who gives it and
at what cost.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import free_name, text_batches

#: Rows that the cost and selectivity of rules are estimated on.  More only make the estimate finer: the verdicts do not depend on it.
SAMPLE_ROWS = 2_000
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = frozenset("#*$%&|<>")


class Counts:
    """Counts of one text, each made when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return _WORDS.findall(self.text)

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, _SYMBOLS))

    @cached_property
    def n_bangs(self) -> int:
        return self.text.count("!")

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if _WORDS.search(x)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def kinds(self) -> Counter:
        return Counter(self.words)

    @cached_property
    def n_types(self) -> int:
        return len(self.kinds)

    @cached_property
    def n_top_word(self) -> int:
        return max(self.kinds.values(), default=0)

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in 3-word windows that the text has twice or more."""
        w = self.words
        if len(w) < 4:
            return 0
        seen: set = set()
        add, again = seen.add, set()
        for x in (windows := list(zip(w, w[1:], w[2:]))):
            if x in seen:
                again.add(x)
            else:
                add(x)
        if not again:
            return 0
        total, free = 0, 0
        for i, x in enumerate(windows):
            if x in again:
                total += i + 3 - max(i, free)
                free = i + 3
        return total


#: What each count is made from, in an order in which all can be made.
BUILT_ON = {
    "words": (), "n_words": ("words",), "word_chars": ("words",), "n_symbols": (), "n_bangs": (), "lines": (),
    "n_dup_lines": ("lines",), "kinds": ("words",), "n_types": ("kinds",), "n_top_word": ("kinds",), "n_repeat_words": ("words",),
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets a document's :class:`Counts` and says whether it goes; ``needs`` names the counts that it reads."""

    name: str
    rejects: Callable[[Counts], bool]
    needs: tuple[str, ...] = tuple(BUILT_ON)


#: The first two are the floor that every text must pass; the others are what this filter adds.
RULES = (
    Rule("few_words", lambda c: c.n_words < 50, ("n_words",)),
    Rule("repetition", lambda c: 100 * c.n_repeat_words > 50 * c.n_words, ("n_repeat_words", "n_words")),
    Rule("symbols", lambda c: 10 * c.n_symbols > c.n_words, ("n_symbols", "n_words")),
    Rule("shouting", lambda c: 2 * c.n_bangs > c.n_words, ("n_bangs", "n_words")),
    Rule("word_length", lambda c: c.word_chars < 2 * c.n_words or c.word_chars > 15 * c.n_words, ("word_chars", "n_words")),
    Rule("repeated_lines", lambda c: 2 * c.n_dup_lines > len(c.lines), ("n_dup_lines", "lines")),
    Rule("one_word", lambda c: 2 * c.n_top_word > c.n_words, ("n_top_word", "n_words")),
    Rule("few_types", lambda c: 50 * c.n_types < c.n_words, ("n_types", "n_words")),
)
BASE = ("few_words", "repetition")
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _closure(names: tuple[str, ...]) -> set[str]:
    out: set[str] = set()
    todo = list(names)
    while todo:
        if (n := todo.pop()) not in out:
            out.add(n)
            todo += BUILT_ON[n]
    return out


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS, n_rows: int | None = None) -> list[dict]:
    """Rules in the order to run them: dicts of rule, rows (sampled rows that the rules before it leave), rejected (of them),
    cost_ns (mean a row, of the counts that only this rule and later ones need) and score (rejections per second).

    ``n_rows`` saves counting ``docs``.  With no rows the given order stays.  Executors return a row for each set of
    rejecting rules that they saw, at most ``sample_rows``, and one for each count.
    """
    total = docs.count() if n_rows is None else n_rows
    few = docs.select(F.col(text).cast("string").alias("t"))
    few = few if total <= sample_rows else few.sample(fraction=sample_rows / total, seed=7)

    def measure(batches):
        import pandas as pd

        cost, seen = dict.fromkeys(BUILT_ON, 0), Counter()
        for batch in batches:
            for t in batch["t"]:
                counts = Counts(t)
                for name in BUILT_ON:
                    began = time.perf_counter_ns()
                    getattr(counts, name)
                    cost[name] += time.perf_counter_ns() - began
                seen[sum(1 << i for i, rule in enumerate(rules) if rule.rejects(counts))] += 1
        rows = [("", mask, n) for mask, n in seen.items()] + [(name, 0, ns) for name, ns in cost.items()]
        yield pd.DataFrame(rows, columns=["count", "mask", "n"])

    got = few.mapInPandas(measure, "count string, mask long, n long").groupBy("count", "mask").agg(F.sum("n").alias("n")).collect()
    masks = {r["mask"]: r["n"] for r in got if not r["count"]}
    rows = max(1, sum(masks.values()))
    cost = {r["count"]: r["n"] / rows for r in got if r["count"]}
    made: set[str] = set()
    left, out = list(range(len(rules))), []
    while left:
        live = sum(masks.values())

        def gain(i: int) -> tuple[int, float]:
            gone = sum(n for mask, n in masks.items() if mask >> i & 1)
            return gone, sum(cost.get(c, 0.0) for c in _closure(rules[i].needs) - made) + 1.0

        best = max(left, key=lambda i: (gain(i)[0] / gain(i)[1], -gain(i)[1], -i))
        gone, ns = gain(best)
        out.append({"rule": rules[best].name, "rows": live, "rejected": gone, "cost_ns": ns, "score": gone / max(1, live) / ns * 1e9})
        masks = {mask: n for mask, n in masks.items() if not mask >> best & 1}
        made |= _closure(rules[best].needs)
        left.remove(best)
    return out


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", order: list[str] | None = None, stats: bool = False, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``rejected_by`` (name of the rule that rejected first, null if kept), ``n_rules`` (rules run) and ``kept``.

    With ``stats`` also the counts in :data:`STATS`, of every row; the cascade then saves only what other counts cost.  No
    shuffle: one pass over the rows.  ``order`` fixes the order of rules; else it follows measured costs, so that
    ``rejected_by`` and ``n_rules`` can change from run to run where several rules reject, while ``kept`` cannot.  Null text
    has no words and goes by ``few_words``; texts of any length are read whole; equal rows get equal verdicts; no rows give no
    rows; columns of ``docs`` stay, and a new column whose name is taken gets underscores in front (it comes after them).
    """
    text_batches(docs.sparkSession)
    names = order or [x["rule"] for x in plan_cascade(docs, rules, text, sample_rows)]
    by_name = {r.name: r for r in rules}
    cascade = [by_name[n] for n in names]
    added = ("rejected_by string", "n_rules int", *((f"{n} long" for n in STATS) if stats else ()))

    def judge(column):
        import pandas as pd

        out = []
        for t in column:
            counts, by, i = Counts(t), None, 0
            for i, rule in enumerate(cascade, 1):
                if rule.rejects(counts):
                    by = rule.name
                    break
            out.append((by, i, *((getattr(counts, n) for n in STATS) if stats else ())))
        return pd.DataFrame(out, columns=[x.split()[0] for x in added])

    verdict, kind = free_name(docs, "verdict"), ", ".join(added)
    udf = F.pandas_udf(judge, kind)
    out = docs.withColumn(verdict, udf(F.col(text).cast("string")))
    for x in added:
        out = out.withColumn(free_name(docs, x.split()[0]), F.col(f"{verdict}.{x.split()[0]}"))
    return out.withColumn(free_name(docs, "kept"), F.col(f"{verdict}.rejected_by").isNull()).drop(verdict)
