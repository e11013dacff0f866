"""Quality gates on a full run, routing to review, close calls, and how a holdout reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.stats import numbered
from verdigris.operators.facts import labels_of, long_labels
from verdigris.operators.sampling import hash_rank
from verdigris.plans.registry import THRESHOLDED, Registry

CLASS_SHIFT, NULL_RISE, LOW_CONFIDENCE = 0.15, 0.15, 0.10
FAILURE_CEILING, SPOT_CHECK = 0.005, 50
MARGIN, NUMERIC_BAND = 0.05, (0.5, 2.0)
LARGE_GAP, WIDESPREAD = 0.10, 0.5
NEAR_ZERO = 0.05


class GateRefused(RuntimeError):
    """A gate that does not let a step go on; the message says why."""


def _check(df: DataFrame, name: str, passed, detail) -> DataFrame:
    return df.select(F.lit(name).alias("name"), passed.alias("passed"), detail.alias("detail"))


def class_shares(rows: DataFrame, registry: Registry, values: str) -> DataFrame:
    """(task_id, label, share): label counts over rows; several labels a row can sum to more than one."""
    total = F.broadcast(rows.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("total")))
    counts = long_labels(rows, registry, values).groupBy("task_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(total).select("task_id", "label", (F.col("n") / F.col("total")).alias("share"))


def null_rates(rows: DataFrame, registry: Registry, values: str, raw: bool = False) -> DataFrame:
    """(task_id, rate): share of rows without an answer; null words count as none unless ``raw``."""
    from verdigris.functions.text import is_null_word

    def silent(t):
        c = F.col(f"{values}.{t.id}")
        if t.type in ("multilabel", "extract_list"):
            return c.isNull() | (F.size(c) == 0)
        if raw or t.type == "span":
            return c.isNull()
        return is_null_word(c.cast("string"))

    each = F.explode(F.array(*(F.struct(F.lit(t.id).alias("task_id"), silent(t).cast("int").alias("n")) for t in registry))).alias("x")
    return rows.select(each).groupBy("x.task_id").agg(F.avg("x.n").alias("rate"))


def class_shifts(produced: DataFrame, reference: DataFrame, limit: float = CLASS_SHIFT) -> DataFrame:
    """(task_id, label, delta): shares that moved by more than ``limit``, of labels on either side; tasks are those produced."""
    both = produced.join(reference.withColumnRenamed("share", "was"), ["task_id", "label"], "full_outer")
    both = both.join(produced.select("task_id").distinct(), "task_id", "left_semi")
    return both.select("task_id", "label", (F.coalesce("share", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))).alias("delta")).where(F.abs("delta") > limit)


def run_gates(outcomes: DataFrame, registry: Registry, expected: int, reference: DataFrame | None = None, reference_rates: DataFrame | None = None, values: str = "values", reference_values: str = "values", ceiling: float = FAILURE_CEILING, spot_check: int = SPOT_CHECK) -> DataFrame:
    """(name, passed, detail) of each gate over outcomes (doc_id, ok, values)."""
    tally = outcomes.agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("good"))
    rate = F.when(F.col("n") > 0, 1 - F.col("good") / F.col("n")).otherwise(1.0)
    out = _check(tally, "coverage", F.col("n") == expected, F.concat(F.col("n"), F.lit(f" outputs for {expected} documents")))
    out = out.unionByName(_check(tally, "schema", rate <= ceiling, F.concat(F.col("n") - F.col("good"), F.lit(" failures, "), F.format_number(100 * rate, 2), F.lit(f"% against a ceiling of {100 * ceiling:.2f}%"))))
    good = outcomes.where("ok")
    listed = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ", ")
    if reference is not None:
        moved = class_shifts(class_shares(good, registry, values), class_shares(reference, registry, reference_values)).agg(F.count(F.lit(1)).alias("n"), listed(F.concat_ws("/", "task_id", "label")).alias("which"))
        out = out.unionByName(_check(moved, "class distribution", F.col("n") == 0, F.when(F.col("n") == 0, "no class share moved").otherwise(F.concat(F.lit("shifted: "), F.col("which")))))
    if reference_rates is not None:
        risen = null_rates(good, registry, values).join(reference_rates.select("task_id", F.col("rate").alias("was")), "task_id").where(F.col("rate") - F.col("was") > NULL_RISE)
        known = reference_rates.agg(F.count(F.lit(1)).alias("known"))
        r = risen.agg(F.count(F.lit(1)).alias("n"), listed(F.col("task_id")).alias("which")).join(F.broadcast(known))
        out = out.unionByName(_check(r, "null rates", (F.col("known") > 0) & (F.col("n") == 0), F.when(F.col("known") == 0, "the reference has no rates, so this can't be checked").when(F.col("n") == 0, "as in validation").otherwise(F.concat(F.lit("risen: "), F.col("which")))))
    return out.unionByName(_check(tally, "manual spot-check", F.lit(True), F.concat(F.least(F.lit(spot_check), F.col("good")), F.lit(" random documents to look at"))))


def triage(outcomes: DataFrame, registry: Registry, manifest: DataFrame | None = None, values: str = "values", seed: int = 0, spot_check: int = SPOT_CHECK) -> DataFrame:
    """(route, doc_id) of outcomes (doc_id, ok, values); a document may take several routes.

    ``manifest`` has doc_id, transcribed_pages, unread_pages, truncated.  The random slice is unbiased; the other routes pick
    what is already suspect.
    """
    ids = outcomes.select("doc_id", "ok", values).withColumn("doc_id", F.col("doc_id").cast("string"))
    good = ids.where("ok")
    route = lambda df, name: df.select(F.lit(name).alias("route"), "doc_id")
    out = route(ids.where(~F.col("ok")), "failed")
    if manifest is not None:
        m = manifest.withColumn("doc_id", F.col("doc_id").cast("string")).join(ids, "doc_id", "left_semi")
        out = out.unionByName(route(m.where((F.coalesce("transcribed_pages", F.lit(0)) > 0) | (F.coalesce("unread_pages", F.lit(0)) > 0)), "transcribed_or_unread")).unionByName(route(m.where("truncated"), "truncated"))
    usual = F.broadcast(null_rates(good, registry, values, raw=True).where("rate < 0.5").agg(F.collect_set("task_id").alias("usual")))
    silent = F.filter(F.array(*(F.when(F.size(labels_of("multilabel" if t.type in ("multilabel", "extract_list") else t.type, F.col(f"{values}.{t.id}"))) == 0, F.lit(t.id)) for t in registry)), lambda x: x.isNotNull())
    n = good.select("doc_id", silent.alias("silent")).join(usual)
    out = out.unionByName(route(n.where(F.arrays_overlap("silent", "usual")), "nulls_on_answered_tasks"))
    # the least answered tenth, one at least
    low = n.select("doc_id", F.size("silent").alias("k")).where("k > 0")
    total = good.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * LOW_CONFIDENCE)).alias("take"))
    out = out.unionByName(route(numbered(low, F.desc("k"), F.col("doc_id")).join(F.broadcast(total)).where("at < take"), "low_confidence"))
    return out.unionByName(route(good.orderBy(hash_rank(F.col("doc_id"), seed, "slice"), "doc_id").limit(spot_check), "random_slice")).distinct()


def adjudicate(facts: DataFrame) -> DataFrame:
    """(doc_id, task_id, reason, correct, ...): decisions a threshold made narrowly, and the other errors as ``error``."""
    fuzzy = (F.col("task_type") == "extract_fuzzy") & F.col("strict").isNotNull() & (F.col("strict.correct") != F.col("correct"))
    listed = (F.col("task_type") == "extract_list") & F.col("correct") & (F.array_sort("gold_items") != F.array_sort("pred_items"))
    number = F.col("task_type") == "extract_numeric"
    near = F.abs(F.col("measure") - F.col("threshold")) <= MARGIN
    reason = (
        F.when(~F.col("task_type").isin(*THRESHOLDED), None)
        .when(fuzzy | listed, "theta overruled strict equality")
        .when(number & (F.col("note") == "units differ"), "units differ")
        .when(F.col("task_type") == "extract_date", F.col("note"))
        .when(F.col("measure").isNull() | F.col("threshold").isNull(), None)
        .when(number, F.when(F.col("measure").between(*NUMERIC_BAND), "delta is near the tolerance"))
        .when(near, "near the threshold")
    )
    out = facts.withColumn("reason", F.coalesce(reason, F.when(~F.col("correct"), "error"))).where("reason is not null")
    return out.select("doc_id", "task_id", "reason", "correct", "gold", "pred", "gold_items", "pred_items", "measure", "threshold")


def holdout_gaps(validation: DataFrame, holdout: DataFrame) -> DataFrame:
    """(task_id, validation, holdout, gap, within_ci, is_large) from (task_id, value) and (task_id, value, low, high)."""
    j = holdout.select("task_id", F.col("value").alias("holdout"), "low", "high").join(validation.select("task_id", F.col("value").alias("validation")), "task_id", "left").withColumn("validation", F.coalesce("validation", F.lit(0.0)))
    inside = F.col("validation").between(F.col("low"), F.col("high"))
    gap = F.col("validation") - F.col("holdout")
    return j.select("task_id", "validation", "holdout", gap.alias("gap"), inside.alias("within_ci"), (~inside & (gap > LARGE_GAP)).alias("is_large"))


def read_gaps(gaps: DataFrame) -> DataFrame:
    """One row: how the gaps read together."""
    t = gaps.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_large").alias("large"), F.coalesce(F.bool_and("within_ci"), F.lit(True)).alias("inside"))
    return t.select(F.when(F.col("large") == 0, F.when(F.col("inside"), "within_ci").otherwise("modest")).when(F.col("large") / F.col("n") > WIDESPREAD, "large_widespread").otherwise("large_few").alias("verdict"))


def upstream_problems(runs: DataFrame, limit: float = NEAR_ZERO) -> DataFrame:
    """Tasks (task_id, best) that no run (run, task_id, value) lifts off zero: the fault is before the model."""
    return runs.groupBy("task_id").agg(F.max("value").alias("best")).where(F.col("best") <= limit)


def best_run(runs: DataFrame) -> DataFrame:
    """The run (run, aggregate) with the best number, the first of equals."""
    return runs.orderBy(F.desc("aggregate"), "run").limit(1)


def failure_share(outcomes: DataFrame, ceiling: float = 0.0) -> DataFrame:
    """(share, refused): the share of failed outcomes, and whether it is over the ceiling."""
    share = outcomes.agg(F.coalesce(F.avg((~F.col("ok")).cast("int")), F.lit(0.0)).alias("share"))
    return share.withColumn("refused", F.col("share") > ceiling)


def failure_gate(outcomes: DataFrame, ceiling: float = 0.0) -> float:
    """The share of failed outcomes; over the ceiling the step is refused."""
    share, refused = failure_share(outcomes, ceiling).first()
    if refused:
        raise GateRefused(f"{share:.2%} of replies could not be read; at most {ceiling:.2%} may fail")
    return share


def by_task(decisions: DataFrame) -> DataFrame:
    """(task_id, reason, n, first_doc, docs) of what :func:`adjudicate` lists: a row per task and reason with its documents' first 50."""
    first = decisions.groupBy("task_id", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
    rank = F.row_number().over(Window.partitionBy("task_id", "reason").orderBy("doc_id"))
    few = decisions.withColumn("at", rank).where("at <= 50").groupBy("task_id", "reason").agg(F.array_sort(F.collect_list("doc_id")).alias("docs"))
    return first.join(few, ["task_id", "reason"])


def priced(entries: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """``entries`` with the columns of ``prices`` for their model: by its name, else by its name without the provider in front."""
    columns = [c for c in prices.columns if c != "model"]
    named = lambda i: F.broadcast(prices.select(F.col("model").alias(f"_name{i}"), *(F.col(c).alias(f"_{c}{i}") for c in columns)))
    out = entries.join(named(0), F.col(model) == F.col("_name0"), "left")
    out = out.join(named(1), F.substring_index(F.col(model), "/", -1) == F.col("_name1"), "left")
    return out.select(*entries.columns, *(F.coalesce(f"_{c}0", f"_{c}1").alias(c) for c in columns))


def spend_totals(entries: DataFrame, prices: DataFrame, batch_factor: float = 0.5) -> DataFrame:
    """(model, input_tokens, output_tokens, usd, priced) from entries (model, route, input_tokens, output_tokens).

    A model's price (model, input_per_million, output_per_million) is found by its name, else by its name without the
    provider in front; an unpriced model has tokens and no dollars.
    """
    e = priced(entries, prices)
    usd = (F.col("input_tokens") * F.col("input_per_million") + F.col("output_tokens") * F.col("output_per_million")) / 1e6
    usd = usd * F.when(F.col("route") == "batch", batch_factor).otherwise(1.0)
    return e.withColumn("usd", usd).groupBy("model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("usd").alias("usd"), F.bool_and(F.col("usd").isNotNull()).alias("priced"))


