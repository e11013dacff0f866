"""Metrics over the fact table, at the grains of task and of task and class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions import stats as St
from verdigris.plans.registry import CLASSIFICATION, Registry
from verdigris.sources.commits import scratch

SUPPORT_FLOOR, MEASURABLE_FLOOR = 30, 10
#: Different outcomes of documents that are sent to every task at most.
FEW = 10_000


def _prf(df: DataFrame) -> DataFrame:
    p, r, f = St.precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return df.withColumns({"precision": p, "recall": r}).withColumn("f1", f)


def task_counts(facts: DataFrame, strict: bool = False) -> DataFrame:
    """Summed counts per task, corpus-level precision, recall and F1; ``strict`` takes what strict equality says where there is it."""
    of = lambda n: F.coalesce(F.col(f"strict.{n}"), F.col(n)) if strict else F.col(n)
    return _prf(facts.groupBy("task_id").agg(*(F.sum(of(n)).alias(n) for n in ("tp", "fp", "fn", "tn"))))


def weighted_counts(facts: DataFrame) -> DataFrame:
    """The same weighed by one over the inclusion probability: estimates for the corpus that was drawn from."""
    return _prf(facts.groupBy("task_id").agg(*(F.sum(F.col("ipw") * F.col(n)).alias(n) for n in ("tp", "fp", "fn", "tn"))))


def class_counts(facts: DataFrame, registry: Registry) -> DataFrame:
    """(task_id, label, tp, fp, fn): each class against the rest; declared classes that nobody named have zeros."""
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    both = facts.where(F.col("task_type").isin(*CLASSIFICATION)).select("task_id", F.coalesce("gold_items", one("gold")).alias("g"), F.coalesce("pred_items", one("pred")).alias("p"))
    seen = both.select("task_id", F.explode(F.array_union("g", "p")).alias("label"), "g", "p")
    has = lambda side: F.array_contains(side, F.col("label"))
    n = lambda c: F.count_if(c)
    got = seen.groupBy("task_id", "label").agg(n(has("g") & has("p")).alias("tp"), n(~has("g") & has("p")).alias("fp"), n(has("g") & ~has("p")).alias("fn"))
    declared = registry.labels_frame(facts.sparkSession)
    return declared.join(got, ["task_id", "label"], "full_outer").select("task_id", "label", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))


def class_metrics(facts: DataFrame, registry: Registry, support_floor: int = SUPPORT_FLOOR, measurable_floor: int = MEASURABLE_FLOOR) -> DataFrame:
    c = _prf(class_counts(facts, registry)).withColumn("support", F.col("tp") + F.col("fn"))
    low, high = St.wilson(F.col("tp"), F.col("support"))
    return c.withColumns({"recall_low": low, "recall_high": high, "measurable": F.col("support") >= measurable_floor, "above_floor": F.col("support") >= support_floor, "readable_as": St.readable_at(F.col("support"))})


def confusion(facts: DataFrame) -> DataFrame:
    """(task_id, gold, pred, n) with ``(null)`` for silence; single-label tasks."""
    label = lambda c: F.coalesce(F.col(c), F.lit("(null)")).alias(c)
    return facts.where(F.col("task_type").isin("binary", "multiclass")).groupBy("task_id", label("gold"), label("pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion_table(facts: DataFrame, task_id: str) -> DataFrame:
    """One task's confusion as a table, gold down and predicted across."""
    return confusion(facts).where(F.col("task_id") == task_id).groupBy("gold").pivot("pred").agg(F.sum("n")).fillna(0).orderBy("gold")


def primary_values(facts: DataFrame, registry: Registry, support_floor: int = SUPPORT_FLOOR, measurable_floor: int = MEASURABLE_FLOOR) -> DataFrame:
    """(task_id, primary, basis, n_classes, measurable, exact_match, gold_null_rate, pred_null_rate).

    Binary: F1 of true.  Classes: mean F1 of those with enough support, else of those that appear, else 0.  Others: F1 of the
    summed counts.  A task is measurable if its rarest class, or its positives, reach the floor.
    """
    classes = class_metrics(facts, registry, support_floor, measurable_floor)
    seen = F.col("tp") + F.col("fp") + F.col("fn") > 0
    by = classes.groupBy("task_id").agg(
        F.avg(F.when(F.col("above_floor"), F.col("f1"))).alias("above"), F.avg(F.when(seen, F.col("f1"))).alias("seen"), F.count_if("above_floor").alias("n_above"), F.count_if(seen).alias("n_seen"),
        F.max(F.when(F.col("label") == "true", F.col("f1"))).alias("positive"), F.min("support").alias("rarest"),
    )
    flag = lambda c: F.avg(F.col(c).cast("int"))
    shares = facts.groupBy("task_id", "task_type").agg(flag("correct").alias("exact_match"), flag("gold_null").alias("gold_null_rate"), flag("pred_null").alias("pred_null_rate"))
    t = task_counts(facts).join(shares, "task_id").join(by, "task_id", "left")
    many = F.col("task_type").isin("multiclass", "multilabel")
    return t.select(
        "task_id",
        F.when(F.col("task_type") == "binary", F.coalesce("positive", F.lit(0.0))).when(many, F.coalesce("above", "seen", F.lit(0.0))).otherwise(F.col("f1")).alias("primary"),
        F.when(F.col("task_type") == "binary", "positive class").when(many & (F.col("n_above") > 0), "classes above the floor").when(many & (F.col("n_seen") > 0), "classes that appear").when(many, "no class appears").otherwise("pooled").alias("basis"),
        F.coalesce(F.when(F.col("n_above") > 0, F.col("n_above")).otherwise(F.col("n_seen")), F.lit(0)).alias("n_classes"),
        (F.coalesce("rarest", F.col("tp") + F.col("fn")) >= measurable_floor).alias("measurable"), "exact_match", "gold_null_rate", "pred_null_rate",
    )


def answer_rates(facts: DataFrame, registry: Registry) -> DataFrame:
    """(task_id, counts, support, precision, precision_low, precision_high, recall, recall_low, recall_high, f1): how often an answer is right, and how much is found.

    A binary task is counted on its answers ``true``, others on all answers; intervals are Wilson's.
    """
    yes = class_counts(facts, registry).where("label = 'true'").join(facts.where("task_type = 'binary'").select("task_id").distinct(), "task_id", "left_semi")
    rest = facts.where("task_type <> 'binary'").groupBy("task_id").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    c = yes.select("task_id", F.lit("true").alias("counts"), "tp", "fp", "fn").unionByName(rest.select("task_id", F.lit("all answers").alias("counts"), "tp", "fp", "fn"))
    support = F.col("tp") + F.col("fn")
    ends = dict(zip(("precision_low", "precision_high", "recall_low", "recall_high"), (*St.wilson(F.col("tp"), F.col("tp") + F.col("fp")), *St.wilson(F.col("tp"), support)), strict=True))
    return _prf(c).withColumns(ends).select("task_id", "counts", support.alias("support"), "precision", "precision_low", "precision_high", "recall", "recall_low", "recall_high", "f1")


def primary_map(primary: DataFrame) -> DataFrame:
    """All tasks' headline numbers as one map."""
    return primary.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("task_id", "primary")))).alias("per_task"))


def task_primary_interval(facts: DataFrame, registry: Registry, resamples: int = 1000, seed: int = 0, support_floor: int = SUPPORT_FLOOR) -> DataFrame:
    """(task_id, low, high): percentile interval of each headline number over resampled documents.

    Documents are drawn by hash as in :func:`stats.bootstrap_interval`.  Those with the same outcomes are one: the first of
    them stands for all, draws carry how often it was taken, and every replicate's counts are sums weighed by that.
    """
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    f = facts.select("doc_id", "task_id", "task_type", "tp", "fp", "fn", F.coalesce("gold_items", one("gold")).alias("g"), F.coalesce("pred_items", one("pred")).alias("p"))
    # of other tasks the counts alone matter
    side = lambda c: F.when(F.col("task_type").isin(*CLASSIFICATION), F.col(c)).alias(c)
    held = f.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("task_id", "task_type", "tp", "fp", "fn", side("g"), side("p")))).alias("outcomes"))
    # a null document can be drawn and has no outcomes
    same = held.select("doc_id", F.filter("outcomes", lambda _: F.col("doc_id").isNotNull()).alias("outcomes"))
    docs = St.numbered(same, F.col("doc_id")).withColumnRenamed("at", "i")
    path = scratch(facts.sparkSession, "outcomes")
    docs.groupBy("outcomes").agg(F.min_by(F.struct("i", "doc_id"), "i").alias("first")).write.parquet(path)
    first = facts.sparkSession.read.parquet(path)
    few = first.count() <= FEW
    values = docs.join(F.broadcast(first) if few else first, "outcomes").select("i", F.col("first.i").alias("v"))
    counted = St.drawn(values, resamples, docs.count(), seed).groupBy("r", "v").agg(F.sum("times").alias("w"))
    drawn = counted.join(first.select(F.col("first.i").alias("v"), "first.doc_id"), "v").select("r", "doc_id", "w")
    f = f.join(first.select("first.doc_id"), "doc_id", "left_semi")
    pooled = _prf(f.where(~F.col("task_type").isin(*CLASSIFICATION)).join(drawn, "doc_id").groupBy("r", "task_id").agg(*(F.sum(F.col("w") * F.col(c)).alias(c) for c in ("tp", "fp", "fn")))).select("r", "task_id", F.col("f1").alias("primary"))
    c = f.where(F.col("task_type").isin(*CLASSIFICATION)).select("doc_id", "task_id", "task_type", F.explode(F.array_union("g", "p")).alias("label"), "g", "p").join(drawn, "doc_id")
    has = lambda side: F.array_contains(side, F.col("label"))
    s = lambda cond: F.sum(F.when(cond, F.col("w")).otherwise(0))
    by = _prf(c.groupBy("r", "task_id", "task_type", "label").agg(s(has("g") & has("p")).alias("tp"), s(~has("g") & has("p")).alias("fp"), s(has("g") & ~has("p")).alias("fn")))
    macro = by.groupBy("r", "task_id", "task_type").agg(F.avg(F.when(F.col("tp") + F.col("fn") >= support_floor, F.col("f1"))).alias("above"), F.avg("f1").alias("seen"), F.max(F.when(F.col("label") == "true", F.col("f1"))).alias("positive"))
    classes = macro.select("r", "task_id", F.when(F.col("task_type") == "binary", F.coalesce("positive", F.lit(0.0))).otherwise(F.coalesce("above", "seen", F.lit(0.0))).alias("primary"))
    ends = pooled.unionByName(classes).groupBy("task_id").agg(F.percentile("primary", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    return ends.select("task_id", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))
