"""The fact table: one row per document and task with counted outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.plans.registry import CLASSIFICATION, Registry


def best_guess(o: Column) -> Column:
    """Silence charged as a wrong answer: a pure miss is an invention too."""
    return F.when((o["fn"] > 0) & (o["tp"] == 0) & (o["fp"] == 0), o["fn"]).otherwise(o["fp"])


def match_results(pairs: DataFrame, registry: Registry, doc_id: str = "doc_id", gold: str = "gold", pred: str = "pred", policy: str = "scored", excluded: dict[str, list[str]] | None = None, ipw: Column | None = None, failed: Column | None = None) -> DataFrame:
    """Facts from rows with ``gold`` and ``pred`` structs, a field per task.

    One scan: each task is a struct of expressions, and the structs are exploded; there is no join and no union per task.  A
    failed reply is a wrong answer to every task.  ``excluded`` lists gold classes that don't enter a document's score.
    """
    out = []
    for position, t in enumerate(registry):
        o = t.match(F.col(f"{gold}.{t.id}"), F.col(f"{pred}.{t.id}"))
        weighed = F.struct(F.lit(t.id).alias("task_id"), F.lit(t.type).alias("task_type"), F.lit(position).alias("position"), F.lit(t.weight).alias("weight"), o.alias("o"))
        out.append(weighed)
    facts = pairs.select(F.col(doc_id).cast("string").alias("doc_id"), (ipw if ipw is not None else F.lit(1.0)).alias("ipw"), (failed if failed is not None else F.lit(False)).alias("failed"), F.explode(F.array(*out)).alias("f"))
    facts = facts.select("doc_id", "f.task_id", "f.task_type", "f.position", "f.weight", "ipw", "failed", "f.o.*")
    wrong = F.col("failed")
    fn = F.when(wrong, F.when(F.col("gold_null"), 0).otherwise(F.greatest(F.col("tp") + F.col("fn"), F.lit(1)))).otherwise(F.col("fn"))
    charged = F.when(wrong, F.greatest(F.col("fp"), F.lit(1))).otherwise(best_guess({n: F.col(n) for n in ("tp", "fp", "fn")}) if policy == "best_guess" else F.col("fp"))
    facts = facts.withColumns({"fp": charged.cast("long"), "fn": fn.cast("long"), "tp": F.when(wrong, 0).otherwise(F.col("tp")).cast("long"), "tn": F.when(wrong, 0).otherwise(F.col("tn")).cast("long"), "correct": F.when(wrong, False).otherwise(F.col("correct"))})
    facts = facts.withColumn("excluded", _excluded(excluded or {}))
    return facts


def _excluded(classes: dict[str, list[str]]) -> Column:
    out = F.lit(False)
    for task, labels in classes.items():
        below = F.array(*(F.lit(x) for x in labels))
        of_set = (F.size("gold_items") > 0) & (F.size(F.array_except("gold_items", below)) == 0)
        out = F.when(F.col("task_id") == task, F.when(F.col("gold_items").isNotNull(), of_set).otherwise(F.coalesce(F.col("gold").isin(*labels), F.lit(False)))).otherwise(out)
    return out


def example_scores(facts: DataFrame) -> DataFrame:
    """(doc_id, aggregate, all_correct, excluded): the weighted share of correct tasks, without excluded ones; 1 if none is left."""
    counts = ~F.col("excluded")
    weight = F.sum(F.when(counts, F.col("weight")))
    return facts.groupBy("doc_id").agg(
        F.coalesce(F.try_divide(F.sum(F.when(counts & F.col("correct"), F.col("weight")).otherwise(0.0)), weight), F.lit(1.0)).alias("aggregate"),
        F.bool_and("correct").alias("all_correct"),
        F.array_sort(F.collect_set(F.when(F.col("excluded"), F.col("task_id")))).alias("excluded"),
    )


def unmatched(gold: DataFrame, pred: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, side): documents that only one side has; scoring needs none."""
    g, p = gold.select(doc_id).distinct(), pred.select(doc_id).distinct()
    return g.join(p, doc_id, "left_anti").withColumn("side", F.lit("gold")).unionByName(p.join(g, doc_id, "left_anti").withColumn("side", F.lit("pred")))


def labels_of(kind: str, c: Column) -> Column:
    """The classes a value carries."""
    if kind == "multilabel":
        return F.coalesce(F.filter(c, lambda x: x.isNotNull()), F.array().cast("array<string>"))
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c.cast("string")))


def long_labels(rows: DataFrame, registry: Registry, values: str, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, task_id, label) of every class that a document's values carry; classification tasks alone."""

    def named(task_id: str, labels: Column) -> Column:
        return F.transform(labels, lambda x: F.struct(F.lit(task_id).alias("task_id"), x.alias("label")))

    none = F.array().cast("array<struct<task_id:string,label:string>>")
    parts = [named(t.id, labels_of(t.type, F.col(f"{values}.{t.id}"))) for t in registry if t.type in CLASSIFICATION]
    return rows.select(F.col(doc_id).cast("string").alias("doc_id"), F.explode(F.concat(none, *parts)).alias("l")).select("doc_id", "l.task_id", "l.label")


