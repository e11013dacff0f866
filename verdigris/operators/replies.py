"""Model replies: which fields are there, and replies that can't be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.stats import numbered
from verdigris.plans.registry import Registry

HEADER = r"\[\[ ## (\w+) ## \]\]"


def chat_fields(reply: Column) -> Column:
    """Names of the field headers that a reply holds, each once, in order."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(reply, F.lit(HEADER), F.lit(1))), F.array().cast("array<string>"))


def json_fields(reply: Column) -> Column:
    """Keys of the outer JSON object of a reply, which may stand in other text; none if there is no object."""
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.coalesce(F.json_object_keys(body), F.array().cast("array<string>"))


def chat_value(reply: Column, field: str) -> Column:
    """What stands under a field's header, up to the next header."""
    return F.nullif(F.trim(F.regexp_extract(reply, rf"(?s)\[\[ ## {field} ## \]\]\s*(.*?)\s*(?:\[\[ ## |\z)", 1)), F.lit(""))


def missing_fields(present: Column, declared: list[str]) -> Column:
    """Declared fields that a reply leaves out; an explicit null is an answer, an absent field is not."""
    return F.array_except(F.array(*(F.lit(d) for d in declared)), present)


def read_replies(replies: DataFrame, registry: Registry, form: str = "chat", reply: str = "reply") -> DataFrame:
    """``replies`` with ``ok``, ``error`` and ``pred`` (a string per task): a reply without every field fails as a whole."""
    ids = [t.id for t in registry]
    present = chat_fields(F.col(reply)) if form == "chat" else json_fields(F.col(reply))
    lost = missing_fields(present, ids)
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    value = (lambda i: chat_value(F.col(reply), i)) if form == "chat" else (lambda i: F.get_json_object(body, f"$.{i}"))
    error = F.when(F.col(reply).isNull(), "no reply").when(F.size(lost) > 0, F.concat(F.lit("missing: "), F.array_join(lost, ", ")))
    return replies.withColumns({"ok": error.isNull(), "error": F.coalesce(error, F.lit("")), "pred": F.when(error.isNull(), F.struct(*(value(i).alias(i) for i in ids)))})


def merge_groups(replies: DataFrame, n_groups: int) -> DataFrame:
    """(doc_id, values MAP, ok) of replies (doc_id, group, values MAP): a document is whole only with all its groups."""
    g = replies.groupBy("doc_id").agg(F.collect_set("group").alias("groups"), F.flatten(F.collect_list(F.map_entries("values"))).alias("entries"))
    return g.select("doc_id", F.map_from_entries("entries").alias("values"), (F.size("groups") == n_groups).alias("ok"))


def batches(pending: DataFrame, size: int = 10_000, key: str = "doc_id") -> DataFrame:
    """Pending requests with a batch number, ``size`` a batch, in order of key; numbers come from counts per range, not from one task."""
    return numbered(pending, F.col(key)).withColumn("batch", F.floor(F.col("at") / size).cast("int")).drop("at")


def feedback(facts: DataFrame, texts: DataFrame, tasks: int = 5, around: int = 200) -> DataFrame:
    """(doc_id, aggregate, feedback): score and a line for up to ``tasks`` failing tasks, with what stands around gold in the text."""
    from verdigris.functions.text import context_window
    from verdigris.operators.facts import example_scores

    wrong = facts.where(~F.col("correct")).join(texts, "doc_id")
    window = context_window(F.col("text"), F.col("gold"), around)
    line = F.concat(F.col("task_id"), F.lit(": expected "), F.coalesce("gold", F.array_join("gold_items", ", "), F.lit("null")), F.lit(", got "), F.coalesce("pred", F.array_join("pred_items", ", "), F.lit("null")), F.coalesce(F.concat(F.lit(" ["), window, F.lit("]")), F.lit("")))
    lines = wrong.groupBy("doc_id").agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda s: s["line"]), 1, tasks), "\n").alias("feedback"))
    return example_scores(facts).select("doc_id", "aggregate").join(lines, "doc_id", "left").withColumn("feedback", F.coalesce("feedback", F.lit("all correct")))
