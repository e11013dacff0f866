"""Replies of any shape: JSON kept as VARIANT, values taken out by the types that the tasks declare, failures beside them.

What a model answers need not have the declared type.  A task's value is cast if it can be, from the shapes that are usual
for its type; else it is null and the reply's ``problems`` name the task, so nothing is lost and nothing is guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.plans.registry import BadDeclaration, Registry, Task

_QUANTITY, _SPAN = "struct<value:double,unit:string>", "struct<start:int,stop:int,text:string>"


def sql_type(task: Task) -> str:
    """The type of a task's value."""
    by_type = {"binary": "boolean", "multilabel": "array<string>", "extract_list": "array<string>", "extract_numeric": _QUANTITY, "span": _SPAN}
    return by_type.get(task.type, "string")


def _path(name: str) -> str:
    """A field's path: names may hold either kind of quotes, not both."""
    if "'" in name and '"' in name:
        raise BadDeclaration(f"a task id can't have both kinds of quotes: {name}")
    return f'$["{name}"]' if "'" in name else f"$['{name}']"


def value_of(variant: Column, task: Task) -> Column:
    """A task's value from a VARIANT object: null if it is absent, null, or of a shape that the type doesn't have.

    A single text is a list of one; a bare number is a quantity without a unit; a text is a quotation of a span.  Truth values
    are those of JSON, or the texts true and false; other texts are problems.
    """
    path = _path(task.id)
    got = lambda at, kind: F.try_variant_get(variant, at, kind)
    shape = F.upper(F.regexp_extract(F.schema_of_variant(F.coalesce(got(path, "variant"), F.parse_json(F.lit("null")))), r"^([A-Za-z]+)", 1))
    is_text, is_list, is_object = shape == "STRING", shape == "ARRAY", shape == "OBJECT"
    is_number = shape.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")
    if task.type == "binary":
        text = F.lower(F.trim(got(path, "string")))
        return F.when(shape == "BOOLEAN", got(path, "boolean")).when(is_text & text.isin("true", "false"), text == "true")
    if task.type in ("multilabel", "extract_list"):
        return F.when(is_list, got(path, "array<string>")).when(is_text, F.array(got(path, "string")))
    if task.type == "extract_numeric":
        whole = F.struct(got(f"{path}.value", "double").alias("value"), got(f"{path}.unit", "string").alias("unit"))
        bare = F.struct(got(path, "double").alias("value"), F.lit(None).cast("string").alias("unit"))
        number = got(path, "double")
        return F.when(is_object & whole["value"].isNotNull(), whole).when(is_number | (is_text & number.isNotNull()), bare)
    if task.type == "span":
        none = F.lit(None).cast("int")
        whole = F.struct(got(f"{path}.start", "int").alias("start"), got(f"{path}.stop", "int").alias("stop"), got(f"{path}.text", "string").alias("text"))
        quoted = F.struct(none.alias("start"), none.alias("stop"), got(path, "string").alias("text"))
        return F.when(is_object & (whole["text"].isNotNull() | (whole["start"].isNotNull() & whole["stop"].isNotNull())), whole).when(is_text, quoted)
    return F.when(~is_list & ~is_object, got(path, "string"))


def typed(rows: DataFrame, registry: Registry, variant: str = "predicted") -> DataFrame:
    """``rows`` with ``values``, a struct of the tasks' types, and ``problems``, a text for each answer that has another shape.

    A null variant, as failed replies have, gives a struct of nulls and no problems.
    """
    v = F.col(variant)
    values = {t.id: value_of(v, t) for t in registry}
    given = {t.id: F.try_variant_get(v, _path(t.id), "variant") for t in registry}
    wrong = [F.when(given[i].isNotNull() & ~F.is_variant_null(given[i]) & value.isNull(), F.concat(F.lit(f"{i}: no {sql_type(registry[i])} in "), F.substring(F.to_json(given[i]), 1, 100))) for i, value in values.items()]
    return rows.withColumns({"values": F.struct(*(value.alias(i) for i, value in values.items())), "problems": F.filter(F.array(*wrong), lambda x: x.isNotNull())})


def prediction_lines(outcomes: DataFrame) -> DataFrame:
    """``outcomes`` (doc_id, ok, error, predicted VARIANT) with ``value``: one JSON text each, with ``predicted`` as it is or ``failed``."""
    failed = F.when(~F.col("ok"), F.struct("error"))
    return outcomes.withColumn("value", F.to_json(F.struct("doc_id", F.when(F.col("ok"), F.col("predicted")).alias("predicted"), failed.alias("failed"))))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ok, error, predicted VARIANT, line) of JSON lines; a line that is no JSON object is a failed row that keeps its text."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    v = F.try_parse_json("value")
    rows = lines.select(F.col("value").alias("line"), v.alias("v"))
    error = F.when(F.col("v").isNull(), "no JSON").otherwise(F.try_variant_get("v", "$.failed.error", "string"))
    predicted = F.when(error.isNull(), F.try_variant_get("v", "$.predicted", "variant"))
    return rows.select(F.try_variant_get("v", "$.doc_id", "string").alias("doc_id"), error.isNull().alias("ok"), error.alias("error"), predicted.alias("predicted"), "line")
