"""Files in and out, with explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.plans.registry import Registry

LABELS = "doc_id string, stratum string, inclusion_probability double, labeling_mode string, notes string, labels map<string,string>"
PREDICTIONS = "doc_id string, predicted map<string,string>, failed struct<error:string,attempts:int>"
SPEND = "at string, label string, model string, route string, input_tokens bigint, output_tokens bigint, usd double"
LEDGER = ("date", "project", "version", "n_documents", "n_tasks", "k_labeled", "baseline_holdout", "compiled_holdout", "labeling_hours", "cost_usd", "notes")


#: Problems that a message names.
SHOWN = 50


class BadData(ValueError):
    """Stored rows that can't be used; the message lists what is wrong."""


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by schema, with ``_bad`` for lines that are no JSON of that shape."""
    return spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label records; broken lines, missing or repeated ids, missing labels and an empty file are errors.

    Problems are found in one go over all records; a message names the first :data:`SHOWN` and says how many more there are.
    """
    rows = read_json(spark, path, LABELS)
    wrong = rows.select(F.when(F.col("_bad").isNotNull(), F.concat(F.lit("no JSON: "), F.substring("_bad", 1, 60))).when(F.col("doc_id").isNull(), "a record has no doc_id").when(F.col("labels").isNull(), F.concat("doc_id", F.lit(" has no labels"))).alias("p")).where("p is not null")
    twice = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.concat("doc_id", F.lit(" repeats")).alias("p"))
    found = wrong.union(twice)
    problems = sorted(r["p"] for r in found.orderBy("p").limit(SHOWN).collect())
    if len(problems) == SHOWN and (more := found.count() - SHOWN):
        problems.append(f"and {more} more")
    if not problems and rows.isEmpty():
        problems = ["the file has no records"]
    if problems:
        raise BadData("; ".join(problems))
    return rows.drop("_bad").withColumn("inclusion_probability", F.coalesce("inclusion_probability", F.lit(1.0)))


def write_labels(labels: DataFrame, path: str) -> None:
    labels.write.mode("overwrite").json(path)


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, predicted, failed): a failed row is a failed reply to every task."""
    return spark.read.schema(PREDICTIONS).json(path)


def predictions_json(outcomes: DataFrame, values: str = "predicted") -> DataFrame:
    """One JSON text per outcome (doc_id, ok, error, values); sets are sorted."""
    return outcomes.select(F.to_json(F.struct("doc_id", F.when(F.col("ok"), F.col(values)).alias("predicted"), F.when(~F.col("ok"), F.struct("error")).alias("failed"))).alias("value"))


def outputs_json(outcomes: DataFrame, values: str = "values") -> DataFrame:
    """One JSON text per document, failures too."""
    return outcomes.select(F.when(F.col("ok"), F.to_json(F.struct("doc_id", "ok", values))).otherwise(F.to_json(F.struct("doc_id", "ok", "error"))).alias("value"))


def read_sheet(spark: SparkSession, path: str, registry: Registry) -> DataFrame:
    """(doc_id, notes, a STRING column per task) of a sheet, CSV or XLSX, keyed by file_name or doc_id.

    Missing task columns are an error; a workbook is a sample that a person filled in, so the driver reads it.
    """
    if path.lower().endswith(".xlsx"):
        from verdigris.sources.xlsx import read_xlsx

        head, rows = read_xlsx(path)
        if not head:
            raise BadData("the workbook has no rows")
        raw = spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in head))
    else:
        raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    names = {c.lstrip("﻿").strip(): c for c in raw.columns}
    key = next((k for k in ("file_name", "doc_id") if k in names), None)
    if key is None:
        raise BadData("a sheet needs a file_name or a doc_id column")
    if missing := [t.id for t in registry if t.id not in names]:
        raise BadData(f"the sheet has no columns for {missing}")
    from verdigris.functions.text import doc_id_of

    notes = F.col(f"`{names['notes']}`") if "notes" in names else F.lit("")
    return raw.select(doc_id_of(F.col(f"`{names[key]}`")).alias("doc_id"), F.coalesce(notes, F.lit("")).alias("notes"), *(F.coalesce(F.col(f"`{names[t.id]}`"), F.lit("")).alias(t.id) for t in registry)).where("coalesce(doc_id, '') <> ''")


def last_rows(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Of each key the row with the largest ``at``."""
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(at)).alias("_last"))
    return best.select(key, "_last.*").select(*rows.columns)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest's rows, of each id the one that was written last: by the file's time, then by the place in the file."""
    rows = spark.read.option("header", True).csv(path)
    placed = rows.withColumn("_at", F.struct(F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_name").alias("f"), F.monotonically_increasing_id().alias("n")))
    return last_rows(placed, "doc_id", "_at").drop("_at")


def append_ledger(rows: DataFrame, path: str) -> None:
    """Rows appended as CSV; columns the ledger doesn't know are refused."""
    if unknown := set(rows.columns) - set(LEDGER):
        raise BadData(f"the ledger has no columns {sorted(unknown)}")
    rows.select(*(F.col(c) if c in rows.columns else F.lit("").alias(c) for c in LEDGER)).write.mode("append").option("header", True).csv(path)


def load_spend(spark: SparkSession, path: str) -> DataFrame:
    """Spend entries of JSON lines; broken lines are an error."""
    rows = read_json(spark, path, SPEND)
    if bad := rows.where("_bad is not null").limit(SHOWN).collect():
        raise BadData("; ".join(f"no JSON: {r['_bad'][:60]}" for r in bad))
    return rows.drop("_bad")
