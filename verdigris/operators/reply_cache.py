"""Replies of a model, kept by prompt, model and attempt in a table that all executors share.

A prompt that was asked before is answered from the table by a join; what is left is asked once for each distinct prompt, by
the tasks that hold them, and committed before it is used.  A further attempt passes the table by and adds a row of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators.program import Ask
from verdigris.sources.commits import Tables

KEPT = {"replies": "key string, attempt int, reply string, error string"}
#: Prompts that are asked at a time.
BATCH = 64


def cache_tables(spark: SparkSession, root: str) -> Tables:
    return Tables(spark, root, KEPT)


def _asked(new: DataFrame, ask: Ask, attempt: int, batch: int) -> DataFrame:
    def run(batches):
        import pandas as pd

        for frame in batches:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch]
                try:
                    said = list(ask(list(part["prompt"]), attempt))
                except Exception as e:  # a fault of the model is an outcome of these prompts
                    said = [e] * len(part)
                rows = [(key, attempt, r if isinstance(r, str) else None, "" if isinstance(r, str) else f"{r or 'no reply'}"[:300]) for key, r in zip(part["key"], said, strict=True)]
                yield pd.DataFrame(rows, columns=["key", "attempt", "reply", "error"])

    return new.select("key", "prompt").mapInPandas(run, KEPT["replies"])


def ask_kept(prompts: DataFrame, root: str, model: str, ask: Ask, attempt: int = 1, batch: int = BATCH) -> DataFrame:
    """``prompts`` (prompt and other columns) with ``reply``, ``error`` and ``hit``, whether it was known before.

    The first attempt takes any good reply that the table under ``root`` has for the same prompt and model, the latest attempt
    first; a further one asks afresh unless this very attempt is there.  Failed replies are kept with their error but never
    hit.  A null prompt is asked as the empty one.  Two runs that ask for the same prompt at the same time both pay; the later
    commit counts.
    """
    spark = prompts.sparkSession
    tables = cache_tables(spark, root)
    key = F.sha2(F.concat_ws("\0", F.lit(model), F.coalesce("prompt", F.lit(""))), 256)
    keyed = prompts.withColumn("key", key)

    def known() -> DataFrame:
        rows = tables.read("replies", with_commit=True).where("reply IS NOT NULL")
        rows = rows.where(F.col("attempt") == attempt) if attempt > 1 else rows
        return rows.groupBy("key").agg(F.max_by("reply", F.struct("attempt", "commit_number")).alias("reply"))

    held = known()
    new = keyed.select("key", F.coalesce("prompt", F.lit("")).alias("prompt")).join(held.select("key"), "key", "left_anti").dropDuplicates(["key"])
    staged = tables.stage()
    fresh = staged.write("replies", _asked(new, ask, attempt, batch))
    if not fresh.isEmpty():
        staged.commit()
    old = held.select("key", "reply", F.lit("").alias("error"), F.lit(True).alias("hit")).join(fresh.select("key"), "key", "left_anti")
    both = old.unionByName(fresh.select("key", "reply", "error", F.lit(False).alias("hit")))
    return keyed.join(both, "key").drop("key")
