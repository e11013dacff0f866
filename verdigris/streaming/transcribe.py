"""Transcription of page images by a pluggable function; what was read once is not read again."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A transcriber maps a page's image to (text, whole): ``whole`` is false if the text was cut off.
Transcriber = Callable[[bytes], tuple[str, bool]]
CACHE = "key string, text string, status string"
TRANSCRIPTS = "doc_id string, page int, key string, text string, status string, error string"


def cache_key(image, version: str, model: str):
    """A page is known by its image, the prompt's version and the model."""
    return F.sha2(F.concat_ws("|", F.sha2(image, 256), F.lit(version), F.lit(model)), 256)


def transcribe(pages: DataFrame, transcriber: Transcriber, path: str, version: str = "1", model: str = "", retries: int = 4) -> DataFrame:
    """(doc_id, page, text, status) of pages (doc_id, page, image): ``complete``, ``truncated`` or ``failed``.

    Texts are kept under ``path`` by :func:`cache_key`; equal images are read once, failures are tried again next time.
    """
    spark = pages.sparkSession
    probe = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = probe.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(probe)
    keyed = pages.withColumn("key", cache_key(F.col("image"), version, model))
    todo = keyed.dropDuplicates(["key"])
    if there:
        todo = todo.join(spark.read.schema(CACHE).parquet(path).select("key"), "key", "left_anti")

    def run(batches: Iterable):
        import pandas as pd

        for batch in batches:
            rows = []
            for key, image in zip(batch["key"], batch["image"], strict=True):
                text, status = None, "failed"
                for _ in range(retries):
                    try:
                        text, whole = transcriber(bytes(image))
                        status = "complete" if whole else "truncated"
                        break
                    except Exception:  # tried again, then a recorded failure
                        text = None
                rows.append((key, text, status))
            yield pd.DataFrame(rows, columns=["key", "text", "status"])

    new = todo.select("key", "image").mapInPandas(run, CACHE)
    new.where("status <> 'failed'").write.mode("append").parquet(path)
    kept = spark.read.schema(CACHE).parquet(path).dropDuplicates(["key"])
    out = keyed.select("doc_id", "page", "key").join(kept, "key", "left")
    return out.select("doc_id", "page", "text", F.coalesce("status", F.lit("failed")).alias("status"))
