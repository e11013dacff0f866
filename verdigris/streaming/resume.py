"""Running a model over a corpus: what is done stays done, failures are tried again, and every document gets an outcome."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdigris.functions.stats import numbered
from verdigris.project import Budget, BudgetSpent, Refused
from verdigris.sources.commits import Tables, scratch

#: ``at`` is when an outcome was made, in seconds.
OUTCOME = "doc_id string, ok boolean, values map<string,string>, error string, attempts int, at double"
#: A predictor maps a batch of (doc_id, text) to a values dict each; an exception in a dict's place is a failure.
Predictor = Callable[[list[tuple[str, str]], int], list[Any]]


def pending(docs: DataFrame, outcomes: DataFrame | None, key: str = "doc_id") -> DataFrame:
    """Documents without a good outcome yet."""
    return docs if outcomes is None else docs.join(outcomes.where("ok").select(key), key, "left_anti")


def predict(docs: DataFrame, predictor: Predictor, retries: int = 3, batch: int = 64) -> DataFrame:
    """Outcomes of (doc_id, text): unreadable replies are asked again, with the attempt's number, then fail.

    A predictor that raises over a batch is asked for its rows one by one; what raises alone is a failed reply.
    """

    def asked(rows: list, attempt: int) -> list:
        try:
            return list(predictor(rows, attempt))
        except Exception as e:  # a fault of one document must not take the others along
            return [e] if len(rows) == 1 else [r for row in rows for r in asked([row], attempt)]

    def run(batches: Iterable):
        import time

        import pandas as pd

        for frame in batches:
            rows = list(zip(frame["doc_id"].astype(str), frame["text"], strict=True))
            for lo in range(0, len(rows), batch):
                left, out = rows[lo : lo + batch], []
                for attempt in range(1, retries + 1):
                    again = []
                    for row, reply in zip(left, asked(left, attempt), strict=True):
                        if isinstance(reply, Exception) or reply is None:
                            again.append((row, f"{reply}"[:300]))
                        else:
                            out.append((row[0], True, {k: None if v is None else str(v) for k, v in reply.items()}, "", attempt))
                    left = [r for r, _ in again]
                    if not left:
                        break
                    if attempt == retries:
                        out += [(r[0], False, None, e or "no reply", attempt) for r, e in again]
                yield pd.DataFrame([(*o, time.time()) for o in out], columns=["doc_id", "ok", "values", "error", "attempts", "at"])

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, OUTCOME)


def replay(recorded: dict[str, dict]) -> Predictor:
    """A predictor that answers from recorded values."""
    return lambda rows, attempt: [recorded.get(doc, KeyError(doc)) for doc, _ in rows]


def produce(docs: DataFrame, path: str, predictor: Predictor, retries: int = 3) -> DataFrame:
    """Outcomes of all documents, appended under ``path`` as they come; a run that died goes on where it stood.

    The latest good outcome of a document counts; counts that don't add up are an error.
    """
    spark = docs.sparkSession
    probe = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = probe.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(probe)
    done = spark.read.schema(OUTCOME).parquet(path) if there else None
    keyed = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    predict(pending(keyed, done), predictor, retries).write.mode("append").parquet(path)
    rows = spark.read.schema(OUTCOME).parquet(path)
    best = rows.groupBy("doc_id").agg(F.max_by(F.struct("ok", "values", "error", "attempts"), F.struct("ok", "at")).alias("o")).select("doc_id", "o.*")
    lost = keyed.select("doc_id").distinct().join(best, "doc_id", "left_anti").count()
    if lost:
        raise RuntimeError(f"{lost} documents have no outcome")
    return best


#: Tables of a streamed run.
STREAMED = {"outcomes": OUTCOME}


def stream_tables(spark: SparkSession, root: str) -> Tables:
    return Tables(spark, root, STREAMED)


def stream_outcomes(stream: DataFrame, root: str, predictor: Predictor, retries: int = 3, budget: Budget | None = None, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """The same over arriving documents (doc_id, text): one outcome for each id, however often it arrives or the run dies.

    Ids that came before are held in the stream's state store, so a repeated one isn't asked again (RocksDB as
    ``spark.sql.streaming.stateStore.providerClass`` keeps that off the heap).  A micro-batch's outcomes are one commit under
    the batch's number: one that is run again after a crash finds itself committed and asks nothing.  Attempts are counted
    from what a batch wrote, and a run whose ``budget`` is used up stops at the end of that batch: it passes its cap by one
    batch at most, and what was paid for is kept.  ``after`` is called with each batch's number once it is committed.  Everything is under ``root``; the
    query ends when all that is there is done.  A null id has no outcome.
    """
    tables = stream_tables(stream.sparkSession, root)
    if budget is not None:
        budget.check_rollouts()

    def each(batch: DataFrame, number: int) -> None:
        key = f"stream-{number}"
        if not tables.done(key):
            staged = tables.stage()
            rows = staged.write("outcomes", predict(batch, predictor, retries))
            staged.commit(key)
            if budget is not None:
                budget.paid(rows.agg(F.coalesce(F.sum("attempts"), F.lit(0))).first()[0])
                try:
                    budget.check_rollouts()
                except BudgetSpent as e:  # no ordinary exception, and the stream waits for ever on any other
                    raise Refused(str(e)) from e
        else:
            # nothing to ask, but the ids of this batch must reach the state store
            batch.write.format("noop").mode("append").save()
        if after is not None:
            after(number)

    ids = F.col("doc_id").cast("string")
    once = stream.where(ids.isNotNull()).select(ids.alias("doc_id"), "text").dropDuplicates(["doc_id"])
    return once.writeStream.foreachBatch(each).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()


def predict_within(docs: DataFrame, predictor: Predictor, retries: int, budget: Budget, wave: int = 256) -> DataFrame:
    """Outcomes of (doc_id, text) like :func:`predict`, asked in waves of ``wave`` documents until the budget is used up.

    Each wave is written once and its attempts are counted from that before the next one begins, so a run stops within one wave
    of its cap, with :class:`BudgetSpent`.  For evaluation splits: waves are jobs of their own, in order of id.
    """
    spark = docs.sparkSession
    tables = stream_tables(spark, scratch(spark, "waves"))
    ranked = numbered(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), F.col("doc_id"))
    for first in range(0, ranked.count(), wave):
        budget.check_rollouts()
        staged = tables.stage()
        rows = staged.write("outcomes", predict(ranked.where((F.col("at") >= first) & (F.col("at") < first + wave)).drop("at"), predictor, retries))
        staged.commit()
        budget.paid(rows.agg(F.coalesce(F.sum("attempts"), F.lit(0))).first()[0])
    return tables.read("outcomes")


def ask_again(docs: DataFrame, root: str, predictor: Predictor, retries: int = 3) -> int:
    """Asks for those of ``docs`` (doc_id, text) whose streamed outcome is a failure; how many there were."""
    tables = stream_tables(docs.sparkSession, root)
    ids = F.col("doc_id").cast("string")
    bad = streamed(docs.sparkSession, root).where("NOT ok").select("doc_id")
    staged = tables.stage()
    rows = staged.write("outcomes", predict(docs.select(ids.alias("doc_id"), "text").dropDuplicates(["doc_id"]).join(bad, "doc_id", "left_semi"), predictor, retries))
    n = rows.count()
    if n:
        staged.commit()
    return n


def streamed(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, ok, values, error, attempts, at) of every document that a streamed run has met: the last good outcome, else the last one."""
    rows = stream_tables(spark, root).read("outcomes", with_commit=True)
    best = F.max_by(F.struct("ok", "values", "error", "attempts", "at"), F.struct("ok", "commit_number")).alias("o")
    return rows.groupBy("doc_id").agg(best).select("doc_id", "o.*")
