"""Registered queries over runs: a stream that dies and goes on, files as a source, batched requests, replies kept and replies of any shape."""

from __future__ import annotations

import contextlib

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import sql as Sq
from verdigris.operators import batching, typed_replies
from verdigris.operators import reply_cache as Rc
from verdigris.plans import inputs as I
from verdigris.plans.queries import ENTITY, FACTS, TASKS, query, table
from verdigris.plans.registry import Registry
from verdigris.sources import documents as Do
from verdigris.sources import extract as Ex
from verdigris.sources import io
from verdigris.sources.commits import Files, Tables, scratch
from verdigris.streaming import resume

# --- a stream of documents ------------------------------------------------------------------------------------------


def _by_rule(rows: list[tuple[str, str]], attempt: int) -> list:
    """A replay: one document in ten is never readable, one only when it is asked again."""
    kinds = [int(doc) % 10 for doc, _ in rows]
    return [ValueError("unreadable") if k == 7 or (k == 3 and attempt == 1) else {"n": len(text)} for k, (_, text) in zip(kinds, rows, strict=True)]


#: Micro-batches, about, that arriving documents are dealt into.
STREAM_BATCHES = 8


class _PowerCut(RuntimeError):
    pass


@query("""SELECT CAST(doc_id AS STRING) AS doc_id, doc_id % 10 <> 7 AS ok, CASE WHEN doc_id % 10 IN (3, 7) THEN 2 ELSE 1 END AS attempts,
CASE WHEN doc_id % 10 <> 7 THEN CAST(length(text) AS STRING) END AS n, CASE WHEN doc_id % 10 = 7 THEN 'unreadable' ELSE '' END AS error, 1 AS stored FROM documents""")
def streamed_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """All documents as a file stream, a quarter of them arriving twice; the run dies after a commit and goes on."""
    root = scratch(spark, "stream")
    docs = table(spark, d, "documents").select("doc_id", "text")
    # files as the table's own tasks make them, and at least three
    parts = docs.rdd.getNumPartitions()
    (docs if parts >= 3 else docs.repartition(3)).write.parquet(f"{root}/in")
    docs.where("doc_id % 4 = 0").write.mode("append").parquet(f"{root}/in")
    files = len(Files(spark, root).names(f"{root}/in"))
    stream = lambda: spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", -(-files // STREAM_BATCHES)).parquet(f"{root}/in")

    def dies(number: int) -> None:
        raise _PowerCut(f"after batch {number}")

    with contextlib.suppress(PySparkException):
        resume.stream_outcomes(stream(), f"{root}/run", _by_rule, 2, after=dies).awaitTermination()
    resume.stream_outcomes(stream(), f"{root}/run", _by_rule, 2).awaitTermination()
    stored = resume.stream_tables(spark, f"{root}/run").read("outcomes").groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("stored"))
    out = resume.streamed(spark, f"{root}/run").join(stored, "doc_id")
    return out.select("doc_id", "ok", "attempts", F.try_element_at("values", F.lit("n")).alias("n"), "error", "stored")


# --- files as a source ----------------------------------------------------------------------------------------------


def _marked(content: bytes) -> tuple[list[str], list[float]]:
    """Pages end with a form feed; one that begins with ``IMAGE`` is mostly image."""
    pages = content.decode("utf-8").split("\f")
    return [p.removeprefix("IMAGE") for p in pages], [0.9 if p.startswith("IMAGE") else 0.0 for p in pages]


def _write_pages(rows: DataFrame, folder: str) -> int:
    """One file for each of ``rows`` (name, content binary), written by the tasks that hold them; how many."""

    def write(batches):
        import pandas as pd

        system, root = Do.open_folder(folder)
        system.create_dir(root, recursive=True)
        for frame in batches:
            for name, content in zip(frame["name"], frame["content"], strict=True):
                with system.open_output_stream(f"{root}/{name}") as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"n": [len(frame)]})

    return rows.mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0


@query("""SELECT concat('p', page_id) AS doc_id, concat('p', page_id, '.TXT') AS file_name, CASE WHEN page_id % 20 = 7 THEN 0 ELSE 2 + CAST(page_id % 3 AS INT) END AS page_count,
CASE WHEN page_id % 20 = 7 THEN 0 ELSE CAST(page_id % 3 AS INT) + CASE WHEN page_id % 5 = 0 AND length(trim(url)) < 100 THEN 1 ELSE 0 END END AS thin_pages,
CASE WHEN page_id % 20 = 7 THEN 'UnicodeDecodeError' ELSE '' END AS error FROM pages""")
def documents_from_files(spark: SparkSession, d: str) -> DataFrame:
    """A file for each web page (its address, its markup, a few scans) read through the data source; one in twenty can't be decoded."""
    folder = f"{scratch(spark, 'files')}/in"
    k = F.col("page_id")
    address = F.concat(F.when(k % 5 == 0, "IMAGE").otherwise(""), "url")
    scans = F.concat_ws("", F.array_repeat(F.lit("\fIMAGE scan"), (k % 3).cast("int")))
    content = F.when(k % 20 == 7, F.unhex(F.lit("fffe"))).otherwise(F.encode(F.concat(address, F.lit("\f"), F.translate(F.coalesce("html", F.lit("")), "\f", " "), scans), "utf-8"))
    _write_pages(table(spark, d, "pages").select(F.concat(F.lit("p"), k.cast("string"), F.lit(".TXT")).alias("name"), content.alias("content")), folder)
    spark.dataSource.register(Do.source({"marked": _marked}))
    pages = spark.read.format("document_pages").options(suffix="txt", extractor="marked", partitionBytes="1000000").load(folder)
    docs = Do.by_document(pages)
    out = Ex.document_texts(docs).join(docs.select("doc_id", "file_name"), "doc_id")
    return out.select("doc_id", "file_name", "page_count", "thin_pages", F.substring_index("error", ":", 1).alias("error"))


@query("SELECT CAST(doc_id AS STRING) AS doc_id, length(text) + CASE WHEN doc_id % 3 = 0 THEN 7 ELSE 0 END AS n_chars, length(text) + CASE WHEN doc_id % 3 = 0 THEN 7 ELSE 0 END AS manifest_chars, 1 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS versions FROM documents")
def committed_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Texts and manifest of a corpus that is stored, partly stored again, and once left half written."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    tables = Tables(spark, f"{scratch(spark, 'corpus')}/out", {"texts": "doc_id string, text string", "manifest": "doc_id string, n_chars int"}, {"manifest": ("csv", {"header": "true"})})
    frames = lambda rows: {"texts": rows, "manifest": rows.select("doc_id", F.length("text").alias("n_chars"))}
    tables.put(frames(docs), "first")
    again = docs.where(F.col("doc_id").cast("long") % 3 == 0).withColumn("text", F.concat("text", F.lit(" edited")))
    tables.stage().write("texts", again.withColumn("text", F.lit("half written")))
    tables.put(frames(again), "second")
    tables.put(frames(again), "second")
    versions = tables.read("texts").groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("versions"))
    manifest = tables.latest("manifest", "doc_id").withColumnRenamed("n_chars", "manifest_chars")
    return tables.latest("texts", "doc_id").join(manifest, "doc_id").join(versions, "doc_id").select("doc_id", F.length("text").alias("n_chars"), "manifest_chars", "versions")


# --- batched requests -----------------------------------------------------------------------------------------------


def _answer(custom_id: str, body: str) -> str | None:
    return None if len(body) % 11 == 0 else f"{len(body)} characters"


class _CutOff(batching.FolderService):
    """A service whose line is cut after it took the first batch of each task."""

    def submit(self, key: str, requests: list[tuple[str, str]]) -> str:
        super().submit(key, requests)
        raise ConnectionError("cut off")


@query("""SELECT CAST(doc_id AS STRING) AS doc_id, g AS "group", CASE WHEN (length(text) + length(g)) % 11 = 0 THEN 'missing' ELSE 'answered' END AS state,
CASE WHEN (length(text) + length(g)) % 11 <> 0 THEN concat(length(text) + length(g), ' characters') END AS reply, 1 AS times FROM documents, (VALUES ('facts'), ('dates')) v(g)""")
def batched_requests(spark: SparkSession, d: str) -> DataFrame:
    """Two requests a document through a batch service whose line is cut in between: each is sent once and ends in one state."""
    root = scratch(spark, "batches")
    docs = table(spark, d, "documents")
    requests = docs.select("doc_id", F.explode(F.array(F.lit("facts"), F.lit("dates"))).alias("group"), "text").select("doc_id", "group", F.concat("text", "group").alias("body"))
    service, cut = batching.FolderService(f"{root}/service", _answer), _CutOff(f"{root}/service", _answer)
    run = batching.Batches(spark, f"{root}/run", "facts and dates", size=500)
    run.plan(requests)
    with contextlib.suppress(PySparkException):
        run.send(requests, cut)
    again = batching.Batches(spark, f"{root}/run", "facts and dates", size=500)
    again.plan(requests)
    again.send(requests, service)
    again.collect(service)
    times = service.submissions(spark).select("custom_id", F.col("times").cast("int").alias("times"))
    return again.latest().join(times, "custom_id").select("doc_id", "group", "state", "reply", "times")


# --- replies that are kept ------------------------------------------------------------------------------------------


def _said(prompts: list[str], attempt: int) -> list[str]:
    return [f"{attempt}: {p.upper()}" for p in prompts]


@query("""WITH p AS (SELECT doc_id, concat(lang, ' text of ', n_chars) AS prompt FROM documents), f AS (SELECT DISTINCT prompt FROM p WHERE doc_id % 2 = 0)
SELECT doc_id, concat(CASE WHEN doc_id % 6 = 0 THEN '2: ' ELSE '1: ' END, upper(prompt)) AS reply, doc_id % 6 <> 0 AND prompt IN (FROM f) AS hit,
(SELECT CAST(count(DISTINCT prompt) AS BIGINT) FROM p) AS asked FROM p""")
def kept_replies(spark: SparkSession, d: str) -> DataFrame:
    """Half of the documents asked, then all: what was asked is not asked again but by a further attempt; equal prompts are one."""
    root = scratch(spark, "replies")
    prompts = table(spark, d, "documents").select("doc_id", F.concat_ws(" ", "lang", F.lit("text of"), F.col("n_chars").cast("string")).alias("prompt"))
    Rc.ask_kept(prompts.where("doc_id % 2 = 0"), root, "replay-1", _said)
    all_ = Rc.ask_kept(prompts, root, "replay-1", _said)
    asked = Rc.cache_tables(spark, root).read("replies").select(F.count(F.lit(1)).alias("asked")).first()[0]
    afresh = Rc.ask_kept(prompts.where("doc_id % 6 = 0"), root, "replay-1", _said, attempt=2)
    return all_.where("doc_id % 6 <> 0").unionByName(afresh).select("doc_id", "reply", "hit", F.lit(asked).alias("asked"))


# --- replies of any shape -------------------------------------------------------------------------------------------

SHAPES = Registry.of({"tasks": [
    {"id": "flag", "type": "binary", "question": "?"},
    {"id": "tags", "type": "multilabel", "question": "?", "output": {"enum": ["en", "de", "fr", "es", "long"]}},
    {"id": "amount", "type": "extract_numeric", "question": "?", "match": {"tolerance": 0, "unit": "USD"}},
    {"id": "where", "type": "span", "question": "?"},
]})


@query("""SELECT CAST(doc_id AS STRING) AS doc_id, k <> 9 AS ok, CASE WHEN k = 9 THEN 'no JSON' END AS error,
CASE WHEN k NOT IN (1, 9) THEN n_chars % 2 = 0 END AS flag, CASE WHEN k NOT IN (2, 9) THEN concat(lang, ',long') END AS tags,
CASE WHEN k NOT IN (3, 9) THEN CAST(n_chars AS DOUBLE) END AS amount, CASE WHEN k NOT IN (3, 4, 9) THEN 'USD' END AS unit, CASE WHEN k NOT IN (5, 9) THEN CAST(n_chars % 7 AS INT) END AS start,
CASE k WHEN 1 THEN 'flag' WHEN 2 THEN 'tags' WHEN 3 THEN 'amount' WHEN 5 THEN 'where' ELSE '' END AS problems FROM (SELECT *, doc_id % 10 AS k FROM documents)""")
def typed_replies_read_back(spark: SparkSession, d: str) -> DataFrame:
    """Predictions written as JSON lines and read back by the declared types: nested answers, answers of another type, broken lines."""
    path = f"{scratch(spark, 'predictions')}/lines"
    docs, k = table(spark, d, "documents"), F.col("doc_id") % 10
    flag = F.when(k == 1, F.lit('"perhaps"')).otherwise((F.col("n_chars") % 2 == 0).cast("string"))
    tags = F.when(k == 2, F.lit('{"tag": 1}')).otherwise(F.to_json(F.array("lang", F.lit("long"))))
    amount = F.when(k == 3, F.lit('["much"]')).when(k == 4, F.col("n_chars").cast("string")).otherwise(F.to_json(F.struct(F.col("n_chars").alias("value"), F.lit("USD").alias("unit"))))
    where = F.when(k == 5, F.lit("true")).otherwise(F.to_json(F.struct((F.col("n_chars") % 7).alias("start"), (F.col("n_chars") % 7 + 3).alias("stop"))))
    said = F.concat(F.lit('{"flag": '), flag, F.lit(', "tags": '), tags, F.lit(', "amount": '), amount, F.lit(', "where": '), where, F.lit("}"))
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"), F.parse_json(said).alias("predicted"), k.alias("k"))
    lines = typed_replies.prediction_lines(rows).select(F.when(F.col("k") == 9, F.concat(F.lit('{"doc_id": "'), "doc_id", F.lit('", "predicted": {'))).otherwise(F.col("value")).alias("value"))
    lines.write.text(path)
    read = typed_replies.read_predictions(spark, path)
    p = typed_replies.typed(read, SHAPES)
    return p.select(
        F.coalesce("doc_id", F.regexp_extract("line", '"doc_id": "([0-9]+)"', 1)).alias("doc_id"), "ok", "error", "values.flag", F.array_join("values.tags", ",").alias("tags"), F.col("values.amount.value").alias("amount"),
        "values.amount.unit", "values.where.start", F.array_join(F.transform("problems", lambda x: F.substring_index(x, ":", 1)), ",").alias("problems"),
    )


# --- normalizers and matchers in SQL --------------------------------------------------------------------------------


def _sql(spark: SparkSession, d: str, text: str, rows: str) -> DataFrame:
    """``text`` over ``{rows}``, in a session whose SQL functions are registered for the tasks."""
    Sq.register(spark, TASKS)
    return spark.sql(text, rows=I.frame(spark, d, rows))


@query(f"SELECT id, pred AS raw, {ENTITY('pred')} AS value FROM ({I.NAMES})")
def norm_entity_name_by_sql(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, "SELECT id, pred AS raw, norm_entity_name(pred) AS value FROM {rows}", I.NAMES)


@query(f"WITH {FACTS} SELECT doc_id, task_id, tp, fp, fn, tn, correct FROM facts")
def tasks_matched_by_sql(spark: SparkSession, d: str) -> DataFrame:
    """Every answer of every task judged by the functions that its declaration makes, in SQL text alone."""
    one = "SELECT CAST(doc_id AS STRING) AS doc_id, '{0}' AS task_id, match_{0}(gold_{0}, pred_{0}) AS o FROM {{rows}}"
    union = " UNION ALL ".join(one.format(t.id) for t in TASKS)
    return _sql(spark, d, f"SELECT doc_id, task_id, o.tp, o.fp, o.fn, o.tn, o.correct FROM ({union})", I.CLASSES)


# --- files that people and other programs read ----------------------------------------------------------------------


@query("SELECT CAST(doc_id AS STRING) AS doc_id, CAST(quality AS STRING) AS quality, CASE WHEN toxic = 1 THEN '1' END AS toxic, CASE WHEN doc_id % 4 = 0 THEN 0.25 ELSE 1.0 END AS inclusion_probability FROM labels")
def stored_labels(spark: SparkSession, d: str) -> DataFrame:
    """Label records written as JSON lines and read back: a label that is null stays one, a missing probability is 1."""
    path = f"{scratch(spark, 'labels')}/labels"
    k = F.col("doc_id")
    values = F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), F.when(F.col("toxic") == 1, "1"))
    rows = table(spark, d, "labels").select(k.cast("string").alias("doc_id"), F.lit("all").alias("stratum"), F.when(k % 4 == 0, 0.25).alias("inclusion_probability"), F.lit("blind").alias("labeling_mode"), F.lit("").alias("notes"), values.alias("labels"))
    io.write_labels(rows, path)
    back = io.load_labels(spark, path)
    return back.select("doc_id", *(F.try_element_at("labels", F.lit(c)).alias(c) for c in ("quality", "toxic")), F.col("inclusion_probability").cast("decimal(3,2)").alias("inclusion_probability"))


@query("""SELECT CAST(doc_id AS STRING) AS doc_id, CASE WHEN doc_id % 7 = 0 THEN concat('see "', lang, '", line', chr(10), 'two') ELSE '' END AS notes, CASE WHEN doc_id % 2 = 0 THEN 'yes' ELSE '' END AS flag, concat(lang, '; ', source) AS tags FROM documents""")
def stored_sheet(spark: SparkSession, d: str) -> DataFrame:
    """A filled-in sheet as CSV, with quotes and line ends in its cells, read by the tasks' columns."""
    path = f"{scratch(spark, 'sheet')}/sheet"
    k = F.col("doc_id")
    notes = F.when(k % 7 == 0, F.concat(F.lit('see "'), "lang", F.lit('", line\ntwo'))).otherwise("")
    sheet = table(spark, d, "documents").select(F.concat(k.cast("string"), F.lit(".pdf")).alias("file_name"), notes.alias("notes"), F.when(k % 2 == 0, "yes").otherwise("").alias("flag"), F.concat("lang", F.lit("; "), "source").alias("tags"), F.lit("x").alias("other"))
    sheet.unionByName(sheet.limit(1).withColumn("file_name", F.lit("  "))).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    tasks = Registry.of({"tasks": [{"id": "flag", "type": "binary", "question": "?"}, {"id": "tags", "type": "extract_list", "question": "?"}]})
    return io.read_sheet(spark, path, tasks)


@query("SELECT CAST(doc_id AS STRING) AS doc_id, doc_id % 9 <> 0 AS ok, CASE WHEN doc_id % 9 <> 0 THEN lang END AS lang, CASE WHEN doc_id % 9 = 0 THEN 'no reply' END AS error, CASE WHEN doc_id % 9 = 0 THEN 'error' ELSE 'values' END AS last_key FROM documents")
def stored_outputs(spark: SparkSession, d: str) -> DataFrame:
    """A full run's outputs as JSON lines: values or an error, never both."""
    path = f"{scratch(spark, 'outputs')}/outputs"
    ok = F.col("doc_id") % 9 != 0
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), ok.alias("ok"), F.when(ok, F.create_map(F.lit("lang"), F.col("lang"))).alias("values"), F.when(~ok, "no reply").alias("error"))
    io.outputs_json(rows).write.text(path)
    line = F.col("value")
    back = spark.read.text(path)
    return back.select(
        F.get_json_object(line, "$.doc_id").alias("doc_id"), F.get_json_object(line, "$.ok").cast("boolean").alias("ok"), F.get_json_object(line, "$.values.lang").alias("lang"),
        F.get_json_object(line, "$.error").alias("error"), F.element_at(F.json_object_keys(line), -1).alias("last_key"),
    )


@query("SELECT source AS project, CAST(count(*) AS STRING) AS n_documents, lang AS notes, 2 AS times FROM documents GROUP BY source, lang")
def stored_ledger(spark: SparkSession, d: str) -> DataFrame:
    """A ledger that grows by appended rows; columns that a row lacks are empty."""
    path = f"{scratch(spark, 'ledger')}/ledger"
    rows = table(spark, d, "documents").groupBy(F.col("source").alias("project"), F.col("lang").alias("notes")).agg(F.count(F.lit(1)).alias("n_documents"))
    io.append_ledger(rows, path)
    io.append_ledger(rows, path)
    back = spark.read.option("header", True).csv(path).where("version IS NULL AND cost_usd IS NULL")
    return back.groupBy("project", "n_documents", "notes").agg(F.count(F.lit(1)).cast("int").alias("times"))
