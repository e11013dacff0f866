"""Documents from files: page texts by a pluggable extractor, thin pages, transcriptions, truncation, a manifest."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import text as T
from verdigris.sources.commits import Tables

THIN_CHARS, THIN_IMAGE = 100, 0.5
MANIFEST = ("doc_id", "file_name", "page_count", "n_chars", "extractor", "thin_pages", "transcribed_pages", "unread_pages", "truncated", "original_chars", "limit", "head_share", "error")
Extractor = Callable[[bytes], tuple[list[str], list[float]]]
_registered: dict[str, Extractor] = {}


class BadCorpus(ValueError):
    """Files that can't be told apart, or counts that don't add up."""


def register_extractor(name: str) -> Callable[[Extractor], Extractor]:
    """An extractor maps a file's bytes to page texts and the share of each page under images."""

    def add(f: Extractor) -> Extractor:
        _registered[name] = f
        return f

    return add


def registered_extractors() -> list[str]:
    return sorted(_registered)


@register_extractor("plain")
def plain(content: bytes) -> tuple[list[str], list[float]]:
    """Text files; a form feed ends a page."""
    pages = content.decode("utf-8", "replace").split("\f")
    return pages, [0.0] * len(pages)


def list_files(spark: SparkSession, folder: str, suffix: str = "pdf") -> DataFrame:
    """(doc_id, path, content) of a folder's files with the suffix in any case; hidden files are left out, two files of one id are an error.

    Spark's own reader passes over files without a byte; :mod:`verdigris.sources.documents` lists them too.
    """
    pattern = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.substring_index("path", "/", -1)
    files = files.where(~name.startswith(".")).select(F.trim(F.regexp_replace(F.trim(name), rf"(?i)\.{suffix}$", "")).alias("doc_id"), "path", "content")
    twice = files.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id").limit(5).collect()
    if twice:
        raise BadCorpus(f"several files have one id: {[r[0] for r in twice]}")
    return files


def extractors() -> dict[str, Extractor]:
    return dict(_registered)


def pages_of(content: bytes, tried: list[tuple[str, Extractor]]) -> tuple[list[str], list[float], str, str]:
    """(page texts, image shares, extractor, error) of a file: each of the named extractors until one finds text."""
    pages: list[str] = []
    images: list[float] = []
    used, error = "", ""
    for name, f in tried:
        try:
            found, shares = f(content)
            pages, images = list(found), [min(1.0, float(i)) for i in shares]
            used, error = name, ""
        except Exception as e:  # an unreadable file is a recorded outcome
            error = f"{type(e).__name__}: {e}"[:300]
        if any(p.strip() for p in pages):
            break
    return pages, images, used, error


def read_pages(files: DataFrame, extractor: str = "plain", fallback: str | None = None) -> DataFrame:
    """(doc_id, pages, images, extractor, error): the fallback is taken when the first finds no text."""
    names = [n for n in (extractor, fallback) if n]
    funcs = [(n, _registered[n]) for n in names]

    def run(batches: Iterable):
        import pandas as pd

        for batch in batches:
            rows = []
            for doc, content in zip(batch["doc_id"], batch["content"], strict=True):
                pages, images, used, error = pages_of(bytes(content), funcs)
                rows.append((doc, pages, images, used, error))
            yield pd.DataFrame(rows, columns=["doc_id", "pages", "images", "extractor", "error"])

    return files.select("doc_id", "content").mapInPandas(run, "doc_id string, pages array<string>, images array<double>, extractor string, error string")


def thin_pages(pages: Column, images: Column, chars: int = THIN_CHARS, share: float = THIN_IMAGE) -> Column:
    """Numbers, from 0, of pages with little text and much image."""
    return F.filter(F.transform(pages, lambda p, i: F.when((F.length(F.trim(p)) < chars) & (F.coalesce(F.get(images, i), F.lit(0.0)) >= share), i)), lambda i: i.isNotNull())


def document_texts(pages: DataFrame, transcripts: DataFrame | None = None, limit: int | None = None, head_share: float = 0.7) -> DataFrame:
    """Manifest rows with ``text``: transcriptions (doc_id, page, text, status) in place of thin pages, then truncated.

    A thin page counts as unread until a whole transcription of it is there.
    """
    d = pages.withColumn("thin", thin_pages(F.col("pages"), F.col("images")))
    none = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<string>"))
    if transcripts is not None:
        t = transcripts.where("status <> 'failed'").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("page", "text"))).alias("read"), F.collect_set(F.when(F.col("status") == "truncated", F.col("page"))).alias("part"))
        d = d.join(t, "doc_id", "left")
    else:
        d = d.withColumns({"read": none, "part": F.array().cast("array<int>")})
    read, part = F.coalesce("read", none), F.coalesce("part", F.array().cast("array<int>"))
    whole = F.array_join(F.transform("pages", lambda p, i: F.when(F.array_contains("thin", i), F.coalesce(F.try_element_at(read, i), p)).otherwise(p)), "\n\n")
    done = F.array_intersect("thin", F.map_keys(read))
    unread = F.array_union(F.array_except("thin", done), F.array_intersect(done, part))
    d = d.withColumns({"whole": whole, "transcribed_pages": F.size(done), "unread_pages": F.size(unread)})
    cut = F.col("whole") if limit is None else T.truncate(F.col("whole"), limit, head_share)
    return d.select("doc_id", F.size("pages").alias("page_count"), "extractor", F.size("thin").alias("thin_pages"), "transcribed_pages", "unread_pages", (F.length("whole") > F.lit(limit if limit is not None else 2**31 - 1)).alias("truncated"), F.length("whole").alias("original_chars"), "error", cut.alias("text")).withColumn("n_chars", F.length("text"))


def pending_documents(files: DataFrame, manifest: DataFrame | None, retry_unread: bool = False) -> DataFrame:
    """Files that the manifest does not have yet; with a transcriber also those with unread pages."""
    if manifest is None:
        return files
    done = manifest if not retry_unread else manifest.where("unread_pages = 0")
    return files.join(done.select("doc_id"), "doc_id", "left_anti")


def legacy_manifest(rows: DataFrame) -> DataFrame:
    """A manifest with the old columns ``ocr`` and ``ocr_needed`` in today's form."""
    out = rows
    if "transcribed_pages" not in rows.columns:
        out = out.withColumn("transcribed_pages", F.when(F.lower(F.col("ocr").cast("string")) == "true", F.col("page_count").cast("int")).otherwise(0) if "ocr" in rows.columns else F.lit(0))
    if "unread_pages" not in rows.columns:
        out = out.withColumn("unread_pages", F.when(F.lower(F.col("ocr_needed").cast("string")) == "true", F.col("page_count").cast("int")).otherwise(0) if "ocr_needed" in rows.columns else F.lit(0))
    return out.drop("ocr", "ocr_needed")


def texts_of(ids: DataFrame, texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text) of the ids; an id without a text is an error when it is read."""
    found = ids.select(key).join(texts.select(key, "text", F.lit(True).alias("_there")), key, "left")
    missing = F.raise_error(F.concat(F.lit("no text for "), F.col(key).cast("string")))
    return found.withColumn("text", F.when(F.col("_there"), F.col("text")).otherwise(missing)).drop("_there")


def missing_texts(ids: DataFrame, texts: DataFrame, key: str = "doc_id") -> list[str]:
    """Ids without a text, in order: what a message lists."""
    return [str(r[0]) for r in ids.select(key).distinct().join(texts.select(key), key, "left_anti").orderBy(key).collect()]


#: What is stored of a document: its text, and beside it a manifest row that people read.
STORED = {
    "texts": "doc_id string, text string",
    "manifest": "doc_id string, file_name string, page_count int, n_chars int, extractor string, thin_pages int, transcribed_pages int, unread_pages int, truncated boolean, original_chars int, `limit` string, head_share double, error string",
}
_WHOLE = "doc_id string, file_name string, text string, page_count int, n_chars int, extractor string, thin_pages int, transcribed_pages int, unread_pages int, truncated boolean, original_chars int, error string"


def corpus_tables(spark: SparkSession, out: str) -> Tables:
    """Texts and manifest of an extracted corpus, which change together."""
    return Tables(spark, out, STORED | {"whole": _WHOLE}, {"manifest": ("csv", {"header": "true"})})


def extract_corpus(spark: SparkSession, folder: str, out: str, extractor: str = "plain", fallback: str | None = None, suffix: str = "pdf", transcripts: DataFrame | None = None, limit: int | None = None, head_share: float = 0.7) -> DataFrame:
    """Texts and manifest rows under ``out`` for the files that it does not have yet, in one commit.

    Files are read once: what was extracted is staged, both tables are made of it, and one rename makes both count.  A run that
    dies before leaves nothing that is read.  Run again, it goes on where it stood; with ``transcripts`` documents with unread
    pages are read again and replaced.  Returns the manifest, one row for each document; files and manifest that don't add
    up are an error.
    """
    tables = corpus_tables(spark, out)
    files = list_files(spark, folder, suffix)
    old = tables.latest("manifest", "doc_id")
    todo = pending_documents(files, old, retry_unread=transcripts is not None)
    names = todo.select("doc_id", F.substring_index("path", "/", -1).alias("file_name"))
    rows = document_texts(read_pages(todo, extractor, fallback), transcripts, limit, head_share).join(names, "doc_id")
    staged = tables.stage()
    whole = staged.write("whole", rows)
    if not whole.isEmpty():
        staged.write("texts", whole)
        staged.write("manifest", whole.withColumns({"limit": F.lit("" if limit is None else str(limit)), "head_share": F.lit(head_share)}))
        tables.files.delete(staged.path("whole"))
        staged.commit()
    done = tables.latest("manifest", "doc_id")
    if lost := [r[0] for r in files.select("doc_id").join(done, "doc_id", "left_anti").limit(5).collect()]:
        raise BadCorpus(f"files without a manifest row: {lost}")
    return done.select(*MANIFEST)


def stored_texts(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, text) of all documents that :func:`extract_corpus` stored."""
    return corpus_tables(spark, out).latest("texts", "doc_id")


def load_texts(spark: SparkSession, out: str, ids: DataFrame) -> DataFrame:
    """Texts that :func:`extract_corpus` stored, for the ids; missing ones are an error that lists them."""
    stored = stored_texts(spark, out)
    if lost := missing_texts(ids, stored):
        raise BadCorpus(f"{len(lost)} ids have no text: {lost[:50]}")
    return texts_of(ids, stored)
