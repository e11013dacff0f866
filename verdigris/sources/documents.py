"""Files of documents as a Spark data source: ``spark.read.format("document_pages").option("suffix", "txt").load(folder)``.

One row a page: (doc_id, file_name, n_bytes, page, text, image, extractor, error).  Files are listed once, by Arrow's file
systems (a local folder, HDFS, object stores), and dealt to partitions by their bytes, so a task reads about as much as any
other; a large file is a task of its own.  With the option ``modifiedAfter`` (seconds since 1970) files that are no younger
are left out of the listing and never opened.  Conditions are not pushed into the source: in Spark 4.1 what one query pushes
stays with the frame's source, and the next query of that frame would miss rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from verdigris.sources import extract

PAGES = "doc_id string, file_name string, n_bytes long, page int, text string, image double, extractor string, error string"
#: Bytes and files of a partition at most; a larger file is a partition of its own.
PARTITION_BYTES, PARTITION_FILES = 64_000_000, 10_000
#: Rows of an Arrow batch: pages may be long.
BATCH_ROWS = 500


class Split(InputPartition):
    """Files of one task, as (doc_id, path, bytes)."""

    def __init__(self, files: list[tuple[str, str, int]]):
        self.files = files


def dealt(files: list[tuple[str, str, int]], most_bytes: int, most_files: int = PARTITION_FILES) -> list[list[tuple[str, str, int]]]:
    """Files in parts of at most so many bytes and files, the largest first, so that small ones fill up what is left."""
    out: list[list[tuple[str, str, int]]] = []
    now: list[tuple[str, str, int]] = []
    held = 0
    for f in sorted(files, key=lambda f: (-f[2], f[1])):
        if now and (held + f[2] > most_bytes or len(now) == most_files):
            out.append(now)
            now, held = [], 0
        now.append(f)
        held += f[2]
    return [*out, now] if now else out


def open_folder(path: str):
    """(Arrow file system, folder there) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def listed(path: str, suffix: str, recursive: bool = False, after: float = float("-inf")) -> list[tuple[str, str, int]]:
    """(doc_id, path, bytes) of a folder's files with the suffix in any case, empty ones too; hidden files are left out, two files of one id are an error."""
    from pyarrow import fs

    system, folder = open_folder(path)
    files, seen = [], {}
    for info in system.get_file_info(fs.FileSelector(folder, recursive=recursive)):
        name = info.base_name.strip()
        if info.type != fs.FileType.File or name.startswith((".", "_")) or not name.lower().endswith(f".{suffix.lower()}"):
            continue
        doc = name[: -len(suffix) - 1].strip()
        if doc in seen:
            raise extract.BadCorpus(f"several files have one id: {doc}: {seen[doc]}, {info.path}")
        seen[doc] = info.path
        if info.mtime is None or info.mtime.timestamp() > after:
            files.append((doc, info.path, info.size))
    return files


def source(extractors: dict[str, extract.Extractor]) -> type[DataSource]:
    """The data source with these extractors, which go to the executors with it."""

    class Reader(DataSourceReader):
        def __init__(self, options: dict[str, str]):
            self.path, self.suffix = options.get("path", ""), options.get("suffix", "pdf")
            self.recursive = options.get("recursive", "false").lower() == "true"
            self.most = int(options.get("partitionbytes", PARTITION_BYTES))
            self.names = [n for n in (options.get("extractor", "plain"), options.get("fallback", "")) if n]
            if unknown := [n for n in self.names if n not in extractors]:
                raise ValueError(f"no extractor {unknown[0]!r}; there are {', '.join(sorted(extractors))}")
            self.after = float(options.get("modifiedafter", "-inf"))

        def partitions(self) -> list[InputPartition]:
            return [Split(part) for part in dealt(listed(self.path, self.suffix, self.recursive, self.after), self.most)] or [Split([])]

        def read(self, partition: InputPartition) -> Iterator:
            import pyarrow as pa

            system, _ = open_folder(self.path)
            schema = pa.schema([("doc_id", pa.string()), ("file_name", pa.string()), ("n_bytes", pa.int64()), ("page", pa.int32()), ("text", pa.string()), ("image", pa.float64()), ("extractor", pa.string()), ("error", pa.string())])
            rows: list[tuple] = []

            def batch():
                out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows.clear()
                return out

            for doc, path, size in partition.files:
                name = path.rsplit("/", 1)[-1]
                try:
                    with system.open_input_stream(path) as stream:
                        content = stream.read()
                    pages, images, used, error = extract.pages_of(content, [(n, extractors[n]) for n in self.names])
                except Exception as e:  # a file that can't be opened is a recorded outcome
                    pages, images, used, error = [], [], "", f"{type(e).__name__}: {e}"[:300]
                if not pages:
                    rows.append((doc, name, size, None, None, None, used, error))
                for i, text in enumerate(pages):
                    rows.append((doc, name, size, i, text, images[i] if i < len(images) else 0.0, used, error))
                    if len(rows) >= BATCH_ROWS:
                        yield batch()
                if len(rows) >= BATCH_ROWS:
                    yield batch()
            if rows:
                yield batch()

    class DocumentPages(DataSource):
        @classmethod
        def name(cls) -> str:
            return "document_pages"

        def schema(self) -> str:
            return PAGES

        def reader(self, schema) -> DataSourceReader:
            return Reader({k.lower(): v for k, v in self.options.items()})

    return DocumentPages


def register(spark: SparkSession) -> None:
    """Makes ``document_pages`` known to the session, with the extractors registered so far."""
    spark.dataSource.register(source(extract.extractors()))


def by_document(pages: DataFrame) -> DataFrame:
    """The source's pages as one row a document, as :func:`verdigris.sources.extract.document_texts` reads them: (doc_id, file_name, pages, images, extractor, error).

    A document's pages come from one task and are one file, so gathering them holds no more than was read at once.
    """
    got = pages.groupBy("doc_id", "file_name").agg(
        F.array_sort(F.collect_list(F.when(F.col("page").isNotNull(), F.struct("page", "text", "image")))).alias("ps"), F.max("extractor").alias("extractor"), F.max("error").alias("error")
    )
    return got.select("doc_id", "file_name", F.transform("ps", lambda p: p["text"]).alias("pages"), F.transform("ps", lambda p: p["image"]).alias("images"), "extractor", "error")
