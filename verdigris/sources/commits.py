"""Tables that change together: staged folders that one rename makes visible.

``root/staged/<part>`` holds what a writer wrote, one folder for each table; ``root/commits/<number>.json`` names the parts
that count, in order.  A writer that dies leaves a staged folder that nobody reads.  A commit's file is written aside and
renamed to the next free number, which a file system does as one step and refuses if the name is taken; so two writers
can't both be the same commit, and a reader sees all of a commit or nothing of it.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where queries and tests keep tables if a local session names no folder.
_LOCAL = "file:///tmp/checkpoints"
_COMMIT = re.compile(r"(\d{10})\.json")


class Conflict(RuntimeError):
    """A commit under a key that another writer has committed already."""


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, ``spark.checkpoint.dir``; only a local master may do without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _LOCAL


def scratch(spark: SparkSession, label: str) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_dir(spark)}/verdigris/{label}-{uuid.uuid4().hex}"


class Files:
    """What is needed of a file system that Spark reads, whichever it is."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, at: str):
        return self.jvm.org.apache.hadoop.fs.Path(at)

    def exists(self, at: str) -> bool:
        return self.fs.exists(self.path(at))

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, at: str) -> str:
        stream = self.fs.open(self.path(at))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, at: str, text: str) -> None:
        stream = self.fs.create(self.path(at), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename_new(self, source: str, target: str) -> bool:
        """Renames unless the target is there; whether it did."""
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(target).makeQualified(self.fs.getUri(), self.fs.getWorkingDirectory()).toUri(), self.conf)
        plain = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self.path(source), self.path(target), plain)
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    def delete(self, at: str) -> None:
        self.fs.delete(self.path(at), True)


@dataclass(frozen=True)
class Part:
    """A committed folder, the number of its commit and the key that it was committed under."""

    number: int
    path: str
    key: str


class Tables:
    """The tables under ``root``, written and read by commits.

    ``formats`` says how a table that isn't Parquet is stored: (format, options).
    """

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], formats: dict[str, tuple[str, dict[str, str]]] | None = None):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas
        self.formats = formats or {}
        self.files = Files(spark, root)

    # --- reading

    def parts(self) -> list[Part]:
        """What counts, oldest first."""
        out = []
        for name in self.files.names(f"{self.root}/commits"):
            if m := _COMMIT.fullmatch(name):
                held = json.loads(self.files.read(f"{self.root}/commits/{name}"))
                out.append(Part(int(m[1]), f"{self.root}/staged/{held['part']}", held["key"]))
        return out

    def read(self, table: str, with_commit: bool = False) -> DataFrame:
        """All committed rows of a table; ``with_commit`` adds the number of their commit as ``commit_number``."""
        kind, options = self.formats.get(table, ("parquet", {}))
        there = [p for p in self.parts() if self.files.exists(f"{p.path}/{table}")]
        reader = self.spark.read.schema(self.schemas[table]).options(**options).format(kind)
        if not there:
            empty = self.spark.createDataFrame([], self.schemas[table])
            return empty.withColumn("commit_number", F.lit(0).cast("long")) if with_commit else empty
        rows = reader.load([f"{p.path}/{table}" for p in there])
        if not with_commit:
            return rows
        part = F.regexp_extract(F.col("_metadata.file_path"), r"/staged/([^/]+)/", 1)
        numbers = self.spark.createDataFrame([(p.path.rsplit("/", 1)[1], p.number) for p in there], "_part string, commit_number long")
        return rows.withColumn("_part", part).join(F.broadcast(numbers), "_part").drop("_part")

    def latest(self, table: str, key: str) -> DataFrame:
        """Of each key the row that was committed last; of several in one commit, one of them."""
        rows = self.read(table, with_commit=True)
        others = [c for c in rows.columns if c not in (key, "commit_number")]
        best = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct("commit_number", F.struct(*(F.col(c).cast("string") for c in others)))).alias("_row"))
        return best.select(key, "_row.*").select(*(c for c in rows.columns if c != "commit_number"))

    def done(self, key: str) -> bool:
        return any(p.key == key for p in self.parts())

    # --- writing

    def stage(self) -> Staged:
        return Staged(self, uuid.uuid4().hex)

    def put(self, frames: dict[str, DataFrame], key: str = "") -> int:
        """Stages and commits several tables at once; a key that was committed before is left as it is (then 0)."""
        if key and self.done(key):
            return 0
        staged = self.stage()
        for table, rows in frames.items():
            staged.write(table, rows)
        return staged.commit(key)

    def clean(self) -> int:
        """Deletes staged folders that no commit names: what writers that died left.  Not while others write."""
        kept = {p.path.rsplit("/", 1)[1] for p in self.parts()}
        left = [n for n in self.files.names(f"{self.root}/staged") if n not in kept]
        for name in left:
            self.files.delete(f"{self.root}/staged/{name}")
        return len(left)


class Staged:
    """A folder that is being written; nothing of it is read before :meth:`commit`."""

    def __init__(self, tables: Tables, part: str):
        self.tables, self.part = tables, part

    def path(self, table: str) -> str:
        return f"{self.tables.root}/staged/{self.part}/{table}"

    def write(self, table: str, rows: DataFrame) -> DataFrame:
        """Writes a table and gives what was written, by the table's schema."""
        schema = self.tables.schemas[table]
        kind, options = self.tables.formats.get(table, ("parquet", {}))
        names = [f.name for f in self.tables.spark.createDataFrame([], schema).schema]
        rows.select(*names).write.mode("error").options(**options).format(kind).save(self.path(table))
        return self.tables.spark.read.schema(schema).options(**options).format(kind).load(self.path(table))

    def commit(self, key: str = "") -> int:
        """Makes the folder count under the next free number and gives that number; a key can be committed once."""
        t = self.tables
        aside = f"{t.root}/commits/.{self.part}"
        t.files.write(aside, json.dumps({"part": self.part, "key": key}))
        while True:
            there = t.parts()
            if key and any(p.key == key for p in there):
                t.files.delete(aside)
                raise Conflict(f"{key} was committed by another writer")
            number = there[-1].number + 1 if there else 1
            if t.files.rename_new(aside, f"{t.root}/commits/{number:010d}.json"):
                return number
