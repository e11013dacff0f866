"""Requests sent in batches to a service that answers later, each exactly once: an append-only table of request states.

Every step is a commit (:mod:`verdigris.sources.commits`): which requests stand in which batch is committed before anything
is sent, then what the service took, then what it answered.  A run that dies goes on from the table: a batch that was sent
but not noted is found again at the service, by its key or by the ids of its requests, and not sent twice.

A batch is sent by the task that holds it, so request bodies never pass through the driver.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Iterable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.project import Refused
from verdigris.sources.commits import Conflict, Tables

#: Requests in a batch at most.
SIZE = 10_000
#: Tables of a batched run: what is to be sent, what was sent, what came back.
STATES = {
    "requests": "custom_id string, doc_id string, group string, batch string, fingerprint string",
    "sent": "batch string, service_id string",
    "replies": "custom_id string, batch string, reply string",
}
#: Batches that :func:`_part` names.
_NAMED = "^[0-9a-f]+-[0-9]+-[0-9]+-[0-9]+$"


def _part(deal: Column, name: Column) -> Column:
    """The part of a deal (an id, -, its parts' number) that a request goes to; a part's batches have its name, -, a number."""
    return F.concat_ws("-", deal, F.pmod(F.xxhash64(name), F.element_at(F.split(deal, "-"), 2).cast("long")).cast("string"))


class Service(Protocol):
    """What a batch service offers; objects go to the executors, so they must pickle."""

    def submit(self, key: str, requests: list[tuple[str, str]]) -> str:
        """Starts a batch of (custom_id, body) named ``key`` and gives the service's id of it."""

    def find(self, key: str) -> str | None:
        """The service's id of the batch named ``key``, if it has one."""

    def ended(self, service_id: str) -> bool: ...

    def results(self, service_id: str) -> Iterable[tuple[str, str | None]]:
        """(custom_id, reply); what the service gave up on is missing or None."""


def custom_id(doc_id: str, group: str) -> str:
    """A request's name: only letters, digits, - and _, at most 64 characters, different for different requests."""
    plain = "".join(c if c.isascii() and (c.isalnum() or c in "-_") else "-" for c in f"{doc_id}--{group}")
    return f"{plain[:47]}-{hashlib.sha256(f'{doc_id}|{group}'.encode()).hexdigest()[:16]}"


def custom_ids(doc_id: Column, group: Column) -> Column:
    """:func:`custom_id` as a column."""
    plain = F.regexp_replace(F.concat(doc_id, F.lit("--"), group), "[^A-Za-z0-9_-]", "-")
    return F.concat(F.substring(plain, 1, 47), F.lit("-"), F.substring(F.sha2(F.concat(doc_id, F.lit("|"), group), 256), 1, 16))


class Batches:
    """A batched run under ``root``.  ``fingerprint`` names the tasks asked; a run of other tasks is refused while requests are open."""

    def __init__(self, spark: SparkSession, root: str, fingerprint: str, size: int = SIZE):
        self.spark, self.fingerprint, self.size = spark, fingerprint, size
        self.tables = Tables(spark, root, STATES)
        others = self.latest().where((F.col("fingerprint") != fingerprint) & F.col("state").isin("written", "sent"))
        if not others.isEmpty():
            raise Refused("batches of other tasks are still open; collect them or remove their state")

    # --- what there is

    def latest(self) -> DataFrame:
        """(custom_id, doc_id, group, fingerprint, batch, service_id, state, reply) of every request.

        ``state`` is written (to be sent), sent, answered or missing (the batch ended without a reply to it).
        """
        requests, sent, replies = (self.tables.read(t) for t in ("requests", "sent", "replies"))
        r = requests.join(F.broadcast(sent), "batch", "left") if not sent.isEmpty() else requests.withColumn("service_id", F.lit(None).cast("string"))
        r = r.join(replies.select("custom_id", "reply", F.lit(True).alias("_back")), "custom_id", "left")
        state = F.when(F.col("reply").isNotNull(), "answered").when(F.col("_back"), "missing").when(F.col("service_id").isNotNull(), "sent").otherwise("written")
        return r.select("custom_id", "doc_id", "group", "fingerprint", "batch", "service_id", state.alias("state"), "reply")

    # --- steps

    def plan(self, requests: DataFrame) -> int:
        """Puts those of ``requests`` (doc_id, group, ...) that have no state yet in batches and commits that; how many there were.

        Rows that repeat a document and group are one request; nulls are the empty text.
        """
        named = requests.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("doc_id", "group"))).distinct()
        named = named.withColumn("custom_id", custom_ids(F.col("doc_id"), F.col("group")))
        new = named.join(self.tables.read("requests").select("custom_id"), "custom_id", "left_anti")
        n = new.count()
        if not n:
            return 0
        deal = F.concat_ws("-", F.lit(uuid.uuid4().hex), F.lit(-(-n * 20 // (19 * self.size))).cast("string"))
        own = Window.partitionBy("_part").orderBy("custom_id")
        dealt = new.withColumn("_part", _part(deal, F.col("custom_id")))
        place = F.concat_ws("-", "_part", F.floor((F.row_number().over(own) - 1) / self.size).cast("string"))
        self.tables.put({"requests": dealt.select("custom_id", "doc_id", "group", place.alias("batch"), F.lit(self.fingerprint).alias("fingerprint"))})
        return n

    def reconcile(self, known: DataFrame) -> int:
        """Notes batches that the service has and the table does not: ``known`` has (service_id, custom_id) of its requests.

        For services that don't keep a batch's key.  Returns how many batches were found.
        """
        open_ = self.latest().where("state = 'written'").select("custom_id", "batch")
        found = open_.join(known, "custom_id").select("batch", "service_id").groupBy("batch").agg(F.min("service_id").alias("service_id"))
        staged = self.tables.stage()
        n = staged.write("sent", found).count()
        if n:
            staged.commit()
        return n

    def send(self, requests: DataFrame, service: Service) -> int:
        """Sends the batches that are written and not sent; ``requests`` has (doc_id, group, body).  How many batches there were.

        A task asks the service for its batch's key first, so one that is run again sends nothing twice.  A request whose
        body is gone is sent with an empty one.
        """
        todo = self.latest().where("state = 'written'").select("custom_id", "batch")
        bodies = requests.select(custom_ids(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "group"))).alias("custom_id"), F.coalesce(F.col("body").cast("string"), F.lit("")).alias("body"))
        if todo.where(~F.col("batch").rlike(_NAMED)).isEmpty():
            # a body's part is known without its batch: bodies are dealt once, to the part, and repeated ones are one there
            deals = todo.select(F.substring_index("batch", "-", 2).alias("deal")).distinct()
            bodies = bodies.join(F.broadcast(deals)).select(_part(F.col("deal"), F.col("custom_id")).alias("part"), "custom_id", "body")
            bodies = bodies.repartition("part").groupBy("part", "custom_id").agg(F.min("body").alias("body"))
            todo = todo.withColumn("part", F.substring_index("batch", "-", 3))
        else:  # batches that an earlier version named
            named = todo.select(F.col("custom_id").alias("custom_id"), F.col("batch").alias("part"))
            bodies = named.join(bodies, "custom_id").groupBy("part", "custom_id").agg(F.min("body").alias("body"))
            todo = todo.withColumn("part", F.col("batch"))

        def one(left, right):
            import pandas as pd

            rows = left[["custom_id", "batch"]].merge(right[["custom_id", "body"]], "left", "custom_id")
            out = []
            for name, frame in rows.groupby("batch"):
                held = service.find(name) or service.submit(name, list(zip(frame["custom_id"], frame["body"].fillna(""), strict=True)))
                out.append((name, held))
            return pd.DataFrame(out, columns=["batch", "service_id"], dtype=object)

        staged = self.tables.stage()
        sent = staged.write("sent", todo.groupBy("part").cogroup(bodies.groupBy("part")).applyInPandas(one, STATES["sent"]))
        n = sent.count()
        if n:
            staged.commit()
        return n

    def collect(self, service: Service, wait: float = 30.0, most: float = 86_400.0) -> int:
        """Waits for the batches that are sent and commits their replies; what never came is committed as missing.  How many replies came."""
        began = time.monotonic()
        requests, sent, back = (self.tables.read(t) for t in ("requests", "sent", "replies"))
        open_ = sent.join(back.select("batch").distinct(), "batch", "left_anti")
        left = sorted((r["batch"], r["service_id"]) for r in open_.collect())  # one row a batch
        if not left:
            return 0
        while late := [s for _, s in left if not service.ended(s)]:
            if time.monotonic() - began > most:
                raise Refused(f"batch {late[0]} has not ended; run again to go on")
            time.sleep(wait)

        def read(batches):
            import pandas as pd

            for frame in batches:
                for name, held in zip(frame["batch"], frame["service_id"], strict=True):
                    got = pd.DataFrame(service.results(held), columns=["custom_id", "reply"])
                    yield got.drop_duplicates("custom_id").assign(batch=name)[["custom_id", "batch", "reply"]]

        ended = self.spark.createDataFrame(left, STATES["sent"]).repartition(min(len(left), 1_000))
        got = ended.mapInPandas(read, STATES["replies"])
        whole = requests.join(F.broadcast(ended.select("batch")), "batch", "left_semi").select("custom_id", "batch").join(got.drop("batch"), "custom_id", "left")
        staged = self.tables.stage()
        rows = staged.write("replies", whole)
        try:
            staged.commit("replies-" + hashlib.sha256("|".join(b for b, _ in left).encode()).hexdigest())
        except Conflict:  # another run collected the same batches
            return 0
        return rows.where("reply IS NOT NULL").count()


class FolderService:
    """A batch service kept in a folder that all executors see: what tests and replays send to.

    ``answer`` maps (custom_id, body) to a reply or None.  Every submission is a file that comes into place at once, so that a
    test can count how often a batch was sent.
    """

    def __init__(self, folder: str, answer):
        self.folder, self.answer = folder, answer

    def _open(self):
        from verdigris.sources.documents import open_folder

        return open_folder(self.folder)

    def find(self, key: str) -> str | None:
        from pyarrow import fs

        system, root = self._open()
        there = system.get_file_info(fs.FileSelector(f"{root}/batches/{key}", allow_not_found=True))
        return min((f"{key}/{i.base_name.removesuffix('.json')}" for i in there), default=None)

    def submit(self, key: str, requests: list[tuple[str, str]]) -> str:
        import json

        system, root = self._open()
        mark = uuid.uuid4().hex
        for part in (f"batches/{key}", "arriving"):
            system.create_dir(f"{root}/{part}", recursive=True)
        with system.open_output_stream(f"{root}/arriving/{mark}") as out:
            out.write(json.dumps([list(r) for r in requests]).encode())
        system.move(f"{root}/arriving/{mark}", f"{root}/batches/{key}/{mark}.json")
        return f"{key}/{mark}"

    def ended(self, service_id: str) -> bool:
        return True

    def results(self, service_id: str) -> list[tuple[str, str | None]]:
        import json

        system, root = self._open()
        with system.open_input_stream(f"{root}/batches/{service_id}.json") as file:
            return [(c, self.answer(c, body)) for c, body in json.loads(file.read())]

    def submissions(self, spark: SparkSession) -> DataFrame:
        """(custom_id, times): how often each request was sent."""
        rows = spark.read.text(f"{self.folder}/batches/*", wholetext=True).select(F.explode(F.from_json("value", "array<array<string>>")).alias("request"))
        return rows.groupBy(F.get("request", F.lit(0)).alias("custom_id")).agg(F.count(F.lit(1)).alias("times"))
