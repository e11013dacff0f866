"""What the operators share: reading tables, a shared working folder, text rules, connected components."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of anything but ASCII white space is a word.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Where written tables go if the session names no folder and everything runs in one process, as in tests.
_LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"
#: Spark deletes an execution's shuffle files when it ends, instead of when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    A local master without the setting gets a folder of its own; a cluster without it is an error, since a machine's own
    folder would hold only part of a table.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _LOCAL_CHECKPOINTS


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/verdigris/{label}-{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**{"compression": "zstd", **options}).parquet(path)
    finally:
        if was is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._verdigris_path = path
    return out


#: Rows of an Arrow batch that holds whole texts: both sides of the pipe hold a batch or two at a time.
TEXT_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(spark: SparkSession) -> None:
    """From now on the session sends at most ``TEXT_ROWS`` rows a batch to Python; a smaller setting stays."""
    was = int(spark.conf.get(_BATCH))
    if was <= 0 or was > TEXT_ROWS:
        spark.conf.set(_BATCH, str(TEXT_ROWS))


def drop_written(df: DataFrame) -> None:
    """Delete a table made by :func:`written`; the frame must not be read again."""
    path = getattr(df, "_verdigris_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def parts_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone, so that every engine agrees."""
    return F.translate(c, UPPER, LOWER)


#: Nodes that a task's forest holds before it is sent on, and edges that one task takes by itself.
FOREST_NODES, FEW_EDGES = 500_000, 100_000


def _forest(rows):
    """Union-find over a task's edges: each node once with its root, so that what is shuffled hardly exceeds the nodes met.

    With ``FOREST_NODES`` nodes the forest so far goes out and a new one begins; joined forests connect what the edges do.
    """
    import numpy as np
    import pyarrow as pa

    parent: dict[int, int] = {}

    def root(x):
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top and x != top:
            parent[x] = top
            x = up
        return top

    def out():
        nodes = np.fromiter(parent, dtype=np.int64, count=len(parent))
        roots = np.fromiter((root(x) for x in parent), dtype=np.int64, count=len(parent))
        keep = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], names=["u", "v"])

    for batch in rows:
        if len(parent) > FOREST_NODES:
            yield out()
            parent.clear()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    yield out()


def components(edges: DataFrame, a: str, b: str, label: str = "cc") -> DataFrame:
    """Connected components of the undirected ``edges``: rows (node long, component_id long = smallest node reachable).

    Each task first reduces its edges to a spanning forest; if at most ``FEW_EDGES`` edges are left, one task joins them, else
    rounds of large-star and small-star hang every node
    on a smaller one until nothing changes.  A round shuffles by node with a map-side ``min``, so a hub is one small sum
    per task; lineage is cut by a table in the shared folder after each round.  Nulls and loops are ignored; no edges
    give no rows.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = e.mapInArrow(_forest, "u long, v long").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = written(e.distinct(), label)
    before = mark(now)
    if before[0] <= FEW_EDGES:  # one task's forest is the answer
        few, now = now, written(now.coalesce(1).mapInArrow(_forest, "u long, v long"), label)
        drop_written(few)
        before = (0, None)
    while before[0]:
        # large-star: neighbours larger than a node go to the smallest of its neighbourhood
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        new = written(star.where("u <> v").distinct(), label)
        drop_written(now)
        now, last = new, before
        before = mark(now)
        if before == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component_id")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct())


#: A side is broadcast only if its rows, counted, take no more than this.
BROADCAST_BYTES = 32_000_000


def small_side(df: DataFrame, row_bytes: int, n_rows: int | None = None, arrays: tuple[str, ...] = ()) -> DataFrame:
    """``df`` hinted for broadcast if its bytes, summed, are few, else as it is: the join then shuffles and may split skew.

    ``row_bytes`` is what a row takes beside ``arrays``, whose elements are counted at eight bytes or the array's own
    struct's fields at eight bytes each.
    """
    if n_rows is not None and not arrays:
        size = n_rows * row_bytes
    else:
        width = {f.name: 8 * max(1, len(getattr(getattr(f.dataType, "elementType", None), "fields", None) or [0])) for f in df.schema.fields}
        each = F.lit(row_bytes)
        for name in arrays:
            each = each + F.greatest(F.size(name), F.lit(0)) * width[name]
        size = df.agg(F.coalesce(F.sum(each.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df.hint("merge")


def least_frequent_of(df: DataFrame, count: str, most: int) -> int:
    """The least power of two that at most ``most`` rows of ``df`` reach in ``count``: what is above may be broadcast.

    Rows are counted by powers of two, so at most 64 numbers come to the driver.
    """
    level = F.floor(F.log2(F.greatest(F.col(count), F.lit(1)))).cast("int").alias("level")
    found = {r["level"]: r["k"] for r in df.select(level).groupBy("level").agg(F.count(F.lit(1)).alias("k")).collect()}
    total, least = 0, 63
    for at in range(62, -1, -1):
        total += found.get(at, 0)
        if total > most:
            break
        least = at
    return 2**least if least < 63 else 2**63 - 1


def text_slices(column, most_bytes: int):
    """(first row, part) of an Arrow string column in parts of about ``most_bytes``; a longer text stands alone."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, side="right")))
        yield at, column.slice(at, to - at)
        at = to
