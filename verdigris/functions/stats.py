"""Statistics as column expressions, and hashed resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.sources.commits import scratch

#: Rows whose values, 8 bytes each, are sent to every task at most, rows in a pack of them, and draws of a task at most.
SENT, PACK, DRAWS = 4_000_000, 1024, 4_000_000
_ROW_BITS = 33  # monotonically_increasing_id counts rows below this bit and partitions above it
#: The normal quantile of a two-sided 95 % interval.
Z = 1.959963984540054
#: Support, half width of the interval of a recall near 0.8, and what such a number can carry.
READABLE = ((5, 0.29, "presence check only"), (10, 0.22, "detecting total failure"), (30, 0.14, "coarse comparison"), (50, 0.11, "a number with a caveat"), (100, 0.08, "a number"))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return p, r, ratio(2 * p * r, p + r)


def wilson(hits: Column, total: Column) -> tuple[Column, Column]:
    """Lower and upper end of the score interval, in [0, 1]; (0, 1) without a total."""
    n = total.cast("double")
    share = F.try_divide(hits.cast("double"), n)
    scale = 1 + Z * Z / n
    centre = (share + Z * Z / (2 * n)) / scale
    half = Z / scale * F.sqrt(share * (1 - share) / n + Z * Z / (4 * n * n))
    return F.when(total > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0), F.when(total > 0, F.least(F.lit(1.0), centre + half)).otherwise(1.0)


def wilson_half_width(hits: Column, total: Column) -> Column:
    low, high = wilson(hits, total)
    return (high - low) / 2


def readable_at(support: Column) -> Column:
    """The strongest claim that so many examples can carry."""
    out = F.when(support < READABLE[0][0], "not measurable")
    for (_, _, phrase), (above, _, _) in zip(READABLE, READABLE[1:]):
        out = out.when(support < above, phrase)
    return out.otherwise(READABLE[-1][2])


def half_width_table() -> str:
    """The table as Markdown."""
    rows = [f"| {n} | ±{round(100 * w)} points | {phrase} |" for n, w, phrase in READABLE]
    return "\n".join(["| examples | half width | reads as |", "| --- | --- | --- |", *rows])


def documents_needed(support: Column, total: Column, target: int) -> Column:
    """Documents to draw so that a class of this prevalence reaches ``target``; null if it was never seen."""
    return F.when(support > 0, F.ceil(target * total / support))


def index_of(seed: int, replicate: Column, draw: Column, n: Column) -> Column:
    """The row, from 0, that a draw of a replicate takes: the same on any cluster."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), replicate.cast("string"), draw.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % n


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``at``, their place from 0 in an order: ranges are sorted apart and shifted by the sizes of those before.

    The ranges are written once and read for both, so that sizes and places come from the same ranges.  Rows that are equal
    in ``order`` follow each other in any way.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    path = scratch(spark, "numbered")
    ranged.write.parquet(path)
    held = spark.read.schema(ranged.schema).parquet(path).withColumn("_part", F.shiftright("_row", _ROW_BITS))
    counts = held.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    return held.join(F.broadcast(before), "_part").withColumn("at", F.col("_before") + F.col("_row").bitwiseAND(2**_ROW_BITS - 1)).drop("_part", "_row", "_before")


def draws(spark: SparkSession, resamples: int, n: int, seed: int) -> DataFrame:
    """(r, i): the row ``i`` of ``n`` that each draw of each of ``resamples`` replicates takes."""
    parts = max(spark.sparkContext.defaultParallelism, -(-resamples * n // DRAWS))
    grid = spark.range(0, resamples * n, 1, parts).select(F.expr(f"id div {max(n, 1)}").alias("r"), (F.col("id") % max(n, 1)).alias("k"))
    return grid.select("r", index_of(seed, F.col("r"), F.col("k"), F.lit(max(n, 1))).alias("i"))


def drawn(rows: DataFrame, resamples: int, n: int, seed: int) -> DataFrame:
    """(r, v, times): the values that each of ``resamples`` replicates draws from ``rows`` (i, v), numbered from 0 to ``n``.

    The values of up to ``SENT`` rows go to every task in packs of ``PACK``, so that no draw is shuffled and ``times`` is 1.
    Of more, draws are counted by replicate and row before they are joined.
    """
    each = draws(rows.sparkSession, resamples, n, seed)
    if n > SENT:
        return each.groupBy("r", "i").agg(F.count(F.lit(1)).alias("times")).join(rows, "i").select("r", "v", "times")
    packs = rows.groupBy(F.expr(f"i div {PACK}").alias("pack")).agg(F.array_sort(F.collect_list(F.struct("i", "v")))["v"].alias("values"))
    return each.withColumn("pack", F.expr(f"i div {PACK}")).join(F.broadcast(packs), "pack").select("r", F.get("values", F.col("i") % PACK).alias("v"), F.lit(1).cast("long").alias("times"))


def bootstrap_interval(values: DataFrame, value: str, key: str, resamples: int = 2000, seed: int = 0) -> DataFrame:
    """(low, high, n): percentile interval of the mean of ``value``, by resampling rows with replacement.

    Rows are numbered by ``key``; a replicate's draws take their values by number.  The grid is resamples times rows, and
    grows as they do.  No rows give (0, 0, 0).
    """
    spark = values.sparkSession
    rows = numbered(values.select(F.col(value).cast("double").alias("v"), F.col(key).alias("_key")), F.col("_key")).select("v", F.col("at").alias("i"))
    n = values.count()
    if n == 0:
        return spark.range(1).select(F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.lit(0).cast("long").alias("n"))
    means = drawn(rows, resamples, n, seed).groupBy("r").agg((F.sum(F.col("times") * F.col("v")) / n).alias("mean"))
    ends = means.agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    return ends.select(F.col("p")[0].alias("low"), F.col("p")[1].alias("high"), F.lit(n).cast("long").alias("n"))
