"""Mixing sources to target weights by hierarchical budgeting.

Documents are leaves' stock in a tree domain > language > source.  A token budget is split among domains by weight, each
domain's among its languages, each language's among its sources.  A node can take no more than its leaves hold over
``max_epochs`` passes; what it can't take goes to its siblings by weight, and only what none of them can take goes up to
its parent's siblings.  Each leaf then takes a prefix of its documents in seeded order: whole epochs first, then documents of
the next epoch while their tokens fit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import WORD, drop_written, free_name, small_side, written

LEVELS = ("domain", "lang", "source")
#: Documents in a bucket of the seeded order, on average; sums run over buckets, then within one.
BUCKET_ROWS = 256


def token_count(text: Column) -> Column:
    """Words of the text; what a caller's tokenizer counts can be given instead."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: int, epoch: Column, key: Column) -> Column:
    """Sort key of a document in an epoch: the same on any cluster."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))))


def weight_column(weights: dict[str, float] | None, name: str) -> Column:
    """Weight of a node: given by its name, 0 for a name that is not given; 1 for all if no weights are."""
    if weights is None:
        return F.lit(1.0)
    pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(name)), F.lit(0.0)) if pairs else F.lit(0.0)


def pour(parents: list[str], budget: str, capacity: str, weight: str, key: str) -> Column:
    """Share of ``budget`` for each child of a parent: the level at which weights fill up children to their capacities.

    A child gets min(capacity, level * weight).  With children in order of capacity per weight, the level is the largest of
    (budget left after the children before are full) / (weights that are left).
    """
    ratio = F.try_divide(F.col(capacity), F.col(weight))
    order = Window.partitionBy(*parents).orderBy(ratio.asc_nulls_last(), key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy(*parents).orderBy(ratio.asc_nulls_last(), key).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = F.try_divide(F.col(budget) - (F.sum(capacity).over(order) - F.col(capacity)), F.sum(weight).over(back))
    return level


def leaf_budgets(leaves: DataFrame, total: int, weights: dict[str, dict[str, float] | None], max_epochs: int = 1) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with ``budget``: whole tokens, at most ``tokens * max_epochs``.

    Work is in windows over the leaves of one parent; the leaf table is as long as there are leaves.
    """
    now = leaves.withColumn("cap2", (F.col("tokens") * max_epochs).cast("double"))
    for i, name in enumerate(LEVELS):
        now = now.withColumn(f"w{i}", weight_column(weights.get(name), name))
    now = now.withColumn("cap2", F.when((F.col("w0") > 0) & (F.col("w1") > 0) & (F.col("w2") > 0), F.col("cap2")).otherwise(0.0))
    languages = now.groupBy("domain", "lang").agg(F.sum("cap2").alias("cap1"), F.first("w0").alias("w0"), F.first("w1").alias("w1"))
    domains = languages.groupBy("domain").agg(F.sum("cap1").alias("cap0"), F.first("w0").alias("w0"))

    def shared(df: DataFrame, parents: list[str], budget: str, i: int) -> DataFrame:
        name = LEVELS[i]
        can = df.withColumn("weight", F.when(F.col(f"cap{i}") > 0, F.col(f"w{i}")).otherwise(0.0))
        level = can.withColumn("level", F.when(F.col("weight") > 0, pour(parents, budget, f"cap{i}", "weight", name)))
        return level.withColumn("level", F.max("level").over(Window.partitionBy(*parents))).withColumn(f"b{i}", F.coalesce(F.least(F.col(f"cap{i}"), F.greatest(F.col("level"), F.lit(0.0)) * F.col("weight")), F.lit(0.0))).drop("level", "weight")

    d = shared(domains.withColumns({"all": F.lit(0), "total": F.lit(float(total))}), ["all"], "total", 0).select("domain", "b0")
    g = shared(languages.join(d, "domain"), ["domain"], "b0", 1).select("domain", "lang", "b1")
    s = shared(now.join(g, ["domain", "lang"]), ["domain", "lang"], "b1", 2)
    return s.select(*leaves.columns, F.floor(F.col("b2") + 1e-6).cast("long").alias("budget"))


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, float] | None], share: float | None = None, total: int | None = None, max_epochs: int = 1, seed: int = 1, tokens: Column | None = None, doc_id: str = "doc_id", lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``docs``, one row for each time a row is taken, with ``domain``, ``n_tokens`` and ``epoch`` (0, 1, ...).

    The budget is ``total`` tokens, or ``share`` of all tokens in ``docs``.  A leaf's prefix never exceeds its budget, and rows
    with equal doc_id are drawn together.  Null domains, languages and sources are the name ``''``; null text has no tokens
    and is taken with the rows around it; a leaf without weight or stock gives nothing; no rows give no rows; new columns
    whose names are taken get underscores in front.

    A document's place is found by token sums of hashed stretches of a leaf's order, then within its stretch, so a leaf with
    a third of all rows is spread.  Text is not shuffled: a leaf's prefix ends at one sort key, and rows are compared with it.
    """
    own = {n: free_name(docs, n) for n in ("_leaf", "_tokens", "_key", "_cut", "domain", "n_tokens", "epoch")}
    leaf = F.struct(F.coalesce(domain.cast("string"), F.lit("")).alias("domain"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"))
    counted = tokens if tokens is not None else token_count(F.col(text))
    stock = written(docs.select(leaf.alias("leaf"), counted.cast("long").alias("tokens"), F.col(doc_id).alias("doc")).select("leaf.*", "tokens", "doc"), "stock")
    leaves = stock.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    leaves = written(leaves, "leaves")
    sums = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.coalesce(F.sum("rows"), F.lit(0)).alias("r"), F.count(F.lit(1)).alias("n")).first()
    budget = int(total if total is not None else math.floor(sums["t"] * share))
    plan = leaf_budgets(leaves, budget, weights, max_epochs)
    plan = plan.select(*LEVELS, F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.when(F.col("budget") > 0, 1).otherwise(0)).alias("full"), F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0).alias("rest"))
    plan = written(plan, "plan")

    # 16 ** digits stretches of a leaf at most, whose sums one task adds up
    digits = min(3, max(1, math.ceil(math.log(max(sums["r"], 1) / BUCKET_ROWS, 16)))) if sums["r"] > BUCKET_ROWS else 1
    part = stock.join(small_side(plan.where("rest > 0"), 200, sums["n"]), list(LEVELS)).withColumn("key", draw(seed, F.col("full"), F.col("doc")))
    part = part.groupBy(*LEVELS, "rest", "key").agg(F.sum("tokens").alias("tokens")).withColumn("stretch", F.substring("key", 1, digits))
    size = part.groupBy(*LEVELS, "stretch").agg(F.sum("tokens").alias("n"))
    before = size.select(*LEVELS, "stretch", (F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("stretch")) - F.col("n")).alias("before"))
    inside = part.withColumn("upto", F.sum("tokens").over(Window.partitionBy(*LEVELS, "stretch").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    cut = inside.join(before, [*LEVELS, "stretch"]).where(F.col("before") + F.col("upto") <= F.col("rest")).groupBy(*LEVELS).agg(F.max("key").alias("cut"))
    ends = plan.join(cut, list(LEVELS), "left").where("full > 0 or cut is not null").select(F.struct(*LEVELS).alias(own["_leaf"]), F.struct("full", "cut").alias(own["_cut"]))
    ends = written(ends, "ends")
    for t in (stock, leaves, plan):
        drop_written(t)

    out = docs.withColumns({own["_leaf"]: leaf, own["n_tokens"]: counted.cast("long")}).join(small_side(ends, 200, sums["n"]), own["_leaf"])
    cut_, full = F.col(f"{own['_cut']}.cut"), F.col(f"{own['_cut']}.full")
    out = out.withColumn(own["_key"], draw(seed, full, F.col(doc_id)))
    times = full + F.when(cut_.isNotNull() & (F.col(own["_key"]) <= cut_), 1).otherwise(0)
    out = out.withColumn(own["epoch"], F.explode(F.when(times > 0, F.sequence(F.lit(0), (times - 1).cast("int"))).otherwise(F.array().cast("array<int>"))))
    return out.withColumn(own["domain"], F.col(f"{own['_leaf']}.domain")).select(*docs.columns, own["domain"], own["n_tokens"], own["epoch"])
