"""Seeded samples, stratified splits and class support.

Draws rank rows by a hash of key, seed and purpose, so a seed gives the same draw on any cluster and any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions import stats as St
from verdigris.functions.stats import numbered
from verdigris.plans.registry import Registry

SPLIT_SEED = 20260918
CV_MINIMUM, CV_FOLDS, CV_TRAIN = 50, 5, 0.7
SUPPORT_FLOOR, SUPPORT_TARGET = 30, 30


class BadSplit(ValueError):
    """Labels that can't be split as asked."""


def hash_rank(key: Column, seed: int, purpose: str) -> Column:
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)), F.lit(purpose)))


def draw_sample(docs: DataFrame, n: int, holdout_share: float, seed: int, key: str = "doc_id") -> DataFrame:
    """(key, is_holdout): ``n`` documents without replacement, the corpus at most; a share of them, one at least, held out.

    The sample is a top-n by hash, taken per partition first; the holdout ranks the sample alone.
    """
    few = docs.select(key).distinct().orderBy(hash_rank(F.col(key), seed, "sample"), key).limit(n)
    size = F.count(F.lit(1)).over(Window.partitionBy())
    hold = F.when(size <= 1, 0).otherwise(F.greatest(F.lit(1), F.bround(size * holdout_share).cast("int")))
    rank = F.row_number().over(Window.orderBy(hash_rank(F.col(key), seed, "holdout"), key))
    return few.select(key, (rank <= hold).alias("is_holdout"))


def to_correct(plan: DataFrame) -> DataFrame:
    return plan.where(~F.col("is_holdout")).drop("is_holdout")


def strategy(n: int) -> tuple[tuple[float, float, float], str, bool]:
    """Ratios of train, val and holdout for so many labels, their name, and whether folds apply."""
    # Splits and reports depend on these counts, ratios and names.
    if n >= 200:
        return (0.50, 0.25, 0.25), "50/25/25", False
    if n >= 100:
        return (0.45, 0.25, 0.30), "45/25/30", False
    if n >= CV_MINIMUM:
        return (CV_TRAIN, 0.0, 1 - CV_TRAIN), f"{CV_FOLDS}-fold CV on 70% / 30% holdout", True
    return (0.45, 0.25, 0.30), "45/25/30 (below the recommended minimum)", False


def class_supports(labels: DataFrame, registry: Registry, total: int, target: int = SUPPORT_TARGET) -> DataFrame:
    """(task_id, label, count, total, prevalence, half_width, readable_as, documents_needed) from (doc_id, task_id, label)."""
    got = labels.groupBy("task_id", "label").agg(F.count(F.lit(1)).alias("count"))
    c = registry.labels_frame(labels.sparkSession).join(got, ["task_id", "label"], "full_outer").select("task_id", "label", F.coalesce("count", F.lit(0)).cast("long").alias("count"), F.lit(total).cast("long").alias("total"))
    return c.withColumns({
        "prevalence": St.ratio(F.col("count"), F.col("total")), "half_width": St.wilson_half_width(F.bround(0.8 * F.col("count")), F.col("count")),
        "readable_as": St.readable_at(F.col("count")), "documents_needed": St.documents_needed(F.col("count"), F.col("total"), target),
    })


def below_floor(supports: DataFrame, floor: int = SUPPORT_FLOOR) -> DataFrame:
    """Classes under the floor, rarest first."""
    return supports.where(F.col("count") < floor).orderBy("count", "task_id", "label")


def support_prompt(support: dict) -> str:
    """What can be done about a class that is too rare to measure."""
    s = support
    need = "unknown" if s["documents_needed"] is None else str(s["documents_needed"])
    return "\n".join([f"{s['task_id']}={s['label']}: {s['count']} of {s['total']} labelled documents, {s['readable_as']}", f"1 label more: about {need} documents at this prevalence", "2 enrich: label documents that a keyword or a model nominates", "3 merge the class into another", "4 report it as unmeasured"])


def stratification_key(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, stratum): the rarest class that a document carries, or ``(no class)``; ties by task, then label."""
    rare = labels.groupBy("task_id", "label").agg(F.count(F.lit(1)).alias("n"))
    named = labels.join(rare, ["task_id", "label"]).groupBy("doc_id").agg(F.min(F.struct("n", "task_id", "label")).alias("m"))
    found = named.select(F.col("doc_id").alias(key), F.concat_ws("=", "m.task_id", "m.label").alias("stratum"))
    return docs.select(F.col(key).cast("string").alias(key)).distinct().join(found, key, "left").select(key, F.coalesce("stratum", F.lit("(no class)")).alias("stratum"))


def allocation(size: Column, ratios: tuple[float, float, float]) -> Column:
    """STRUCT<train, val> of a stratum by largest remainder; one row trains, a second validates."""
    raw = [size * r for r in ratios]
    base = [F.floor(r + 1e-9) for r in raw]
    left = size - sum(base[1:], base[0])
    order = F.array_sort(F.array(*(F.struct((-F.round(r - b, 9)).alias("r"), F.lit(i).alias("i")) for i, (r, b) in enumerate(zip(raw, base, strict=True)))))
    takes = lambda i: F.when(F.array_contains(F.transform(F.slice(order, 1, F.greatest(left, F.lit(0)).cast("int")), lambda s: s["i"]), F.lit(i)), 1).otherwise(0)
    return F.struct(F.when(size < 3, 1).otherwise(base[0] + takes(0)).cast("int").alias("train"), F.when(size == 1, 0).when(size == 2, 1).otherwise(base[1] + takes(1)).cast("int").alias("val"))


def assign_splits(strata: DataFrame, ratios: tuple[float, float, float], seed: int = SPLIT_SEED, key: str = "doc_id") -> DataFrame:
    """(key, stratum, split): ranks by hash within each stratum against its allocation."""
    w = Window.partitionBy("stratum")
    ranked = strata.withColumns({"n": F.count(F.lit(1)).over(w), "at": F.row_number().over(w.orderBy(hash_rank(F.col(key), seed, "split"), key))})
    a = ranked.withColumn("a", allocation(F.col("n"), ratios))
    return a.select(key, "stratum", F.when(F.col("at") <= F.col("a.train"), "train").when(F.col("at") <= F.col("a.train") + F.col("a.val"), "val").otherwise("holdout").alias("split"))


def repaired(splits: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Splits where no class is in the holdout alone: the smallest such class gives its first carrier to train, until there is none.

    What reaches the driver is each orphan class's first carrier and the orphan classes that those carry.
    """
    spark = splits.sparkSession
    where = labels.join(splits.select(F.col(key).alias("doc_id"), "split"), "doc_id")
    tally = where.groupBy("task_id", "label").agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "holdout").alias("hold"))
    orphans = tally.where("train = 0 and hold > 0").select("task_id", "label")
    carriers = where.where(F.col("split") == "holdout").join(F.broadcast(orphans), ["task_id", "label"]).select("task_id", "label", F.col("doc_id").cast("string").alias("doc_id")).distinct()
    per = {(r["task_id"], r["label"]): (r["n"], r["doc"]) for r in carriers.groupBy("task_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc")).collect()}
    firsts = spark.createDataFrame(sorted({(doc,) for _, doc in per.values()}), "doc_id string")
    held = {r["doc_id"]: {(c["task_id"], c["label"]) for c in r["classes"]} for r in carriers.join(F.broadcast(firsts), "doc_id").groupBy("doc_id").agg(F.collect_set(F.struct("task_id", "label")).alias("classes")).collect()}
    moved: list[str] = []
    while per:
        doc = per[min(per, key=lambda k: (per[k][0], k))][1]
        moved.append(doc)
        per = {k: v for k, v in per.items() if k not in held[doc]}
    if not moved:
        return splits
    gives = F.broadcast(spark.createDataFrame([(m,) for m in moved], "_moved string"))
    out = splits.join(gives, F.col(key).cast("string") == F.col("_moved"), "left")
    return out.withColumn("split", F.when(F.col("_moved").isNotNull(), "train").otherwise(F.col("split"))).drop("_moved")


def with_folds(splits: DataFrame, seed: int = SPLIT_SEED, folds: int = CV_FOLDS, key: str = "doc_id") -> DataFrame:
    """Splits with ``fold`` for rows outside the holdout; the last fold validates."""
    free = splits.where(F.col("split") != "holdout").select(key)
    pool = numbered(free, hash_rank(F.col(key), seed, "fold"), F.col(key)).select(key, (F.col("at") % folds).alias("fold"))
    out = splits.join(pool, key, "left")
    return out.withColumn("split", F.when(F.col("fold") == folds - 1, "val").when(F.col("fold").isNotNull(), "train").otherwise(F.col("split")))


def make_splits(docs: DataFrame, labels: DataFrame, seed: int = SPLIT_SEED, fixed_holdout: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(key, split, fold) of all labelled documents: by size, stratified by rarest class, repaired, folded under cross-validation."""
    n = docs.select(key).distinct().count()
    ratios, _, folded = strategy(n)
    strata = stratification_key(docs, labels, key)
    if fixed_holdout is not None:
        held = fixed_holdout.select(F.col(key).cast("string").alias(key)).distinct()
        pool = strata.join(held, key, "left_anti")
        free = ratios[0] + ratios[1]
        out = assign_splits(pool, (ratios[0] / free, ratios[1] / free, 0.0), seed, key).unionByName(strata.join(held, key, "left_semi").withColumn("split", F.lit("holdout")))
    else:
        out = assign_splits(strata, ratios, seed, key)
    if folded:
        # folds come first, so that the repair sees the final train
        return repaired(with_folds(out.drop("stratum"), seed, key=key), labels, key)
    return repaired(out.drop("stratum"), labels, key).withColumn("fold", F.lit(None).cast("int"))


def verify_splits(docs: DataFrame, splits: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, problem): documents not placed exactly once."""
    want = docs.select(F.col(key).cast("string").alias(key)).distinct().withColumn("there", F.lit(1))
    got = splits.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    both = want.join(got, key, "full_outer")
    return both.select(key, F.when(F.col("there").isNull(), "not labelled").when(F.col("n").isNull(), "not placed").when(F.col("n") > 1, "placed more than once").alias("problem")).where("problem is not null")


def optimization_pool(splits: DataFrame) -> DataFrame:
    return splits.where(F.col("split").isin("train", "val"))


def keyword_stratum(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.where(F.col(text).rlike(f"(?i){pattern}")).select(key)


def model_stratum(labels: DataFrame, task_id: str, label: str) -> DataFrame:
    """Documents that a model's labels (doc_id, task_id, label) nominate."""
    return labels.where((F.col("task_id") == task_id) & (F.col("label") == label)).select("doc_id").distinct()


def plan_enrichment(candidates: DataFrame, labelled: DataFrame, n: int, seed: int, key: str = "doc_id") -> DataFrame:
    """(key, inclusion_probability): up to ``n`` candidates that aren't labelled yet, by hash."""
    free = candidates.select(key).distinct().join(labelled.select(key), key, "left_anti")
    drawn = free.orderBy(hash_rank(F.col(key), seed, "enrich"), key).limit(n)
    total = free.agg(F.count(F.lit(1)).alias("available"))
    return drawn.join(F.broadcast(total)).select(key, St.ratio(F.least(F.lit(n), F.col("available")), F.col("available")).alias("inclusion_probability"))


def weights_of(labels: DataFrame, probability: str = "inclusion_probability") -> DataFrame:
    """``labels`` with ``weight``, one over the probability; a probability that is not positive is an error."""
    p = F.col(probability)
    return labels.withColumn("weight", F.when(p.isNull(), 1.0).when(p > 0, 1 / p).otherwise(F.raise_error(F.concat(F.lit("inclusion probability is not positive: "), p.cast("string")))))


def sample_errors(facts: DataFrame, n: int = 3, seed: int = 0) -> DataFrame:
    """Up to ``n`` wrong documents per task, by hash."""
    rank = F.row_number().over(Window.partitionBy("task_id").orderBy(hash_rank(F.concat_ws(":", "task_id", "doc_id"), seed, "errors"), "doc_id"))
    return facts.where(~F.col("correct")).withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")


def select_records(records: DataFrame, ids: DataFrame, key: str = "doc_id", position: str = "position") -> DataFrame:
    """Records of the ids (key, position), in that order; one that has no record is an error."""
    joined = ids.join(records.withColumn("_there", F.lit(True)), key, "left")
    checked = joined.withColumn("_there", F.when(F.col("_there"), True).otherwise(F.raise_error(F.concat(F.lit("no record for "), F.col(key).cast("string")))))
    return checked.where("_there").drop("_there").orderBy(position)


def build_examples(labels: DataFrame, texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Labels with their texts; a label without a text is an error."""
    t = texts.select(F.col(key), F.col("text"))
    out = labels.join(t.withColumn("_there", F.lit(True)), key, "left")
    return out.withColumn("text", F.when(F.col("_there"), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("no text for "), F.col(key).cast("string"))))).drop("_there")


def class_coverage_order(labels: DataFrame, docs: DataFrame, registry: Registry, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """(key, front, place): documents in order of ``front`` and ``place``, carriers of every class first, as few as that takes in
    order of the classes; then the rest by hash.

    A carrier per class is what reaches the driver; places of the rest are hashes, to be sorted by.
    """
    spark = labels.sparkSession
    rank = Window.partitionBy("task_id", "label").orderBy(hash_rank(F.col("doc_id"), seed, "cover"), "doc_id")
    first = labels.withColumn("r", F.row_number().over(rank)).where("r = 1")
    carried = {(r["task_id"], r["label"]): r["doc_id"] for r in first.collect()}
    has = labels.join(F.broadcast(first.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.collect_set(F.struct("task_id", "label")).alias("c"))
    classes = {r["doc_id"]: {(c["task_id"], c["label"]) for c in r["c"]} for r in has.collect()}
    front: list[str] = []
    done: set[tuple[str, str]] = set()
    for t in registry:
        for label in t.labels:
            if (doc := carried.get((t.id, label))) and (t.id, label) not in done:
                front.append(doc)
                done |= classes[doc]
    head = F.broadcast(spark.createDataFrame([(d, f"{i:08d}") for i, d in enumerate(front)], "_head string, _at string"))
    ids = docs.select(F.col(key).cast("string").alias(key)).distinct()
    out = ids.join(head, F.col(key) == F.col("_head"), "left")
    return out.select(key, F.col("_head").isNotNull().alias("front"), F.coalesce("_at", hash_rank(F.col(key), seed, "order")).alias("place"))


def demo_class_coverage(labels: DataFrame, demos: DataFrame, registry: Registry) -> DataFrame:
    """(task_id, label, n_demos, shown): how many demonstrations (doc_id) carry each declared class of labels (doc_id, task_id, label)."""
    seen = labels.join(F.broadcast(demos.select("doc_id").distinct()), "doc_id", "left_semi").groupBy("task_id", "label").agg(F.count_distinct("doc_id").alias("n"))
    out = registry.labels_frame(labels.sparkSession).join(seen, ["task_id", "label"], "left").withColumn("n_demos", F.coalesce("n", F.lit(0)))
    return out.select("task_id", "label", "n_demos", (F.col("n_demos") > 0).alias("shown"))


def coverage_notes(coverage: DataFrame) -> list[str]:
    """A line for each class that no demonstration shows."""
    return [f"{r['task_id']}: no demonstration shows {r['label']}" for r in coverage.where("not shown").orderBy("task_id", "label").collect()]


def support_decision(folder: str, task_id: str, label: str, choice: str, reason: str = "") -> dict:
    """Records what was decided about a rare class, beside the project's other decisions; a merge or a report needs no reason."""
    import json
    from pathlib import Path

    if choice not in ("label", "enrich", "merge", "report"):
        raise ValueError("a rare class is labelled more, enriched, merged or reported")
    entry = {"task_id": task_id, "label": label, "choice": choice, "reason": reason}
    path = Path(folder) / "support_decisions.json"
    kept = json.loads(path.read_text(encoding="utf-8")) if path.exists() else []
    kept = [k for k in kept if (k["task_id"], k["label"]) != (task_id, label)] + [entry]
    path.write_text(json.dumps(kept, indent=1), encoding="utf-8")
    return entry
