"""Golden numbers by hand, policies, splits, gates."""

import pytest
from pyspark.sql import functions as F

from verdigris.functions import stats as St
from verdigris.operators import facts as Fa
from verdigris.operators import gates as G
from verdigris.operators import metrics as Me
from verdigris.operators import sampling as Sa
from verdigris.plans.registry import BadDeclaration, Registry

TASKS = Registry.of({"tasks": [
    {"id": "signed", "type": "binary", "question": "Signed?"},
    {"id": "state", "type": "multiclass", "question": "State?", "output": {"enum": ["CA", "NY", "TX"]}},
    {"id": "number", "type": "extract_exact", "question": "Number?"},
]})
ROWS = [
    ("a", ("yes", "CA", "1"), ("yes", "CA", "1")),
    ("b", ("no", "NY", "2"), ("yes", "ny", "2")),
    ("c", ("yes", "TX", None), ("n/a", "Ohio", "9")),
    ("d", ("no", None, "4"), ("no", None, "5")),
]


@pytest.fixture(scope="module")
def pairs(spark):
    side = "struct<signed:string,state:string,number:string>"
    return spark.createDataFrame(ROWS, f"doc_id string, gold {side}, pred {side}")


def test_golden(spark, pairs):
    f = Fa.match_results(pairs, TASKS)
    assert {r["doc_id"]: round(r["aggregate"], 6) for r in Fa.example_scores(f).collect()} == {"a": 1.0, "b": round(2 / 3, 6), "c": 0.0, "d": round(2 / 3, 6)}
    c = {r["task_id"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in Me.task_counts(f).collect()}
    assert c == {"signed": (2, 1, 2, 0), "state": (2, 1, 1, 1), "number": (2, 2, 1, 0)}
    classes = {(r["task_id"], r["label"]): (r["tp"], r["fp"], r["fn"]) for r in Me.class_metrics(f, TASKS).collect()}
    assert classes["state", "ohio"] == (0, 1, 0) and classes["state", "TX"] == (0, 0, 1) and classes["signed", "true"] == (1, 1, 1)
    p = {r["task_id"]: r for r in Me.primary_values(f, TASKS).collect()}
    assert p["signed"]["primary"] == pytest.approx(0.5) and p["state"]["primary"] == pytest.approx((1 + 1 + 0 + 0) / 4) and p["state"]["basis"] == "classes that appear"
    low = Me.primary_values(f, TASKS, support_floor=1)
    assert {r["task_id"]: r["basis"] for r in low.collect()}["state"] == "classes above the floor"
    assert {(r["gold"], r["pred"]): r["n"] for r in Me.confusion(f).where("task_id = 'state'").collect()} == {("CA", "CA"): 1, ("NY", "NY"): 1, ("TX", "ohio"): 1, ("(null)", "(null)"): 1}
    assert Me.confusion_table(f, "state").count() == 4
    ci = {r["task_id"]: (r["low"], r["high"]) for r in Me.task_primary_interval(f, TASKS, 50).collect()}
    assert all(0 <= a <= b <= 1 for a, b in ci.values()) and len(ci) == 3


def test_policies(spark, pairs):
    f = Fa.match_results(pairs, TASKS, policy="best_guess")
    assert Me.task_counts(f).where("task_id = 'signed'").first()["fp"] == 2
    f = Fa.match_results(pairs, TASKS, excluded={"state": ["TX"], "signed": ["false"]})
    s = {r["doc_id"]: r for r in Fa.example_scores(f).collect()}
    assert s["c"]["excluded"] == ["state"] and s["b"]["aggregate"] == 1.0 and s["b"]["all_correct"] is False
    f = Fa.match_results(pairs, TASKS, failed=F.col("doc_id") == "a")
    assert {r["aggregate"] for r in Fa.example_scores(f).where("doc_id = 'a'").collect()} == {0.0}
    same = pairs.select("doc_id", "gold", F.col("gold").alias("pred"))
    assert Fa.example_scores(Fa.match_results(same, TASKS)).agg(F.min("aggregate")).first()[0] == 1.0
    assert Fa.match_results(pairs.limit(0), TASKS).count() == 0
    assert Fa.unmatched(pairs, pairs.where("doc_id <> 'a'")).collect()[0]["side"] == "gold"


@pytest.mark.parametrize("bad", [
    {"id": "x", "type": "nope", "question": "?"}, {"id": "x", "type": "binary"}, {"id": "x", "type": "binary", "question": "?", "extra": 1}, {"id": "x", "type": "multiclass", "question": "?"},
    {"id": "x", "type": "multiclass", "question": "?", "output": {"enum": ["a", "a"]}}, {"id": "x", "type": "multiclass", "question": "?", "output": {"enum": ["a"], "synonyms": {"b": "c"}}},
    {"id": "x", "type": "extract_fuzzy", "question": "?"}, {"id": "x", "type": "extract_fuzzy", "question": "?", "match": {"theta": 2}}, {"id": "x", "type": "extract_numeric", "question": "?"},
    {"id": "x", "type": "extract_date", "question": "?", "match": {"granularity": "week"}}, {"id": "x", "type": "binary", "question": "?", "weight": -1},
])
def test_bad_declarations(bad):
    with pytest.raises(BadDeclaration, match="x"):
        Registry.of({"tasks": [bad]})


@pytest.mark.parametrize("n", [30, 60, 120, 250])
def test_splits(spark, n):
    docs = spark.range(n).select(F.concat(F.lit("d"), "id").alias("doc_id"), "id")
    labels = docs.select("doc_id", F.lit("state").alias("task_id"), F.when(F.col("id") % 29 == 0, "TX").when(F.col("id") % 3 == 0, "NY").otherwise("CA").alias("label"))
    s = Sa.make_splits(docs, labels, seed=5)
    assert Sa.verify_splits(docs, s).count() == 0
    where = labels.join(s, "doc_id").groupBy("label").agg(F.collect_set("split").alias("s")).collect()
    assert all("train" in r["s"] for r in where)
    shares = {r["split"]: r["count"] / n for r in s.groupBy("split").count().collect()}
    ratios, _, folded = Sa.strategy(n)
    assert abs(shares["holdout"] - ratios[2]) < 0.11
    assert sorted(map(tuple, s.select("doc_id", "split").collect())) == sorted(map(tuple, Sa.make_splits(docs.orderBy(F.desc("id")), labels, seed=5).select("doc_id", "split").collect()))
    if folded:
        assert s.where("split <> 'holdout'").select("fold").distinct().count() == 5
    order = Sa.class_coverage_order(labels, docs, TASKS)
    ids = [r["doc_id"] for r in order.orderBy(F.desc("front"), "place").collect()]
    assert len(ids) == n and len(set(ids)) == n


def test_gates(spark, pairs):
    o = pairs.select("doc_id", F.lit(True).alias("ok"), F.col("pred").alias("values"), "gold")
    g = {r["name"]: r["passed"] for r in G.run_gates(o, TASKS, 4, o, G.null_rates(o, TASKS, "gold"), reference_values="gold").collect()}
    assert g["coverage"] and g["schema"] and not g["class distribution"] and not g["null rates"]
    worse = o.withColumn("ok", F.col("doc_id") != "a")
    g = {r["name"]: r["passed"] for r in G.run_gates(worse, TASKS, 5).collect()}
    assert not g["coverage"] and not g["schema"]
    empty = G.null_rates(o, TASKS, "gold").limit(0)
    assert not {r["name"]: r["passed"] for r in G.run_gates(o, TASKS, 4, reference_rates=empty).collect()}["null rates"]
    routes = {(r["route"], r["doc_id"]) for r in G.triage(worse, TASKS).collect()}
    assert ("failed", "a") in routes and ("random_slice", "b") in routes and ("failed", "b") not in routes
    with pytest.raises(G.GateRefused):
        G.failure_gate(worse)
    gaps = spark.createDataFrame([("t", True, False), ("u", False, True)], "task_id string, within_ci boolean, is_large boolean")
    assert G.read_gaps(gaps).first()[0] == "large_few" and G.read_gaps(gaps.where("is_large")).first()[0] == "large_widespread" and G.read_gaps(gaps.limit(0)).first()[0] == "within_ci"


def test_findings_name_tasks_far_below_validation():
    from verdigris.operators.runs import READINGS, HoldoutFindings

    gap = {"holdout": 0.4, "validation": 0.9, "gap": 0.5, "low": 0.3, "high": 0.5, "support": 12, "readable_as": "detecting total failure"}
    gaps = [{**gap, "task_id": "a", "within_ci": False, "is_large": True}, {**gap, "task_id": "b", "within_ci": True, "is_large": False}]
    rates = [{"task_id": "a", "counts": "true", "precision": 1.0, "precision_low": 0.6, "precision_high": 1.0, "recall": 0.25, "recall_low": 0.1, "recall_high": 0.5, "f1": 0.4}]
    lock = {"opened_at": "now", "opened_by": "me", "overrides": [{"at": "later", "by": "you", "reason": "a | b"}]}
    found = HoldoutFindings(0.4, "large_few", gaps, [{"task_id": "b", "measurable": False}], lock, (0.3, 0.5), 0.9, 30, rates)
    text = found.to_markdown()
    assert found.worse == ["a"] and "- a: far below validation" in text and READINGS["large_few"][1] in text and "validation 0.900, +0.500" in text
    assert "| a | 0.400 | 0.300 to 0.500 | 0.900 | +0.500 | large gap | 12 | detecting total failure |" in text and "0.100 to 0.500" in text and "- b: too few" in text and "a | b" in text


def test_draws_are_bounded_in_a_task_and_not_shuffled(spark, monkeypatch):
    assert St.draws(spark, 2000, 20_000, 1).rdd.getNumPartitions() >= 10
    values = spark.createDataFrame([(k, None if k % 7 == 0 else float(k % 5)) for k in range(3000)], "doc long, v double")
    packed = St.bootstrap_interval(values, "v", "doc", 40, 5).first()
    rows = spark.createDataFrame([(k, float(k)) for k in range(2500)], "i long, v double")
    taken = St.drawn(rows, 3, 2500, 5)
    assert "hashpartitioning(r" not in taken._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(St, "SENT", 10)
    assert St.bootstrap_interval(values, "v", "doc", 40, 5).first() == packed
    sums = lambda d: sorted(map(tuple, d.groupBy("r").agg(F.sum("times"), F.sum(F.col("times") * F.col("v"))).collect()))
    assert sums(taken) == sums(St.drawn(rows, 3, 2500, 5))


@pytest.mark.parametrize("few", [0, 10_000])
def test_interval_of_documents_with_equal_outcomes(spark, monkeypatch, few):
    """Each replicate's number from its drawn documents one by one, also with a null document and several tasks."""
    import hashlib

    monkeypatch.setattr(Me, "FEW", few)
    rows = [(d, t, "extract_exact", int((int(d or 0) * k) % 3 == 0), int((int(d or 0) * k) % 3 == 1), int((int(d or 0) * k) % 3 != 0)) for d in [*(f"{i:03d}" for i in range(60)), None] for k, t in ((1, "a"), (2, "b"))]
    facts = spark.createDataFrame(rows, "doc_id string, task_id string, task_type string, tp long, fp long, fn long")
    facts = facts.withColumns({c: F.lit(None).cast("array<string>") for c in ("gold_items", "pred_items")} | {c: F.lit(None).cast("string") for c in ("gold", "pred")})
    got = {r["task_id"]: (r["low"], r["high"]) for r in Me.task_primary_interval(facts, None, resamples=25, seed=9).collect()}
    docs = [None, *sorted({r[0] for r in rows if r[0]})]
    for task in ("a", "b"):
        by = {r[0]: r[3:] for r in rows if r[1] == task}
        f1 = []
        for r in range(25):
            took = [docs[int(hashlib.md5(f"9:{r}:{k}".encode()).hexdigest()[:8], 16) % len(docs)] for k in range(len(docs))]
            tp, fp, fn = (sum(by[d][c] for d in took if d) for c in range(3))
            f1.append(2 * tp / (2 * tp + fp + fn) if tp else 0.0)
        want = spark.createDataFrame([(x,) for x in f1], "x double").agg(F.percentile("x", F.array(F.lit(0.025), F.lit(0.975)))).first()[0]
        assert got[task] == pytest.approx(tuple(want), abs=1e-12)
