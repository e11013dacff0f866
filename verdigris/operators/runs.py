"""Evaluation runs: a split scored, its files written and read, baselines, experiments and the one look at a holdout."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris import project
from verdigris.functions import stats as St
from verdigris.operators import facts as Fa
from verdigris.operators import gates as G
from verdigris.operators import metrics as Me
from verdigris.operators import sampling as Sa
from verdigris.plans.registry import Registry
from verdigris.sources.io import BadData, predictions_json
from verdigris.streaming.resume import Predictor, predict, predict_within


@dataclass
class Scored:
    """The frames of a scored split; ``summary`` has (name, value) rows, few enough for a file."""

    facts: DataFrame
    tasks: DataFrame
    classes: DataFrame
    examples: DataFrame
    confusion: DataFrame
    failed: DataFrame
    summary: DataFrame


def score_split(facts: DataFrame, registry: Registry, failed: DataFrame | None = None) -> Scored:
    """All metrics of one split from its facts; ``failed`` has (doc_id, error) of replies that could not be read."""
    spark = facts.sparkSession
    failed = spark.createDataFrame([], "doc_id string, error string") if failed is None else failed.select("doc_id", "error")
    examples, tasks = Fa.example_scores(facts), Me.primary_values(facts, registry)
    row = lambda df, name, value: df.select(F.lit(name).alias("name"), value.cast("double").alias("value"))
    total = examples.agg(F.avg("aggregate").alias("a"), F.count(F.lit(1)).alias("n"))
    summary = row(total, "aggregate", F.col("a")).unionByName(row(total, "n", F.col("n"))).unionByName(row(failed.agg(F.count(F.lit(1)).alias("n")), "failed", F.col("n")))
    summary = summary.unionByName(tasks.select(F.concat(F.lit("primary."), "task_id").alias("name"), F.col("primary").cast("double").alias("value")))
    return Scored(facts, tasks, Me.class_metrics(facts, registry), examples, Me.confusion(facts), failed, summary)


def _rows(df: DataFrame, *order: str) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]


def metrics_payload(scored: Scored) -> dict[str, Any]:
    """A run's numbers as plain values: a row per task and class, nothing per document."""
    return {"summary": {r["name"]: r["value"] for r in scored.summary.collect()}, "tasks": _rows(scored.tasks, "task_id"), "classes": _rows(scored.classes, "task_id", "label"), "confusion": _rows(scored.confusion, "task_id", "gold", "pred")}


def write_metrics(scored: Scored, folder: str | Path) -> dict[str, Any]:
    payload = metrics_payload(scored)
    path = Path(folder)
    path.mkdir(parents=True, exist_ok=True)
    (path / "metrics.json").write_text(json.dumps(payload, indent=1, sort_keys=True, default=str), encoding="utf-8")
    return payload


def load_metrics(folder: str | Path) -> dict[str, Any]:
    return json.loads((Path(folder) / "metrics.json").read_text(encoding="utf-8"))


def primary_of(payload: dict[str, Any]) -> dict[str, float]:
    """A stored run's headline number per task."""
    return {t["task_id"]: t["primary"] for t in payload["tasks"]}


def null_rates_of(payload: dict[str, Any]) -> dict[str, float]:
    """How often a stored run answered nothing, per task."""
    return {t["task_id"]: t["pred_null_rate"] for t in payload["tasks"]}


def failures_markdown(scored: Scored, registry: Registry, examples: int = 3) -> str:
    """What went wrong: unreadable replies, a line and a class table per task, a confusion table, a few errors drawn by hash."""
    lines = ["# Failures", ""]
    failed = scored.failed.orderBy("doc_id").limit(20).collect()
    lines += [f"{scored.failed.count()} replies could not be read.", *(f"- {r['doc_id']}: {r['error'][:300]}" for r in failed), ""]
    wrong: dict[str, list] = {}
    for r in Sa.sample_errors(scored.facts, examples).select("task_id", "doc_id", "gold", "pred", "gold_items", "pred_items").orderBy("task_id", "doc_id").collect():
        wrong.setdefault(r["task_id"], []).append(r)
    payload = metrics_payload(scored)
    said = lambda one, many: "null" if one is None and not many else ", ".join(many) if many else one
    for t in payload["tasks"]:
        lines += [f"## {t['task_id']}", "", f"{t['basis']}: {t['primary']:.3f}, exact match {t['exact_match']:.3f}" + ("" if t["measurable"] else " (too few examples to measure)"), ""]
        own = [c for c in payload["classes"] if c["task_id"] == t["task_id"]]
        if own:
            lines += [project.markdown_table(["class", "support", "precision", "recall", "F1"], [(c["label"], c["support"], c["precision"], c["recall"], c["f1"]) for c in own]), ""]
        cells = {(c["gold"], c["pred"]): c["n"] for c in payload["confusion"] if c["task_id"] == t["task_id"]}
        if cells:
            across = sorted({p for _, p in cells})
            lines += [project.markdown_table(["gold \\ predicted", *across], [(g, *(cells.get((g, p), 0) for p in across)) for g in sorted({g for g, _ in cells})]), ""]
        lines += [f"- {r['doc_id']}: expected {said(r['gold'], r['gold_items'])}, got {said(r['pred'], r['pred_items'])}" for r in wrong.get(t["task_id"], [])] + [""]
    return "\n".join(lines)


def write_run(scored: Scored, registry: Registry, folder: str | Path, predictions: DataFrame | None = None) -> dict[str, Any]:
    """``metrics.json``, ``failures.md`` and, if given, ``predictions`` (doc_id, ok, error, predicted) as JSON lines."""
    payload = write_metrics(scored, folder)
    (Path(folder) / "failures.md").write_text(failures_markdown(scored, registry), encoding="utf-8")
    if predictions is not None:
        predictions_json(predictions).write.mode("overwrite").text(str(Path(folder) / "predictions"))
    return payload


# --- splits and label plans -----------------------------------------------------------------------------------------


def write_splits(splits: DataFrame, path: str | Path, seed: int, strategy: str) -> None:
    """Labelled documents by split as JSON: labels are what people made, so they are few."""
    by = {r["split"]: r["ids"] for r in splits.groupBy("split").agg(F.array_sort(F.collect_list("doc_id")).alias("ids")).collect()}
    folds = {r["doc_id"]: r["fold"] for r in splits.where("fold is not null").collect()} if "fold" in splits.columns else {}
    payload = {"seed": seed, "strategy": strategy, **{k: by.get(k, []) for k in ("train", "val", "holdout")}, "folds": folds}
    Path(path).write_text(json.dumps(payload, indent=1, sort_keys=True), encoding="utf-8")


def load_splits(spark: SparkSession, path: str | Path) -> DataFrame:
    """(doc_id, split, fold) of a file; a missing part or a document in two parts is an error."""
    raw = json.loads(Path(path).read_text(encoding="utf-8"))
    if missing := [k for k in ("train", "val", "holdout", "seed") if k not in raw]:
        raise BadData(f"the splits file lacks {missing}")
    rows = [(str(d), k, raw.get("folds", {}).get(str(d))) for k in ("train", "val", "holdout") for d in raw[k]]
    if len({r[0] for r in rows}) != len(rows):
        raise BadData("a document stands in two splits")
    return spark.createDataFrame(rows, "doc_id string, split string, fold int")


def write_plan(plan: DataFrame, path: str | Path, seed: int) -> None:
    """A label plan (doc_id, is_holdout, is_prefilled) as JSON."""
    rows = plan.orderBy("doc_id").collect()
    payload = {"seed": seed, "sampled": [r["doc_id"] for r in rows], "holdout": [r["doc_id"] for r in rows if r["is_holdout"]], "prefilled": [r["doc_id"] for r in rows if r["is_prefilled"]]}
    Path(path).write_text(json.dumps(payload, indent=1), encoding="utf-8")


def load_plan(spark: SparkSession, path: str | Path) -> DataFrame:
    """(doc_id, is_holdout, is_prefilled); a holdout outside the sample or with suggestions is an error."""
    raw = json.loads(Path(path).read_text(encoding="utf-8"))
    sampled, held, shown = ({str(d) for d in raw.get(k, [])} for k in ("sampled", "holdout", "prefilled"))
    if outside := sorted((held | shown) - sampled):
        raise BadData(f"not in the sample: {outside[:10]}")
    if both := sorted(held & shown):
        raise BadData(f"holdout documents must be labelled blind: {both[:10]}")
    return spark.createDataFrame([(d, d in held, d in shown) for d in sorted(sampled)], "doc_id string, is_holdout boolean, is_prefilled boolean")


# --- runs with a predictor ------------------------------------------------------------------------------------------


def evaluate(docs: DataFrame, gold: DataFrame, registry: Registry, predictor: Predictor, retries: int = 2, ceiling: float = 0.0, budget: project.Budget | None = None) -> tuple[Scored, DataFrame]:
    """Scores of a predictor over (doc_id, text) against (doc_id, gold struct); too many unreadable replies refuse the run; with a budget it stops when that is used up."""
    outcomes = predict(docs, predictor, retries).persist() if budget is None else predict_within(docs, predictor, retries, budget)
    G.failure_gate(outcomes, ceiling)
    values = F.struct(*(F.try_element_at("values", F.lit(t.id)).alias(t.id) for t in registry)).alias("pred")
    pairs = gold.withColumn("doc_id", F.col("doc_id").cast("string")).join(outcomes.select("doc_id", "ok", values), "doc_id")
    scored = score_split(Fa.match_results(pairs, registry, failed=~F.col("ok")), registry, outcomes.where("not ok"))
    return scored, outcomes


def run_baselines(docs: DataFrame, gold: DataFrame, registry: Registry, predictors: dict[str, Predictor], folder: str | Path, retries: int = 2) -> list[dict]:
    """One stored run for each named predictor (zero-shot, few-shot, ...); returns them best first."""
    out = []
    for name, predictor in predictors.items():
        scored, outcomes = evaluate(docs, gold, registry, predictor, retries, ceiling=1.0)
        payload = write_run(scored, registry, Path(folder) / "runs" / f"baseline_{name}", outcomes.withColumnRenamed("values", "predicted"))
        outcomes.unpersist()
        out.append({"name": name, "aggregate": payload["summary"]["aggregate"], "per_task": primary_of(payload)})
    return sorted(out, key=lambda r: (-r["aggregate"], r["name"]))


def baselines_markdown(runs: list[dict], near_zero: float = G.NEAR_ZERO) -> str:
    """Baselines side by side, and tasks that none of them lifts off zero."""
    tasks = sorted({t for r in runs for t in r["per_task"]})
    table = project.markdown_table(["baseline", "aggregate", *tasks], [(r["name"], r["aggregate"], *(r["per_task"].get(t) for t in tasks)) for r in runs])
    dead = [t for t in tasks if max(r["per_task"].get(t, 0.0) for r in runs) <= near_zero]
    return "\n".join(["# Baselines", "", table, "", *(f"- {t} stays near zero in every run: look at its question, its labels and the texts first" for t in dead)])


def run_experiment(docs: DataFrame, gold: DataFrame, registry: Registry, make: Callable[[dict | None], Predictor], folder: str | Path, config: dict, budget: project.Budget, usd: float = 0.0) -> dict:
    """A numbered experiment: refused over budget; built on the champion; scored, recorded, and pinned if strictly better."""
    budget.check(len(project.leaderboard(folder)), usd)
    began, parent = time.monotonic(), project.champion(folder)
    predictor = make(parent)

    scored, outcomes = evaluate(docs, gold, registry, predictor, ceiling=1.0, budget=budget)
    payload = metrics_payload(scored)
    entry = project.record_experiment(folder, config, payload["summary"]["aggregate"], primary_of(payload), parent["id"] if parent else None, budget.rollouts, time.monotonic() - began)
    write_run(scored, registry, Path(folder) / "runs" / entry["id"], outcomes.withColumnRenamed("values", "predicted"))
    outcomes.unpersist()
    return entry


#: What the gaps between validation and holdout say together, and what to do then.
READINGS = {
    "within_ci": ("holdout and validation agree", "release it"),
    "modest": ("a drop of the usual size", "release it with the holdout's numbers"),
    "large_few": ("a few tasks learned their examples by heart", "take those tasks back to their baseline"),
    "large_widespread": ("the program as a whole was tuned to its validation documents", "take a simpler one"),
}


@dataclass
class HoldoutFindings:
    """What the one look at a holdout found.

    ``interval`` is that of the aggregate over resampled documents; ``gaps`` has a row a task with both numbers, the interval,
    support and what so much support can carry; ``rates`` has how often answers are right and how much they find.
    """

    aggregate: float
    verdict: str
    gaps: list[dict]
    tasks: list[dict]
    lock: dict
    interval: tuple[float, float] = (0.0, 1.0)
    validation: float = 0.0
    n: int = 0
    rates: list[dict] = field(default_factory=list)

    @property
    def worse(self) -> list[str]:
        """Tasks that fell far short of validation."""
        return [g["task_id"] for g in self.gaps if g["is_large"]]

    def to_markdown(self) -> str:
        span = lambda low, high: f"{low:.3f} to {high:.3f}"
        reading, action = READINGS[self.verdict]
        lines = ["# Holdout", "", f"aggregate {self.aggregate:.3f} ({span(*self.interval)}) over {self.n} documents; validation {self.validation:.3f}, {self.validation - self.aggregate:+.3f}; opened {self.lock['opened_at']} by {self.lock['opened_by']}", ""]
        lines += [f"{self.verdict}: {reading}. Next: {action}.", "", "## Tasks", ""]
        told = lambda g: "inside" if g["within_ci"] else "large gap" if g["is_large"] else "outside"
        lines += [project.markdown_table(["task", "holdout", "range", "validation", "gap", "reads", "examples", "can carry"], [(g["task_id"], g["holdout"], span(g["low"], g["high"]), g["validation"], f"{g['gap']:+.3f}", told(g), g["support"], g["readable_as"]) for g in self.gaps]), ""]
        lines += ["## Answers", "", project.markdown_table(["task", "counts", "precision", "range", "recall", "range", "F1"], [(r["task_id"], r["counts"], r["precision"], span(r["precision_low"], r["precision_high"]), r["recall"], span(r["recall_low"], r["recall_high"]), r["f1"]) for r in self.rates]), ""]
        lines += [f"- {t}: far below validation; quote the number here, and go back to its baseline" for t in self.worse]
        lines += [f"- {t['task_id']}: too few examples to measure" for t in self.tasks if not t["measurable"]]
        lines += [f"- opened again on {o['at']} by {o['by']}: {o['reason']}" for o in self.lock["overrides"]]
        return "\n".join(lines)


def run_holdout(docs: DataFrame, gold: DataFrame, registry: Registry, predictor: Predictor, validation: dict[str, float], folder: str | Path, who: str, reason: str = "", resamples: int = 1000, seed: int = 0, aggregate: float | None = None) -> HoldoutFindings:
    """Predicts, then takes the lock, then scores: a run that fails before has not looked.

    ``validation`` has each task's headline number there, ``aggregate`` the aggregate (else their weighed mean stands for it);
    gaps are read against resampled intervals.
    """
    spark = docs.sparkSession
    if (Path(folder) / "holdout.lock.json").exists() and not reason:
        project.open_holdout(folder, who)
    scored, outcomes = evaluate(docs, gold, registry, predictor)
    outcomes.count()
    lock = project.open_holdout(folder, who, reason)
    ends = Me.task_primary_interval(scored.facts, registry, resamples, seed)
    tasks = _rows(scored.tasks, "task_id")
    found = scored.tasks.select("task_id", F.col("primary").alias("value")).join(ends, "task_id")
    before = spark.createDataFrame([(k, float(v)) for k, v in validation.items()], "task_id string, value double")
    rates = Me.answer_rates(scored.facts, registry)
    carried = rates.select("task_id", "support", St.readable_at(F.col("support")).alias("readable_as"))
    gaps = G.holdout_gaps(before, found).join(ends, "task_id").join(carried, "task_id")
    whole = St.bootstrap_interval(scored.examples, "aggregate", "doc_id", resamples, seed).first()
    weight = sum(t.weight for t in registry if t.id in validation)
    mean = sum(t.weight * float(validation[t.id]) for t in registry if t.id in validation) / weight if weight else 0.0
    report = HoldoutFindings(
        scored.summary.where("name = 'aggregate'").first()["value"], G.read_gaps(gaps).first()[0], _rows(gaps, "task_id"), tasks, lock,
        (whole["low"], whole["high"]), mean if aggregate is None else aggregate, whole["n"], _rows(rates, "task_id", "counts"),
    )
    write_run(scored, registry, Path(folder) / "runs" / "holdout", outcomes.withColumnRenamed("values", "predicted"))
    (Path(folder) / "runs" / "holdout" / "report.md").write_text(report.to_markdown(), encoding="utf-8")
    outcomes.unpersist()
    return report


# --- reports of a full run ------------------------------------------------------------------------------------------


def qa_markdown(gates: DataFrame, routes: DataFrame, failed: DataFrame, shown: int = 8) -> str:
    """Gates, the first ids of each route with how many there are, and errors on one line each."""
    lines = ["# Quality", "", project.markdown_table(["gate", "passed", "detail"], [(r["name"], "yes" if r["passed"] else "no", r["detail"]) for r in gates.collect()]), ""]
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("route").orderBy("doc_id"))
    counts = {r["route"]: r["n"] for r in routes.groupBy("route").agg(F.count(F.lit(1)).alias("n")).collect()}
    first: dict[str, list[str]] = {}
    for r in routes.withColumn("at", at).where(F.col("at") <= shown).orderBy("route", "at").collect():
        first.setdefault(r["route"], []).append(r["doc_id"])
    lines += [f"- {k}: {', '.join(v)}" + (f" and {counts[k] - len(v)} more" if counts[k] > len(v) else "") for k, v in sorted(first.items())]
    lines += ["", *(f"- {r['doc_id']}: {' '.join((r['error'] or '').split())[:300]}" for r in failed.orderBy("doc_id").limit(50).collect())]
    return "\n".join(lines)


def adjudication_markdown(decisions: DataFrame, limit: int = 500) -> str:
    """Close calls and errors by task, gold and predicted side by side, the first ``limit`` of each task."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("task_id").orderBy("reason", "doc_id"))
    rows = decisions.withColumn("at", at).where(F.col("at") <= limit).orderBy("task_id", "at").collect()
    totals = {r["task_id"]: r["n"] for r in decisions.groupBy("task_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    said = lambda one, many: ", ".join(many) if many else one
    lines = ["# Adjudication", ""]
    for task, n in sorted(totals.items()):
        own = [r for r in rows if r["task_id"] == task]
        lines += [f"## {task}: {n}", "", project.markdown_table(["document", "reason", "gold", "predicted", "measure", "threshold"], [(r["doc_id"], r["reason"], said(r["gold"], r["gold_items"]), said(r["pred"], r["pred_items"]), r["measure"], r["threshold"]) for r in own]), ""]
    return "\n".join(lines)


#: What a closed project is expected to leave behind.
ARTIFACTS = ("tasks.yaml", "label_plan.json", "labels.jsonl", "splits.json", "runs/champion", "runs/holdout/report.md", "outputs", "qa.md", "adjudication.md")


def write_report(folder: str | Path, notes: str | Path | None = None) -> Path:
    """``REPORT.md``: the leaderboard, the holdout's report, the artifacts that are there and those that aren't, and notes."""
    root = Path(folder)
    read = lambda p: (root / p).read_text(encoding="utf-8") if (root / p).exists() else ""
    there = [f"- [{p}]({p})" if (root / p).exists() else f"- {p}: missing" for p in ARTIFACTS]
    parts = ["# Report", "", project.leaderboard_markdown(root), "", read("runs/holdout/report.md"), "", "## Artifacts", "", *there]
    if notes is not None and Path(notes).exists():
        parts += ["", "## Notes", "", Path(notes).read_text(encoding="utf-8")]
    (root / "REPORT.md").write_text("\n".join(parts), encoding="utf-8")
    return root / "REPORT.md"


def write_prompt(registry: Registry, folder: str | Path, demos: list[dict] | None = None, most: int = 400) -> Path:
    """The questions of every group as text, with demonstrations shortened to ``most`` characters."""
    parts = ["# Prompt", ""]
    for group in registry.groups:
        parts += [f"## {group}", "", registry.prompt(group), ""]
    for i, demo in enumerate(demos or [], 1):
        text = demo.get("text", "")
        parts += [f"### Example {i}", "", text if len(text) <= most else f"{text[:most]} ...", "", json.dumps(demo.get("labels", {}), ensure_ascii=False, sort_keys=True), ""]
    path = Path(folder) / "PROMPT.md"
    path.write_text("\n".join(parts), encoding="utf-8")
    return path
