"""``python -m verdigris COMMAND ...``: thin commands over the API; refusals end with 2."""

from __future__ import annotations

import argparse
import importlib.util
import json
import shutil
import sys
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris import project
from verdigris.operators import batching, facts, gates, labeling, program, runs, sampling
from verdigris.plans.registry import BadDeclaration, Registry
from verdigris.sources import extract, io
from verdigris.streaming import resume

STARTER = """tasks:
  - id: example
    type: binary
    question: Is this document an example?
"""


class Context:
    """A project's folder with what is in it; session and declarations are made when first used."""

    def __init__(self, folder: str):
        self.folder = Path(folder)

    @property
    def spark(self) -> SparkSession:
        return SparkSession.builder.getOrCreate()

    @property
    def registry(self) -> Registry:
        load_customizations(self.folder if self.folder.is_dir() else self.folder.parent)  # tasks may name matchers of its own
        return Registry.read(str(self.folder if self.folder.is_file() else self.folder / "tasks.yaml"))

    @property
    def config(self) -> project.Config:
        path = self.folder / "config.yaml"
        return project.Config.read(path) if path.exists() else project.Config()

    def path(self, name: str) -> str:
        return str(self.folder / name)

    def labels(self) -> DataFrame:
        return io.load_labels(self.spark, self.path("labels.jsonl"))

    def texts(self) -> DataFrame:
        return extract.stored_texts(self.spark, self.path("corpus"))

    def gold(self) -> DataFrame:
        value = F.struct(*(F.try_element_at("labels", F.lit(t.id)).alias(t.id) for t in self.registry)).alias("gold")
        return self.labels().select("doc_id", value)

    def long_labels(self) -> DataFrame:
        return facts.long_labels(self.gold(), self.registry, "gold")

    def predictor(self):
        """``predictor`` of the project's ``custom.py``."""
        module = load_customizations(self.folder)
        if module is None or not hasattr(module, "predictor"):
            raise project.Refused("custom.py must define predictor(rows, attempt)")
        return module.predictor


_customized: dict[tuple[str, int], Any] = {}


def load_customizations(folder: str | Path):
    """Runs a project's ``custom.py``, which registers normalizers, matchers, extractors; None without one.  Executors get it too.

    A file that hasn't changed is run once.
    """
    path = Path(folder) / "custom.py"
    if not path.exists():
        return None
    if (held := (str(path.resolve()), path.stat().st_mtime_ns)) in _customized:
        return _customized[held]
    spec = importlib.util.spec_from_file_location("custom", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if active := SparkSession.getActiveSession():
        active.sparkContext.addPyFile(str(path))
        _customized[held] = module
    return module


def status(c: Context, args) -> None:
    print(json.dumps(project.status(c.folder), indent=1))


def check_tasks(c: Context, args) -> None:
    print(f"{len(c.registry.tasks)} tasks, fingerprint {c.registry.fingerprint()}")


def newproject(c: Context, args) -> None:
    if c.folder.exists() and any(c.folder.iterdir()):
        raise project.Refused(f"{c.folder} is not empty")
    (c.folder / "documents").mkdir(parents=True)
    (c.folder / "tasks.yaml").write_text(STARTER, encoding="utf-8")
    (c.folder / "config.yaml").write_text("{}\n", encoding="utf-8")


def extract_command(c: Context, args) -> None:
    load_customizations(c.folder)
    done = extract.extract_corpus(c.spark, args.documents or c.path("documents"), c.path("corpus"), args.extractor, suffix=args.suffix, limit=c.config.char_limit, head_share=c.config.head_share)
    shutil.rmtree(c.path("extraction_manifest.csv"), ignore_errors=True)
    done.coalesce(1).write.option("header", True).csv(c.path("extraction_manifest.csv"))
    print(f"{done.count()} documents")


def sample_labels(c: Context, args) -> None:
    if (c.folder / "label_plan.json").exists():
        raise project.Refused("a sample was drawn already; a second one would mix two")
    drawn = sampling.draw_sample(c.texts(), args.n, args.holdout, args.seed)
    plan = drawn.withColumn("is_prefilled", ~F.col("is_holdout") & F.lit(bool(args.prefill)))
    runs.write_plan(plan, c.folder / "label_plan.json", args.seed)


def label_sheet(c: Context, args) -> None:
    plan = runs.load_plan(c.spark, c.folder / "label_plan.json")
    values = None
    if args.predictions:
        p = io.load_predictions(c.spark, args.predictions).where("predicted is not null")
        values = p.select("doc_id", F.struct(*(F.try_element_at("predicted", F.lit(t.id)).alias(t.id) for t in c.registry)).alias("values"))
    sheet = labeling.sheet_frame(plan, values, c.registry)
    if args.xlsx:
        labeling.write_workbook(sheet, c.registry, c.path("sheet.xlsx"))
    else:
        labeling.write_sheet(sheet, c.path("sheet"))


def import_labels(c: Context, args) -> None:
    plan = runs.load_plan(c.spark, c.folder / "label_plan.json")
    rows = io.read_sheet(c.spark, args.sheet, c.registry)
    records, problems, warnings = labeling.import_sheet(rows, plan, c.texts(), c.registry)
    found = problems.orderBy("doc_id").limit(200).collect()
    if found:
        raise project.Refused("\n".join(f"{r['doc_id']}{'' if r['task_id'] is None else ' ' + r['task_id']}: {r['problem']}" for r in found))
    for r in warnings.limit(50).collect():
        print(f"{r['doc_id']} {r['task_id']}: {r['warning']}")
    labels = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(t.id).alias("k"), F.col(f"labels.{t.id}").alias("v")) for t in c.registry)), lambda e: e["k"].isNotNull()))
    io.write_labels(records.withColumn("labels", labels), c.path("labels.jsonl"))
    print(f"{records.count()} labels")


def audit_labels(c: Context, args) -> None:
    bad = labeling.schema_problems(c.labels(), c.registry).limit(200).collect()
    if bad:
        raise project.Refused("\n".join(f"{r['doc_id']} {r['task_id']}: {r['problem']}" for r in bad))
    total = c.labels().count()
    supports = sampling.class_supports(c.long_labels(), c.registry, total)
    rare = [r.asDict() for r in sampling.below_floor(supports, c.config.support_floor).collect()]
    text = "\n\n".join(["# Label audit", f"{total} labelled documents", *(sampling.support_prompt(r) for r in rare)])
    (c.folder / "label_audit.md").write_text(text, encoding="utf-8")
    print(text)


def make_splits(c: Context, args) -> None:
    if (c.folder / "splits.json").exists() and not args.reason:
        raise project.Refused("splits were made already; making them again needs a reason")
    docs = c.labels().select("doc_id")
    plan = c.folder / "label_plan.json"
    held = runs.load_plan(c.spark, plan).where("is_holdout").join(docs, "doc_id", "left_semi") if plan.exists() else None
    out = sampling.make_splits(docs, c.long_labels(), c.config.split_seed, held)
    runs.write_splits(out, c.folder / "splits.json", c.config.split_seed, sampling.strategy(docs.count())[1])


def _part(c: Context, *names: str) -> tuple[DataFrame, DataFrame]:
    ids = runs.load_splits(c.spark, c.folder / "splits.json").where(F.col("split").isin(*names)).select("doc_id")
    return extract.texts_of(ids, c.texts()), c.gold().join(ids, "doc_id", "left_semi")


def run_baseline(c: Context, args) -> None:
    found = runs.run_baselines(*_part(c, "val"), c.registry, {args.name: c.predictor()}, c.folder, c.config.evaluation_retries)
    print(runs.baselines_markdown(found))


def compile_command(c: Context, args) -> None:
    budget = project.Budget(c.config.max_experiments, c.config.max_rollouts, c.config.max_usd)
    predictor = c.predictor()
    print(json.dumps(runs.run_experiment(*_part(c, "val"), c.registry, lambda parent: predictor, c.folder, {"name": args.name}, budget)))


def holdout(c: Context, args) -> None:
    before = project.champion(c.folder)
    report = runs.run_holdout(*_part(c, "holdout"), c.registry, c.predictor(), before["per_task"] if before else {}, c.folder, args.who, args.reason, aggregate=before["aggregate"] if before else None)
    print(report.to_markdown())


def batched(c: Context) -> DataFrame:
    """Outcomes by way of the batch service that ``custom.py`` defines as ``service``: a request for each document and group of tasks.

    Replies are read strictly and merged; a document whose reply to a group is missing or can't be read fails.
    """
    module = load_customizations(c.folder)
    if module is None or not hasattr(module, "service"):
        raise project.Refused("custom.py must define service, the batch service to send to")
    registry, texts = c.registry, c.texts()
    whole = program.Program.of(registry)
    prompt = lambda group: whole.prompt(registry, group, "\0")
    parts = F.create_map(*(F.lit(x) for g in registry.groups for x in (g, prompt(g).rsplit("\0", 1)[0])))
    requests = texts.select("doc_id", F.explode(F.array(*(F.lit(g) for g in registry.groups))).alias("group"), "text").select("doc_id", "group", F.concat(F.try_element_at(parts, F.col("group")), F.coalesce("text", F.lit(""))).alias("body"))
    run = batching.Batches(c.spark, c.path("batches"), registry.fingerprint())
    run.plan(requests)
    run.send(requests, module.service)
    run.collect(module.service)
    return program.merged(run.latest().where(F.col("fingerprint") == registry.fingerprint()), registry)


def production(c: Context, args) -> None:
    registry = c.registry
    best = batched(c) if args.batch else resume.produce(c.texts(), c.path("outcomes"), c.predictor(), c.config.production_retries)
    io.outputs_json(best).write.mode("overwrite").text(c.path("outputs"))
    values = F.struct(*(F.try_element_at("values", F.lit(t.id)).alias(t.id) for t in registry)).alias("values")
    o = best.select("doc_id", "ok", "error", values)
    reference = c.gold().select("doc_id", F.col("gold").alias("values"))
    g = gates.run_gates(o, registry, c.texts().count(), reference, gates.null_rates(reference, registry, "values"), ceiling=c.config.production_failures)
    text = runs.qa_markdown(g, gates.triage(o, registry, spot_check=c.config.spot_check), o.where("not ok"))
    (c.folder / "qa.md").write_text(text, encoding="utf-8")
    print(text)


def run_pairs(c: Context, run: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, gold, pred, ok) and (doc_id, ok, error, predicted) of a stored run: its predictions beside today's labels."""
    path = c.folder / "runs" / run / "predictions"
    if not path.exists():
        raise project.Refused(f"run {run} has no stored predictions")
    rows = io.load_predictions(c.spark, str(path))
    kept = rows.select("doc_id", F.col("failed").isNull().alias("ok"), F.coalesce("failed.error", F.lit("")).alias("error"), "predicted")
    pred = F.struct(*(F.try_element_at("predicted", F.lit(t.id)).alias(t.id) for t in c.registry)).alias("pred")
    return c.gold().join(kept.select("doc_id", "ok", pred), "doc_id"), kept


def rescore(c: Context, args) -> None:
    """Scores a run again from its stored predictions: no model is asked, and the numbers follow today's tasks and labels."""
    folder, registry = c.folder / "runs" / args.run, c.registry
    pairs, kept = run_pairs(c, args.run)
    before = runs.load_metrics(folder)["summary"]
    scored = runs.score_split(facts.match_results(pairs, registry, failed=~F.col("ok")), registry, kept.where("NOT ok"))
    after = runs.write_run(scored, registry, folder)["summary"]
    for name in sorted(k for k in after if k == "aggregate" or k.startswith("primary.")):
        was = before.get(name)
        print(f"{name.removeprefix('primary.')}: {after[name]:.3f}" + ("" if was is None or abs(was - after[name]) < 1e-9 else f" (was {was:.3f})"))


def adjudicate(c: Context, args) -> None:
    """Close calls and errors of a run, from its stored predictions, for a person to check."""
    decisions = gates.adjudicate(facts.match_results(run_pairs(c, args.run)[0].where("ok"), c.registry))
    text = runs.adjudication_markdown(decisions)
    for path in (c.folder / "runs" / args.run / "adjudication.md", c.folder / "adjudication.md"):
        path.write_text(text, encoding="utf-8")
    print(f"{decisions.where(F.col('reason') != 'error').count()} close calls, {decisions.where(F.col('reason') == 'error').count()} other errors")


def close(c: Context, args) -> None:
    print(runs.write_report(c.folder, args.notes))


COMMANDS = {
    "status": (status, ()), "check-tasks": (check_tasks, ()), "newproject": (newproject, ()),
    "extract": (extract_command, (("--documents", {}), ("--extractor", {"default": "plain"}), ("--suffix", {"default": "pdf"}))),
    "sample-labels": (sample_labels, (("--n", {"type": int, "default": 120}), ("--holdout", {"type": float, "default": 0.25}), ("--seed", {"type": int, "default": 1}), ("--prefill", {"action": "store_true"}))),
    "label-sheet": (label_sheet, (("--predictions", {}), ("--xlsx", {"action": "store_true"}))), "import-labels": (import_labels, (("sheet", {}),)), "audit-labels": (audit_labels, ()),
    "make-splits": (make_splits, (("--reason", {"default": ""}),)), "run-baseline": (run_baseline, (("--name", {"default": "zero_shot"}),)), "compile": (compile_command, (("--name", {"default": ""}),)),
    "holdout": (holdout, (("--who", {"required": True}), ("--reason", {"default": ""}))), "production": (production, (("--batch", {"action": "store_true"}),)),
    "rescore": (rescore, (("run", {"help": "a folder of runs"}),)), "adjudicate": (adjudicate, (("run", {}),)), "close": (close, (("--notes", {}),)),
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="verdigris")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        command = commands.add_parser(name)
        command.add_argument("folder")
        for option, kw in options:
            command.add_argument(option, **kw)
    args = parser.parse_args(argv)
    try:
        COMMANDS[args.command][0](Context(args.folder), args)
    except (BadDeclaration, project.Refused, io.BadData, extract.BadCorpus, gates.GateRefused, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
