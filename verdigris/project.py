"""A project's bookkeeping on the driver: settings, the holdout lock, budgets, snapshots, experiments and how far it is."""

from __future__ import annotations

import hashlib
import json
import os
import time
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

import yaml

from verdigris.plans.registry import BadDeclaration


class Refused(RuntimeError):
    """A guard that does not let a step begin."""


class BudgetSpent(BaseException):
    """A hard stop that no handler for ordinary errors swallows."""


@dataclass(frozen=True)
class Config:
    """Settings with their defaults; unknown ones are errors."""

    split_seed: int = 20260918
    support_floor: int = 30
    measurable_floor: int = 10
    abstention: str = "scored"
    excluded_classes: dict[str, list[str]] = field(default_factory=dict)
    evaluation_retries: int = 2
    production_retries: int = 3
    transcription_retries: int = 4
    evaluation_failures: float = 0.0
    production_failures: float = 0.005
    spot_check: int = 50
    thin_chars: int = 100
    thin_image: float = 0.5
    char_limit: int | None = None
    head_share: float = 0.7
    bootstrap_resamples: int = 2000
    max_experiments: int = 8
    max_rollouts: int = 2000
    max_usd: float | None = None

    @classmethod
    def of(cls, raw: dict[str, Any]) -> Config:
        names = {f.name for f in fields(cls)}
        if unknown := set(raw) - names:
            raise BadDeclaration(f"unknown settings {sorted(unknown)}")
        c = cls(**raw)
        if c.measurable_floor > c.support_floor:
            raise BadDeclaration("measurable_floor must not be over support_floor")
        if c.abstention not in ("scored", "best_guess"):
            raise BadDeclaration("abstention is scored or best_guess")
        return c

    @classmethod
    def read(cls, path: str | Path) -> Config:
        return cls.of(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


def add_excluded_classes(path: str | Path, task_id: str, labels: list[str]) -> None:
    """Labels merged into the excluded classes of a settings file, quoted, so that ``true`` stays text."""
    p = Path(path)
    raw = yaml.safe_load(p.read_text(encoding="utf-8")) or {}
    classes = raw.setdefault("excluded_classes", {})
    classes[task_id] = sorted({*map(str, classes.get(task_id, [])), *labels})
    p.write_text(yaml.safe_dump(raw, sort_keys=False), encoding="utf-8")


def open_holdout(folder: str | Path, who: str, reason: str = "") -> dict:
    """The lock that says a holdout was looked at: once; again only with a reason, which is recorded."""
    path = Path(folder) / "holdout.lock.json"
    now = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    lock = {"opened_at": now, "opened_by": who, "overrides": []}
    try:
        with os.fdopen(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w", encoding="utf-8") as f:
            json.dump(lock, f)
        return lock
    except FileExistsError:
        lock = json.loads(path.read_text(encoding="utf-8"))
    if not reason:
        raise Refused(f"the holdout was opened on {lock['opened_at']} by {lock['opened_by']}; a second look needs a reason") from None
    lock["overrides"].append({"at": now, "by": who, "reason": reason})
    path.write_text(json.dumps(lock), encoding="utf-8")
    return lock


def snapshot(paths: list[str | Path]) -> dict[str, str]:
    return {str(p): hashlib.sha256(Path(p).read_bytes()).hexdigest() if Path(p).exists() else "" for p in paths}


class ReadOnly:
    """Files that a step must leave as they are; an error of the step itself comes first."""

    def __init__(self, paths: list[str | Path]):
        self.paths = paths

    def __enter__(self) -> ReadOnly:
        self.before = snapshot(self.paths)
        return self

    def __exit__(self, kind, error, trace) -> None:
        changed = sorted(p for p, h in snapshot(self.paths).items() if h != self.before[p])
        if changed and kind is None:
            raise Refused(f"files that must not change did: {changed}")


@dataclass
class Budget:
    """Refuses before a step; counts rollouts and stops hard at the cap."""

    max_experiments: int = 8
    max_rollouts: int = 2000
    max_usd: float | None = None
    rollouts: int = 0

    def check(self, experiments: int, usd: float, priced: bool = True) -> None:
        if experiments >= self.max_experiments:
            raise Refused(f"{experiments} experiments ran; the budget is {self.max_experiments}")
        if self.max_usd is not None and not priced:
            raise Refused("a dollar budget needs a price for the model")
        if self.max_usd is not None and usd >= self.max_usd:
            raise Refused(f"${usd:.2f} is spent; the budget is ${self.max_usd:.2f}")

    def count(self, n: int = 1) -> None:
        if self.rollouts + n > self.max_rollouts:
            raise BudgetSpent(f"{self.max_rollouts} rollouts are used up")
        self.rollouts += n

    def check_rollouts(self) -> None:
        """Refuses to go on once the cap is reached."""
        if self.rollouts >= self.max_rollouts:
            raise BudgetSpent(f"{self.max_rollouts} rollouts are used up")

    def paid(self, n: int) -> None:
        """Counts rollouts that were made, also those past the cap."""
        self.rollouts += n


def experiment_id(n: int) -> str:
    return f"exp_{n:03d}"


def record_experiment(folder: str | Path, config: dict, aggregate: float, per_task: dict[str, float], parent: str | None = None, rollouts: int = 0, seconds: float = 0.0) -> dict:
    """A numbered record; it is the champion if it is strictly better than the one before."""
    root = Path(folder) / "runs"
    root.mkdir(parents=True, exist_ok=True)
    entry = {"id": experiment_id(len(list(root.glob("exp_*"))) + 1), "config": config, "aggregate": aggregate, "per_task": per_task, "parent": parent, "rollouts": rollouts, "seconds": seconds}
    (root / entry["id"]).mkdir()
    (root / entry["id"] / "config.json").write_text(json.dumps(entry, sort_keys=True), encoding="utf-8")
    best = champion(folder)
    if best is None or aggregate > best["aggregate"]:
        (root / "champion").write_text(entry["id"], encoding="utf-8")
    return entry


def leaderboard(folder: str | Path) -> list[dict]:
    rows = [json.loads(p.read_text(encoding="utf-8")) for p in sorted((Path(folder) / "runs").glob("exp_*/config.json"))]
    return sorted(rows, key=lambda r: (-r["aggregate"], r["id"]))


def champion(folder: str | Path) -> dict | None:
    pin = Path(folder) / "runs" / "champion"
    return json.loads((pin.parent / pin.read_text(encoding="utf-8") / "config.json").read_text(encoding="utf-8")) if pin.exists() else None


def leaderboard_markdown(folder: str | Path) -> str:
    rows = [f"| {r['id']} | {r['aggregate']:.3f} | {r['rollouts']} | {r['parent'] or '-'} |" for r in leaderboard(folder)]
    return "\n".join(["| experiment | aggregate | rollouts | parent |", "| --- | --- | --- | --- |", *rows])


def markdown_table(columns: list[str], rows: list[tuple]) -> str:
    """Rows as Markdown; pipes and line ends in cells are escaped."""
    cell = lambda v: ("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)).replace("|", "\\|").replace("\n", " ")
    return "\n".join([f"| {' | '.join(columns)} |", f"| {' | '.join('---' for _ in columns)} |", *(f"| {' | '.join(map(cell, r))} |" for r in rows)])


#: The stages of a project and the file that shows each is done.
STAGES = (
    ("tasks declared", "tasks.yaml"), ("text extracted", "extraction_manifest.csv"), ("documents sampled", "label_plan.json"), ("labels imported", "labels.jsonl"), ("labels audited", "label_audit.md"),
    ("splits made", "splits.json"), ("baselines recorded", "runs/baselines"), ("compiled", "runs/champion"), ("holdout measured", "holdout.lock.json"), ("production run", "outputs"), ("closed", "REPORT.md"),
)


def status(folder: str | Path) -> dict[str, Any]:
    """How far a project is, from its files alone: stages done, the last of them and the next."""
    root = Path(folder)

    def done(path: str) -> bool:
        return len(list(root.glob("runs/baseline*"))) >= 2 if path == "runs/baselines" else (root / path).exists()

    there = [name for name, path in STAGES if done(path)]
    return {"done": there, "phase": there[-1] if there else None, "next": next((name for name, _ in STAGES if name not in there), None)}
