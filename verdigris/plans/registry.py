"""The declared questions: strict, never inferred; compiled to column expressions."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions.match import matcher
from verdigris.functions.normalize import normalizer

TYPES = ("binary", "multiclass", "multilabel", "extract_exact", "extract_fuzzy", "extract_list", "extract_numeric", "extract_date", "span")
CLASSIFICATION = ("binary", "multiclass", "multilabel")
THRESHOLDED = ("extract_fuzzy", "extract_list", "extract_numeric", "extract_date", "span")
#: What a type is matched with unless its declaration says otherwise; None must be declared.
DEFAULTS: dict[str, dict[str, Any]] = {
    "binary": {"matcher": "identity", "normalizer": "boolean"},
    "multiclass": {"matcher": "identity", "normalizer": "enum"},
    "multilabel": {"matcher": "set", "normalizer": "enum"},
    "extract_exact": {"matcher": "exact", "normalizer": "free_string"},
    "extract_fuzzy": {"matcher": "entity_name", "normalizer": "entity_name", "theta": None},
    "extract_list": {"matcher": "list", "normalizer": "entity_name", "theta": 1.0, "pair_matcher": "entity_name"},
    "extract_numeric": {"matcher": "numeric", "normalizer": "numeric", "tolerance": None, "tolerance_kind": "relative", "unit": "", "unit_aliases": {}},
    "extract_date": {"matcher": "date", "normalizer": "date", "granularity": "day", "allow_coarser": False, "dayfirst": False},
    "span": {"matcher": "span", "normalizer": "span", "overlap_threshold": 0.5},
}
_TASK_KEYS = {"id", "type", "question", "weight", "nullable", "group", "output", "match"}
_OUTPUT_KEYS = {"enum", "nullable", "synonyms"}
_ANY_MATCH = {"matcher", "normalizer", "null_tokens", "vocabulary", "compatibility"}


class BadDeclaration(ValueError):
    """A schema or setting that can't be right; the message names where."""


@dataclass(frozen=True)
class Task:
    id: str
    type: str
    question: str
    weight: float = 1.0
    nullable: bool = True
    group: str = "all"
    enum: tuple[str, ...] = ()
    synonyms: dict[str, str] = field(default_factory=dict)
    params: dict[str, Any] = field(default_factory=dict)

    @property
    def labels(self) -> list[str]:
        return ["true", "false"] if self.type == "binary" else list(self.enum)

    def match(self, gold: Column, pred: Column) -> Column:
        return matcher(self.params["matcher"])(gold, pred, self.params)

    def normalized(self, value: Column) -> Column:
        return normalizer(self.params["normalizer"])(value, self.params)


def _task(raw: dict) -> Task:
    name = raw.get("id", "(no id)")

    def refuse(what: str) -> None:
        raise BadDeclaration(f"task {name}: {what}")

    if unknown := set(raw) - _TASK_KEYS:
        refuse(f"unknown keys {sorted(unknown)}")
    kind = raw.get("type")
    if kind not in TYPES:
        refuse(f"unknown type {kind!r}; there are {', '.join(TYPES)}")
    if not raw.get("id") or not raw.get("question"):
        refuse("needs an id and a question")
    output, given = dict(raw.get("output") or {}), dict(raw.get("match") or {})
    if unknown := set(output) - _OUTPUT_KEYS:
        refuse(f"unknown output keys {sorted(unknown)}")
    if unknown := set(given) - set(DEFAULTS[kind]) - _ANY_MATCH:
        refuse(f"unknown match keys {sorted(unknown)}")
    members = [str(m) for m in output.get("enum") or []]
    if kind in ("multiclass", "multilabel") and not members:
        refuse("needs output.enum")
    if len(set(members)) != len(members):
        refuse("enum members repeat")
    synonyms = {str(k): str(v) for k, v in (output.get("synonyms") or {}).items()}
    if wrong := sorted(set(synonyms.values()) - set(members)):
        refuse(f"synonyms for members that don't exist: {wrong}")
    params = DEFAULTS[kind] | given
    if missing := [k for k, v in params.items() if v is None and k in ("theta", "tolerance")]:
        refuse(f"match.{missing[0]} has no default and must be declared")
    if "theta" in params and not 0 < float(params["theta"]) <= 1:
        refuse("theta must be over 0 and at most 1")
    if "tolerance" in params and float(params["tolerance"]) < 0:
        refuse("tolerance must not be negative")
    if params.get("tolerance_kind", "relative") not in ("relative", "absolute"):
        refuse("tolerance_kind is relative or absolute")
    if params.get("granularity", "day") not in ("year", "month", "day"):
        refuse("granularity is year, month or day")
    params["unit"] = params.get("unit") or None
    weight = float(raw.get("weight", 1.0))
    if weight < 0:
        refuse("weight must not be negative")
    matcher(params["matcher"])
    normalizer(params["normalizer"])
    nullable = bool(output.get("nullable", raw.get("nullable", True)))
    return Task(str(raw["id"]), kind, str(raw["question"]), weight, nullable, str(raw.get("group", "all")), tuple(members), synonyms, params | {"enum": members, "synonyms": synonyms})


@dataclass(frozen=True)
class Registry:
    """The tasks in their order."""

    tasks: tuple[Task, ...]

    @classmethod
    def of(cls, raw: dict) -> Registry:
        if not isinstance(raw, dict) or set(raw) != {"tasks"} or not raw["tasks"]:
            raise BadDeclaration("a schema is a mapping with a list of tasks and nothing else")
        tasks = tuple(_task(t) for t in raw["tasks"])
        ids = [t.id for t in tasks]
        if twice := sorted({i for i in ids if ids.count(i) > 1}):
            raise BadDeclaration(f"task ids repeat: {twice}")
        return cls(tasks)

    @classmethod
    def read(cls, path: str) -> Registry:
        with open(path, encoding="utf-8") as f:
            return cls.of(yaml.safe_load(f))

    def __iter__(self):
        return iter(self.tasks)

    def __getitem__(self, name: str) -> Task:
        return next(t for t in self.tasks if t.id == name)

    @property
    def total_weight(self) -> float:
        return sum(t.weight for t in self.tasks)

    @property
    def groups(self) -> dict[str, list[Task]]:
        out: dict[str, list[Task]] = {}
        for t in self.tasks:
            out.setdefault(t.group, []).append(t)
        return out

    def fingerprint(self) -> str:
        """Sixteen hexadecimal digits of the declaration."""
        return hashlib.sha256(json.dumps([[t.id, t.type, t.question, t.weight, t.nullable, t.group, t.params] for t in self.tasks], sort_keys=True, default=str).encode()).hexdigest()[:16]

    def prompt(self, group: str) -> str:
        """The questions of a group as instructions."""
        lines = []
        for t in self.groups[group]:
            hint = f" One of: {', '.join(t.enum)}." if t.type == "multiclass" else f" Any of: {', '.join(t.enum)}." if t.type == "multilabel" else " Quote the passage word for word." if t.type == "span" else ""
            lines.append(f"{t.id} ({t.type}{', may be null' if t.nullable else ''}): {t.question}{hint}")
        return "\n".join(lines)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t.id, t.type, t.weight, i) for i, t in enumerate(self.tasks)], "task_id string, task_type string, weight double, position int")

    def labels_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(t.id, label) for t in self.tasks if t.type in CLASSIFICATION for label in t.labels]
        return spark.createDataFrame(rows, "task_id string, label string")


def literal_tasks(registry: Registry) -> Column:
    return F.array(*(F.struct(F.lit(t.id).alias("task_id"), F.lit(t.weight).alias("weight")) for t in registry))
