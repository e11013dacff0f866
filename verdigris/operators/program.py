"""A program: one question to a model for each group of tasks, replies read strictly and merged into one answer a document.

The model is a function ``ask(prompts, attempt) -> replies``; an exception or None in a reply's place is a failed reply.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.plans.registry import BadDeclaration, Registry
from verdigris.streaming.resume import Predictor

Ask = Callable[[list[str], int], list[Any]]
EFFORTS = ("low", "medium", "high")
_FIELD = re.compile(r"\[\[ ## (\w+) ## \]\]")


@dataclass(frozen=True)
class ModelConfig:
    """How a model is called; thinking that is off and an effort for it exclude each other."""

    name: str
    max_tokens: int = 4096
    temperature: float | None = None
    effort: str | None = None
    thinking: bool = True
    input_per_million: float | None = None
    output_per_million: float | None = None

    def __post_init__(self):
        if self.effort is not None and self.effort not in EFFORTS:
            raise BadDeclaration(f"effort is one of {', '.join(EFFORTS)}")
        if self.effort is not None and not self.thinking:
            raise BadDeclaration("an effort needs thinking, which is off")

    @property
    def priced(self) -> bool:
        return self.input_per_million is not None and self.output_per_million is not None

    def options(self) -> dict[str, Any]:
        """What a call passes on; what is not set is left to the service."""
        given = {"model": self.name, "max_tokens": self.max_tokens, "temperature": self.temperature, "effort": self.effort}
        return {k: v for k, v in given.items() if v is not None} | ({} if self.thinking else {"thinking": "off"})


def attribute_for(group: str) -> str:
    """A group's name as an identifier; groups that would share one are told apart by a hash."""
    plain = re.sub(r"\W", "_", group)
    plain = plain if plain and not plain[0].isdigit() else f"_{plain}"
    return plain if plain == group else f"{plain}_{hashlib.sha256(group.encode()).hexdigest()[:6]}"


@dataclass
class Program:
    """Instructions and demonstrations by group; what a search for better prompts changes, and all that is stored of it."""

    instructions: dict[str, str] = field(default_factory=dict)
    demos: list[dict] = field(default_factory=list)

    @classmethod
    def of(cls, registry: Registry) -> Program:
        return cls({group: registry.prompt(group) for group in registry.groups})

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=1, ensure_ascii=False, sort_keys=True), encoding="utf-8")

    @classmethod
    def load(cls, path: str | Path, registry: Registry) -> Program:
        """A stored program; one whose groups aren't those of the tasks is an error."""
        out = cls(**json.loads(Path(path).read_text(encoding="utf-8")))
        if set(out.instructions) != set(registry.groups):
            raise BadDeclaration("the stored program has other groups than the tasks")
        return out

    def prompt(self, registry: Registry, group: str, text: str) -> str:
        ids = [t.id for t in registry.groups[group]]
        form = "\n".join(f"[[ ## {i} ## ]]" for i in ids)
        shown = [f"Document:\n{d['text']}\n" + "\n".join(f"[[ ## {i} ## ]]\n{_said(d['labels'].get(i))}" for i in ids) for d in self.demos]
        return "\n\n".join([self.instructions[group], f"Answer every field, null where there is no answer:\n{form}", *shown, f"Document:\n{text}"])


def _said(value: Any) -> str:
    return "null" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def read_fields(reply: str, ids: list[str]) -> dict[str, str | None]:
    """Fields of a reply; one that is left out is an error, an explicit null an answer."""
    parts = _FIELD.split(reply)
    found = dict(zip(parts[1::2], (p.strip() for p in parts[2::2]), strict=True))
    if missing := [i for i in ids if i not in found]:
        raise ValueError(f"missing: {', '.join(missing)}")
    return {i: None if found[i].lower() in ("", "null") else found[i] for i in ids}


def build_program(registry: Registry, ask: Ask, program: Program | None = None) -> Predictor:
    """A predictor that asks for each group and merges; a document whose reply to one group fails, fails."""
    program = program or Program.of(registry)
    groups = {g: [t.id for t in tasks] for g, tasks in registry.groups.items()}

    def predictor(rows: list[tuple[str, str]], attempt: int) -> list[Any]:
        out: list[Any] = [{} for _ in rows]
        for group, ids in groups.items():
            prompts = [program.prompt(registry, group, text or "") for _, text in rows]
            for i, reply in enumerate(ask(prompts, attempt)):
                if isinstance(out[i], Exception):
                    continue
                try:
                    if reply is None or isinstance(reply, Exception):
                        raise reply or ValueError("no reply")
                    out[i] |= read_fields(reply, ids)
                except Exception as e:  # a reply that can't be read is this document's failure
                    out[i] = e
        return out

    return predictor


def merged(replies: DataFrame, registry: Registry) -> DataFrame:
    """Outcomes (doc_id, ok, values, error, attempts) from one reply for each document and group: (doc_id, group, reply).

    Fields are read strictly: one that is left out, or a reply that is missing, fails the document; a null word is an answer.
    """
    ids = F.create_map(*(x for g, tasks in registry.groups.items() for x in (F.lit(g), F.array(*(F.lit(t.id) for t in tasks)))))
    r = replies.select("doc_id", "group", "reply", F.try_element_at(ids, F.col("group")).alias("ids")).where("ids IS NOT NULL")
    parts = F.split(F.coalesce("reply", F.lit("")), r"\[\[ ## (?=\w+ ## \]\])")
    fields = F.transform(F.filter(parts, lambda p: p.rlike(r"^\w+ ## \]\]")), lambda p: F.struct(F.regexp_extract(p, r"^(\w+) ## \]\]", 1).alias("k"), F.btrim(F.regexp_replace(p, r"^\w+ ## \]\]", ""), F.lit(" \t\r\n")).alias("v")))
    last = lambda i: F.try_element_at(F.filter("fields", lambda f: f["k"] == i), F.lit(-1))["v"]
    r = r.withColumn("fields", fields).withColumn("read", F.transform("ids", lambda i: F.struct(i.alias("k"), last(i).alias("v"))))
    missing = F.transform(F.filter("read", lambda f: f["v"].isNull()), lambda f: f["k"])
    error = F.when(F.col("reply").isNull(), "no reply").when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))).otherwise("")
    said = F.transform("read", lambda f: F.struct(f["k"], F.when(~F.lower(f["v"]).isin("", "null"), f["v"]).alias("v")))
    one = r.select("doc_id", "group", error.alias("error"), said.alias("said"))
    out = one.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("group", "said", "error"))).alias("g"), F.count_distinct("group").alias("n"))
    first = F.coalesce(F.get(F.filter(F.transform("g", lambda x: x["error"]), lambda e: e != ""), F.lit(0)), F.when(F.col("n") < len(registry.groups), "no reply").otherwise(""))
    ok = first == ""
    return out.select("doc_id", ok.alias("ok"), F.when(ok, F.map_from_entries(F.flatten(F.transform("g", lambda x: x["said"])))).alias("values"), first.alias("error"), F.lit(1).alias("attempts"))


def cached(ask: Ask, held: dict[str, str]) -> Ask:
    """``ask`` with replies kept by prompt; a further attempt asks afresh and replaces what was kept."""
    key = lambda p: hashlib.sha256(p.encode()).hexdigest()

    def out(prompts: list[str], attempt: int) -> list[Any]:
        todo = [p for p in dict.fromkeys(prompts) if attempt > 1 or key(p) not in held]
        fresh = dict(zip(todo, ask(todo, attempt), strict=True)) if todo else {}
        held.update({key(p): r for p, r in fresh.items() if isinstance(r, str)})
        return [fresh[p] if p in fresh else held[key(p)] for p in prompts]

    return out
