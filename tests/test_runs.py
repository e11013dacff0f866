"""Runs, stored files, batches and the commands, over a project of their own."""

import csv
import json
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from verdigris import project
from verdigris.__main__ import main
from verdigris.operators import labeling, program, runs
from verdigris.operators import sampling as Sa
from verdigris.plans.registry import BadDeclaration, Registry
from verdigris.sources import extract, io, xlsx
from verdigris.streaming import resume, transcribe

TASKS = """tasks:
  - {id: urgent, type: binary, question: "Is it urgent?"}
  - {id: kind, type: multiclass, question: "Which kind?", output: {enum: [letter, bill]}}
"""
CUSTOM = """
def predictor(rows, attempt):
    return [{"urgent": "yes" if "now" in text else "no", "kind": "bill" if "pay" in text else "letter"} for _, text in rows]
"""


SERVICE = """
from verdigris.operators.batching import FolderService

def answer(custom_id, body):
    text = body.rsplit("Document:\\n", 1)[1]
    if text.endswith(" 7"):
        return None
    urgent = "null" if text.endswith(" 9") else "yes" if "now" in text else "no"
    kind = "" if text.endswith(" 8") else "[[ ## kind ## ]]\\n" + ("bill" if "pay" in text else "letter")
    return f"[[ ## urgent ## ]]\\n{urgent}\\n{kind}"

service = FolderService("FOLDER", answer)
"""


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "p"
    assert main(["newproject", str(root)]) == 0 and main(["newproject", str(root)]) == 2
    (root / "tasks.yaml").write_text(TASKS)
    (root / "custom.py").write_text(CUSTOM)
    for i in range(60):
        text = ("please pay " if i % 3 == 0 else "hello ") + ("now " if i % 2 == 0 else "later ") + f"number {i}"
        (root / "documents" / f"d{i:02d}.PDF").write_text(text)
    return root


def sheet_of(root: Path) -> list[dict]:
    part = next((root / "sheet").glob("part-*"))
    with part.open(encoding="utf-8", newline="") as f:
        return list(csv.DictReader(f))


def test_project_from_documents_to_report(spark, folder, capsys):
    root = str(folder)
    assert main(["extract", root]) == 0 and main(["extract", root]) == 0
    assert extract.stored_texts(spark, f"{root}/corpus").count() == 60
    assert main(["sample-labels", root, "--n", "54", "--seed", "3"]) == 0 and main(["sample-labels", root]) == 2
    plan = runs.load_plan(spark, folder / "label_plan.json")
    assert plan.count() == 54 and plan.where("is_holdout").count() == 14
    assert main(["label-sheet", root]) == 0
    rows = sheet_of(folder)
    assert len(rows) == 54 and rows[0]["urgent"] == "" and list(rows[0]) == ["file_name", "notes", "urgent", "kind"]
    filled = folder / "filled.csv"

    def fill(kind: str) -> None:
        with filled.open("w", encoding="utf-8", newline="") as f:
            out = csv.DictWriter(f, list(rows[0]))
            out.writeheader()
            for r in rows:
                i = int(r["file_name"][1:])
                out.writerow(r | {"urgent": "yes" if i % 2 == 0 else "no", "kind": "bill" if i % 3 == 0 else kind})

    fill("parcel")
    assert main(["import-labels", root, str(filled)]) == 2 and "not one of" in capsys.readouterr().err
    fill("letter")
    assert main(["import-labels", root, str(filled)]) == 0 and main(["audit-labels", root]) == 0
    assert main(["make-splits", root]) == 0 and main(["make-splits", root]) == 2
    splits = runs.load_splits(spark, folder / "splits.json")
    assert splits.count() == 54 and splits.where("split = 'holdout'").join(plan.where("is_holdout"), "doc_id").count() == 14
    assert main(["run-baseline", root]) == 0 and runs.load_metrics(folder / "runs" / "baseline_zero_shot")["summary"]["aggregate"] == 1.0
    assert main(["compile", root]) == 0 and project.champion(root)["aggregate"] == 1.0
    assert main(["holdout", root, "--who", "me"]) == 0 and main(["holdout", root, "--who", "me"]) == 2
    report = (folder / "runs/holdout/report.md").read_text()
    assert "aggregate 1.000 (1.000 to 1.000) over 14 documents; validation 1.000, +0.000" in report and "within_ci: holdout and validation agree. Next: release it." in report
    assert "| urgent | true | 1.000 |" in report and "| kind | all answers | 1.000 |" in report and "can carry" in report
    champion = project.champion(root)["id"]
    strict = TASKS.replace("enum: [letter, bill]}", "enum: [letter, bill], synonyms: {bills: bill}}")
    (folder / "tasks.yaml").write_text(strict)
    (folder / "labels.jsonl").rename(folder / "labels.old")
    spark.read.text(str(folder / "labels.old")).selectExpr("replace(value, '\"kind\":\"bill\"', '\"kind\":\"letter\"') AS value").write.text(str(folder / "labels.jsonl"))
    capsys.readouterr()
    assert main(["rescore", root, champion]) == 0 and "(was 1.000)" in capsys.readouterr().out
    assert runs.load_metrics(folder / "runs" / champion)["summary"]["aggregate"] < 1
    assert main(["adjudicate", root, champion]) == 0 and "0 close calls, 3 other errors" in capsys.readouterr().out and (folder / "runs" / champion / "adjudication.md").exists()
    assert main(["rescore", root, "exp_099"]) == 2 and main(["adjudicate", root, "holdout"]) == 0
    (folder / "adjudication.md").unlink()
    assert main(["production", root]) == 0 and "coverage" in (folder / "qa.md").read_text()
    assert spark.read.text(f"{root}/outputs").count() == 60
    assert "production run" in project.status(root)["done"]
    assert main(["production", root, "--batch"]) == 2 and "service" in capsys.readouterr().err
    (folder / "custom.py").write_text(CUSTOM + SERVICE.replace("FOLDER", f"{root}/service"))
    assert main(["production", root, "--batch"]) == 0 and main(["production", root, "--batch"]) == 0
    sent = json.loads(next((folder / "service/batches").glob("*/*.json")).read_text())
    assert len(sent) == 60 and len(list((folder / "service/batches").glob("*/*.json"))) == 1 and sent[0][1].startswith("urgent (binary")
    done = {o["doc_id"]: o for o in (json.loads(r["value"]) for r in spark.read.text(f"{root}/outputs").collect())}
    assert len(done) == 60 and done["d07"] == {"doc_id": "d07", "ok": False, "error": "no reply"} and done["d08"]["error"] == "missing: kind"
    assert done["d06"]["values"] == {"urgent": "yes", "kind": "bill"} and done["d09"]["values"] == {"urgent": None, "kind": "bill"}
    assert main(["close", root]) == 0 and "adjudication.md: missing" in (folder / "REPORT.md").read_text()
    assert runs.write_prompt(Registry.read(f"{root}/tasks.yaml"), folder, [{"text": "x" * 900, "labels": {"urgent": "yes"}}]).read_text().count("x") < 500


def test_stored_files(spark, tmp_path):
    r = Registry.of({"tasks": [{"id": "k", "type": "multiclass", "question": "?", "output": {"enum": ["a", "b"]}}]})
    docs = spark.createDataFrame([("1", "t"), ("2", "t"), ("3", "t")], "doc_id string, text string")
    gold = spark.createDataFrame([("1", ("a",)), ("2", ("b",)), ("3", ("b",))], "doc_id string, gold struct<k:string>")
    scored, outcomes = runs.evaluate(docs, gold, r, resume.replay({"1": {"k": "a"}, "2": {"k": "a"}}), ceiling=1.0)
    runs.write_run(scored, r, tmp_path / "run", outcomes.withColumnRenamed("values", "predicted"))
    payload = runs.load_metrics(tmp_path / "run")
    assert payload["summary"]["failed"] == 1 and payload["summary"]["n"] == 3 and runs.primary_of(payload)["k"] < 1 and set(runs.null_rates_of(payload)) == {"k"}
    assert "expected b, got a" in (tmp_path / "run" / "failures.md").read_text()
    back = {x["doc_id"]: x for x in io.load_predictions(spark, str(tmp_path / "run" / "predictions")).collect()}
    assert back["1"]["predicted"] == {"k": "a"} and back["3"]["failed"]["error"]
    with pytest.raises(io.BadData):
        (tmp_path / "s.json").write_text(json.dumps({"train": ["1"], "val": ["1"], "holdout": [], "seed": 1}))
        runs.load_splits(spark, tmp_path / "s.json")
    with pytest.raises(io.BadData):
        (tmp_path / "p.json").write_text(json.dumps({"sampled": ["1"], "holdout": ["1"], "prefilled": ["1"]}))
        runs.load_plan(spark, tmp_path / "p.json")
    two = runs.run_baselines(docs, gold, r, {"good": resume.replay({"1": {"k": "a"}, "2": {"k": "b"}, "3": {"k": "b"}}), "none": resume.replay({})}, tmp_path)
    assert [x["name"] for x in two] == ["good", "none"] and "near zero" not in runs.baselines_markdown(two) and "near zero" in runs.baselines_markdown(two[1:])
    budget = project.Budget(max_experiments=1)
    entry = runs.run_experiment(docs, gold, r, lambda parent: resume.replay({"1": {"k": "a"}}), tmp_path, {"name": "x"}, budget)
    assert entry["id"] == "exp_001" and budget.rollouts == 5
    with pytest.raises(project.Refused):
        runs.run_experiment(docs, gold, r, lambda parent: resume.replay({}), tmp_path, {}, budget)
    assert Sa.support_decision(tmp_path, "k", "b", "merge")["choice"] == "merge" and len(json.loads((tmp_path / "support_decisions.json").read_text())) == 1


def test_extraction_goes_on(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.pdf").write_text("one")
    first = extract.extract_corpus(spark, str(src), str(tmp_path / "out"))
    assert [r["doc_id"] for r in first.collect()] == ["a"]
    (src / "b.PDF").write_text("two\fpages")
    second = {r["doc_id"]: r for r in extract.extract_corpus(spark, str(src), str(tmp_path / "out")).collect()}
    assert set(second) == {"a", "b"} and second["b"]["page_count"] == "2" and set(extract.MANIFEST) <= set(second["b"].asDict())
    ids = spark.createDataFrame([("b",)], "doc_id string")
    assert extract.load_texts(spark, str(tmp_path / "out"), ids).first()["text"] == "two\n\npages"
    with pytest.raises(extract.BadCorpus, match="zz"):
        extract.load_texts(spark, str(tmp_path / "out"), spark.createDataFrame([("zz",)], "doc_id string"))


def test_a_predictor_that_raises_fails_alone(spark):
    def touchy(rows, attempt):
        if any(d == "3" for d, _ in rows):
            raise ValueError("can't read 3")
        return [{"x": "1"} for _ in rows]

    docs = spark.range(6).select(F.col("id").cast("string").alias("doc_id"), F.lit("t").alias("text"))
    got = {r["doc_id"]: r for r in resume.predict(docs, touchy, 2).collect()}
    assert [d for d, r in got.items() if not r["ok"]] == ["3"] and "can't read 3" in got["3"]["error"]


def test_the_latest_good_outcome_counts(spark, tmp_path):
    docs = spark.createDataFrame([("a", "t")], "doc_id string, text string")
    path = str(tmp_path / "o")
    for x in "12":
        resume.predict(docs, resume.replay({"a": {"x": x}})).write.mode("append").parquet(path)
    assert resume.produce(docs, path, resume.replay({})).first()["values"] == {"x": "2"}


def test_messages_say_how_many_more(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text("\n".join(json.dumps({"doc_id": str(i)}) for i in range(70)))
    with pytest.raises(io.BadData, match="and 20 more"):
        io.load_labels(spark, str(tmp_path / "l.jsonl"))


def test_workbooks(spark, tmp_path):
    r = Registry.of({"tasks": [{"id": "k", "type": "multiclass", "question": "?", "output": {"enum": ["a", "b"]}}, {"id": "flag", "type": "binary", "question": "?"}]})
    plan = spark.createDataFrame([("d1", False), ("d2", True)], "doc_id string, is_prefilled boolean")
    values = spark.createDataFrame([("d2", ("b", "true"))], "doc_id string, values struct<k:string,flag:string>")
    path = str(tmp_path / "s.xlsx")
    labeling.write_workbook(labeling.sheet_frame(plan, values, r), r, path)
    head, rows = xlsx.read_xlsx(path)
    assert head == ["file_name", "notes", "k", "flag"] and rows == [["d1", "", "", ""], ["d2", "", "b", "yes"]]
    assert [tuple(x) for x in io.read_sheet(spark, path, r).orderBy("doc_id").collect()] == [("d1", "", "", ""), ("d2", "", "b", "yes")]
    xlsx.write_xlsx(tmp_path / "odd.xlsx", ["a", "b"], [["x & <y>\x01", " é"], ["", ""]], {0}, {"a": ["z" * 300]})
    assert xlsx.read_xlsx(tmp_path / "odd.xlsx") == (["a", "b"], [["x & <y>", "é"]])
    with zipfile.ZipFile(tmp_path / "typed.xlsx", "w") as z, zipfile.ZipFile(path) as old:
        for n in old.namelist():
            body = old.read(n).decode()
            if n.endswith("sheet1.xml"):
                body = body[: body.index("<sheetData>")] + '<sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>h</t></is></c><c r="C1" t="inlineStr"><is><t>i</t></is></c></row><row r="3"><c r="A3" t="b"><v>1</v></c><c r="B3" s="3"><v>45292</v></c><c r="C3"><v>2.50</v></c></row></sheetData></worksheet>'
            if n.endswith("styles.xml"):
                body = body.replace("</cellXfs>", '<xf numFmtId="14"/></cellXfs>')
            z.writestr(n, body)
    assert xlsx.read_xlsx(tmp_path / "typed.xlsx") == (["h", "", "i"], [["", "", ""], ["yes", "2024-01-01", "2.50"]])


def test_programs(spark, tmp_path):
    r = Registry.of({"tasks": [{"id": "a", "type": "binary", "question": "A?"}, {"id": "b", "type": "extract_exact", "question": "B?", "group": "two words"}]})
    asked = []

    def ask(prompts, attempt):
        asked.append((len(prompts), attempt))
        return [f"[[ ## a ## ]]\nyes" if "A?" in p else "[[ ## b ## ]]\nnull" if "good" in p else "nothing" for p in prompts]

    out = program.build_program(r, ask)([("1", "good"), ("2", "bad")], 1)
    assert out[0] == {"a": "yes", "b": None} and isinstance(out[1], ValueError)
    p = program.Program.of(r)
    p.demos.append({"text": "shown", "labels": {"a": True, "b": "x"}})
    p.save(tmp_path / "p.json")
    again = program.Program.load(tmp_path / "p.json", r)
    assert again == p and "shown" in again.prompt(r, "all", "t") and "[[ ## b ## ]]\nx" in again.prompt(r, "two words", "t")
    with pytest.raises(BadDeclaration):
        program.Program.load(tmp_path / "p.json", Registry.of({"tasks": [{"id": "a", "type": "binary", "question": "A?"}]}))
    asked.clear()
    held = program.cached(ask, {})
    held(["A? x", "A? x"], 1), held(["A? x"], 1), held(["A? x"], 2)
    assert asked == [(1, 1), (1, 2)]
    assert program.attribute_for("two words") != program.attribute_for("two-words") and program.attribute_for("all") == "all"
    assert program.ModelConfig("m", thinking=False).options()["thinking"] == "off" and not program.ModelConfig("m").priced
    with pytest.raises(BadDeclaration):
        program.ModelConfig("m", effort="low", thinking=False)


def test_pages_are_read_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def read(image):
        (log / f"{image.decode()}-{len(list(log.iterdir()))}").write_text("")
        if image == b"bad":
            raise ValueError
        return image.decode().upper(), image != b"cut"

    pages = spark.createDataFrame([("d", 0, bytearray(b"one")), ("d", 1, bytearray(b"cut")), ("e", 0, bytearray(b"one")), ("e", 1, bytearray(b"bad"))], "doc_id string, page int, image binary").coalesce(1)
    for _ in range(2):
        got = {(r["doc_id"], r["page"]): (r["text"], r["status"]) for r in transcribe.transcribe(pages, read, str(tmp_path / "cache"), retries=1).collect()}
        assert got == {("d", 0): ("ONE", "complete"), ("d", 1): ("CUT", "truncated"), ("e", 0): ("ONE", "complete"), ("e", 1): (None, "failed")}
    assert sum(p.name.startswith("one") for p in log.iterdir()) == 1 and sum(p.name.startswith("bad") for p in log.iterdir()) == 2


def test_spend_is_read(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"model": "m", "input_tokens": 5, "usd": 0.1}\n')
    assert io.load_spend(spark, str(tmp_path / "s.jsonl")).first()["input_tokens"] == 5
    (tmp_path / "s.jsonl").write_text("no\n")
    with pytest.raises(io.BadData):
        io.load_spend(spark, str(tmp_path / "s.jsonl"))
