"""Sheets, replies, extraction, files, resumed runs, bookkeeping and the registered queries."""

import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from verdigris import project
from verdigris.__main__ import main
from verdigris.operators import facts as Fa
from verdigris.operators import gates as G
from verdigris.operators import labeling as L
from verdigris.operators import replies as R
from verdigris.operators import sampling as Sa
from verdigris.plans.registry import BadDeclaration, Registry
from verdigris.sources import extract as Ex
from verdigris.sources import io
from verdigris.streaming import resume

TASKS = Registry.of({"tasks": [
    {"id": "signed", "type": "binary", "question": "?", "nullable": False}, {"id": "state", "type": "multiclass", "question": "?", "output": {"enum": ["CA", "none"]}}, {"id": "tags", "type": "multilabel", "question": "?", "output": {"enum": ["x", "y"]}},
    {"id": "names", "type": "extract_list", "question": "?"}, {"id": "cost", "type": "extract_numeric", "question": "?", "match": {"tolerance": 0, "unit": "USD"}}, {"id": "day", "type": "extract_date", "question": "?"}, {"id": "place", "type": "span", "question": "?"},
]})


def test_sheet(spark):
    cols = "doc_id string, notes string, signed string, state string, tags string, names string, cost string, day string, place string"
    rows = spark.createDataFrame([
        ("a", "", "yes", "none", "Y; x", "Ann Lee; Bob Ray", "$5", "June 2024", "pay now"), ("b", "skip: too long", "", "", "", "", "", "", ""), ("c", "skip", "", "", "", "", "", "", ""), ("d", "", "", "", "", "", "", "", ""),
        ("e", "", "", "Ohio", "z", "Stryker Corp and Conformis Inc", "several", "whenever", "missing"), ("f", "", "no", "", "", "", "3 EUR", "", ""), ("a", "", "no", "", "", "", "", "", ""), ("q", "", "no", "", "", "", "", "", ""), ("g", "x", "no", "CA", "", "", "", "", ""),
    ], cols)
    plan = spark.createDataFrame([(x, x == "f") for x in "abcdefgh"], "doc_id string, is_prefilled boolean")
    texts = spark.createDataFrame([(x, "You shall pay  now. Then pay now again.") for x in "abcdef"], "doc_id string, text string")
    records, problems, warnings = L.import_sheet(rows, plan, texts, TASKS)
    p = {(r["doc_id"], r["task_id"]): r["problem"] for r in problems.collect()}
    assert p["c", None].startswith("skipped") and p["d", None].startswith("nothing") and p["q", None] == "not in the sample" and p["h", None] == "has no row" and p["g", None] == "no text" and p["a", None].startswith("appears")
    assert set(k for d, k in p if d == "e") == {"signed", "state", "tags", "cost", "day", "place"}
    w = {(r["doc_id"], r["task_id"]) for r in warnings.collect()}
    assert ("e", "names") in w and ("f", "cost") in w
    assert [r["doc_id"] for r in records.collect()] == ["f"] and records.first()["labeling_mode"] == "corrected"
    one = rows.limit(1)
    labels = L.import_sheet(one, plan.where("doc_id = 'a'"), texts, TASKS)[0].first()["labels"]
    assert labels["signed"] == "true" and labels["state"] == "none" and json.loads(labels["tags"]) == ["x", "y"] and json.loads(labels["cost"]) == {"value": 5.0, "unit": "USD"} and labels["day"] == "2024-06"


def test_replies(spark):
    t = Registry.of({"tasks": [{"id": "a", "type": "extract_exact", "question": "?"}, {"id": "b", "type": "extract_exact", "question": "?"}]})
    chat = ["[[ ## a ## ]]\n1\n[[ ## b ## ]]\nnull", "[[ ## a ## ]] 1", None]
    got = R.read_replies(spark.createDataFrame([(i, c) for i, c in enumerate(chat)], "i int, reply string"), t).orderBy("i").collect()
    assert [r["ok"] for r in got] == [True, False, False] and got[0]["pred"]["b"] == "null" and got[1]["error"] == "missing: b"
    js = ['x {"a": 1, "b": null} y', '{"a": 1}', "no"]
    got = R.read_replies(spark.createDataFrame([(i, c) for i, c in enumerate(js)], "i int, reply string"), t, "json").orderBy("i").collect()
    assert [r["ok"] for r in got] == [True, False, False] and got[0]["pred"]["a"] == "1" and got[0]["pred"]["b"] is None
    b = R.batches(spark.range(2500).withColumnRenamed("id", "doc_id"), 1000).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in b] == [1000, 1000, 500]
    whole = R.merge_groups(spark.createDataFrame([("d", "g1", {"a": "1"}), ("d", "g2", {"b": "2"}), ("e", "g1", {"a": "3"})], "doc_id string, group string, values map<string,string>"), 2)
    assert {r["doc_id"]: r["ok"] for r in whole.collect()} == {"d": True, "e": False}


def test_extraction(spark, tmp_path):
    for name, text in (("One.TXT", "page one\fpage two"), ("two.txt", "x"), (".hid.txt", "no")):
        (tmp_path / name).write_text(text)
    files = Ex.list_files(spark, str(tmp_path), "txt")
    pages = Ex.read_pages(files)
    docs = {r["doc_id"]: r for r in Ex.document_texts(pages, limit=10).collect()}
    assert set(docs) == {"One", "two"} and docs["One"]["page_count"] == 2 and docs["One"]["truncated"] and not docs["two"]["truncated"]
    (tmp_path / "one.txt").rename(tmp_path / "One .txt") if (tmp_path / "one.txt").exists() else (tmp_path / "One .txt").write_text("y")
    with pytest.raises(Ex.BadCorpus):
        Ex.list_files(spark, str(tmp_path), "txt")
    p = spark.createDataFrame([("d", ["", "long enough text", ""], [0.9, 0.0, 0.9], "plain", "")], "doc_id string, pages array<string>, images array<double>, extractor string, error string")
    t = spark.createDataFrame([("d", 0, "read from image", "ok")], "doc_id string, page int, text string, status string")
    r = Ex.document_texts(p, t).first()
    assert (r["thin_pages"], r["transcribed_pages"], r["unread_pages"]) == (2, 1, 1) and r["text"].startswith("read from image")
    assert Ex.pending_documents(files.select("doc_id"), spark.createDataFrame([("One", 0)], "doc_id string, unread_pages int")).where("doc_id = 'One'").count() == 0


def test_files(spark, tmp_path):
    good = tmp_path / "labels.jsonl"
    good.write_text('{"doc_id": "a", "labels": {"x": "1"}}\n{"doc_id": "b", "labels": {"x": null}, "inclusion_probability": 0.5}\n')
    rows = io.load_labels(spark, str(good))
    assert {r["doc_id"]: r["weight"] for r in Sa.weights_of(rows).collect()} == {"a": 1.0, "b": 2.0}
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"doc_id": "a", "labels": {"x": "1"}}\n{"doc_id": "a", "labels": {"x": "1"}}\nnot json\n{"labels": {}}\n')
    with pytest.raises(io.BadData, match="repeats"):
        io.load_labels(spark, str(bad))
    (tmp_path / "sheet.csv").write_text("file_name,notes,signed\nA.pdf,,yes\n,,\n")
    one = Registry.of({"tasks": [{"id": "signed", "type": "binary", "question": "?"}]})
    assert [tuple(r) for r in io.read_sheet(spark, str(tmp_path / "sheet.csv"), one).collect()] == [("A", "", "yes")]
    with pytest.raises(io.BadData):
        io.read_sheet(spark, str(tmp_path / "sheet.csv"), TASKS)
    with pytest.raises(io.BadData):
        io.append_ledger(spark.range(1).withColumn("nope", F.lit(1)), str(tmp_path / "ledger"))


def test_resume(spark, tmp_path):
    docs = spark.createDataFrame([(str(i), f"t{i}") for i in range(20)], "doc_id string, text string")
    path = str(tmp_path / "out")
    first = {r["doc_id"]: r for r in resume.produce(docs, path, resume.replay({str(i): {"x": i} for i in range(15)}), 2).collect()}
    assert sum(r["ok"] for r in first.values()) == 15 and first["19"]["attempts"] == 2 and first["3"]["values"] == {"x": "3"}
    again = {r["doc_id"]: r for r in resume.produce(docs, path, resume.replay({str(i): {"x": -i} for i in range(20)}), 2).collect()}
    assert all(r["ok"] for r in again.values()) and again["3"]["values"] == {"x": "3"} and again["19"]["values"] == {"x": "-19"}
    assert spark.read.parquet(path).count() == 25


def test_project(tmp_path, capsys):
    project.open_holdout(tmp_path, "me")
    with pytest.raises(project.Refused):
        project.open_holdout(tmp_path, "me")
    assert project.open_holdout(tmp_path, "me", "a bug")["overrides"][0]["reason"] == "a bug"
    b = project.Budget(max_rollouts=2, max_usd=1.0)
    b.count(2)
    with pytest.raises(project.BudgetSpent):
        b.count()
    with pytest.raises(project.Refused):
        b.check(0, 0.0, priced=False)
    f = tmp_path / "x"
    f.write_text("1")
    with pytest.raises(project.Refused), project.ReadOnly([f]):
        f.write_text("2")
    project.record_experiment(tmp_path, {}, 0.5, {})
    project.record_experiment(tmp_path, {}, 0.5, {})
    assert project.champion(tmp_path)["id"] == "exp_001" and [r["id"] for r in project.leaderboard(tmp_path)] == ["exp_001", "exp_002"]
    assert project.status(tmp_path)["phase"] == "holdout measured" and project.status(tmp_path)["next"] == "tasks declared"
    with pytest.raises(BadDeclaration):
        project.Config.of({"measurable_floor": 40})
    c = tmp_path / "config.yaml"
    c.write_text("support_floor: 20\n")
    project.add_excluded_classes(c, "flag", ["true"])
    assert project.Config.read(c).excluded_classes == {"flag": ["true"]}
    assert main(["status", str(tmp_path)]) == 0 and "holdout" in capsys.readouterr().out
    (tmp_path / "t.yaml").write_text("tasks: []\n")
    assert main(["check-tasks", str(tmp_path / "t.yaml")]) == 2


def test_adjudication(spark):
    r = Registry.of({"tasks": [{"id": "n", "type": "extract_fuzzy", "question": "?", "match": {"theta": 0.9}}, {"id": "c", "type": "extract_numeric", "question": "?", "match": {"tolerance": 0.01}}, {"id": "d", "type": "extract_date", "question": "?"}]})
    rows = spark.createDataFrame([("a", ("Smith Hartley", "100", "2024-06-15"), ("Smyth Hartley", "101.5", "June 2024")), ("b", ("x", "5 days", "2024"), ("completely other", "5 months", "2023"))], "doc_id string, gold struct<n:string,c:string,d:string>, pred struct<n:string,c:string,d:string>")
    got = {(x["doc_id"], x["task_id"]): x["reason"] for x in G.adjudicate(Fa.match_results(rows, r)).collect()}
    assert got["a", "n"].startswith("theta") and got["a", "c"].startswith("delta") and got["a", "d"].startswith("granularity")
    assert got["b", "n"] == "error" and got["b", "c"] == "units differ" and got["b", "d"] == "error"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_queries_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    assert entry.entry(spark).count() > 0
    names = ["norm_entity_name", "match_fuzzy", "match_numeric", "task_metrics", "make_splits", "adjudicate", "spend_totals"]
    for name in names:
        df, rel = entry.queries()[name](spark, sf), c.sql(entry.oracle_sql()[name])
        cols = sorted(df.columns)
        assert cols == sorted(rel.columns)
        norm = lambda rows, at: sorted(str([f"{r[i]:.6g}" if isinstance(r[i], float) else str(r[i]) for i in at]) for r in rows)
        assert norm(df.collect(), [df.columns.index(x) for x in cols]) == norm(rel.fetchall(), [rel.columns.index(x) for x in cols]), name
