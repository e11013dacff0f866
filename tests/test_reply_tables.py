"""Replies kept in a table, and replies of any shape."""

from decimal import Decimal

from pyspark.sql import functions as F

from verdigris.operators import reply_cache as Rc
from verdigris.operators import typed_replies as Ty
from verdigris.plans.registry import Registry
from verdigris.sources import commits


def model(tmp_path):
    """A model that notes every prompt it is asked, and fails at two of them."""
    folder = str(tmp_path)

    def ask(prompts, attempt):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}.txt", "w") as f:
            f.write("\n".join(prompts) + "\n")
        if any(p == "boom" for p in prompts):
            raise ValueError("out of order")
        return [None if p == "mute" else f"{p} / {attempt}" for p in prompts]

    ask.__module__ = "__main__"
    return ask, lambda: sorted(line for p in tmp_path.glob("*.txt") for line in p.read_text().splitlines())


def test_a_prompt_is_asked_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    ask, asked = model(log)
    root = str(tmp_path / "cache")
    prompts = spark.createDataFrame([(i, f"q{i % 3}", "x") for i in range(9)] + [(9, "mute", "x"), (10, None, "x")], "doc_id int, prompt string, reply_to string").repartition(3)
    first = {r["doc_id"]: r for r in Rc.ask_kept(prompts, root, "m", ask).collect()}
    assert len(first) == 11 and not any(r["hit"] for r in first.values()) and first[4]["reply"] == "q1 / 1" and first[9]["error"] == "no reply" and first[10]["reply"] == " / 1"
    assert asked() == ["", "mute", "q0", "q1", "q2"]
    again = {r["doc_id"]: r for r in Rc.ask_kept(prompts.where("doc_id <> 9"), root, "m", ask).collect()}
    assert all(r["hit"] for r in again.values()) and len(asked()) == 5
    Rc.ask_kept(prompts, root, "m", ask)  # a failed reply is asked again
    assert asked().count("mute") == 2 and len(asked()) == 6
    third = {r["doc_id"]: r for r in Rc.ask_kept(prompts.where("doc_id < 3"), root, "m", ask, attempt=2).collect()}
    assert third[1]["reply"] == "q1 / 2" and not third[1]["hit"] and len(asked()) == 9
    assert all(r["hit"] for r in Rc.ask_kept(prompts.where("doc_id < 3"), root, "m", ask, attempt=2).collect()) and len(asked()) == 9
    assert Rc.ask_kept(prompts.where("doc_id = 1"), root, "m", ask).first()["reply"] == "q1 / 2"
    assert not Rc.ask_kept(prompts.where("doc_id = 1"), root, "other model", ask).first()["hit"]
    assert Rc.ask_kept(prompts.limit(0), root, "m", ask).count() == 0


def test_a_model_that_fails_and_a_run_that_dies(spark, tmp_path, monkeypatch):
    log = tmp_path / "log"
    log.mkdir()
    ask, asked = model(log)
    root = str(tmp_path / "cache")
    prompts = spark.createDataFrame([(1, "boom"), (2, "fine")], "doc_id int, prompt string").repartition(2, "doc_id")
    got = {r["doc_id"]: r for r in Rc.ask_kept(prompts, root, "m", ask, batch=1).collect()}
    assert got[1]["error"] == "out of order" and got[2]["reply"] == "fine / 1"
    real = commits.Staged.commit
    monkeypatch.setattr(commits.Staged, "commit", lambda self, key="": (_ for _ in ()).throw(RuntimeError("power cut")))
    try:
        Rc.ask_kept(spark.createDataFrame([(3, "late")], prompts.schema), root, "m", ask)
    except RuntimeError:
        pass
    monkeypatch.setattr(commits.Staged, "commit", real)
    assert not Rc.ask_kept(spark.createDataFrame([(3, "late")], prompts.schema), root, "m", ask).first()["hit"]


TASKS = Registry.of({"tasks": [
    {"id": "flag", "type": "binary", "question": "?"}, {"id": "kind", "type": "multiclass", "question": "?", "output": {"enum": ["a", "b"]}}, {"id": "tags", "type": "multilabel", "question": "?", "output": {"enum": ["a", "b"]}},
    {"id": "cost", "type": "extract_numeric", "question": "?", "match": {"tolerance": 0}}, {"id": "day", "type": "extract_date", "question": "?"}, {"id": "it's", "type": "span", "question": "?"},
]})
CASES = [
    ('{"flag": true, "kind": "a", "tags": ["a", "b"], "cost": {"value": 1.5, "unit": "EUR"}, "day": "2024-01-02"}', (True, "a", ["a", "b"], (1.5, "EUR"), "2024-01-02"), []),
    ('{"flag": " FALSE ", "kind": 3, "tags": "a", "cost": 7, "day": null}', (False, "3", ["a"], (7.0, None), None), []),
    ('{"flag": "perhaps", "kind": ["a"], "tags": {"a": 1}, "cost": "much", "day": {"y": 1}}', (None, None, None, None, None), ["flag", "kind", "tags", "cost", "day"]),
    ('{"flag": 1, "tags": [], "cost": "12", "kind": true}', (None, "true", [], (12.0, None), None), ["flag"]),
    ('{"cost": {"unit": "EUR"}, "tags": [1, "b"]}', (None, None, ["1", "b"], None, None), ["cost"]),
    ("{}", (None, None, None, None, None), []),
    ("null", (None, None, None, None, None), []),
    ("[1]", (None, None, None, None, None), []),
]


def test_values_by_type(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, j string").select("i", F.parse_json("j").alias("predicted"))
    for r in Ty.typed(rows, TASKS).orderBy("i").collect():
        v, (_, want, wrong) = r["values"], CASES[r["i"]]
        assert (v["flag"], v["kind"], v["tags"], v["cost"] and tuple(v["cost"]), v["day"]) == want, CASES[r["i"]]
        assert [p.split(":")[0] for p in r["problems"]] == wrong
    spans = ['{"it\'s": {"start": 2, "stop": 9}}', '{"it\'s": "word for word"}', '{"it\'s": {"text": "quoted"}}', '{"it\'s": {"start": 2}}', '{"it\'s": 5}']
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(spans)], "i int, j string").select("i", F.parse_json("j").alias("predicted"))
    got = [(r["values"]["it's"] and tuple(r["values"]["it's"]), len(r["problems"])) for r in Ty.typed(rows, TASKS).orderBy("i").collect()]
    assert got == [((2, 9, None), 0), ((None, None, "word for word"), 0), ((None, None, "quoted"), 0), (None, 1), (None, 1)]


def test_predictions_there_and_back(spark, tmp_path):
    rows = spark.createDataFrame([("a", True, None, '{"x": {"y": [1, {"z": null}]}, "w": "ü"}'), ("b", False, "no reply", None), ("c", True, None, "{}")], "doc_id string, ok boolean, error string, j string")
    out = rows.withColumn("predicted", F.parse_json("j"))
    Ty.prediction_lines(out).select("value").write.text(str(tmp_path / "p"))
    with open(tmp_path / "p" / "part-zz.txt", "w") as f:
        f.write('{"doc_id": "d", "pred\n\n{"doc_id": 7, "predicted": 1}\n')
    got = {r["doc_id"]: r for r in Ty.read_predictions(spark, str(tmp_path / "p")).withColumn("j", F.to_json("predicted")).collect()}
    assert len(got) == 5 and got["a"]["ok"] and got["a"]["j"] == '{"w":"ü","x":{"y":[1,{"z":null}]}}' and got["c"]["j"] == "{}" and got["7"]["j"] == "1"
    assert not got["b"]["ok"] and got["b"]["error"] == "no reply" and got["b"]["j"] is None
    assert got[None]["error"] == "no JSON" and got[None]["line"].startswith('{"doc_id": "d"')
    typed = Ty.typed(Ty.read_predictions(spark, str(tmp_path / "p")), TASKS).where("NOT ok").select("values.flag", F.size("problems").alias("n")).collect()
    assert [tuple(r) for r in typed] == [(None, 0)] * 2


def test_variants_are_stored_as_they_are(spark, tmp_path):
    rows = spark.createDataFrame([(1, '{"a": 1.25}')], "i int, j string").select("i", F.parse_json("j").alias("v"))
    rows.write.parquet(str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).select(F.try_variant_get("v", "$.a", "decimal(4,2)").alias("a")).first()["a"] == Decimal("1.25")
