"""SQL functions beside the column functions of the same names."""

import pytest
from pyspark.sql import functions as F

from verdigris.functions import normalize as N
from verdigris.functions import sql as S
from verdigris.functions.match import matcher
from verdigris.plans.registry import Registry

ODD = [
    None, "", "  ", "N/A", " not  stated ", "“quoted”", "'single'", '"', "''", "`x`", "a'b\\c", "L.L.C.", "The  Acme & Sons, L.L.C.", "A.B. Co. Ltd", "Straße – 5…", "Yes", " f ", "Dr. Ann O'Neil-Smith, Ph.D.", "MR X Jr.", "prof", "Ünï\tcode\n x",
    "the the inc", "co", "English", "en_", "E.N.", "ENGLISH", "fr-", "x y", "J. R. R. Tolkien", "100%", "-", "--", "null", "a \\' b",
]
TASKS = Registry.of({"tasks": [
    {"id": "lang", "type": "multiclass", "question": "?", "output": {"enum": ["en", "fr", "It's \\ odd"], "synonyms": {"English": "en", "its  odd": "It's \\ odd"}}, "match": {"null_tokens": ["co", "--"]}},
    {"id": "flag", "type": "binary", "question": "?"}, {"id": "a number", "type": "extract_exact", "question": "?"}, {"id": "cost", "type": "extract_numeric", "question": "?", "match": {"tolerance": 0}},
]})


def test_the_same_as_columns(spark):
    names = S.register(spark, TASKS)
    assert {"norm_lang", "match_lang", "norm_a number", "match_flag", "match_exact"} <= set(names) and "norm_cost" not in names
    df = spark.createDataFrame([(i, c, ODD[(i * 7 + 3) % len(ODD)] if i % 3 else c) for i, c in enumerate(ODD)], "i int, c string, d string")
    df.createOrReplaceTempView("odd")
    ways = {"norm_free_string": lambda c: N.free_string(c, {}), "norm_boolean": lambda c: N.boolean(c, {}), "norm_entity_name": lambda c: N.entity_name(c, {}), "norm_person_name": lambda c: N.person_name(c, {})}
    ways |= {f"norm_{t.id}": t.normalized for t in TASKS if t.id != "cost"}
    for name, column in ways.items():
        got = spark.sql(f"SELECT i, `{name}`(c) AS v FROM odd")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
        want = {r["i"]: r["v"] for r in df.select("i", column(F.col("c")).alias("v")).collect()}
        assert {r["i"]: r["v"] for r in got.collect()} == want, name
    counts = ("tp", "fp", "fn", "tn", "correct")
    matchers = {"match_exact": lambda g, p: matcher("exact")(g, p, {}), **{f"match_{t.id}": t.match for t in TASKS if t.id != "cost"}}
    for name, column in matchers.items():
        got = {r["i"]: tuple(r["o"]) for r in spark.sql(f"SELECT i, `{name}`(c, d) AS o FROM odd").collect()}
        want = {r["i"]: tuple(r["o"][k] for k in counts) for r in df.select("i", column(F.col("c"), F.col("d")).alias("o")).collect()}
        assert got == want, name


def test_what_has_no_sql_form_is_refused(spark):
    for match in ({"normalizer": "date"}, {"compatibility": True}, {"null_tokens": ["x"]}):
        with pytest.raises(N.UnknownName, match="number"):
            S.register(spark, Registry.of({"tasks": [{"id": "number", "type": "extract_exact", "question": "?", "match": match}]}))
