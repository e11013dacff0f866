"""Normalizers, matchers and spans on literal rows."""

import pytest
from pyspark.sql import functions as F

from verdigris.functions import match as M
from verdigris.functions import normalize as N
from verdigris.functions import similarity as S
from verdigris.functions import spans as Sp
from verdigris.functions import text as T

STATES = {"enum": ["CA", "NY", "none"], "synonyms": {"California": "CA"}}
NORMAL = [
    ("free_string", {}, [("  Net  30 ", "net 30"), ('"Net 30"', "net 30"), ("“Net 30”", "net 30"), ("N/A", None), (None, None), ("Straße", "strasse")]),
    ("boolean", {}, [("Yes", "true"), ("f", "false"), ("probably", "probably"), ("not stated", None)]),
    ("enum", STATES, [("CA", "CA"), ("n.y.", "NY"), ("N-Y", "NY"), ("california", "CA"), ("none", "none"), ("n/a", None), ("Klingon", "klingon")]),
    ("controlled_code", {"vocabulary": {"New York": "NY", "Texas": "TX"}}, [("texas", "TX"), ("ny", "NY"), ("null", None)]),
    ("entity_name", {}, [("Acme, L.L.C.", "acme"), ("The Smith & Sons Co.", "smith and sons"), ("U.S. Steel Corp", "us steel"), ("J. Brown Holdings", "j brown holdings"), ("Foo-Bar Inc Ltd", "foo bar"), ("--", None)]),
    ("person_name", {}, [("Dr. Ann Lee, PhD, M.D.", "ann lee"), ("Wei Ma", "wei ma"), ("Bob Ray Jr.", "bob ray jr"), ("Mary - Lou Esq", "mary-lou"), ("Dr.", None)]),
]


@pytest.mark.parametrize("name,params,cases", NORMAL, ids=[n[0] for n in NORMAL])
def test_text_normalizers(spark, name, params, cases):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, x string")
    once = N.normalizer(name)(F.col("x"), params)
    got = {r["i"]: (r["y"], r["z"]) for r in df.select("i", once.alias("y")).select("i", "y", N.normalizer(name)(F.col("y"), params).alias("z")).collect()}
    for i, (raw, want) in enumerate(cases):
        assert got[i][0] == want, (name, raw)
        if want is not None and not (name == "free_string"):
            assert got[i][1] == want, ("not the same again", name, raw)


def test_numbers(spark):
    cases = [("$1,234.50", 1234.5, "USD"), ("(1,234)", -1234.0, "USD"), ("1.2 million", 1.2e6, "USD"), ("12%", 12.0, "percent"), ("thirty (30) days", 30.0, "days"), ("USD 1 000", 1000.0, "USD"), ("3 months", 3.0, "months"), ("2k", 2000.0, "USD"), ("€5", 5.0, "EUR"), ("several", None, None), ("n/a", None, None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, x string").select("i", N.numeric(F.col("x"), {"unit": "USD"}).alias("q"))
    for r in df.collect():
        raw, value, unit = cases[r["i"]]
        q = r["q"]
        if raw == "n/a":
            assert q is None
        elif raw == "several":
            assert q["text"] == "several" and q["value"] is None
        else:
            assert (q["value"], q["unit"]) == (value, unit), raw
    r = spark.range(1).select(N.numeric_of(F.lit("3.25"), F.lit("million USD"), {}).alias("q")).first()["q"]
    assert (r["value"], r["unit"]) == (3.25e6, "USD")


def test_dates(spark):
    cases = [("2024", "2024", 1), ("2024-6", "2024-06", 2), ("June 2024", "2024-06", 2), ("2024 jun", "2024-06", 2), ("June 15, 2024", "2024-06-15", 3), ("15 June 2024", "2024-06-15", 3), ("6/15/2024", "2024-06-15", 3), ("15/6/2024", "2024-06-15", 3), ("2024-06-15", "2024-06-15", 3), ("2024-13", None, None), ("whenever", None, None), ("marble 2024", "2024-03", 2)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, x string").select("i", N.date(F.col("x"), {}).alias("d"))
    for r in df.collect():
        raw, iso, parts = cases[r["i"]]
        assert (r["d"]["iso"], r["d"]["parts"]) == (iso, parts), raw
        assert (r["d"]["text"] is None) == (iso is not None)
    assert spark.range(1).select(N.date(F.lit("3/4/2024"), {"dayfirst": True})["iso"]).first()[0] == "2024-04-03"


def test_unknown_names():
    with pytest.raises(N.UnknownName, match="entity_name"):
        N.normalizer("nope")
    with pytest.raises(N.UnknownName, match="numeric"):
        M.matcher("nope")


def plain_similarity(a, b):
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return 1.0 if a == b else 2 * row[-1] / (len(a) + len(b)) if a and b else 0.0


def test_similarity(spark):
    pairs = [("smith hartley", "hartley smith"), ("acme industries", "acme"), ("", ""), ("abc", ""), ("kitten", "sitting"), ("b a", "a b c")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.similarity(F.col("a"), F.col("b")).alias("s"), S.pair_scores(F.array("a"), F.array("b")).alias("q"))
    for r in df.collect():
        assert r["s"] == pytest.approx(-r["q"][0]["s"]) and r["s"] == pytest.approx(plain_similarity(r["a"], r["b"])), r
    assert S.common_length("kitten", "sitting") == 4


OUTCOMES = [
    ("identity", {"normalizer": "enum", "enum": ["A", "B"]}, "A", "a", (1, 0, 0, 0, True)),
    ("identity", {"normalizer": "enum", "enum": ["A", "B"]}, "A", "B", (0, 1, 1, 0, False)),
    ("exact", {}, None, "n/a", (0, 0, 0, 1, True)),
    ("exact", {}, "x", None, (0, 0, 1, 0, False)),
    ("exact", {}, None, "x", (0, 1, 0, 0, False)),
    ("entity_name", {"theta": 0.9}, "Smith & Hartley Ltd", "Hartley and Smith", (1, 0, 0, 0, True)),
    ("entity_name", {"theta": 0.9}, "Acme Industries", "Acme", (0, 1, 1, 0, False)),
    ("numeric", {"tolerance": 0.01}, "100 days", "100.5 days", (1, 0, 0, 0, True)),
    ("numeric", {"tolerance": 0.01}, "100 days", "100 months", (0, 1, 1, 0, False)),
    ("numeric", {"tolerance": 0.0}, "several", "several", (1, 0, 0, 0, True)),
    ("date", {}, "2024-06-15", "June 2024", (0, 1, 1, 0, False)),
    ("date", {"granularity": "month"}, "2024-06-15", "June 2024", (1, 0, 0, 0, True)),
    ("date", {"allow_coarser": True}, "2024-06-15", "2024", (1, 0, 0, 0, True)),
]


@pytest.mark.parametrize("name,params,gold,pred,want", OUTCOMES)
def test_outcomes(spark, name, params, gold, pred, want):
    df = spark.createDataFrame([(gold, pred)], "g string, p string")
    o = df.select(M.matcher(name)(F.col("g"), F.col("p"), params).alias("o")).first()["o"]
    assert (o["tp"], o["fp"], o["fn"], o["tn"], o["correct"]) == want
    assert o["tp"] + o["fp"] + o["fn"] + o["tn"] > 0
    if name not in ("date", "numeric"):
        b = df.select(M.matcher(name)(F.col("p"), F.col("g"), params).alias("o")).first()["o"]
        assert (b["fp"], b["fn"]) == (o["fn"], o["fp"])


def test_sets_and_lists(spark):
    df = spark.createDataFrame([(["a", "b", "b"], ["b", "c"]), ([], None), (["Jane Doe", "Al Roe"], ["Roe Al", "Jane Doe", "X Y"])], "g array<string>, p array<string>")
    s = [r["o"] for r in df.select(M.set_match(F.col("g"), F.col("p"), {"normalizer": "free_string"}).alias("o")).collect()]
    assert [(o["tp"], o["fp"], o["fn"], o["tn"]) for o in s[:2]] == [(1, 1, 1, 0), (0, 0, 0, 1)]
    low = [r["o"] for r in df.select(M.list_match(F.col("g"), F.col("p"), {"theta": 0.85}).alias("o")).collect()]
    assert [(o["tp"], o["fp"], o["fn"]) for o in low] == [(1, 1, 2), (0, 0, 0), (2, 1, 0)]
    assert low[2]["measure"] == 1.0 and low[1]["measure"] is None


def test_spans(spark):
    doc = "Notice: the “Seller” shall\n pay within thirty—30—days. Seller pays."
    quotes = ["shall pay within", '"THE "seller" shall"', "thirty-30-days", "not there", "...pay within...", "N/A", None]
    df = spark.createDataFrame([(doc, q) for q in quotes], "d string, q string")
    got = [r["s"] for r in df.select(Sp.span_of_quote(F.col("d"), F.col("q")).alias("s")).collect()]
    text = lambda s: doc[s["start"] : s["stop"]]
    assert text(got[0]) == "shall\n pay within" and text(got[1]) == "the “Seller” shall" and text(got[2]) == "thirty—30—days"
    assert got[3]["text"] == "not there" and got[3]["start"] is None and text(got[4]) == "pay within" and got[5] is None and got[6] is None
    o = spark.createDataFrame([((0, 100, None), (50, 120, None))], "g struct<start:int,stop:int,text:string>, p struct<start:int,stop:int,text:string>").select(M.span(F.col("g"), F.col("p"), {"overlap_threshold": 0.4}).alias("o")).first()["o"]
    assert (o["tp"], o["fp"], o["fn"], o["correct"]) == (50, 20, 50, True)
    assert o["measure"] == pytest.approx(50 / 120)


def test_excerpts(spark):
    r = spark.range(1).select(T.truncate(F.lit("a" * 50 + "b" * 50), 10, 0.7).alias("t"), T.context_window(F.lit("x\ny NEEDLE z"), F.lit("needle"), 3).alias("w"), T.doc_id_of(F.lit(" A.PDF ")).alias("d"), T.is_pdf(F.lit("/x/.a.pdf")).alias("p")).first()
    assert r["t"] == "aaaaaaa" + T.TRUNCATED + "bbb" and r["w"] == " y NEEDLE z"[-11:] and r["d"] == "A" and r["p"] is False


def test_equal_pairs_of_items_are_scored_once(monkeypatch):
    """A batch that repeats its items compares them once, and keeps a bounded number of scores."""
    import pyarrow as pa

    from verdigris.functions import similarity as S

    calls, real = [], S.common_length
    monkeypatch.setattr(S, "common_length", lambda a, b: calls.append(1) or real(a, b))
    a, b = pa.array([["one two", "", "three"], None, []] * 50), pa.array([["one twoz", "three"], ["x"], ["y"]] * 50)
    got = S._pair_scores.func(a, b).to_pylist()
    assert len(calls) == 3 and got[1::3] == [[]] * 50 and got[2::3] == [[]] * 50
    assert [(p["i"], p["j"]) for p in got[0]] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1)]
    assert got[0][0]["s"] == pytest.approx(-14 / 15) and got[0][5]["s"] == -1.0 and got[0][2]["s"] == 0.0
    monkeypatch.setattr(S, "_KEPT", 2)
    assert S._pair_scores.func(a, b).to_pylist() == got
