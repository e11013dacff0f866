"""Tables that change together: crashes between writes, writers at odds, extraction run again."""

import pytest
from pyspark.sql import functions as F

from verdigris.sources import commits
from verdigris.sources import extract as Ex

TWO = {"a": "k string, v long", "b": "k string, w string"}


def frames(spark, rows):
    df = spark.createDataFrame(rows, "k string, v long")
    return {"a": df, "b": df.select("k", F.col("v").cast("string").alias("w"))}


def test_both_tables_or_none(spark, tmp_path):
    t = commits.Tables(spark, str(tmp_path), TWO)
    assert t.parts() == [] and t.read("a").count() == 0 and t.latest("b", "k").count() == 0
    assert t.put(frames(spark, [("x", 1), ("y", 2)]), "first") == 1
    staged = t.stage()
    staged.write("a", frames(spark, [("x", 5)])["a"])  # dies before the second table
    other = t.stage()
    for name, df in frames(spark, [("x", 6)]).items():  # dies before its commit
        other.write(name, df)
    assert {(r["k"], r["v"]) for r in t.read("a").collect()} == {("x", 1), ("y", 2)}
    assert t.put(frames(spark, [("x", 7)]), "second") == 2
    assert {(r["k"], r["v"]) for r in t.latest("a", "k").collect()} == {("x", 7), ("y", 2)} and t.latest("b", "k").where("k = 'x'").first()["w"] == "7"
    assert t.clean() == 2 and t.clean() == 0 and t.read("a").count() == 3


def test_a_key_is_committed_once(spark, tmp_path):
    t = commits.Tables(spark, str(tmp_path), TWO)
    late = t.stage()
    for name, df in frames(spark, [("x", 1)]).items():
        late.write(name, df)
    assert t.put(frames(spark, [("x", 2)]), "batch-0") == 1 and t.put(frames(spark, [("x", 3)]), "batch-0") == 0
    with pytest.raises(commits.Conflict):
        late.commit("batch-0")
    assert [r["v"] for r in t.read("a").collect()] == [2]


def test_a_number_is_taken_once(spark, tmp_path, monkeypatch):
    t = commits.Tables(spark, str(tmp_path), TWO)
    t.put(frames(spark, [("x", 1)]))
    seen = t.parts()
    real, calls = commits.Tables.parts, []
    # a writer that listed the commits before another one renamed its own
    monkeypatch.setattr(commits.Tables, "parts", lambda self: calls.append(1) or (seen if len(calls) == 1 else real(self)))
    mine = t.stage()
    mine.write("a", frames(spark, [("y", 2)])["a"])
    monkeypatch.setattr(commits.Tables, "parts", real)
    t.put(frames(spark, [("z", 3)]))
    monkeypatch.setattr(commits.Tables, "parts", lambda self: calls.append(1) or (seen if len(calls) == 1 else real(self)))
    assert mine.commit() == 3 and len(calls) == 2
    monkeypatch.setattr(commits.Tables, "parts", real)
    assert [p.number for p in t.parts()] == [1, 2, 3] and {r["k"] for r in t.read("a").collect()} == {"x", "y", "z"}


def test_extraction_dies_between_its_tables(spark, tmp_path, monkeypatch):
    docs, out = tmp_path / "docs", str(tmp_path / "out")
    docs.mkdir()
    for i in range(5):
        (docs / f"d{i}.txt").write_text(f"text {i}\fpage two")
    real = commits.Staged.write

    def dies(self, table, rows):
        if table == "manifest":
            raise RuntimeError("power cut")
        return real(self, table, rows)

    monkeypatch.setattr(commits.Staged, "write", dies)
    with pytest.raises(RuntimeError, match="power cut"):
        Ex.extract_corpus(spark, str(docs), out, suffix="txt")
    monkeypatch.setattr(commits.Staged, "write", real)
    assert Ex.stored_texts(spark, out).count() == 0
    assert Ex.extract_corpus(spark, str(docs), out, suffix="txt").count() == 5
    tables = Ex.corpus_tables(spark, out)
    assert tables.read("texts").count() == 5 and tables.read("manifest").count() == 5
    (docs / "d9.txt").write_text("late")
    done = Ex.extract_corpus(spark, str(docs), out, suffix="txt")
    assert done.count() == 6 and tables.read("texts").count() == 6 and done.columns == list(Ex.MANIFEST)
    Ex.extract_corpus(spark, str(docs), out, suffix="txt")
    assert len(tables.parts()) == 2  # nothing new, no commit
    ids = spark.createDataFrame([("d9",), ("d0",)], "doc_id string")
    assert {r["text"] for r in Ex.load_texts(spark, out, ids).collect()} == {"late", "text 0\n\npage two"}
    with pytest.raises(Ex.BadCorpus, match="no text"):
        Ex.load_texts(spark, out, spark.createDataFrame([("zz",)], "doc_id string"))


def test_read_again_replaces_text_and_manifest(spark, tmp_path):
    docs, out = tmp_path / "docs", str(tmp_path / "out")
    docs.mkdir()
    (docs / "a.img").write_text("x")

    @Ex.register_extractor("scan")
    def scan(content):
        return [""], [0.9]

    first = Ex.extract_corpus(spark, str(docs), out, "scan", suffix="img").first()
    assert first["unread_pages"] == 1
    read = spark.createDataFrame([("a", 0, "said aloud", "complete")], "doc_id string, page int, text string, status string")
    again = Ex.extract_corpus(spark, str(docs), out, "scan", suffix="img", transcripts=read).collect()
    assert [(r["unread_pages"], r["transcribed_pages"]) for r in again] == [(0, 1)]
    assert [r["text"] for r in Ex.stored_texts(spark, out).collect()] == ["said aloud"]
