"""Files as a data source: pages, partitions by bytes, conditions that reach the listing, bad files."""

import pytest
from pyspark.sql import functions as F

from verdigris.sources import documents as Do
from verdigris.sources import extract as Ex


def make_strict():
    def strict(content: bytes):
        pages = content.decode("utf-8").split("\f")
        return pages, [0.9 if len(p) < 5 else 0.0 for p in pages]

    strict.__module__ = "__main__"  # goes to the workers as it is: they can't import this file
    return strict


@pytest.fixture
def folder(tmp_path):
    for name, content in {"one.txt": b"page one\fpp", "Two.TXT": b"x" * 2000, "bad.txt": b"\xff\xfe", "empty.txt": b"", ".hid.txt": b"no", "other.pdf": b"no"}.items():
        (tmp_path / name).write_bytes(content)
    return str(tmp_path)


def load(spark, folder, **options):
    Ex.register_extractor("strict")(make_strict())
    Do.register(spark)
    return spark.read.format("document_pages").options(suffix="txt", extractor="strict", **options).load(folder)


def test_pages(spark, folder):
    rows = {(r["doc_id"], r["page"]): r for r in load(spark, folder).collect()}
    assert set(rows) == {("one", 0), ("one", 1), ("Two", 0), ("bad", None), ("empty", 0)}
    assert rows["one", 1]["text"] == "pp" and rows["one", 1]["image"] == 0.9 and rows["one", 0]["n_bytes"] == 11 and rows["Two", 0]["file_name"] == "Two.TXT"
    assert rows["bad", None]["error"].startswith("UnicodeDecodeError") and rows["empty", 0]["text"] == ""
    assert {r["extractor"] for r in load(spark, folder, fallback="plain").where("doc_id = 'bad'").collect()} == {"plain"}
    docs = {r["doc_id"]: r for r in Ex.document_texts(Do.by_document(load(spark, folder)), limit=100).collect()}
    assert len(docs) == 4 and docs["one"]["thin_pages"] == 1 and docs["one"]["text"] == "page one\n\npp" and docs["Two"]["truncated"] and docs["bad"]["page_count"] == 0 and docs["bad"]["error"]


def test_partitions_by_bytes(spark, folder):
    assert load(spark, folder).rdd.getNumPartitions() == 1 and load(spark, folder, partitionBytes="12").rdd.getNumPartitions() == 3
    files = [(str(i), f"/{i}", i) for i in range(40)]
    parts = Do.dealt(files, 50)
    assert sorted(f for p in parts for f in p) == sorted(files) and all(sum(f[2] for f in p) <= 50 for p in parts)
    assert Do.dealt([], 50) == [] and [len(p) for p in Do.dealt(files, 10**9, 15)] == [15, 15, 10]
    assert Do.dealt([("a", "/a", 99), ("b", "/b", 1)], 50) == [[("a", "/a", 99)], [("b", "/b", 1)]]


def test_only_younger_files(spark, folder):
    import os

    for name in ("one.txt", "bad.txt", "empty.txt"):
        os.utime(f"{folder}/{name}", (1_000, 1_000))
    young = load(spark, folder, modifiedAfter="1000", partitionBytes="1")
    assert [r["doc_id"] for r in young.collect()] == ["Two"] and young.rdd.getNumPartitions() == 1
    every = load(spark, folder)
    assert every.where("doc_id = 'one'").count() == 2 and every.count() == 5


def test_two_files_of_one_id_and_unknown_extractors(spark, folder, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "one.txt").write_text("again")
    assert load(spark, folder).where("doc_id = 'one'").count() == 2
    with pytest.raises(Exception, match="several files have one id"):
        load(spark, folder, recursive="true").count()
    with pytest.raises(Exception, match="no extractor"):
        load(spark, folder, fallback="nope").count()
    (tmp_path / "none").mkdir()
    assert load(spark, str(tmp_path / "none")).count() == 0
