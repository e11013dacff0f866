"""Registered queries over tables of a few rows."""

import hashlib
from collections import Counter

from verdigris.plans import more_queries as _more  # noqa: F401  # registers beside the others
from verdigris.plans import queries as Q


def test_match_list_takes_every_line(spark, tmp_path):
    lines = [(o, n, (o + n) % 3) for o in range(1, 30) for n in range(1, 2 + o % 7)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, f"part {k}") for k in range(3)], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    want = {}
    for o in {x[0] for x in lines}:
        gold, pred = Counter(), Counter()
        for _, n, k in (x for x in lines if x[0] == o):
            b = int(hashlib.md5(f"{o}-{n}:item".encode()).hexdigest()[:8], 16) % 100
            gold[k] += b < 80
            pred[k] += 2 if b >= 90 else int(b >= 10)
        tp = (gold & pred).total()
        want[o] = (tp, pred.total() - tp, gold.total() - tp)
    got = {r["l_orderkey"]: (r["tp"], r["fp"], r["fn"]) for r in Q.queries()["match_list"](spark, str(tmp_path)).collect()}
    assert got == want


def test_quotes_are_places_of_their_own_characters(spark, tmp_path):
    """Other case, white space, marks at the ends, null words and missing texts: what the query's SQL says of each."""
    docs = [(0, "he said SHALL pay\n within days"), (1, "see one two three"), (2, None), (3, "N/A or more"), (4, "aç😀 nine ten"), (5, "x"), (6, "x")]
    quotes = [(0, "shall pay within"), (1, '"one two"'), (2, "gone"), (3, "N/A"), (4, "nine"), (5, None), (6, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(quotes, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: (r["start"], r["text"]) for r in Q.queries()["quotes_to_spans"](spark, str(tmp_path)).collect()}
    assert got == {0: (None, "shall pay within"), 1: (None, '"one two"'), 2: (None, None), 3: (0, None), 4: (4, None), 5: (None, None), 6: (0, None)}


def test_streamed_documents_are_written_by_the_tables_own_tasks(spark, tmp_path, monkeypatch):
    """No task reads the whole table to make the stream's files, and a document that arrives twice is stored once."""
    from verdigris.plans import run_queries as Ru

    rows = [(k, f"text {k}" * (1 + k % 4)) for k in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(Ru, "scratch", lambda *_: str(tmp_path / "stream"))
    limit = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(limit)
    spark.conf.set(limit, "1000")
    try:
        out = Ru.streamed_outcomes(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(limit, old)
    assert len(list((tmp_path / "stream" / "in").glob("part-*"))) >= 12
    assert sorted(int(r["doc_id"]) for r in out) == list(range(80)) and {r["stored"] for r in out} == {1}
