"""Runs that die and go on: streamed outcomes, batched requests."""

import pytest
from pyspark.sql import functions as F

from verdigris import project
from verdigris.operators import batching
from verdigris.sources import commits
from verdigris.streaming import resume


def by_rule():
    def predictor(rows, attempt):
        out = []
        for doc, text in rows:
            k = int(doc) % 10
            out.append(ValueError("unreadable") if k == 7 or (k == 3 and attempt == 1) else {"n": len(text or "")})
        return out

    predictor.__module__ = "__main__"
    return predictor


@pytest.fixture
def arriving(spark, tmp_path):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text"))
    for at in range(4):
        docs.where(F.col("doc_id") % 4 == at).unionByName(docs.where("doc_id < 5")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return docs, lambda: spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


class Dies(RuntimeError):
    pass


def dies_at(batch):
    def after(number):
        if number == batch:
            raise Dies("power cut")

    return after


def test_a_streamed_run_goes_on(spark, tmp_path, arriving):
    docs, stream = arriving
    root = str(tmp_path / "run")
    # after the commit, before the stream's own checkpoint has the batch
    with pytest.raises(Exception, match="power cut"):
        resume.stream_outcomes(stream(), root, by_rule(), 2, after=dies_at(1)).awaitTermination()
    part = resume.streamed(spark, root).count()
    assert 0 < part < 40
    resume.stream_outcomes(stream(), root, by_rule(), 2).awaitTermination()
    rows = resume.stream_tables(spark, root).read("outcomes")
    assert rows.count() == 40 and rows.select("doc_id").distinct().count() == 40
    got = {r["doc_id"]: r for r in resume.streamed(spark, root).collect()}
    assert all(r["ok"] == (int(d) % 10 != 7) and r["attempts"] == (2 if int(d) % 10 in (3, 7) else 1) for d, r in got.items())
    assert got["13"]["values"] == {"n": "13"} and got["17"]["error"] == "unreadable"
    assert resume.ask_again(docs, root, resume.replay({str(i): {"n": -i} for i in range(40)})) == 4
    assert resume.streamed(spark, root).where("NOT ok").count() == 0 and resume.ask_again(docs, root, by_rule()) == 0
    resume.stream_outcomes(stream(), root, by_rule(), 2).awaitTermination()
    assert resume.streamed(spark, root).where("doc_id = '17'").first()["values"] == {"n": "-17"}


def test_a_batch_that_dies_before_its_commit_leaves_nothing(spark, tmp_path, arriving, monkeypatch):
    _, stream = arriving
    root, real = str(tmp_path / "run"), commits.Staged.commit

    def dies(self, key=""):
        if key == "stream-2":
            raise Dies("power cut")
        return real(self, key)

    monkeypatch.setattr(commits.Staged, "commit", dies)
    with pytest.raises(Exception, match="power cut"):
        resume.stream_outcomes(stream(), root, by_rule(), 2).awaitTermination()
    monkeypatch.setattr(commits.Staged, "commit", real)
    resume.stream_outcomes(stream(), root, by_rule(), 2).awaitTermination()
    assert resume.stream_tables(spark, root).read("outcomes").count() == 40


def test_a_budget_stops_within_a_batch(spark, tmp_path, arriving):
    _, stream = arriving
    root, budget = str(tmp_path / "run"), project.Budget(max_rollouts=12)
    with pytest.raises(Exception, match="12 rollouts are used up"):
        resume.stream_outcomes(stream(), root, by_rule(), 2, budget).awaitTermination()
    paid = resume.stream_tables(spark, root).read("outcomes").agg(F.sum("attempts")).first()[0]
    assert budget.rollouts == paid and 12 <= paid < 12 + 2 * 15
    with pytest.raises(project.BudgetSpent):
        resume.stream_outcomes(stream(), root, by_rule(), 2, budget)
    more = project.Budget()
    resume.stream_outcomes(stream(), root, by_rule(), 2, more).awaitTermination()
    assert resume.streamed(spark, root).count() == 40 and more.rollouts + paid == 40 + 8


def test_waves_stop_within_one_of_the_cap(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    budget = project.Budget(max_rollouts=20)
    with pytest.raises(project.BudgetSpent):
        resume.predict_within(docs, by_rule(), 2, budget, wave=8)
    assert 20 <= budget.rollouts < 20 + 2 * 8
    enough = project.Budget()
    got = resume.predict_within(docs, by_rule(), 2, enough, wave=16)
    assert got.count() == 40 and got.select("doc_id").distinct().count() == 40 and enough.rollouts == 48 == got.agg(F.sum("attempts")).first()[0]


# --- batches


def echo():
    def answer(custom_id, body):
        return None if body == "t3" else f"re: {body}"

    answer.__module__ = "__main__"
    return answer


@pytest.fixture
def asked(spark, tmp_path):
    rows = [(str(i), g, f"t{i}") for i in range(25) for g in ("a", "b")]
    requests = spark.createDataFrame([*rows, rows[0], ("odd id/ä" * 9, None, None)], "doc_id string, group string, body string")
    return requests, batching.FolderService(str(tmp_path / "service"), echo()), str(tmp_path / "run")


def states(run):
    return {r["state"]: r["count"] for r in run.latest().groupBy("state").count().collect()}


def once(spark, service):
    return [r["times"] for r in service.submissions(spark).collect()] == [1] * 51


def test_batches(spark, asked):
    requests, service, root = asked
    run = batching.Batches(spark, root, "f", size=10)
    assert run.plan(requests) == 51 and run.plan(requests) == 0 and states(run) == {"written": 51}
    sizes = run.latest().groupBy("batch").count()
    assert sizes.agg(F.max("count")).first()[0] <= 10 and sizes.count() <= 12
    with pytest.raises(project.Refused):
        batching.Batches(spark, root, "other tasks")
    assert run.send(requests, service) == sizes.count() and run.send(requests, service) == 0 and states(run) == {"sent": 51} and once(spark, service)
    assert run.collect(service, wait=0.01) == 49 and run.collect(service) == 0 and states(run) == {"answered": 49, "missing": 2}
    got = {(r["doc_id"], r["group"]): r["reply"] for r in run.latest().collect()}
    assert got["4", "b"] == "re: t4" and got["3", "a"] is None and got["odd id/ä" * 9, ""] == "re: "
    other = batching.Batches(spark, root, "other tasks")
    assert other.plan(spark.createDataFrame([("99", "a", "t99")], requests.schema)) == 1


def test_ids_as_columns(spark):
    docs = [("a b/ü" * 12, "g|h"), ("x", "y"), ("", ""), ("a|b", "c"), ("a", "b|c")]
    df = spark.createDataFrame(docs, "d string, g string").select("d", "g", batching.custom_ids(F.col("d"), F.col("g")).alias("c"))
    assert all(r["c"] == batching.custom_id(r["d"], r["g"]) and len(r["c"]) <= 64 for r in df.collect()) and df.select("c").distinct().count() == 5


@pytest.mark.parametrize("step", ["plan", "submit", "send", "collect"])
def test_death_at_each_step_sends_nothing_twice(spark, asked, monkeypatch, step):
    requests, service, root = asked
    real = commits.Staged.commit
    deaths = []

    def dies(self, key=""):
        tables = {"plan": "requests", "send": "sent", "collect": "replies"}
        if step in tables and self.tables.files.exists(self.path(tables[step])) and not deaths:
            deaths.append(step)
            raise Dies("power cut")
        return real(self, key)

    class Touchy(batching.FolderService):
        def submit(self, key, batch):
            held = super().submit(key, batch)
            if any(c.startswith("7-") for c, _ in batch):
                raise ValueError("line cut after the service took the batch")
            return held

    def run_all(using):
        run = batching.Batches(spark, root, "f", size=10)
        run.plan(requests)
        run.send(requests, using)
        run.collect(using, wait=0.01)
        return run

    monkeypatch.setattr(commits.Staged, "commit", dies)
    if step == "submit":
        Touchy.__module__ = "__main__"
        with pytest.raises(Exception, match="line cut"):
            run_all(Touchy(service.folder, service.answer))
    else:
        with pytest.raises(Dies):
            run_all(service)
    monkeypatch.setattr(commits.Staged, "commit", real)
    run = run_all(service)
    assert states(run) == {"answered": 49, "missing": 2} and once(spark, service)
    assert run.tables.read("requests").count() == 51 and run.tables.read("replies").count() == 51


def test_what_the_service_has_is_found_by_request_ids(spark, asked):
    requests, service, root = asked
    run = batching.Batches(spark, root, "f", size=10)
    run.plan(requests)
    first = run.latest().first()["batch"]
    ids = [r["custom_id"] for r in run.latest().where(F.col("batch") == first).collect()]
    known = spark.createDataFrame([("svc-1", c) for c in ids] + [("svc-9", "another run's")], "service_id string, custom_id string")
    assert run.reconcile(known) == 1 and run.reconcile(known) == 0
    assert {r["service_id"] for r in run.latest().where("state = 'sent'").collect()} == {"svc-1"} and run.latest().where("state = 'sent'").count() == len(ids)
    run.send(requests, service)
    assert service.submissions(spark).join(spark.createDataFrame([(c,) for c in ids], "custom_id string"), "custom_id").count() == 0


def test_bodies_are_dealt_once(spark, asked, monkeypatch):
    from verdigris.sources import commits

    requests, service, root = asked
    plans, plain = [], commits.Staged.write
    monkeypatch.setattr(commits.Staged, "write", lambda self, t, rows: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), plain(self, t, rows))[1])
    run = batching.Batches(spark, root, "f", size=10)
    run.plan(requests)
    plans.clear()
    run.send(requests, service)
    assert len(plans) == 1 and "hashpartitioning(batch" not in plans[0]
    assert {r["times"] for r in service.submissions(spark).collect()} == {1}


def test_batches_of_an_earlier_version_are_sent_with_their_bodies(spark, asked):
    requests, service, root = asked
    run = batching.Batches(spark, root, "f", size=10)
    run.plan(requests)
    now = run.tables.read("requests").withColumn("batch", F.concat(F.lit("0a-0-"), F.substring_index("batch", "-", -1)))
    old = batching.Batches(spark, f"{root}-old", "f", size=10)
    old.tables.put({"requests": now})
    assert old.send(requests, service) == now.select("batch").distinct().count()
    run.send(requests, service)
    sent = [x for p in (root, f"{root}-old") for b in batching.Batches(spark, p, "f").latest().select("service_id").distinct().collect() for x in service.results(b[0])]
    assert len(sent) == 2 * now.count() and len(set(sent)) == now.count()
