"""The bucketed store, deletions in an append-only log, and numbers within groups of any size."""

import random

import pytest
from pyspark.sql import functions as F

from cuelake.operators import evidence
from cuelake.operators.numbering import numbered
from cuelake.plans import queries as plans
from cuelake.plans.adapters import Tables
from cuelake.sources import store

LOG = "project_id long, cue_id long, append_seq long, kind string, status string, author string, document string, revision_seq long"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cue_keyed_questions_exchange_nothing(spark, small):
    """In a bucketed store approvals, states, newest rows and deletions are read bucket by bucket, one project's folder only."""
    t = Tables(spark, small)
    log = store.read_bucketed(spark, plans.stored_log(t))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # no side is so small in a large store
    try:
        asked = [plans.store_approvals(log), evidence.cue_state(log), evidence.effective_revision(log.where("kind = 'revision'"))]
        rows = log.withColumn("revision_seq", F.lit(None).cast("long"))
        asked.append(evidence.effective_revision(evidence.live_revisions(rows, arranged=True)))
        for df in asked:
            assert "Exchange" not in plan_of(df) and "Bucketed: true" in plan_of(df)
        assert "Exchange" in plan_of(evidence.cue_state(t.log()))
        one = plan_of(plans.store_approvals(log.where("project_id = 1")))
        assert one.count("PartitionFilters: [isnotnull(project_id") == one.count("FileScan") > 0 and "Exchange" not in one
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_appends_add_a_file_a_bucket(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 3).alias("project_id"), (F.col("id") % 100).alias("cue_id"), F.col("id").alias("append_seq"))
    for part in range(2):
        store.append_bucketed(rows.where(f"append_seq % 2 = {part}"), "appended", buckets=4, path=str(tmp_path / "t"))
    assert len(list((tmp_path / "t").rglob("*.parquet"))) == 2 * 3 * 4
    store.compact(spark, "appended", "compacted", buckets=4, path=str(tmp_path / "c"))
    assert len(list((tmp_path / "c").rglob("*.parquet"))) == 3 * 4 and spark.table("compacted").exceptAll(spark.table("appended")).isEmpty()
    spark.sql("drop table appended")
    spark.sql("drop table compacted")


def test_newest_live_revision_is_one_exchange(spark):
    log = spark.createDataFrame([(1, 1, 1, "revision", None, "ocr", "d", None)], LOG)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    assert plan_of(evidence.effective_revision(evidence.live_revisions(log))).count("Exchange hashpartitioning") == 1
    assert before == "true"


def fold(rows):
    """The log of each cue, row by row."""
    live, review = {}, {}
    for r in sorted(rows, key=lambda r: r["append_seq"]):
        cue = r["cue_id"]
        mine = live.setdefault(cue, {})
        if r["kind"] == "revision":
            mine[r["append_seq"]] = r["author"]
            review[cue] = "unreviewed"
        elif r["kind"] == "deletion":
            mine.pop(r["revision_seq"], None)
            review[cue] = "unreviewed"
        elif r["kind"] == "decision":
            review[cue] = r["status"]
    return live, review


def test_random_logs_with_deletions(spark):
    """Append, delete, append, delete again: every operator on current state agrees with a fold row by row."""
    rng = random.Random(8)
    log = spark.createDataFrame([], LOG)
    rows, seq = [], 0
    for _ in range(4):
        fresh = []
        for _ in range(60):
            seq += 1
            kind = rng.choice(["revision", "revision", "decision"])
            fresh.append({"project_id": 1, "cue_id": rng.randrange(6), "append_seq": seq, "kind": kind, "status": "approved" if kind == "decision" else None, "author": rng.choice(evidence.AUTHORS) if kind == "revision" else None, "document": None, "revision_seq": None})
        log = spark.createDataFrame([*rows, *fresh], LOG)
        rows = [r.asDict() for r in log.collect()]
        by = rng.choice([2, 3])
        gone = evidence.delete_from_log(log, F.col("append_seq") % by == 0).collect()
        live, _ = fold(rows)
        want = {(c, s) for c, own in live.items() if any(s % by for s in own) for s in own if s % by == 0}
        assert {(r.cue_id, r.revision_seq) for r in gone} == want
        assert sorted(r.append_seq for r in gone) == list(range(seq + 1, seq + len(gone) + 1))
        seq += len(gone)
        rows += [{"status": None, "author": None, "document": None, **r.asDict()} for r in gone]
    rows.append({"project_id": 1, "cue_id": 0, "append_seq": seq + 1, "kind": "deletion", "status": None, "author": None, "document": None, "revision_seq": 99999})  # names nothing
    log = spark.createDataFrame(rows, LOG)
    live, review = fold(rows)
    left = evidence.live_revisions(log)
    newest = lambda own, ok=lambda a: True: max((s for s, a in own.items() if ok(a)), default=None)
    pairs = lambda df: {r.cue_id: r.append_seq for r in df.collect()}
    drop = lambda d: {c: s for c, s in d.items() if s is not None}
    assert pairs(evidence.effective_revision(left)) == drop({c: newest(own) for c, own in live.items()})
    assert pairs(evidence.latest_recognition(left)) == drop({c: newest(own, lambda a: a == "ocr") for c, own in live.items()})
    assert pairs(evidence.translation_source(left)) == drop({c: newest(own, lambda a: a != "translation") for c, own in live.items()})
    assert {r.cue_id: r.revisions for r in evidence.revision_counts(left).collect()} == {c: len(own) for c, own in live.items() if own}
    assert {r.cue_id: r.review_status for r in evidence.cue_state(log).collect()} == review
    assert {r.cue_id: (r.replaces, r.restores) for r in evidence.undo_target(left).collect()} == {c: tuple(sorted(own)[::-1][:2]) for c, own in live.items() if len(own) > 1}


def test_a_cue_keeps_one_live_revision(spark):
    log = spark.createDataFrame([(1, 1, n, "revision", None, "ocr", None, None) for n in (1, 2)] + [(1, 1, 3, "deletion", None, None, None, 2)], LOG)
    assert evidence.delete_from_log(log, F.lit(True)).count() == 0  # one is left, the other gone already
    assert evidence.delete_from_log(log.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("tasks", [1, 3, 8])
def test_numbers_are_those_of_a_window(spark, tasks):
    rng = random.Random(tasks)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(900)]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, o int, at int")
    got = numbered(df, ["g"], ["o", "at"], "n", tasks=tasks).collect()
    want, count = {}, {}
    for g, o, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        count[g] = count.get(g, 0) + 1
        want[i] = count[g]
    assert {r["at"]: r.n for r in got} == want and got[0].__fields__ == ["g", "o", "at", "n"]
    assert numbered(df.limit(0), ["g"], ["o"], "n").count() == 0
    again = numbered(df.withColumn("n", F.lit("old")), ["g"], ["o", "at"], "n", tasks=tasks)
    assert {r["at"]: r.n for r in again.collect()} == want


def test_many_groups_are_joined_by_shuffle(spark, monkeypatch):
    from cuelake.operators import numbering

    df = spark.range(5000).select((F.col("id") % 900).alias("g"), F.col("id").alias("o"))
    want = sorted(map(tuple, numbered(df, ["g"], ["o"], "n", tasks=4).collect()))
    monkeypatch.setattr(numbering, "MOST_RUNS", 10)
    assert sorted(map(tuple, numbered(df, ["g"], ["o"], "n", tasks=4).collect())) == want


def test_one_large_project_on_many_tasks(spark):
    """A million rows of one project and few others: no task has twice the mean, also where most rows are equal in order."""
    for order in ("id", "same"):
        df = spark.range(1_000_000).select(F.when(F.col("id") % 50 == 0, F.col("id") % 7).otherwise(99).alias("project"), F.hash("id").alias("id"), F.lit(1).alias("same"))
        got = numbered(df, ["project"], [order], "n", tasks=32).withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in got.groupBy("task").count().collect()]
        assert len(sizes) >= 30 and max(sizes) < 2 * 1_000_000 / 32
        checks = got.groupBy("project").agg(F.count("*").alias("c"), F.max("n").alias("m"), F.count_distinct("n").alias("d")).collect()
        assert len(checks) == 8 and all(r.c == r.m == r.d for r in checks)


def test_jobs_in_order(spark):
    from cuelake.operators import jobs

    rows = spark.createDataFrame([(i * 7 % 50, f"j{i}") for i in range(50)], "append_seq long, job_id string")
    assert [(r.place, r.append_seq) for r in jobs.list_jobs(rows, tasks=3).collect()] == [(i + 1, 49 - i) for i in range(50)]


def test_no_answer_is_asked_for_twice(spark, tmp_path):
    """Each request reaches the backend once a round, however often the rounds are read."""
    import uuid

    from cuelake.operators import recognition

    calls = str(tmp_path)

    def backend(batch):
        for v in batch["variable"]:
            with open(f"{calls}/{uuid.uuid4().hex}", "w") as f:
                f.write(v)
        return batch["variable"].str.contains("rejected").map({True: "ok", False: "no"})

    requests = spark.createDataFrame([(i, "s", f"v{i}") for i in range(20)], "request_id long, stable string, variable string")
    out = recognition.retry_rounds(requests, backend, lambda df: df.withColumn("error", F.when((F.col("response") == "no") & (F.col("request_id") % 2 == 0), "bad")))
    assert out.count() == 20 and {r.attempt for r in out.collect()} == {1, 2}
    assert len(list(tmp_path.iterdir())) == 30


def test_appended_rows_are_numbered_once(spark, small):
    """The log after deletions is the table and what was appended; nothing of it is numbered again by those who read it."""
    reads = lambda name: plans.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString().count("parquet")
    assert [reads(name) for name in ("live_effective", "live_state", "live_approvals")] == [1, 1, 2]
