"""The lifecycle of one cue, step by step, and rules of the log."""

import pytest
from pyspark.sql import functions as F

from cuelake.operators import evidence, jobs

LOG = "cue_id long, append_seq long, kind string, status string, author string, document string"
STEPS = [
    (1, 1, "attempt", "succeeded", None, None), (1, 2, "revision", None, "ocr", "字幕"), (1, 3, "revision", None, "human", "字幕です"),
    (1, 4, "decision", "approved", None, None), (1, 5, "decision", "unreviewed", None, None), (1, 6, "revision", None, "translation", "subtitle"),
]


def at(spark, n):
    log = spark.createDataFrame(STEPS[:n], LOG)
    return log, log.where("kind = 'revision'")


@pytest.mark.parametrize(("steps", "author", "review"), [(2, "ocr", "unreviewed"), (3, "human", "unreviewed"), (4, "human", "approved"), (5, "human", "unreviewed"), (6, "translation", "unreviewed")])
def test_lifecycle(spark, steps, author, review):
    log, revisions = at(spark, steps)
    assert evidence.effective_revision(revisions).first().author == author
    state = evidence.cue_state(log).first()
    assert (state.ocr_status, state.review_status) == ("succeeded", review)


def test_translation_is_not_its_own_source(spark):
    _, revisions = at(spark, 6)
    assert evidence.translation_source(revisions).first().document == "字幕です"
    assert [r.author for r in evidence.revision_history(revisions, revisions, revisions)[0].collect()] == ["translation", "human", "ocr"]
    assert evidence.revision_counts(revisions).first().revisions == 3


def test_deletion_leaves_one_revision(spark):
    _, revisions = at(spark, 6)
    two = evidence.delete_revisions(revisions, F.col("author") != "ocr").groupBy("outcome").count().collect()
    assert {r.outcome: r["count"] for r in two} == {"deleted": 2, "kept": 1}
    assert {r.outcome for r in evidence.delete_revisions(revisions, F.lit(True)).collect()} == {"refused"}


def test_failed_attempt_leaves_review_alone(spark):
    log = spark.createDataFrame([*STEPS[:4], (1, 9, "attempt", "failed", None, None)], LOG)
    state = evidence.cue_state(log).first()
    assert (state.ocr_status, state.review_status) == ("failed", "approved")


def test_approval_lapses_with_a_later_revision(spark):
    for n, valid in ((4, 1), (6, 0)):
        log, revisions = at(spark, n)
        assert evidence.valid_approvals(evidence.bind_decisions(log), revisions).count() == valid


def test_undo_twice_returns(spark):
    _, revisions = at(spark, 6)
    r = evidence.undo_target(revisions).first()
    assert (r.replaces, r.restores) == (6, 3)
    copy = revisions.where("append_seq = 3").withColumn("append_seq", F.lit(7).cast("long"))
    r = evidence.undo_target(revisions.unionByName(copy)).first()
    assert (r.replaces, r.restores) == (7, 6)


def test_order_is_not_time(spark):
    rows = spark.createDataFrame([(1, 1, "b"), (1, 2, "a")], "cue_id long, append_seq long, author string").withColumn("created_at", F.lit("2024-01-01"))
    assert evidence.effective_revision(rows).first().author == "a"


def test_restart_interrupts(spark):
    j = spark.createDataFrame([(1, "running"), (2, "paused"), (3, "completed")], "job_id long, status string")
    out = jobs.recover_interrupted(j).collect()
    assert [r.status for r in out] == ["interrupted", "interrupted", "completed"] and sum(r.changed for r in out) == 2


def test_odd_status_is_quarantined(spark):
    e = spark.createDataFrame([(1, 1, "running"), (1, 2, "lost")], "job_id long, append_seq long, status string")
    state, odd = jobs.job_state(e)
    assert state.first().status == "running" and odd.count() == 1


def test_schema_gate_and_settings(spark):
    rows = spark.createDataFrame([(1, 2), (2, 1), (3, None)], "project_id long, schema_version int")
    assert [r.error for r in evidence.gate_schema_version(rows).orderBy("project_id").collect()] == [None, "schema version 1, expected 2", "schema version none, expected 2"]
    m = spark.createDataFrame([(1, 1, " a ", "b"), (1, 2, "a", "c"), (1, 3, "x\n", "d"), (1, 4, "", "e"), (1, 5, "y\u0007z", "e")], "project_id long, position long, source string, translation string")
    assert [r.error for r in evidence.normalize_settings(m).orderBy("position").collect()] == [None, "mapped more than once", None, "not 1 to 200 visible characters", "not 1 to 200 visible characters"]
    assert [r[0] for r in spark.createDataFrame([(" jpn ",), ("",), ("x" * 33,)], "l string").select(evidence.language_setting(F.col("l"))).collect()] == ["jpn", None, None]


def test_empty_log(spark):
    empty = spark.createDataFrame([], LOG)
    assert evidence.cue_state(empty).count() == 0 and evidence.undo_target(empty).count() == 0


def test_lists_of_numbers_are_not_walked(spark, monkeypatch):
    import json

    from cuelake.operators import diagnostics

    calls, walk = [], diagnostics._walk
    monkeypatch.setattr(diagnostics, "_walk", lambda *a: calls.append(1) or walk(*a))
    value = {"list": list(range(256)), "mixed": [1, None, True, "token"], "api_key": [1, 2], "long": [0.5] * 257, "flags": [True] * 257}
    out = diagnostics._walk(value, None, (), 0)
    assert out == {"list": list(range(256)), "mixed": [1, None, True, "token"], "api_key": "[REDACTED]", "long": {"redacted": "binary_data", "byte_length": 257}, "flags": [True] * 257}
    assert len(calls) < 20
    deep = lambda n: json.loads("[" * n + "1" + "]" * n)
    assert walk(deep(12), None, (), 0) == deep(12) and walk(deep(13), None, (), 0) == json.loads("[" * 13 + '"[TOO DEEP]"' + "]" * 13)
