"""State of streams: a keyed table without a state store, and jobs that begin from the batch log."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cuelake.operators import jobs as batch
from cuelake.operators.evidence import effective_revision
from cuelake.streaming import jobs, keyed

REVISION = "cue_id long, append_seq long, author string"


def newest_of(rows):
    out = {}
    for cue, seq, author in rows:
        if cue not in out or seq > out[cue][0]:
            out[cue] = (seq, author)
    return out


def held(table):
    rows = table.read().collect()
    assert len({r.cue_id for r in rows}) == len(rows)
    return {r.cue_id: (r.append_seq, r.author) for r in rows}


def test_batches_in_any_order_and_again(spark, tmp_path):
    rng = random.Random(3)
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), REVISION, buckets=8)
    assert held(table) == {}
    rows, seqs = [], list(range(120))
    rng.shuffle(seqs)
    for n in range(5):
        part = [(rng.choice([None, *range(20)]) if n < 4 else 3, seqs.pop(), f"a{n}") for _ in range(20)]
        rows += part
        df = spark.createDataFrame([(*p, "x") for p in part], REVISION + ", more string")
        before = table.versions()
        table.upsert(df, n)
        assert held(table) == newest_of(rows)
        table.upsert(df.withColumn("author", F.lit("again")).withColumn("append_seq", F.lit(999).cast("long")), n)  # a replay changes nothing
        assert held(table) == newest_of(rows)
        if n == 4:  # one key: one bucket is written anew
            assert [b for b, v in table.versions().items() if before.get(b) != v] and sum(before.get(b) != v for b, v in table.versions().items()) == 1
    table.upsert(spark.createDataFrame([], REVISION), 9)
    assert held(table) == newest_of(rows) and table.batches()[-1] == 9
    with pytest.raises(ValueError):
        keyed.KeyedTable(spark, str(tmp_path / "t"), REVISION, buckets=4).read()


def test_a_batch_that_broke_off(spark, tmp_path, monkeypatch):
    """Files without a manifest don't count and are written anew; old versions go, what is read stays."""
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), REVISION, buckets=4)
    table.upsert(spark.createDataFrame([(i, i, "a") for i in range(30)], REVISION), 0)
    monkeypatch.setattr(keyed.KeyedTable, "_put", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.upsert(spark.createDataFrame([(i, 100, "broken") for i in range(30)], REVISION), 1)
    monkeypatch.undo()
    assert {a for _, a in held(table).values()} == {"a"}
    table.upsert(spark.createDataFrame([(1, 100, "b")], REVISION), 1)
    assert held(table) == {i: (100, "b") if i == 1 else (i, "a") for i in range(30)}
    for n in range(2, 6):
        table.upsert(spark.createDataFrame([(i, 100 + n, "c") for i in range(30)], REVISION), n)
    assert sorted(p.name for p in (tmp_path / "t/data").iterdir()) == ["v=4", "v=5"] and table.batches() == [4, 5]
    assert set(held(table).values()) == {(105, "c")}


def test_stream_into_the_table(spark, tmp_path):
    """What the stream leaves is what the batch gives; the query keeps no state, and goes on after a restart."""
    (tmp_path / "in").mkdir()
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), REVISION, buckets=4)
    for n in range(2):
        for part in range(2):
            rows = [{"cue_id": i % 7, "append_seq": (3 - 2 * n - part) * 100 + i, "author": f"a{n}{part}"} for i in range(20)]
            (tmp_path / f"in/{n}{part}.json").write_text("\n".join(map(json.dumps, rows)))
        stream = spark.readStream.schema(REVISION).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        keyed.follow(stream, table, str(tmp_path / "c")).awaitTermination(120)
        want = effective_revision(spark.read.schema(REVISION).json(str(tmp_path / "in"))).collect()
        assert held(table) == {r.cue_id: (r.append_seq, r.author) for r in want}
    assert not (tmp_path / "c/state").exists()


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    jobs.use_rocksdb(spark)
    yield
    spark.conf.set(key, before)


def run(spark, build, rows, schema, folder, mode):
    """The rows of ``build`` over a stream of ``rows``, one file a batch."""
    folder.mkdir()
    for n, part in enumerate(rows):
        (folder / f"{n}.json").write_text("\n".join(map(json.dumps, part)))
    name = f"q{random.randrange(10**9)}"
    q = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name).collect()


PROGRESS = "job_id string, append_seq long, phase string, current int, cue_id string"


def test_progress_from_a_snapshot(spark, tmp_path, rocks):
    """The batch log and then the stream give what one long stream gives, and what the batch fold gives."""
    rng = random.Random(5)
    rows = [{"job_id": rng.choice("abc"), "append_seq": n, "phase": rng.choice(["running", "completed", "completed"]), "current": n, "cue_id": rng.choice([None, *"uvwxyz"])} for n in range(60)]
    last = lambda out: {r.job_id: (r.phase, r.current, r.completed) for r in sorted(out, key=lambda r: (r.current, r.completed))}
    long = last(run(spark, jobs.stream_job_progress, [rows[:30], rows[30:]], PROGRESS, tmp_path / "long", "update"))
    log = spark.createDataFrame([tuple(r.values()) for r in rows[:30]], PROGRESS)
    short = last(run(spark, lambda s: jobs.stream_job_progress(s, log=log), [rows[30:]], PROGRESS, tmp_path / "short", "update"))
    want = {r.job_id: (r.phase, r.current, r.completed) for r in batch.job_progress(spark.createDataFrame([tuple(r.values()) for r in rows], PROGRESS)).collect()}
    assert long == short == want


def test_stale_jobs_from_a_snapshot(spark, tmp_path, rocks):
    schema = "job_id string, status string, at timestamp"
    event = lambda j, s, t: {"job_id": j, "status": s, "at": f"2024-01-01T00:{t // 60:02d}:{t % 60:02d}Z"}
    first = [event("a", "running", 0), event("b", "running", 0), event("d", "running", 5), event("e", "completed", 9)]
    then = [[event("b", "completed", 20), event("d", "running", 90)], [event("c", "running", 900)]]
    build = lambda log: lambda s: jobs.stream_stale_jobs(s, 100, log=log)
    long = run(spark, build(None), [first, *then], schema, tmp_path / "long", "append")
    log = spark.createDataFrame([(e["job_id"], e["status"], e["at"]) for e in first], "job_id string, status string, at string").withColumn("at", F.to_timestamp("at"))
    short = run(spark, build(log), then, schema, tmp_path / "short", "append")
    told = lambda out: sorted((r.job_id, r.status, r.last_at.minute * 60 + r.last_at.second) for r in out)
    assert told(long) == told(short) == [("a", "interrupted", 0), ("d", "interrupted", 90)]


def test_progress_asks_its_state_once_a_frame():
    import pandas as pd

    class Last:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

    class Done(dict):
        calls = 0

        def containsKey(self, key):
            self.calls += 1
            return key in self

        def keys(self):
            self.calls += 1
            return list(super().keys())

        updateValue = dict.__setitem__

    p = jobs._Progress("completed", None)
    p.last, p.done = Last(), Done()
    frame = lambda rows: pd.DataFrame(rows, columns=["append_seq", "phase", "current", "cue_id"])
    assert p.fold(iter([frame([(n, "completed", n, f"c{n % 10}") for n in range(40)] + [(40, "completed", None, None)])])) == ("completed", None, 10) and p.done.calls == 0
    assert p.fold(iter([frame([(n, "completed", 1, f"c{n % 20}") for n in range(41, 81)])])) == ("completed", 1, 20) and p.done.calls == 1
    assert p.fold(iter([frame([(81, "completed", 2, "c3"), (82, "view", 3, "c99"), (5, "failed", 4, "d")])])) == ("view", 3, 20) and p.done.calls == 2
