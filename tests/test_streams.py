"""Keyed state, timers, tails and cancelling in streams."""

import random
import threading
import time

from pyspark.sql import functions as F

from sheafline.operators import ledger
from sheafline.streaming import stateful, tail


def events(*rows):
    """JOB_EVENT rows from (job, kind, fields)."""
    names = ["stage", "progress", "eta", "grp", "message", "warning", "result"]
    return [(job, i, kind, *[fields.get(n) for n in names]) for i, (job, kind, fields) in enumerate(rows)]


def test_job_states_and_logs_over_restarts(spark, tmp_path):
    rows = events(
        (1, "emit", {"stage": "read", "progress": -5, "message": "a", "eta": -3}), (2, "cancel", {}), (1, "emit", {"progress": 150, "message": "b", "warning": "w"}),
        (1, "complete", {"result": "{}"}), (1, "cancel", {}), (2, "emit", {"message": "c"}), (1, "emit", {"message": "late"}), (2, "fail", {"message": "broken"}),
    )
    df = spark.createDataFrame(rows, stateful.JOB_EVENT)
    want = None
    for steps in (1, 3, 8):
        out = stateful.restarted(spark, df, F.floor(F.col("seq") * steps / 8), steps, stateful.job_states, f"{tmp_path}/{steps}", partitions=2)
        last = {r.job: r for r in out.groupBy("job").agg(F.max_by(F.struct(*[c for c in out.columns if c not in ("batch", "logs")]), "seq").alias("e")).select("e.*").collect()}
        logs = sorted((r.job, tuple(r.logs)) for r in out.where("logs IS NOT NULL").collect())
        assert last[1].status == "completed" and last[1].progress == 100 and last[1].eta == 0 and last[1].n_warnings == 1 and last[1].cancel and last[1].step == "late" and last[1].n_logs == 4
        assert last[2].status == "failed" and last[2].error == "broken" and last[2].cancel and last[2].n_logs == 3
        assert (2, ("cancel requested", "c", "broken")) in logs and any(job == 1 and lines[:3] == ("a", "b", "job completed") for job, lines in logs)
        want = want or last
        assert last == want


def test_timers_fire_once_and_survive_restarts(spark, tmp_path):
    rows = [(1, 0, 0, True, 5), (2, 1, 1000, True, 100), (2, 2, 50_000, False, 0), (3, 3, 60_000, True, 1000), (1, 4, 70_000, False, 0), (3, 5, 80_000, True, 1), (4, 6, 500_000, True, 0), (5, 7, 2_000_000, False, 0)]
    rows = [(run, seq, at + 10**6, needs, delay) for run, seq, at, needs, delay in rows]
    df = spark.createDataFrame(rows, "run long, seq long, at long, needs boolean, delay int")
    for steps in (1, 4, 8):
        out = stateful.restarted(spark, df, F.floor(F.col("seq") * steps / 8), steps, stateful.resume_firings, f"{tmp_path}/{steps}", partitions=2)
        assert sorted((r.run, r.due - 10**6, r.attempt) for r in out.collect()) == [(1, 30_000, 1), (3, 1_060_000, 1), (4, 530_000, 1)]  # the least delay is 30 s; run 2 was called off


def test_net_runs_equal_the_batch_snapshot(spark, tmp_path):
    rows = [(1, i, x % 5, kind) for i, (x, kind) in enumerate([(0, "uploaded"), (1, "uploaded"), (2, "skipped"), (2, "undone"), (1, "undone"), (1, "uploaded"), (4, "uploaded"), (4, "undone"), (0, "undone"), (1, "undone")])]
    df = spark.createDataFrame(rows, "run long, seq long, index_ long, kind string")
    out = stateful.restarted(spark, df, F.col("seq"), 10, stateful.net_runs, str(tmp_path), partitions=1)
    got = {r.batch: (r.uploaded, r.skipped, r.undone, r.next_index, r.last_kind) for r in out.collect()}
    for seq in range(10):
        s = ledger.snapshot(df.where(F.col("seq") <= seq).withColumnRenamed("index_", "index"), "run", "seq").first()
        assert got[seq] == (s.uploaded, s.skipped, s.undone, s.next_index, s.last_kind)


def test_tail_reads_what_comes_after_the_end(spark, tmp_path):
    schema = "job long, seq long, ends boolean"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    write([(1, 0, False), (1, 1, False)])
    late = threading.Thread(target=lambda: (time.sleep(3), write([(1, 2, True), (1, 3, False)])))
    late.start()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert tail.tail(stream, F.col("ends"), 1, stateful.into_folders(f"{tmp_path}/out"), f"{tmp_path}/offsets", max_age=60)
    late.join()
    assert sorted(r.seq for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 1, 2, 3]
    assert not tail.tail(stream, F.col("ends"), 2, stateful.into_folders(f"{tmp_path}/out"), f"{tmp_path}/offsets", max_age=4)  # nothing new, so its time ends it


def test_cancel_by_tag(spark):
    from pyspark import inheritable_thread_target

    seen = []

    def slow():
        try:
            tail.tagged(spark, "slow work", lambda: spark.range(4, numPartitions=4).mapInPandas(_sleeping, "id long").collect())
        except Exception as e:
            seen.append(str(e))

    worker = threading.Thread(target=inheritable_thread_target(spark)(slow))
    began = time.time()
    worker.start()
    while worker.is_alive() and time.time() - began < 18:
        time.sleep(1)
        tail.cancel(spark, "slow work")
    worker.join()
    assert seen and spark.range(3).count() == 3


def _sleeping(batches):
    for b in batches:
        time.sleep(20)
        yield b


def test_uploads_are_kept_once(spark, tmp_path):
    import pytest

    from sheafline.streaming import upload

    rows = spark.createDataFrame([(run, i, f"{run}-{i}") for run in range(5) for i in range(1, 8)], "run long, index long, text string")
    path = f"file://{tmp_path}/up"
    upload.upload(rows.where("run = 0"), path, "run", "index")
    for crash in ("task", "driver"):
        with pytest.raises(Exception, match="was lost"):
            upload.upload(rows, path, "run", "index", crash=crash)
        assert upload.ledger(spark, path, "run", "index").count() == 7  # what was not committed does not count
    upload.upload(rows, path, "run", "index")
    got = {(r["run"], r["index"]): (r["text"], r["times"]) for r in upload.ledger(spark, path, "run", "index").collect()}
    assert got == {(run, i): (f"{run}-{i}", 2 if run == 0 else 1) for run in range(5) for i in range(1, 8)}
    rows.write.parquet(f"{tmp_path}/in")
    for checkpoint in ("a", "a", "b"):  # a stream that goes on, then one that starts anew
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        stream.writeStream.format(upload.NAME).option("path", path).option("query", checkpoint).option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()
    assert {r.times for r in upload.ledger(spark, path, "run", "index").collect()} == {3, 4} and upload.ledger(spark, path, "run", "index").count() == 35
    long = spark.range(1, 200).selectExpr("7 AS run", "id AS index")
    plans = [sorted((r["index"], r["seconds"], r["starts_at"]) for r in upload.planned(long, "run", "index", F.lit("slow"), size=s).collect()) for s in (1, 16, 4096)]
    assert plans[0] == plans[1] == plans[2] and plans[0][8] == (9, 85.0, 8 * 85.0 + 240.0)


def test_steps_are_written_side_by_side(spark, tmp_path):
    """No step goes through one task on its way to the stream."""
    from pyspark.sql import functions as F

    from sheafline.streaming import stateful

    rows = spark.range(0, 100, 1, 4)
    parts = stateful.in_steps(rows, str(tmp_path), F.floor(F.col("id") / 50), 2)
    assert [p.rdd.getNumPartitions() for p in parts] == [4, 4] and [p.count() for p in parts] == [50, 50]


class Kept:
    """State of one key in memory that counts the calls."""

    def __init__(self):
        self.value, self.rows, self.calls = None, {}, 0

    def getValueState(self, name, schema):
        return self

    def getMapState(self, name, key, value):
        return KeptMap(self)

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class KeptMap:
    def __init__(self, kept):
        self.kept = kept

    def called(self, out=None):
        self.kept.calls += 1
        return out

    def containsKey(self, key):
        return self.called(key in self.kept.rows)

    def getValue(self, key):
        return self.called(tuple(list(x) if isinstance(x, list) else x for x in self.kept.rows[key]) if key in self.kept.rows else None)

    def updateValue(self, key, value):
        self.called()
        self.kept.rows[key] = value

    def iterator(self):
        return self.called(iter(list(self.kept.rows.items())))


def folded(batches):
    """What a run gives after each batch of (seq, index, kind), and the calls to its map."""
    import pandas as pd

    kept, run, out = Kept(), stateful.NetRun(), []
    run.init(kept)
    for rows in batches:
        before = kept.calls
        (pdf,) = run.handleInputRows((1,), iter([pd.DataFrame([(1, *r) for r in rows], columns=["run", "seq", "index_", "kind"])]), None)
        row = [None if pd.isna(x) else x for x in pdf.iloc[0]]
        out.append((tuple(row), kept.calls - before))
    return out


def test_a_run_asks_for_its_state_by_blocks():
    """A batch over many indexes of a run costs a call or two to the state for a block of them, not some for each index."""
    first, second = folded([[(i, i, "uploaded") for i in range(200)], [(200 + i, i, "skipped") for i in range(200)]])
    assert first == ((1, 200, 0, 0, 200, "uploaded"), first[1]) and second == ((1, 0, 200, 0, 200, "skipped"), second[1])
    assert first[1] <= 200 // 32 and second[1] <= 2 * (200 // 32)
    far = folded([[(0, 5, "uploaded"), (1, 10**12, "uploaded")], [(2, 10**12, "undone")]])  # few rows on indexes far apart need no more
    assert [row for row, _ in far] == [(1, 2, 0, 0, 10**12 + 1, "uploaded"), (1, 1, 0, 1, 6, "undone")] and all(calls <= 3 for _, calls in far)


def test_net_runs_are_brute_force_on_odd_rows():
    """Repeated numbers, indexes below 0 and far apart, kinds that are null as the first on an index, the last index undone again and again."""
    draw = random.Random(3)
    for _ in range(60):
        near = draw.choice([3, 150])
        rows = [(draw.randint(0, 400), draw.randint(-near // 2, near), draw.choice(["uploaded", "uploaded", "skipped", "undone"])) for _ in range(draw.randint(1, 120))]
        rows += [(500, near + 1000, None), (501, near + 2000, "undone")]
        cuts = sorted(draw.choices(range(401), k=2))
        batches = [b for lo, hi in zip([0, *cuts], [*cuts, 600]) if (b := [r for r in rows if lo <= r[0] < hi])]
        net, top, last = {}, -1, None
        for (got, _), batch in zip(folded(batches), batches, strict=True):
            changed = {}
            for _, index, kind in sorted(batch, key=lambda r: r[0]):
                changed[index], last = kind, kind
            net |= {index: kind for index, kind in changed.items() if kind}
            top = max([top, *(index for index, kind in changed.items() if kind != "undone")])
            if changed.get(top) == "undone":
                top = max((index for index, kind in net.items() if kind != "undone"), default=-1)
            n = [sum(kind == x for kind in net.values()) for x in ("uploaded", "skipped", "undone")]
            assert got == (1, *n, top + 1 if top >= 0 else None, last)


def test_rows_without_a_run_go_through(spark, tmp_path):
    """Each of them gives a row, without a run, and they share their state."""
    rows = [(None, 0, 0, "uploaded"), (None, 1, 1, "uploaded"), (None, 2, 1, "undone")]
    df = spark.createDataFrame(rows, "run long, seq long, index_ long, kind string")
    out = stateful.restarted(spark, df, F.col("seq"), 3, stateful.net_runs, str(tmp_path), partitions=1)
    assert sorted((r.batch, r.run, r.uploaded, r.skipped, r.undone, r.next_index, r.last_kind) for r in out.collect()) == [(0, None, 1, 0, 0, 1, "uploaded"), (1, None, 2, 0, 0, 2, "uploaded"), (2, None, 1, 0, 1, 1, "undone")]
