"""Waits and callbacks: table form against brute force, streams against the table form."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from heddlework import schemas as S
from heddlework.operators.cache import newest_completed
from heddlework.operators.runlog import fold_runs
from heddlework.operators.waits import match_waits, waits_from_steps
from heddlework.sources.callbacks import ingest_callbacks, read_callbacks, stream_callbacks, stream_waits
from heddlework.sources.keyindex import KeyIndex
from heddlework.streaming.cached import CachedBatches
from heddlework.streaming.runstate import live_runs, live_runs_ending
from heddlework.streaming.waits import WaitBatches, match_stream, tagged

T0 = dt.datetime(2024, 5, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def tables(spark, waits, callbacks):
    w = spark.createDataFrame([(i, r, "s", at(t), n) for i, r, t, n in waits], S.WAITS)
    c = spark.createDataFrame([(i, r, "s", at(t), p) for i, r, t, p in callbacks], S.CALLBACKS)
    return w, c


def outcomes(matches):
    waits = {r.wait_id: (r.outcome, r.callback_id, r.outputs) for r in matches.waits.collect()}
    return waits, {r.callback_id for r in matches.rejected.collect()}


HAND = (
    [("w1", "in_time", 0, 5), ("w2", "silent", 0, 5), ("w3", "late", 0, 5), ("w4", "default", 0, None)],
    [("early", "in_time", -1, "e"), ("first", "in_time", 3, '{"status":"ok"}'), ("second", "in_time", 4, "x"), ("late", "late", 6, "x"),
     ("nobody", "unknown", 1, "x"), ("edge", "default", 300, "d")],
)


def test_hand_made_cases(spark):
    waits, rejected = outcomes(match_waits(*tables(spark, *HAND)))
    assert waits == {"w1": ("COMPLETED", "first", '{"status":"ok"}'), "w2": ("FAILED", None, None), "w3": ("FAILED", None, None), "w4": ("COMPLETED", "edge", "d")}
    assert rejected == {"early", "second", "late", "nobody"}


def random_case(seed, n=300):
    rng = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", "c"]
    waits = [(f"w{i:03d}", rng.choice(keys), rng.randrange(2000), rng.choice([1, 20, 100])) for i in range(n // 3)]
    calls = [(f"c{i:03d}", rng.choice(keys), rng.randrange(2100), f"p{i}") for i in range(n)]
    return waits, calls


def brute(waits, calls):
    done, rejected = {}, set()
    for cid, run, t, payload in sorted(calls, key=lambda c: (c[2], c[0])):
        own = [w for w in waits if w[1] == run and w[2] <= t]
        newest = max(own, key=lambda w: (w[2], w[0])) if own else None
        if newest and t <= newest[2] + newest[3] and newest[0] not in done:
            done[newest[0]] = (cid, payload)
        else:
            rejected.add(cid)
    return {w[0]: ("COMPLETED", *done[w[0]]) if w[0] in done else ("FAILED", None, None) for w in waits}, rejected


def test_random_cases(spark):
    waits, calls = random_case(1)
    assert outcomes(match_waits(*tables(spark, waits, calls))) == brute(waits, calls)


def test_open_waits_and_waiting_steps(spark):
    w, c = tables(spark, [("w", "r", 0, 100)], [])
    assert match_waits(w, c, as_of=F.lit(at(50))).waits.first().outcome == "WAITING_WEBHOOK"
    assert match_waits(w, c, as_of=F.lit(at(100))).waits.first().outcome == "FAILED"
    rows = [(str(i), "r", "s", text, at(0), 5) for i, text in enumerate(['{"wait_for_webhook":true}', '{"wait_for_webhook":"true"}', '{"wait_for_webhook":1}', "{}", "bad"])]
    steps = spark.createDataFrame(rows, "id string, run_id string, step_id string, resolved_inputs string, started_at timestamp, timeout_seconds int")
    assert [r.wait_id for r in waits_from_steps(steps).collect()] == ["0"]


# --- streams ----------------------------------------------------------------------------


def write_files(folder, rows, n, key):
    """JSON lines in time order over several files, so that state crosses batches."""
    folder.mkdir()
    rows = sorted(rows, key=lambda r: r[key])
    size = -(-len(rows) // n)
    for i in range(n):
        lines = [json.dumps(r, default=str) for r in rows[i * size : (i + 1) * size]]
        path = folder / f"part-{i}.json"
        path.write_text("\n".join(lines))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))  # read in this order


@pytest.fixture()
def files(spark, tmp_path):
    waits, calls = random_case(4, 240)
    calls.append(("tick", "clock", 10_000, ""))
    write_files(tmp_path / "waits", [dict(wait_id=i, run_id=r, step_id="s", started_at=at(t), timeout_seconds=n) for i, r, t, n in waits], 4, "started_at")
    write_files(tmp_path / "calls", [dict(callback_id=i, run_id=r, step_id="s", ts=at(t), payload=p) for i, r, t, p in calls], 5, "ts")
    done, rejected = brute(waits, calls[:-1])
    want = {("FAILED", w) for w, (o, _, _) in done.items() if o == "FAILED"}
    want |= {("COMPLETED", c) for o, c, _ in done.values() if o == "COMPLETED"} | {("REJECTED", c) for c in rejected}
    assert read_callbacks(spark, str(tmp_path / "calls")).count() == len(calls)
    streams = (stream_waits(spark, str(tmp_path / "waits"), 1), stream_callbacks(spark, str(tmp_path / "calls"), 1))
    return streams, want


def shown(rows):
    return sorted((r.outcome, r.callback_id or r.wait_id) for r in rows)


def finish(writer, path):
    writer.option("checkpointLocation", str(path)).trigger(availableNow=True).start().awaitTermination()


@pytest.mark.parametrize("parts", [1, 3])
def test_stateful_stream(spark, files, tmp_path, parts):
    # A wide delay: the two sources are read file by file, not in step with each other.
    streams, want = files
    matched = match_stream(*streams, delay="30 minutes", parts=parts)
    finish(matched.writeStream.format("parquet").option("path", str(tmp_path / "out")), tmp_path / "ck")
    assert shown(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(want)


def late_case(spark, folder, parts):
    """Rows of a first delivery move the watermark to 3,000 s; the second comes behind it."""
    first = [("w_open", "a", 0, 9_000), ("w_over", "b", 0, 10), ("w_done", "c", 0, 9_000)]
    calls = [("on_time", "c", 5, "p"), ("tick", "clock", 3_600, "")]
    late = [("late_wins", "a", 50, "p"), ("late_loses", "a", 60, "p"), ("late_over", "b", 5, "p"), ("late_done", "c", 2, "p"),
            ("late_nobody", "d", 1, "p"), ("tock", "clock", 12_000, "")]
    waits, calls_in = folder / "waits", folder / "calls"
    write_files(waits, [dict(wait_id=i, run_id=r, step_id="s", started_at=at(t), timeout_seconds=n) for i, r, t, n in first], 1, "started_at")
    out = []
    calls_in.mkdir()
    for k, rows in enumerate((calls, late)):
        lines = [json.dumps(dict(callback_id=i, run_id=r, step_id="s", ts=at(t), payload=p), default=str) for i, r, t, p in rows]
        (calls_in / f"{k}.json").write_text("\n".join(lines))
        matched = match_stream(stream_waits(spark, str(waits)), stream_callbacks(spark, str(calls_in)), "10 minutes", parts)
        finish(matched.writeStream.format("parquet").option("path", str(folder / "out")), folder / "ck")
        out.append(shown(spark.read.schema(matched.schema).parquet(str(folder / "out")).collect()))
    return out


@pytest.mark.parametrize("parts", [1, 3])
def test_late_callbacks_are_answered(spark, tmp_path, parts):
    before, after = late_case(spark, tmp_path, parts)
    assert before == [("COMPLETED", "on_time"), ("FAILED", "w_over")]
    assert after == sorted(before + [("COMPLETED", "late_wins"), ("REJECTED", "late_loses"), ("REJECTED", "late_over"),
                                     ("REJECTED", "late_done"), ("REJECTED", "late_nobody"), ("REJECTED", "tick")])


def test_many_callbacks_of_one_key(spark, tmp_path):
    """More than the state store hands out at a time: each is answered once."""
    n = 25_000
    waits, calls = tables(spark, [("w", "hot", 0, 9_000)], [("tick", "clock", 20_000, "")])
    hot = spark.range(n).select(
        F.format_string("c%05d", "id").alias("callback_id"), F.lit("hot").alias("run_id"), F.lit("s").alias("step_id"),
        F.timestamp_seconds(F.lit(T0.timestamp()) + 5 + F.col("id") % 100).alias("ts"), F.lit("p").alias("payload"),
    )
    waits.write.parquet(str(tmp_path / "w"))
    hot.unionByName(calls).coalesce(2).write.parquet(str(tmp_path / "c"))
    streams = [spark.readStream.schema(s).parquet(str(tmp_path / f)) for f, s in (("w", S.WAITS), ("c", S.CALLBACKS))]
    matched = match_stream(*streams)
    finish(matched.writeStream.format("parquet").option("path", str(tmp_path / "out")), tmp_path / "ck")
    got = spark.read.schema(matched.schema).parquet(str(tmp_path / "out"))
    assert got.filter("outcome = 'COMPLETED'").collect()[0].callback_id == "c00000"
    assert (got.count(), got.select("callback_id").distinct().count()) == (n, n)


def test_keys_share_state_and_repeats_are_answered(spark, tmp_path):
    """Many keys lie in few state rows; a callback delivered twice completes once and is rejected once."""
    n = 3_000
    waits, calls = tables(spark, [("w", "k", 0, 9_000)], [("twice", "k", 5, "p"), ("twice", "k", 5, "p"), ("tick", "clock", 20_000, "")])
    more = spark.range(n).select(
        F.format_string("w%05d", "id").alias("wait_id"), F.format_string("r%05d", "id").alias("run_id"), F.lit("s").alias("step_id"),
        F.lit(at(0)).alias("started_at"), F.lit(90_000).alias("timeout_seconds"),
    )
    waits.unionByName(more).write.parquet(str(tmp_path / "w"))
    calls.write.parquet(str(tmp_path / "c"))
    streams = [spark.readStream.schema(s).parquet(str(tmp_path / f)) for f, s in (("w", S.WAITS), ("c", S.CALLBACKS))]
    matched = match_stream(*streams)
    writer = matched.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
    ran = writer.trigger(availableNow=True).start()
    ran.awaitTermination()
    assert shown(spark.read.parquet(str(tmp_path / "out")).collect()) == [("COMPLETED", "twice"), ("REJECTED", "twice")]
    assert 0 < max(p.stateOperators[0].numRowsTotal for p in ran.recentProgress if p.stateOperators) < n


def test_ingest_sets_lines_aside(spark, tmp_path):
    good = '{"callback_id":"c","run_id":"r","step_id":"s","ts":"2024-05-01T00:00:00.000001Z","payload":'
    lines = [good + '{"a":1}}', good + '"text"}', good + "null}", good.replace("2024-", "never-") + "1}", good, "[1]",
             '{"callback_id":"c","run_id":"r","ts":"2024-05-01T00:00:00Z"}', "{}"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    found = ingest_callbacks(spark, str(tmp_path / "in"))
    assert sorted((r.payload or "") for r in found.accepted.collect()) == ["", "text", '{"a":1}']
    want = ["missing_callback_id", "missing_step_id", "unreadable", "unreadable", "unreadable"]
    assert sorted(r.reason for r in found.rejects.collect()) == want
    stream = ingest_callbacks(spark, str(tmp_path / "in"), stream=True).rejects
    finish(stream.writeStream.format("parquet").option("path", str(tmp_path / "out")), tmp_path / "ck")
    assert sorted(r.reason for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_batch_sink_stream(spark, files, tmp_path):
    streams, want = files
    sink = WaitBatches(str(tmp_path / "state"), delay_seconds=1800)
    finish(tagged(*streams).writeStream.foreachBatch(sink), tmp_path / "ck")
    assert shown(sink.outcomes(spark).collect()) == sorted(want)


def test_live_runs_equal_the_batch_fold(spark, tmp_path):
    rng = random.Random(3)
    events = [dict(event_id=f"{i:04d}", run_id=f"r{rng.randrange(9)}", ts=at(i), status=rng.choice(S.STATUSES), outputs=rng.choice([None, f"o{i}"]), error_message=None) for i in range(200)]
    write_files(tmp_path / "events", events, 4, "ts")
    schema = "event_id string, run_id string, ts timestamp, status string, outputs string, error_message string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "events"))
    state = {}
    writer = live_runs(stream).writeStream.outputMode("update").foreachBatch(lambda df, _: state.update({r.run_id: r for r in df.collect()}))
    finish(writer, tmp_path / "ck")
    batch = {r.run_id: r for r in fold_runs(spark.read.schema(schema).json(str(tmp_path / "events"))).collect()}
    assert state == batch


def test_ended_runs_leave_the_state(spark, tmp_path):
    """Runs end one after the other; the state holds open and lately ended ones only."""
    schema = "event_id string, run_id string, ts timestamp, status string, outputs string, error_message string"
    rows = [(f"{i:03d}{s}", f"r{i:03d}", at(100 * i + k), s, None, None) for i in range(60) for k, s in enumerate(("RUNNING", "COMPLETED"))]
    rows += [("open", "never", at(0), "RUNNING", "o", None), ("again", "r000", at(5_990), "RUNNING", None, None)]
    fields = schema.replace(" string", "").replace(" timestamp", "").split(", ")
    write_files(tmp_path / "in", [dict(zip(fields, r, strict=True)) for r in rows], 12, "ts")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))

    def run(keep_seconds):
        state = {}
        writer = live_runs_ending(stream, "1 second", keep_seconds).writeStream.outputMode("update")
        writer = writer.foreachBatch(lambda df, _: state.update({r.run_id: r for r in df.collect()}))
        ran = writer.option("checkpointLocation", str(tmp_path / f"ck-{keep_seconds}")).trigger(availableNow=True).start()
        ran.awaitTermination()
        return state, max(p.stateOperators[0].numRowsTotal for p in ran.recentProgress if p.stateOperators)

    folded, held = run(600)
    want = {r.run_id: r for r in fold_runs(spark.createDataFrame(rows[:-1], schema)).collect()}
    # Taken up again after its state has ended: folded from the events since.
    want["r000"] = fold_runs(spark.createDataFrame(rows[-1:], schema)).first()
    assert folded == want
    folded, all_held = run(10_000_000)
    assert folded == {r.run_id: r for r in fold_runs(spark.createDataFrame(rows, schema)).collect()}
    print("state rows", held, all_held)
    assert held * 2 < all_held


def test_cached_batches_read_earlier_ones(spark, tmp_path):
    rows = [dict(id=str(i), run_id="r", step_id="s", action="sq", resolved_inputs=f'{{"n":{n}}}', use=True, created_at=at(i)) for i, n in enumerate([5, 5, 6, 6, 7, 5])]
    write_files(tmp_path / "in", rows, 3, "created_at")
    schema = "id string, run_id string, step_id string, action string, resolved_inputs string, use boolean, created_at timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    sink = CachedBatches(
        str(tmp_path / "log"), lambda m: m.select("input_hash", F.sha2("input_hash", 256).alias("outputs")), "use", compact_every=2
    )
    finish(stream.writeStream.foreachBatch(sink), tmp_path / "ck")
    got = {r.id: r for r in sink.log(spark).collect()}
    # The two equal requests of a batch are both misses, worked out once.
    assert {i: r.cached for i, r in got.items()} == {"0": False, "1": False, "2": False, "3": False, "4": False, "5": True}
    assert got["5"].outputs == got["0"].outputs and all(r.status == "COMPLETED" for r in got.values())


def test_key_index_equals_the_whole_log(spark, tmp_path):
    """Versions with repeated keys, ties and a version written twice, over two compactions."""
    rng = random.Random(5)
    index = KeyIndex(str(tmp_path / "index"), digits=1, compact_every=3)
    fields = "id string, input_hash string, status string, outputs string, completed_at timestamp"
    log = []
    for version in range(8):
        rows = [(f"{version}-{i}", f"{rng.randrange(40) * 7919 % 256:02x}", rng.choice(["COMPLETED", "FAILED"]), rng.choice([None, f"o{i}"]), at(rng.randrange(30)))
                for i in range(rng.choice([0, 30]))]
        frame = spark.createDataFrame(rows, fields)
        for _ in range(1 + version % 2):
            index.add(frame, version)
        log += rows
        every = newest_completed(spark.createDataFrame(log, fields), columns=["outputs", "id"])
        asked = spark.createDataFrame([(f"{d:x}0",) for d in range(0, 16, 3)] + [(None,)], "input_hash string")
        found = index.lookup(asked, version + 1)
        want = {tuple(r) for r in every.collect() if int(r.input_hash[0], 16) % 3 == 0}
        assert {tuple(r) for r in found.select("input_hash", "outputs", "id").collect()} == want
    plan = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [bucket" in plan
