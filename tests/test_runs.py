"""Definitions, caches, logs and audits."""

import datetime as dt
import random

from pyspark.sql import functions as F

from heddlework import schemas as S
from heddlework.operators import cache, runlog, validation
from heddlework.sources import definitions as D
from heddlework.sources import logs

T0 = dt.datetime(2024, 5, 1, 12, 0, 0)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def step_rows(spark, rows):
    """Rows (id, run, step, status, start, end, outputs) as a step-run table."""
    data = [
        dict(id=i, run_id=run, step_id=step, status=status, outputs=out, cached=False, created_at=at(a),
             started_at=at(a), completed_at=at(b) if b is not None else None, error_trace="boom" if status == "FAILED" else None)
        for i, run, step, status, a, b, out in rows
    ]
    return spark.createDataFrame([tuple(d.get(f) for f in S.STEP_RUNS.fieldNames()) for d in data], S.STEP_RUNS)


# --- definitions -------------------------------------------------------------------


def test_read_validate_and_store(spark, tmp_path):
    texts = [
        '{"workflow_id":"w","steps":[{"id":"a","type":"PYTHON_WORKER","action":"f","inputs":{"z":1,"a":{"q":"${workflow.input.x}"}}},'
        '{"id":"b","type":"HTTP_DISPATCH","action":"GET u","depends_on":["a"],"retry_policy":{"max_retries":2}}]}',
        '{"workflow_id":"bad","steps":[{"id":"x y","type":"OTHER","timeout_seconds":0,"retry_policy":{"max_retries":-1,"backoff_factor":-1}},{"id":"tail\\n","type":"LLM_AGENT","action":"m"}]}',
        "not json",
        '{"version":"3"}',
    ]
    path = str(tmp_path / "defs")
    spark.createDataFrame([(t,) for t in texts], "value string").write.text(path)
    read = D.read_definitions(spark, path)
    good, bad = validation.split_valid(read, validation.definition_errors())
    assert {r.workflow_id for r in good.collect()} == {"w", "bad"}
    assert sorted(r.errors for r in bad.collect()) == [["malformed", "workflow_id_missing", "steps_missing"], ["workflow_id_missing", "steps_missing"]]
    filled = {r.workflow_id: r for r in validation.fill_definition_defaults(good).collect()}
    assert filled["w"].version == "1.0.0" and filled["w"].trigger == {"type": "manual"} and filled["w"].input_schema == "{}"
    steps = validation.fill_step_defaults(D.explode_steps(good))
    by_id = {(r.workflow_id, r.id): r for r in steps.collect()}
    a, b = by_id[("w", "a")], by_id[("w", "b")]
    assert a.depends_on == [] and a.inputs == '{"z":1,"a":{"q":"${workflow.input.x}"}}' and a.timeout_seconds == 300
    assert (a.cache_executed_step, a.retry_policy.max_retries, b.retry_policy.max_retries, b.retry_policy.backoff_factor) == (False, 0, 2, 1.0)
    fine, wrong = validation.split_valid(steps, validation.step_errors())
    assert {r.id for r in fine.collect()} == {"a", "b", "tail\n"}
    assert wrong.first().errors == ["id_format", "type_unknown", "action_missing", "retries_negative", "backoff_negative", "timeout_not_positive"]
    assert [r.action for r in D.definition_step(steps, "b").collect()] == ["GET u"]


def test_upsert_keeps_creation_time(spark, tmp_path):
    def rows(*data):
        return spark.createDataFrame(list(data), S.WORKFLOW_DEFINITIONS)

    root = str(tmp_path / "store")
    D.save_definitions(rows(("w", "1", "{}", at(0), at(0)), ("v", "1", "{}", at(1), at(1))), root)
    merged = D.upsert_definitions(D.load_definitions(spark, root), rows(("w", "2", '{"n":2}', at(9), at(9)), ("u", "1", "{}", at(9), at(9))))
    D.save_definitions(merged, root)
    got = {r.workflow_id: r for r in D.load_definitions(spark, root).collect()}
    assert set(got) == {"u", "v", "w"} and got["w"].version == "2" and got["w"].created_at == at(0) and got["w"].updated_at == at(9)
    wanted = spark.createDataFrame([("w",), ("none",)], "workflow_id string")
    assert {(r.workflow_id, r.found) for r in D.find_definitions(wanted, D.load_definitions(spark, root)).collect()} == {("w", True), ("none", False)}


def test_upsert_at_equal_times_and_unfinished_snapshots(spark, tmp_path):
    def rows(*data):
        return spark.createDataFrame(list(data), S.WORKFLOW_DEFINITIONS)

    root = str(tmp_path / "store")
    assert D.load_definitions(spark, root).count() == 0
    merged = D.upsert_definitions(rows(("w", "9", "{}", at(0), at(5))), rows(("w", "1", "[]", at(3), at(5))))
    assert [(r.version, r.created_at) for r in merged.collect()] == [("1", at(0))]
    done = D.save_definitions(merged, root)
    broken = D.save_definitions(rows(("x", "1", "{}", at(0), at(0))), root)
    (tmp_path / "store" / broken.rsplit("/", 1)[1] / "_SUCCESS").unlink()
    read = D.load_definitions(spark, root)
    assert [r.workflow_id for r in read.collect()] == ["w"]
    assert all(done.rsplit("/", 1)[1] in name for name in read.inputFiles())


def test_log_append_and_pruned_read(spark, tmp_path):
    path = str(tmp_path / "log")
    base = spark.createDataFrame([("1", "r", "a", "RUNNING", at(0)), ("2", "r", "b", "COMPLETED", at(86400)), ("3", "r", "c", "PENDING", at(86400))],
                                 "id string, run_id string, step_id string, status string, created_at timestamp")
    logs.append_log(logs.new_step_runs(base), path)
    logs.append_log(logs.new_step_runs(base.withColumn("id", F.concat("id", F.lit("x")))), path)
    rows = {r.id: r for r in logs.read_step_runs(spark, path).collect()}
    assert len(rows) == 6 and rows["1"].started_at == at(0) and rows["1"].completed_at is None
    assert rows["2"].completed_at == at(86400) and rows["3"].started_at is None and rows["1"].cached is False
    recent = logs.read_step_runs(spark, path, since="2024-05-02")
    assert recent.count() == 4 and "PartitionFilters: [isnotnull(log_date" in recent._jdf.queryExecution().executedPlan().toString()


# --- caches ----------------------------------------------------------------------------


def test_cache_across_runs(spark):
    """Inputs 5, 5, 6 in three runs: miss, hit, miss; each result is worked out once."""
    asked = []

    def square(missing):
        asked.extend(r.resolved_inputs for r in missing.collect())
        n = F.try_variant_get(F.try_parse_json("resolved_inputs"), "$.n", "int")
        return missing.select("input_hash", (n * n).cast("string").alias("outputs"))

    log, seen = spark.createDataFrame([], S.STEP_RUNS), []
    for i, n in enumerate([5, 5, 6]):
        request = spark.createDataFrame([(str(i), f"run{i}", "s", "sq", f'{{"n": {n}}}', True, at(i))],
                                        "id string, run_id string, step_id string, action string, resolved_inputs string, use boolean, created_at timestamp")
        step = cache.cached_step(request, log, square, "use")
        rows = spark.createDataFrame(step.log_rows().collect(), S.STEP_RUNS)
        log = log.unionByName(rows)
        seen.append((rows.first().cached, rows.first().outputs))
    assert seen == [(False, "25"), (True, "25"), (False, "36")] and asked == ['{"n": 5}', '{"n": 6}']


def test_equal_requests_are_computed_once_and_flag_rules(spark):
    rows = [(str(i), "r", "s", "a", '{"n": 1}', flag, at(i)) for i, flag in enumerate([True, False, None])]
    request = spark.createDataFrame(rows, "id string, run_id string, step_id string, action string, resolved_inputs string, use boolean, created_at timestamp")
    counts = []

    def compute(missing):
        counts.append(missing.count())
        return missing.select("input_hash", F.lit("new").alias("outputs"))

    key = cache.with_input_key(request).first().input_hash
    old = step_rows(spark, [("o", "r0", "s", "COMPLETED", 0, 1, "old"), ("p", "r0", "s", "COMPLETED", 0, 1, "old")]).withColumn("input_hash", F.lit(key))
    got = {r.id: (r.outputs, r.cached) for r in cache.cached_step(request, old, compute, "use").results.collect()}
    assert got == {"0": ("old", True), "1": ("new", False), "2": ("new", False)} and counts == [1]


def test_requests_without_a_key_are_set_aside(spark):
    texts = ['{"n": 1}', "{oops", '{"n": 1, "n": 2}', None, '{"n": 1}']
    rows = [(str(i), "r", "s", "a", text, at(i)) for i, text in enumerate(texts)]
    request = spark.createDataFrame(rows, "id string, run_id string, step_id string, action string, resolved_inputs string, created_at timestamp")
    step = cache.cached_step(request, spark.createDataFrame([], S.STEP_RUNS), lambda m: m.select("input_hash", F.lit("new").alias("outputs")))
    assert {(r.id, r.outputs) for r in step.results.collect()} == {("0", "new"), ("4", "new")}
    assert step.computed.count() == 1 and {r.id for r in step.log_rows().collect()} == {"0", "4"}
    assert {(r.id, r.reason) for r in step.rejects.collect()} == {
        ("1", "unreadable_inputs"), ("2", "unreadable_inputs"), ("3", "missing_inputs")}


def test_resume_skips_what_is_done(spark):
    log = step_rows(spark, [("1", "r", "first", "COMPLETED", 0, 1, "one"), ("2", "r", "second", "FAILED", 1, 2, None), ("3", "r", "first", "COMPLETED", 5, 6, "again")])
    runs = spark.createDataFrame([("r", "w")], "run_id string, workflow_id string")
    steps = spark.createDataFrame([("w", s) for s in ("first", "second", "third")], "workflow_id string, step_id string")
    assert {r.step_id for r in cache.steps_to_rerun(runs, steps, log).collect()} == {"second", "third"}
    assert [(r.step_id, r.outputs) for r in cache.completed_outputs(log).collect()] == [("first", "again")]


# --- run log ------------------------------------------------------------------------------


def test_fold(spark):
    events = [("r", 1, "PENDING", None, None), ("r", 2, "RUNNING", None, None), ("r", 3, "FAILED", None, "e"), ("r", 4, "RUNNING", None, None), ("r", 5, "COMPLETED", "o", None), ("q", 1, "RUNNING", None, None)]
    df = spark.createDataFrame([(str(i), run, at(t), st, out, err) for i, (run, t, st, out, err) in enumerate(events)],
                               "event_id string, run_id string, ts timestamp, status string, outputs string, error_message string")
    got = {r.run_id: r for r in runlog.fold_runs(df).collect()}
    r = got["r"]
    assert (r.status, r.started_at, r.completed_at, r.outputs, r.error_message) == ("COMPLETED", at(2), at(5), "o", "e")
    assert got["q"].completed_at is None and got["q"].status == "RUNNING"


def hybrid(spark):
    return step_rows(spark, [("1", "r", "trends", "COMPLETED", 0, 10, '{"volume":5}'), ("2", "r", "news", "COMPLETED", 1, 9, '{"count":2}'), ("3", "r", "join", "COMPLETED", 10, 12, '"x"')])


def test_hybrid_run_audits(spark):
    log = hybrid(spark)
    pairs = spark.createDataFrame([("r", "trends", "news"), ("r", "trends", "join")], "run_id string, step_a string, step_b string")
    assert {(r.step_b, r.overlap) for r in runlog.overlaps(pairs, log).collect()} == {("news", True), ("join", False)}
    assert {(r.id, r.n_overlaps) for r in runlog.overlap_counts(log).collect()} == {("1", 1), ("2", 1), ("3", 0)}
    runs = spark.createDataFrame([("r", "w")], "run_id string, workflow_id string")
    edges = spark.createDataFrame([("w", "trends", "join"), ("w", "news", "join"), ("w", "join", "news")], "workflow_id string, src string, dst string")
    assert [(r.step_id, r.dependency) for r in runlog.barrier_violations(runs, edges, log).collect()] == [("news", "join")]


def test_random_overlaps(spark):
    rng = random.Random(2)
    rows = [(f"{i:04d}", rng.choice("rrrq"), "s", "COMPLETED", a := rng.randrange(300), a + rng.choice([0, 1, 5, 30]), None) for i in range(500)]
    want = {r[0]: sum(r[1] == o[1] and r[0] != o[0] and r[4] < o[5] and o[4] < r[5] for o in rows) for r in rows}
    got = {r.id: r.n_overlaps for r in runlog.overlap_counts(step_rows(spark, rows)).collect()}
    assert got == want


def test_failing_branch(spark):
    log = step_rows(spark, [("1", "r", "branch_fail", "FAILED", 0, 1, None), ("2", "r", "branch_slow", "RUNNING", 0, None, None), ("3", "r", "early", "COMPLETED", 0, 1, None)])
    cut = {r.step_id: r for r in runlog.cancel_siblings(log).collect()}
    assert (cut["branch_slow"].status, cut["branch_slow"].error_trace, cut["branch_slow"].completed_at) == ("CANCELLED", S.CANCELLED_TEXT, at(1))
    assert cut["early"].status == "COMPLETED"
    runs = spark.createDataFrame([("r", "w", None), ("ok", "v", None), ("lost", "w", "no inputs"), ("new", "w", None)], "run_id string, workflow_id string, error_message string")
    steps = spark.createDataFrame([("w", s) for s in ("branch_fail", "branch_slow", "early", "join")] + [("v", "a")], "workflow_id string, step_id string")
    both = log.unionByName(step_rows(spark, [("9", "ok", "a", "COMPLETED", 0, 1, None)]))
    got = {r.run_id: r for r in runlog.run_outcome(runs, steps, both).collect()}
    assert (got["r"].outcome, got["r"].failed_step, got["r"].error) == ("FAILED", "branch_fail", "Workflow failed at step 'branch_fail': boom")
    assert (got["ok"].outcome, got["lost"].outcome, got["lost"].error, got["new"].outcome) == ("COMPLETED", "FAILED", "no inputs", "RUNNING")
    shown = {(r.run_id, r.step_id): (r.display, r.duration) for r in runlog.display_status(runs, steps, both.withColumn("duration_ms", F.when(F.col("step_id") == "a", 12.25)).withColumn("cached", F.col("step_id") == "a")).collect()}
    assert shown[("r", "join")] == ("PENDING", "-") and shown[("ok", "a")][0] == "CACHED" and shown[("r", "branch_fail")] == ("FAILED", "-")


def test_report_nests_page_by_page(spark):
    runs = spark.createDataFrame([("r", "w", "COMPLETED", None, None, None, at(0), at(0), None), ("none", "w", "PENDING", None, None, None, at(0), None, None)], S.WORKFLOW_RUNS)
    got = {(r.id, r.page): r for r in runlog.run_report(runs, hybrid(spark), page_rows=2).collect()}
    assert [s.step_id for s in got[("r", 0)].step_runs] == ["trends", "news"] and [s.step_id for s in got[("r", 1)].step_runs] == ["join"]
    assert got[("none", 0)].step_runs == [] and got[("r", 0)].created_at == "2024-05-01T12:00:00+00:00"
    outputs = {r.page: r.outputs for r in runlog.run_outputs(hybrid(spark), page_rows=2).collect()}
    assert outputs == {0: {"join": '"x"', "news": '{"count":2}'}, 1: {"trends": '{"volume":5}'}}


def test_lookup_of_repeated_rows(spark):
    log = step_rows(spark, [("1", "r", "s", "FAILED", 0, 1, None), ("2", "r", "s", "COMPLETED", 5, 6, None), ("3", "r", "t", "COMPLETED", 5, 6, None)])
    assert logs.find_step_run(log, "r", "s").first().id == "2" and logs.find_step_run(log, "r", "x").count() == 0
    assert [(r.step_id, r.n_rows) for r in logs.repeated_step_runs(log).collect()] == [("s", 2)]
    assert log.select(runlog.duration_ms()).first()[0] == 1000.0
