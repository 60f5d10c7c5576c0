"""Queries on definitions, caches and run logs.

``events`` serves as a log: a run is a user, a step the type of ``props``' last
digit, and an event's value its duration.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from heddlework import schemas as S
from heddlework.functions.fingerprint import input_key
from heddlework.operators import cache, runlog, validation
from heddlework.plans.catalog import joined, micros, query, table
from heddlework.sources import definitions as D
from heddlework.sources import logs

# --- definitions -----------------------------------------------------------------

# One definition per order: two steps with a choice of faults by key.
_DEFINITION_SQL = """
WITH d AS (
  SELECT o_orderkey, 'wf_' || o_custkey AS workflow_id, o_orderpriority, o_orderstatus, o_orderdate,
         o_orderkey % 7 = 3 AS short, o_orderkey % 11 = 5 AS bad_id, o_orderkey % 13 = 6 AS bad_type,
         o_orderkey % 17 = 2 AS no_action, o_orderkey % 19 = 4 AS bad_numbers, o_orderkey % 23 = 1 AS broken
  FROM orders)
"""


def definition_texts(spark, folder):
    """Orders with a definition text each; some lack fields, break rules or are no JSON."""
    o = table(spark, folder, "orders", spread=True)
    k = F.col("o_orderkey")

    def every(n: int, at: int):
        return k % n == at

    rows = o.withColumns(
        {
            "workflow_id": F.concat(F.lit("wf_"), F.col("o_custkey").cast("string")),
            "short": every(7, 3),
            "bad_id": every(11, 5),
            "bad_type": every(13, 6),
            "no_action": every(17, 2),
            "bad_numbers": every(19, 4),
            "broken": every(23, 1),
        }
    )
    first = F.concat(
        F.lit('{"id":"load"'),
        F.when(F.col("bad_type"), ',"type":"SHELL"').otherwise(',"type":"HTTP_DISPATCH"'),
        F.when(F.col("no_action"), "").otherwise(F.lit(',"action":"GET http://x"')),
        F.lit(',"inputs":{"z":1,"a":"'), F.col("o_orderpriority"), F.lit('"}'),
        F.when(F.col("short"), "").otherwise(',"cache_executed_step":true,"timeout_seconds":60'),
        F.when(F.col("bad_numbers"), ',"retry_policy":{"max_retries":-1,"backoff_factor":-0.5}').otherwise(""),
        F.lit("}"),
    )
    second = F.concat(
        F.when(F.col("bad_id"), '{"id":"not-good"').otherwise('{"id":"send"'),
        F.lit(',"type":"LLM_AGENT","action":"mail","depends_on":["load"]}'),
    )
    text = F.concat(
        F.lit('{"workflow_id":"'), F.col("workflow_id"), F.lit('"'),
        F.when(F.col("short"), "").otherwise(',"version":"2.1.0"'),
        F.lit(',"steps":['), first, F.lit(","), second, F.when(F.col("broken"), "]").otherwise("]}"),
    )
    return rows.withColumn("definition_json", text)


@query(
    "definitions_parsed",
    _DEFINITION_SQL + """
    SELECT o_orderkey, CASE WHEN NOT broken THEN workflow_id END AS workflow_id,
           CASE WHEN broken THEN NULL WHEN short THEN '1.0.0' ELSE '2.1.0' END AS version,
           CASE WHEN NOT broken THEN 'manual' END AS trigger_type, broken AS malformed,
           CASE WHEN broken THEN NULL ELSE 2 END AS n_steps
    FROM d
    """,
)
def definitions_parsed(spark, folder):
    parsed = D.parse_definitions(definition_texts(spark, folder), "definition_json", ["o_orderkey"])
    filled = validation.fill_definition_defaults(parsed)
    ok = ~F.col("malformed")
    return filled.select(
        "o_orderkey",
        F.when(ok, F.col("workflow_id")).alias("workflow_id"),
        F.when(ok, F.col("version")).alias("version"),
        F.when(ok, F.col("trigger")["type"]).alias("trigger_type"),
        "malformed",
        F.when(ok, F.size("steps")).alias("n_steps"),
    )


_STEPS_SQL = _DEFINITION_SQL + """,
steps AS (
  SELECT o_orderkey, 0 AS step_pos, 'load' AS id, CASE WHEN bad_type THEN 'SHELL' ELSE 'HTTP_DISPATCH' END AS type, '' AS depends_on,
         CASE WHEN NOT no_action THEN 'GET http://x' END AS action, '{"z":1,"a":"' || o_orderpriority || '"}' AS inputs,
         NOT short AS cached, CASE WHEN short THEN 300 ELSE 60 END AS timeout_seconds,
         CASE WHEN bad_numbers THEN -1 ELSE 0 END AS max_retries, CASE WHEN bad_numbers THEN -0.5 ELSE 1.0 END AS backoff,
         concat_ws(',', CASE WHEN bad_type THEN 'type_unknown' END, CASE WHEN no_action THEN 'action_missing' END,
                   CASE WHEN bad_numbers THEN 'retries_negative,backoff_negative' END) AS errors FROM d WHERE NOT broken
  UNION ALL
  SELECT o_orderkey, 1, CASE WHEN bad_id THEN 'not-good' ELSE 'send' END, 'LLM_AGENT', 'load', 'mail', '{}', FALSE, 300, 0, 1.0,
         CASE WHEN bad_id THEN 'id_format' ELSE '' END FROM d WHERE NOT broken)
"""


def _steps(spark, folder):
    texts = definition_texts(spark, folder).withColumnRenamed("workflow_id", "owner")
    parsed = D.parse_definitions(texts, "definition_json", ["o_orderkey"])
    # Many orders share a customer; the order tells their definitions apart.
    named = parsed.filter(~F.col("malformed")).withColumn("workflow_id", F.col("o_orderkey"))
    return validation.fill_step_defaults(D.explode_steps(named)).withColumnRenamed("workflow_id", "o_orderkey")


@query(
    "definition_steps",
    _STEPS_SQL + "SELECT o_orderkey, step_pos, id, type, depends_on, action, inputs, cached, timeout_seconds, max_retries, CAST(backoff AS DOUBLE) AS backoff FROM steps",
)
def definition_steps(spark, folder):
    return _steps(spark, folder).select(
        "o_orderkey", "step_pos", "id", "type", joined("depends_on").alias("depends_on"), "action", "inputs",
        F.col("cache_executed_step").alias("cached"), "timeout_seconds", "retry_policy.max_retries",
        F.col("retry_policy.backoff_factor").alias("backoff"),
    )


@query("validate_steps", _STEPS_SQL + "SELECT o_orderkey, id, errors, errors = '' AS good FROM steps")
def validate_steps(spark, folder):
    good, bad = validation.split_valid(_steps(spark, folder), validation.step_errors())
    left = good.select("o_orderkey", "id", F.lit("").alias("errors"), F.lit(True).alias("good"))
    return left.unionByName(bad.select("o_orderkey", "id", joined("errors").alias("errors"), F.lit(False).alias("good")))


@query(
    "validate_definitions",
    _DEFINITION_SQL + "SELECT o_orderkey, CASE WHEN broken THEN 'malformed,workflow_id_missing' ELSE '' END AS errors FROM d",
)
def validate_definitions(spark, folder):
    parsed = D.parse_definitions(definition_texts(spark, folder), "definition_json", ["o_orderkey"])
    blank = F.when(~F.col("malformed"), F.col("workflow_id"))
    parsed = parsed.withColumn("workflow_id", blank).withColumn("steps", F.coalesce("steps", F.array().cast(parsed.schema["steps"].dataType)))
    return parsed.select("o_orderkey", joined(validation.definition_errors()).alias("errors"))


@query("definition_step", _STEPS_SQL + "SELECT o_orderkey, step_pos, action FROM steps WHERE id = 'send'")
def definition_step(spark, folder):
    steps = _steps(spark, folder).withColumnRenamed("o_orderkey", "workflow_id")
    return D.definition_step(steps, "send").select(F.col("workflow_id").alias("o_orderkey"), "step_pos", "action")


def _stored(spark, folder):
    """Definition rows as stored: an older and a newer write per customer and day."""
    t = definition_texts(spark, folder)
    return t.select(
        "workflow_id", F.concat(F.lit("1."), F.col("o_orderkey").cast("string")).alias("version"), "definition_json",
        F.col("o_orderdate").alias("created_at"),
        F.timestamp_micros(micros("o_orderdate") + F.col("o_orderkey")).alias("updated_at"), "o_orderstatus",
    )


_UPSERT_SQL = """
WITH rows AS (SELECT 'wf_' || o_custkey AS workflow_id, '1.' || o_orderkey AS version, o_orderdate AS created_at,
              o_orderdate + to_microseconds(o_orderkey) AS updated_at FROM orders),
kept AS (SELECT workflow_id, arg_max(version, updated_at) AS version, epoch_us(min(created_at)) AS created_us,
         epoch_us(max(updated_at)) AS updated_us FROM rows GROUP BY workflow_id)
"""


def _upserted(spark, folder):
    rows = _stored(spark, folder)
    old, new = rows.filter("o_orderstatus = 'F'"), rows.filter("o_orderstatus <> 'F'")
    return D.upsert_definitions(old.drop("o_orderstatus"), new.drop("o_orderstatus"))


@query("upsert_definitions", _UPSERT_SQL + "SELECT * FROM kept")
def upsert_definitions(spark, folder):
    return _upserted(spark, folder).select("workflow_id", "version", micros("created_at").alias("created_us"), micros("updated_at").alias("updated_us"))


@query("find_definition", _UPSERT_SQL + "SELECT workflow_id, version FROM kept WHERE workflow_id = 'wf_7'")
def find_definition(spark, folder):
    return D.find_definition(_upserted(spark, folder), "wf_7").select("workflow_id", "version")


@query(
    "find_definitions",
    _UPSERT_SQL + """SELECT 'wf_' || c_custkey AS workflow_id, k.version, k.version IS NOT NULL AS found
    FROM customer LEFT JOIN kept k ON k.workflow_id = 'wf_' || c_custkey
    """,
)
def find_definitions(spark, folder):
    wanted = table(spark, folder, "customer").select(F.concat(F.lit("wf_"), F.col("c_custkey").cast("string")).alias("workflow_id"))
    return D.find_definitions(wanted, _upserted(spark, folder)).select("workflow_id", "version", "found")


# --- run logs ----------------------------------------------------------------------

STATUS = {"signup": "PENDING", "view": "RUNNING", "click": "COMPLETED", "purchase": "COMPLETED", "error": "FAILED"}
_STATUS_SQL = "CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'RUNNING' WHEN 'error' THEN 'FAILED' ELSE 'COMPLETED' END"
_K_SQL = "CAST(props->>'$.k' AS INTEGER)"

_LOG_SQL = f"""
WITH sr AS (
  SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, 'run_' || user_id AS run_id, 'wf_' || user_id % 10 AS workflow_id,
         's' || {_K_SQL} % 10 AS step_id, {_STATUS_SQL} AS status, props AS outputs,
         sha256('{{"action":"' || event_type || '","inputs":{{"k":' || (props->>'$.k') || '}}}}') AS input_hash,
         CASE WHEN event_type = 'error' THEN 'bad ' || (props->>'$.k') END AS error_trace,
         CASE WHEN event_type IN ('click', 'purchase', 'error') THEN round(value * 1000) / 1000 END AS duration_ms,
         {_K_SQL} < 20 AS cached, ts AS created_at,
         CASE WHEN event_type <> 'signup' THEN ts END AS started_at,
         CASE WHEN event_type IN ('click', 'purchase', 'error') THEN ts + to_microseconds(CAST(round(value * 1000) AS BIGINT) * 1000000) END AS completed_at
  FROM events),
run AS (SELECT DISTINCT run_id, workflow_id FROM sr),
step AS (SELECT DISTINCT workflow_id, step_id FROM sr UNION SELECT DISTINCT workflow_id, 'never' FROM sr)
"""


def step_log(spark, folder):
    """Step runs in the shape of the log table, with the workflow alongside."""
    return shape_log(table(spark, folder, "events", spread=True))


def shape_log(e):
    status = F.coalesce(*[F.when(F.col("event_type") == kind, s) for kind, s in STATUS.items()])
    v = F.try_parse_json("props")
    k = F.try_variant_get(v, "$.k", "int")
    ended = F.col("event_type").isin("click", "purchase", "error")
    length = F.round(F.col("value") * 1000)
    return e.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"),
        F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"),
        F.concat(F.lit("wf_"), (F.col("user_id") % 10).cast("string")).alias("workflow_id"),
        F.concat(F.lit("s"), (k % 10).cast("string")).alias("step_id"),
        status.alias("status"),
        input_key(F.col("event_type"), v).alias("input_hash"),
        F.lit("{}").alias("raw_inputs"),
        F.col("props").alias("resolved_inputs"),
        F.col("props").alias("outputs"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("bad "), k.cast("string"))).alias("error_trace"),
        F.when(ended, length / 1000).alias("duration_ms"),
        (k < 20).alias("cached"),
        F.col("ts").alias("created_at"),
        F.when(F.col("event_type") != "signup", F.col("ts")).alias("started_at"),
        F.when(ended, F.timestamp_micros(micros("ts") + length.cast("long") * 1_000_000)).alias("completed_at"),
    )


def _runs(log):
    return log.select("run_id", "workflow_id").distinct()


def _declared(log):
    seen = log.select("workflow_id", "step_id").distinct()
    return seen.unionByName(log.select("workflow_id", F.lit("never").alias("step_id")).distinct())


@query(
    "cache_newest",
    _LOG_SQL + """SELECT input_hash, id, outputs FROM sr WHERE status = 'COMPLETED'
    QUALIFY row_number() OVER (PARTITION BY input_hash ORDER BY completed_at DESC, id DESC) = 1
    """,
)
def cache_newest(spark, folder):
    return cache.newest_completed(step_log(spark, folder), columns=["id", "outputs"])


# Requests are the views, clicks and errors of later events; the log holds purchases
# and clicks. A request whose k is even may read the log.
_CACHED_SQL = _LOG_SQL + f""",
old AS (SELECT input_hash, id AS source FROM sr WHERE status = 'COMPLETED' AND input_hash IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY input_hash ORDER BY completed_at DESC, id DESC) = 1),
req AS (SELECT event_id, sha256('{{"action":"' || CASE event_type WHEN 'view' THEN 'click' ELSE event_type END || '","inputs":{{"k":' || (props->>'$.k') || '}}}}') AS input_hash,
        {_K_SQL} AS k FROM events)
SELECT r.event_id, r.input_hash, coalesce(o.source IS NOT NULL AND k % 2 = 0, FALSE) AS cached,
       CASE WHEN o.source IS NOT NULL AND k % 2 = 0 THEN '{{"k":' || k || '}}' ELSE '{{"square":' || k * k || '}}' END AS outputs
FROM req r LEFT JOIN old o ON r.input_hash = o.input_hash
"""


def _square(missing):
    k = F.try_variant_get(F.try_parse_json("resolved_inputs"), "$.k", "int")
    return missing.select("input_hash", F.concat(F.lit('{"square":'), (k * k).cast("string"), F.lit("}")).alias("outputs"))


def requests(spark, folder):
    return shape_requests(table(spark, folder, "events", spread=True))


def shape_requests(e):
    action = F.when(F.col("event_type") == "view", "click").otherwise(F.col("event_type"))
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return e.select(
        "event_id", F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"),
        F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"), F.lit("s").alias("step_id"),
        action.alias("action"), F.col("props").alias("resolved_inputs"), (k % 2 == 0).alias("use_cache"),
        F.col("ts").alias("created_at"),
    )


@query("cached_step", _CACHED_SQL)
def cached_step(spark, folder):
    log = step_log(spark, folder).withColumn("outputs", F.to_json(F.try_parse_json("outputs")))
    step = cache.cached_step(requests(spark, folder), log, _square, "use_cache")
    return step.results.select("event_id", "input_hash", "cached", "outputs")


@query(
    "resume_outputs",
    _LOG_SQL + """SELECT run_id, step_id, arg_max(outputs, id) AS outputs FROM (
      SELECT * FROM sr WHERE status = 'COMPLETED' QUALIFY rank() OVER (PARTITION BY run_id, step_id ORDER BY created_at DESC) = 1)
    GROUP BY run_id, step_id
    """,
)
def resume_outputs(spark, folder):
    return cache.completed_outputs(step_log(spark, folder))


@query(
    "resume_worklist",
    _LOG_SQL + """SELECT r.run_id, r.workflow_id, s.step_id FROM run r JOIN step s ON r.workflow_id = s.workflow_id
    ANTI JOIN (SELECT run_id, step_id FROM sr WHERE status = 'COMPLETED') d ON d.run_id = r.run_id AND d.step_id = s.step_id
    """,
)
def resume_worklist(spark, folder):
    log = step_log(spark, folder)
    return cache.steps_to_rerun(_runs(log), _declared(log), log)


@query(
    "new_runs",
    f"""SELECT CAST(event_id AS VARCHAR) AS id, {_STATUS_SQL} AS status, epoch_us(ts) AS created_us,
    CASE WHEN event_type = 'view' THEN epoch_us(ts) END AS started_us FROM events""",
)
def new_runs(spark, folder):
    e = table(spark, folder, "events")
    status = F.coalesce(*[F.when(F.col("event_type") == kind, s) for kind, s in STATUS.items()])
    rows = e.select(F.col("event_id").cast("string").alias("id"), status.alias("status"), F.col("ts").alias("created_at"))
    return logs.new_runs(rows).select("id", "status", micros("created_at").alias("created_us"), micros("started_at").alias("started_us"))


@query(
    "new_step_runs",
    f"""SELECT CAST(event_id AS VARCHAR) AS id, {_STATUS_SQL} AS status, FALSE AS cached,
    CASE WHEN event_type IN ('view', 'click', 'purchase') THEN epoch_us(ts) END AS started_us,
    CASE WHEN event_type IN ('click', 'purchase') THEN epoch_us(ts) END AS completed_us FROM events""",
)
def new_step_runs(spark, folder):
    e = table(spark, folder, "events")
    status = F.coalesce(*[F.when(F.col("event_type") == kind, s) for kind, s in STATUS.items()])
    rows = e.select(F.col("event_id").cast("string").alias("id"), status.alias("status"), F.col("ts").alias("created_at"))
    return logs.new_step_runs(rows).select(
        "id", "status", "cached", micros("started_at").alias("started_us"), micros("completed_at").alias("completed_us")
    )


@query(
    "newest_step_runs",
    _LOG_SQL + "SELECT run_id, step_id, id, status FROM sr QUALIFY row_number() OVER (PARTITION BY run_id, step_id ORDER BY created_at DESC, id DESC) = 1",
)
def newest_step_runs(spark, folder):
    return logs.newest_step_runs(step_log(spark, folder), ["id", "status"])


@query(
    "find_step_run",
    _LOG_SQL + "SELECT run_id, step_id, id, status FROM sr WHERE run_id = 'run_7' AND step_id = 's3' QUALIFY row_number() OVER (ORDER BY created_at DESC, id DESC) = 1",
)
def find_step_run(spark, folder):
    return logs.find_step_run(step_log(spark, folder), "run_7", "s3").select("run_id", "step_id", "id", "status")


@query(
    "repeated_step_runs",
    _LOG_SQL + "SELECT run_id, step_id, count(*) AS n_rows FROM sr GROUP BY run_id, step_id HAVING count(*) > 1",
)
def repeated_step_runs(spark, folder):
    return logs.repeated_step_runs(step_log(spark, folder))


@query(
    "run_report",
    _LOG_SQL + """, many AS (
      SELECT *, (row_number() OVER (PARTITION BY run_id ORDER BY created_at, id) - 1) // 25 AS page FROM sr),
    listed AS (
      SELECT run_id, page, string_agg(step_id || ':' || status || ':' || coalesce(strftime(started_at, '%Y-%m-%dT%H:%M:%S.%f+00:00'), ''), ',' ORDER BY created_at, id) AS steps,
             count(*) AS n_steps FROM many GROUP BY run_id, page)
    SELECT 'run_' || c_custkey AS id, coalesce(page, 0) AS page, coalesce(steps, '') AS steps, coalesce(n_steps, 0) AS n_steps
    FROM customer LEFT JOIN listed ON run_id = 'run_' || c_custkey
    """,
)
def run_report(spark, folder):
    runs = table(spark, folder, "customer").select(F.concat(F.lit("run_"), F.col("c_custkey").cast("string")).alias("id"), "c_name")
    report = runlog.run_report(runs, step_log(spark, folder), page_rows=25)
    shown = F.transform(
        "step_runs", lambda s: F.concat_ws(":", s["step_id"], s["status"], F.coalesce(s["started_at"], F.lit("")))
    )
    return report.select("id", "page", joined(shown).alias("steps"), F.size("step_runs").cast("long").alias("n_steps"))


@query(
    "run_outputs",
    _LOG_SQL + """, last AS (
      SELECT run_id, step_id, outputs FROM sr WHERE status = 'COMPLETED'
      QUALIFY row_number() OVER (PARTITION BY run_id, step_id ORDER BY created_at DESC, id DESC) = 1),
    many AS (SELECT *, (row_number() OVER (PARTITION BY run_id ORDER BY step_id) - 1) // 4 AS page FROM last)
    SELECT run_id, page, string_agg(step_id || '=' || outputs, ',' ORDER BY step_id) AS outputs FROM many GROUP BY run_id, page
    """,
)
def run_outputs(spark, folder):
    paged = runlog.run_outputs(step_log(spark, folder), page_rows=4)
    shown = F.transform(F.map_entries("outputs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return paged.select("run_id", "page", joined(shown).alias("outputs"))


def _status_events(spark, folder):
    log = step_log(spark, folder)
    return log.select(
        F.col("id").alias("event_id"), "run_id", F.concat("run_id", F.lit("/"), "step_id").alias("step_run_id"),
        F.col("created_at").alias("ts"), "status", F.when(F.col("status") == "COMPLETED", F.col("outputs")).alias("outputs"),
        F.col("error_trace").alias("error_message"), "error_trace", "duration_ms",
    )


def _fold_sql(key: str, key_sql: str, error: str, extra: str = "") -> str:
    return _LOG_SQL + f"""SELECT {key_sql} AS {key}, arg_max(status, (created_at, id)) AS status,
    epoch_us(min(created_at) FILTER (status = 'RUNNING')) AS started_us,
    epoch_us(max(created_at) FILTER (status IN ('COMPLETED', 'FAILED', 'CANCELLED'))) AS completed_us,
    arg_max(outputs, (created_at, id)) FILTER (status = 'COMPLETED') AS outputs,
    arg_max(error_trace, (created_at, id)) FILTER (error_trace IS NOT NULL) AS {error}{extra}
    FROM sr GROUP BY {key_sql}"""


@query("fold_runs", _fold_sql("run_id", "run_id", "error_message"))
def fold_runs(spark, folder):
    folded = runlog.fold_runs(_status_events(spark, folder))
    return folded.select("run_id", "status", micros("started_at").alias("started_us"), micros("completed_at").alias("completed_us"), "outputs", "error_message")


@query(
    "fold_step_runs",
    _fold_sql("step_run_id", "run_id || '/' || step_id", "error_trace", ", arg_max(duration_ms, (created_at, id)) FILTER (duration_ms IS NOT NULL) AS duration_ms"),
)
def fold_step_runs(spark, folder):
    folded = runlog.fold_step_runs(_status_events(spark, folder))
    return folded.select(
        "step_run_id", "status", micros("started_at").alias("started_us"), micros("completed_at").alias("completed_us"),
        "outputs", "error_trace", "duration_ms",
    )


@query(
    "display_status",
    _LOG_SQL + """, last AS (SELECT * FROM sr QUALIFY row_number() OVER (PARTITION BY run_id, step_id ORDER BY created_at DESC, id DESC) = 1)
    SELECT r.run_id, r.workflow_id, s.step_id,
           CASE WHEN l.id IS NULL THEN 'PENDING' WHEN l.cached THEN 'CACHED' ELSE l.status END AS display,
           l.duration_ms IS NOT NULL AS has_duration
    FROM run r JOIN step s ON r.workflow_id = s.workflow_id LEFT JOIN last l ON l.run_id = r.run_id AND l.step_id = s.step_id
    """,
)
def display_status(spark, folder):
    log = step_log(spark, folder)
    shown = runlog.display_status(_runs(log), _declared(log), log)
    return shown.select("run_id", "workflow_id", "step_id", "display", (F.col("duration") != "-").alias("has_duration"))


@query(
    "run_outcome",
    _LOG_SQL + """, last AS (SELECT * FROM sr QUALIFY row_number() OVER (PARTITION BY run_id, step_id ORDER BY created_at DESC, id DESC) = 1),
    need AS (SELECT workflow_id, count(*) AS n FROM step WHERE step_id <> 'never' GROUP BY workflow_id),
    got AS (SELECT run_id, count(*) FILTER (status = 'COMPLETED') AS n_done,
            arg_min(step_id, (completed_at, step_id)) FILTER (status = 'FAILED') AS failed_step,
            arg_min(error_trace, (completed_at, step_id)) FILTER (status = 'FAILED') AS why FROM last GROUP BY run_id)
    SELECT r.run_id, r.workflow_id, CASE WHEN failed_step IS NOT NULL THEN 'FAILED' WHEN n_done >= n THEN 'COMPLETED' ELSE 'RUNNING' END AS outcome,
           failed_step, 'Workflow failed at step ''' || failed_step || ''': ' || why AS error
    FROM run r JOIN need USING (workflow_id) JOIN got USING (run_id)
    """,
)
def run_outcome(spark, folder):
    log = step_log(spark, folder)
    runs = _runs(log).withColumn("error_message", F.lit(None).cast("string"))
    steps = _declared(log).filter("step_id <> 'never'")
    return runlog.run_outcome(runs, steps, logs.newest_step_runs(log, ["status", "completed_at", "error_trace"]))


@query(
    "cancel_siblings",
    _LOG_SQL + """, broken AS (SELECT run_id, min(completed_at) AS cut_at FROM sr WHERE status = 'FAILED' GROUP BY run_id)
    SELECT id, CASE WHEN cut_at IS NOT NULL AND status IN ('PENDING', 'RUNNING') THEN 'CANCELLED' ELSE status END AS status,
           CASE WHEN cut_at IS NOT NULL AND status IN ('PENDING', 'RUNNING') THEN 'Cancelled due to sibling task failure' ELSE error_trace END AS error_trace,
           epoch_us(CASE WHEN status IN ('PENDING', 'RUNNING') THEN cut_at ELSE completed_at END) AS completed_us
    FROM sr LEFT JOIN broken USING (run_id)
    """,
)
def cancel_siblings(spark, folder):
    cut = runlog.cancel_siblings(step_log(spark, folder))
    return cut.select("id", "status", "error_trace", micros("completed_at").alias("completed_us"))


@query(
    "overlap_counts",
    _LOG_SQL + """SELECT a.run_id, a.id, count(b.id) AS n_overlaps
    FROM (SELECT * FROM sr WHERE completed_at IS NOT NULL) a
    LEFT JOIN (SELECT * FROM sr WHERE completed_at IS NOT NULL) b
      ON a.run_id = b.run_id AND a.id <> b.id AND a.started_at < b.completed_at AND b.started_at < a.completed_at
    GROUP BY a.run_id, a.id
    """,
)
def overlap_counts(spark, folder):
    return runlog.overlap_counts(step_log(spark, folder))


@query(
    "overlap_pairs",
    _LOG_SQL + """, last AS (SELECT * FROM sr QUALIFY row_number() OVER (PARTITION BY run_id, step_id ORDER BY created_at DESC, id DESC) = 1)
    SELECT a.run_id, a.step_id AS step_a, b.step_id AS step_b, a.started_at < b.completed_at AND b.started_at < a.completed_at AS overlap
    FROM last a JOIN last b ON a.run_id = b.run_id WHERE a.step_id = 's1' AND b.step_id = 's2'
    """,
)
def overlap_pairs(spark, folder):
    log = step_log(spark, folder)
    pairs = _runs(log).select("run_id", F.lit("s1").alias("step_a"), F.lit("s2").alias("step_b"))
    return runlog.overlaps(pairs, logs.newest_step_runs(log, ["started_at", "completed_at"]))


@query(
    "barrier_violations",
    _LOG_SQL + """, last AS (SELECT * FROM sr QUALIFY row_number() OVER (PARTITION BY run_id, step_id ORDER BY created_at DESC, id DESC) = 1),
    edge AS (SELECT DISTINCT workflow_id, 's' || i // 2 AS src, 's' || i AS dst FROM sr, (SELECT unnest(range(1, 10)) AS i))
    SELECT z.run_id, z.step_id, a.step_id AS dependency FROM last z JOIN edge e ON z.workflow_id = e.workflow_id AND z.step_id = e.dst
    JOIN last a ON a.run_id = z.run_id AND a.step_id = e.src WHERE z.started_at < a.completed_at
    """,
)
def barrier_violations(spark, folder):
    log = step_log(spark, folder)
    i = F.col("i")
    edges = log.select("workflow_id").distinct().select("workflow_id", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("i")).select(
        "workflow_id", F.concat(F.lit("s"), F.floor(i / 2).cast("string")).alias("src"), F.concat(F.lit("s"), i.cast("string")).alias("dst")
    )
    return runlog.barrier_violations(_runs(log), edges, logs.newest_step_runs(log, ["started_at", "completed_at"]))


@query(
    "step_durations",
    _LOG_SQL + "SELECT id, (epoch_us(completed_at) - epoch_us(started_at)) / 1000.0 AS took_ms FROM sr WHERE completed_at IS NOT NULL",
)
def step_durations(spark, folder):
    ended = step_log(spark, folder).filter(F.col("completed_at").isNotNull())
    return ended.select("id", runlog.duration_ms().alias("took_ms"))
