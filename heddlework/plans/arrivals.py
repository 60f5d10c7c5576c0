"""Queries on waits and callbacks, and on arriving rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddlework.operators.waits import match_waits, waits_from_steps
from heddlework.plans.catalog import micros, query, table
from heddlework.plans.runs import _CACHED_SQL, _LOG_SQL, _square, shape_log, shape_requests
from heddlework.session import Staging
from heddlework.sources.callbacks import ingest_callbacks, stream_callbacks, write_callbacks
from heddlework.streaming.cached import CachedBatches
from heddlework.streaming.runstate import live_runs, live_runs_ending
from heddlework.streaming.waits import STATE_STORE, WaitBatches, match_stream, tagged

# A signup waits for a purchase of the same user, for as many hours as its k says.
_WAIT_SQL = """
WITH w AS (SELECT event_id, user_id, ts AS began, ts + to_hours(CAST(props->>'$.k' AS INTEGER)) AS ends FROM events WHERE event_type = 'signup'),
c AS (SELECT event_id, user_id, ts, props FROM events WHERE event_type = 'purchase'),
owned AS (
  SELECT c.event_id, c.user_id, c.ts, c.props, w.event_id AS wait_id, w.ends
  FROM c LEFT JOIN w ON w.user_id = c.user_id AND w.began <= c.ts
  QUALIFY row_number() OVER (PARTITION BY c.event_id ORDER BY w.began DESC NULLS LAST, w.event_id DESC) = 1),
won AS (SELECT * FROM owned WHERE ts <= ends QUALIFY row_number() OVER (PARTITION BY wait_id ORDER BY ts, event_id) = 1)
"""


def _name(column: str):
    return F.lpad(F.col(column).cast("string"), 12, "0")


def _waits(events, unit=3600):
    hours = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return events.filter("event_type = 'signup'").select(
        _name("event_id").alias("wait_id"), F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"),
        F.lit("s").alias("step_id"), F.col("ts").alias("started_at"), (hours * unit).alias("timeout_seconds"),
    )


def _callbacks(events):
    return events.filter("event_type = 'purchase'").select(
        _name("event_id").alias("callback_id"), F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"),
        F.lit("s").alias("step_id"), "ts", F.col("props").alias("payload"),
    )


@query(
    "wait_match",
    _WAIT_SQL + """SELECT lpad(CAST(w.event_id AS VARCHAR), 12, '0') AS wait_id, 'run_' || w.user_id AS run_id,
    CASE WHEN won.event_id IS NOT NULL THEN 'COMPLETED' ELSE 'FAILED' END AS outcome,
    lpad(CAST(won.event_id AS VARCHAR), 12, '0') AS callback_id, won.props AS outputs, epoch_us(won.ts) AS callback_us
    FROM w LEFT JOIN won ON won.wait_id = w.event_id""",
)
def wait_match(spark, folder):
    e = table(spark, folder, "events")
    matched = match_waits(_waits(e), _callbacks(e)).waits
    return matched.select("wait_id", "run_id", "outcome", "callback_id", "outputs", micros("callback_ts").alias("callback_us"))


@query(
    "wait_rejects",
    _WAIT_SQL + "SELECT lpad(CAST(c.event_id AS VARCHAR), 12, '0') AS callback_id, 'run_' || c.user_id AS run_id FROM c ANTI JOIN won ON won.event_id = c.event_id",
)
def wait_rejects(spark, folder):
    e = table(spark, folder, "events")
    return match_waits(_waits(e), _callbacks(e)).rejected.select("callback_id", "run_id")


@query(
    "wait_steps",
    """SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS wait_id, 'run_' || user_id AS run_id, 300 AS timeout_seconds
    FROM events WHERE event_type = 'signup'""",
)
def wait_steps(spark, folder):
    kind = F.col("event_type")
    flag = F.when(kind == "signup", '{"wait_for_webhook": true}').when(kind == "view", '{"wait_for_webhook": "true"}')
    flag = flag.when(kind == "click", '{"wait_for_webhook": 1}').otherwise("{}")
    steps = table(spark, folder, "events").select(
        _name("event_id").alias("id"), F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"),
        F.lit("s").alias("step_id"), flag.alias("resolved_inputs"), F.col("ts").alias("started_at"), F.lit(300).alias("timeout_seconds"),
    )
    return waits_from_steps(steps).select("wait_id", "run_id", "timeout_seconds")


# --- streams ------------------------------------------------------------------------


def stream_events(spark, folder):
    """The event table read as a stream, in UTC instants."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    # A glob, because a stream takes a plain path for a folder and the table may be one file.
    rows = spark.readStream.schema(schema).parquet(f"{folder}/event[s].parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(writer, stage, name):
    writer.option("checkpointLocation", f"{stage.root}/{name}-checkpoint").trigger(availableNow=True).start().awaitTermination()


# What the watermark has passed: everything up to the newest event less the delay.
_STREAM_SQL = _WAIT_SQL + """, mark AS (SELECT epoch_ms(epoch_ms(max(ts)) - {delay}) AS at FROM events WHERE event_type IN ('signup', 'purchase'))
SELECT 'run_' || w.user_id AS run_id, 'FAILED' AS outcome, lpad(CAST(w.event_id AS VARCHAR), 12, '0') AS row_id, CAST(NULL AS VARCHAR) AS payload
FROM w ANTI JOIN won ON won.wait_id = w.event_id, mark WHERE w.ends <= mark.at
UNION ALL
SELECT 'run_' || c.user_id, CASE WHEN won.event_id IS NOT NULL THEN 'COMPLETED' ELSE 'REJECTED' END, lpad(CAST(c.event_id AS VARCHAR), 12, '0'), c.props
FROM c LEFT JOIN won ON won.event_id = c.event_id, mark WHERE c.ts <= mark.at
"""


def _shown(outcomes):
    row = F.coalesce("callback_id", "wait_id").alias("row_id")
    return outcomes.select("run_id", "outcome", row, "payload")


@query("wait_stream", _STREAM_SQL.format(delay=3_600_000))
def wait_stream(spark, folder):
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    e = stream_events(spark, folder)
    matched = match_stream(_waits(e), _callbacks(e), "1 hour")
    stage = Staging(spark, "wait-stream")
    _run(matched.writeStream.format("parquet").option("path", f"{stage.root}/out"), stage, "out")
    return _shown(spark.read.schema(matched.schema).parquet(f"{stage.root}/out"))


# Callbacks of the first twelve minutes of an hour come after the watermark has passed them.
_LATE_SQL = _WAIT_SQL.replace("to_hours", "to_days").split(",\nwon AS")[0] + """,
mark AS (SELECT epoch_ms(epoch_ms(max(ts)) - 3600000) AS at FROM events WHERE event_type IN ('signup', 'purchase')),
known AS (SELECT owned.*, mark.at AS mark, ts <= mark.at AND minute(ts) < 12 AS late FROM owned, mark WHERE ts <= mark.at),
on_time AS (SELECT * FROM known WHERE NOT late AND ts <= ends QUALIFY row_number() OVER (PARTITION BY wait_id ORDER BY ts, event_id) = 1),
belated AS (
  SELECT * FROM known WHERE late AND ts <= ends AND ends > mark AND wait_id NOT IN (SELECT wait_id FROM on_time)
  QUALIFY row_number() OVER (PARTITION BY wait_id ORDER BY ts, event_id) = 1),
won AS (SELECT event_id, wait_id FROM on_time UNION ALL SELECT event_id, wait_id FROM belated)
SELECT 'run_' || w.user_id AS run_id, 'FAILED' AS outcome, lpad(CAST(w.event_id AS VARCHAR), 12, '0') AS row_id, CAST(NULL AS VARCHAR) AS payload
FROM w ANTI JOIN won ON won.wait_id = w.event_id, mark WHERE w.ends <= mark.at
UNION ALL
SELECT 'run_' || c.user_id, CASE WHEN won.event_id IS NOT NULL THEN 'COMPLETED' ELSE 'REJECTED' END, lpad(CAST(c.event_id AS VARCHAR), 12, '0'), c.props
FROM known c LEFT JOIN won ON won.event_id = c.event_id
"""


@query("wait_late", _LATE_SQL)
def wait_late(spark, folder):
    """Two deliveries of callback files; the second is behind the watermark of the first."""
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    events = table(spark, folder, "events")
    newest = F.max(F.date_trunc("millisecond", "ts"))
    mark = events.filter("event_type IN ('signup', 'purchase')").agg(newest).first()[0]
    late = (F.col("ts") <= F.lit(mark) - F.expr("INTERVAL 1 HOUR")) & (F.minute("ts") < 12) if mark else F.lit(False)
    stage = Staging(spark, "wait-late")
    for delivery in (~late, late):
        write_callbacks(_callbacks(events).filter(delivery), f"{stage.root}/calls")
        calls = stream_callbacks(spark, f"{stage.root}/calls", 1_000_000)
        matched = match_stream(_waits(stream_events(spark, folder), 86_400), calls, "1 hour", parts=4)
        _run(matched.writeStream.format("parquet").option("path", f"{stage.root}/out"), stage, "out")
    return _shown(spark.read.schema(matched.schema).parquet(f"{stage.root}/out"))


@query(
    "ingest_callbacks",
    """SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS event, CASE WHEN event_type <> 'click' THEN epoch_us(ts) END AS at_us,
    CASE event_type WHEN 'click' THEN NULL WHEN 'view' THEN '[1,2]' ELSE props END AS payload,
    CASE event_type WHEN 'click' THEN 'unreadable' WHEN 'view' THEN 'missing_run_id' ELSE 'accepted' END AS outcome FROM events""",
)
def ingested(spark, folder):
    """Callback files written from all events: clicks as broken lines, views without a run."""
    kind, stage = F.col("event_type"), Staging(spark, "ingest")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    run = F.when(kind == "view", "").otherwise(F.concat(F.lit('"run_id":"run_'), F.col("user_id").cast("string"), F.lit('",')))
    payload = F.when(kind == "view", "[1,2]").otherwise(F.col("props"))
    line = F.concat(
        F.lit('{"callback_id":"'), _name("event_id"), F.lit('",'), run, F.lit('"step_id":"s","ts":"'), at, F.lit('","payload":'), payload, F.lit("}")
    )
    broken = F.concat(F.lit('{"callback_id":"'), _name("event_id"))
    events = table(spark, folder, "events")
    events.select(F.when(kind == "click", broken).otherwise(line)).write.text(f"{stage.root}/calls")
    found = ingest_callbacks(spark, f"{stage.root}/calls")
    accepted = found.accepted.select(F.col("callback_id").alias("event"), micros("ts").alias("at_us"), "payload", F.lit("accepted").alias("outcome"))
    named = F.coalesce("callback_id", F.right("line", F.lit(12)))
    return accepted.unionByName(found.rejects.select(named.alias("event"), micros("ts").alias("at_us"), "payload", F.col("reason").alias("outcome")))


@query("wait_batches", _STREAM_SQL.replace("epoch_ms(epoch_ms(max(ts)) - {delay})", "max(ts) - to_hours(1)"))
def wait_batches(spark, folder):
    e = stream_events(spark, folder)
    stage = Staging(spark, "wait-batches")
    sink = WaitBatches(stage.root, delay_seconds=3600)
    _run(tagged(_waits(e), _callbacks(e)).writeStream.foreachBatch(sink), stage, "sink")
    return _shown(sink.outcomes(spark))


@query(
    "live_runs",
    _LOG_SQL + """SELECT run_id, arg_max(status, (created_at, id)) AS status,
    epoch_us(min(created_at) FILTER (status = 'RUNNING')) AS started_us,
    epoch_us(max(created_at) FILTER (status IN ('COMPLETED', 'FAILED'))) AS completed_us FROM sr GROUP BY run_id""",
)
def live_run_state(spark, folder):
    log = shape_log(stream_events(spark, folder))
    events = log.select(
        F.col("id").alias("event_id"), "run_id", F.col("created_at").alias("ts"), "status", "outputs",
        F.col("error_trace").alias("error_message"),
    )
    stage = Staging(spark, "live")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{stage.root}/state/batch={batch_id}")

    state = live_runs(events)
    _run(state.writeStream.outputMode("update").foreachBatch(keep), stage, "state")
    fields = T.StructType([*state.schema.fields, T.StructField("batch", T.IntegerType())])
    rows = spark.read.schema(fields).option("basePath", f"{stage.root}/state").parquet(f"{stage.root}/state/batch=*")
    newest = rows.groupBy("run_id").agg(F.max_by(F.struct("status", "started_at", "completed_at"), F.col("batch")).alias("s"))
    return newest.select("run_id", "s.status", micros("s.started_at").alias("started_us"), micros("s.completed_at").alias("completed_us"))


# Runs that ended three days before the first half's last hour are taken up anew by the second.
_ENDING_SQL = _LOG_SQL + """, cut AS (SELECT (epoch_us(min(ts)) + epoch_us(max(ts))) // 2 AS at FROM events),
halves AS (SELECT sr.*, epoch_us(created_at) >= cut.at AS second FROM sr, cut),
mark AS (SELECT epoch_ms(epoch_ms(max(created_at)) - 3600000) AS at FROM halves WHERE NOT second),
gone AS (
  SELECT run_id FROM (SELECT run_id, arg_max(status, (created_at, id)) AS status, max(created_at) AS last FROM halves WHERE NOT second GROUP BY run_id), mark
  WHERE status IN ('COMPLETED', 'FAILED', 'CANCELLED') AND last + to_days(3) <= mark.at),
again AS (SELECT DISTINCT run_id FROM halves WHERE second AND run_id IN (SELECT run_id FROM gone))
SELECT run_id, arg_max(status, (created_at, id)) AS status,
epoch_us(min(created_at) FILTER (status = 'RUNNING')) AS started_us,
epoch_us(max(created_at) FILTER (status IN ('COMPLETED', 'FAILED'))) AS completed_us,
arg_max(outputs, (created_at, id)) AS outputs, arg_max(error_trace, (created_at, id)) FILTER (error_trace IS NOT NULL) AS error_message
FROM halves WHERE second OR run_id NOT IN (SELECT run_id FROM again) GROUP BY run_id"""


@query("live_runs_ending", _ENDING_SQL)
def live_runs_that_end(spark, folder):
    """Two deliveries of all events; the second finds the state of long ended runs gone."""
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    log = shape_log(table(spark, folder, "events")).select(
        F.col("id").alias("event_id"), "run_id", F.col("created_at").alias("ts"), "status", "outputs",
        F.col("error_trace").alias("error_message"),
    )
    first, last = log.agg(micros(F.min("ts")), micros(F.max("ts"))).first()
    second = micros("ts") >= ((first or 0) + (last or 0)) // 2
    stage = Staging(spark, "live-ending")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{stage.root}/state/batch={batch_id}")

    for delivery in (~second, second):
        log.filter(delivery).write.mode("append").parquet(f"{stage.root}/events")
        events = spark.readStream.schema(log.schema).parquet(f"{stage.root}/events")
        state = live_runs_ending(events, "1 hour", 3 * 86_400)
        _run(state.writeStream.outputMode("update").foreachBatch(keep), stage, "state")
    fields = T.StructType([*state.schema.fields, T.StructField("batch", T.IntegerType())])
    rows = spark.read.schema(fields).option("basePath", f"{stage.root}/state").parquet(f"{stage.root}/state/batch=*")
    newest = rows.groupBy("run_id").agg(F.max_by(F.struct(*state.columns[1:]), F.col("batch")).alias("s"))
    return newest.select(
        "run_id", "s.status", micros("s.started_at").alias("started_us"), micros("s.completed_at").alias("completed_us"),
        "s.outputs", "s.error_message",
    )


@query("cached_batches", _CACHED_SQL.replace("old AS (SELECT", "old AS (SELECT * FROM (SELECT").replace(
    "completed_at DESC, id DESC) = 1)", "completed_at DESC, id DESC) = 1) WHERE FALSE)"))
def cached_batches(spark, folder):
    stage = Staging(spark, "cached")
    sink = CachedBatches(f"{stage.root}/log", _square, "use_cache")
    _run(shape_requests(stream_events(spark, folder)).writeStream.foreachBatch(sink), stage, "log")
    return sink.log(spark).select(F.col("id").cast("long").alias("event_id"), "input_hash", "cached", "outputs")
