"""Matching waiting steps with callbacks on tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddlework.functions.ordering import scan_within
from heddlework.schemas import DEFAULT_TIMEOUT_SECONDS

KEY = ["run_id", "step_id"]


@dataclass(frozen=True)
class Matches:
    """``waits``: outcome of every wait. ``rejected``: callbacks nobody waited for."""

    waits: DataFrame
    rejected: DataFrame


def waits_from_steps(step_runs: DataFrame) -> DataFrame:
    """Step runs whose inputs say ``wait_for_webhook`` is the boolean true."""
    flag = F.try_variant_get(F.try_parse_json("resolved_inputs"), "$.wait_for_webhook", "variant")
    waiting = step_runs.filter((F.schema_of_variant(flag) == "BOOLEAN") & (F.to_json(flag) == "true"))
    return waiting.select(F.col("id").alias("wait_id"), *KEY, "started_at", "timeout_seconds")


def match_waits(waits: DataFrame, callbacks: DataFrame, as_of=None) -> Matches:
    """First callback inside a wait's time completes it; every other is rejected.

    ``waits``: wait_id, run_id, step_id, started_at, timeout_seconds.
    ``callbacks``: callback_id, run_id, step_id, ts, payload. A callback belongs
    to the newest wait of its key that began by then. A wait without callback is
    FAILED, or still WAITING if its time is not over at ``as_of``, up to which all
    callbacks are known. Waits whose optional column ``done`` is true were
    completed earlier: they take no callback but still hide older waits.

    Waits and callbacks are put in one time-ordered scan per key that carries the
    newest wait along, so no key's waits are multiplied with its callbacks.
    """
    seconds = F.coalesce("timeout_seconds", F.lit(DEFAULT_TIMEOUT_SECONDS))
    deadline = F.col("started_at") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    done = F.col("done") if "done" in waits.columns else F.lit(False)
    timed = waits.withColumn("deadline", deadline)
    # At one moment a wait counts before a callback.
    marks = timed.select(
        *KEY,
        F.col("started_at").alias("at"),
        F.lit(0).alias("kind"),
        F.col("wait_id").alias("row_id"),
        F.struct("wait_id", "deadline", done.alias("done")).alias("opened"),
    ).unionByName(
        callbacks.select(*KEY, F.col("ts").alias("at"), F.lit(1).alias("kind"), F.col("callback_id").alias("row_id")),
        allowMissingColumns=True,
    )
    scanned = scan_within(marks, KEY, ["at", "kind", "row_id"], lasts={"newest": F.col("opened")}, keep=[])
    taken = (F.col("at") <= F.col("newest.deadline")) & ~F.col("newest.done")
    in_time = scanned.filter((F.col("kind") == 1) & taken)
    winners = in_time.groupBy(F.col("newest.wait_id").alias("wait_id")).agg(
        F.min(F.struct("at", F.col("row_id").alias("callback_id"))).alias("_w")
    )
    winners = winners.select("wait_id", "_w.callback_id", F.col("_w.at").alias("callback_ts"))
    answered = winners.join(callbacks.select("callback_id", F.struct("payload").alias("_p")), "callback_id")
    over = F.lit(True) if as_of is None else F.col("deadline") <= as_of
    outcome = F.when(F.col("callback_id").isNotNull() | done, "COMPLETED").when(over, "FAILED").otherwise("WAITING_WEBHOOK")
    result = timed.join(answered, "wait_id", "left").select(
        "wait_id", *KEY, "started_at", "deadline", outcome.alias("outcome"), "callback_id", "callback_ts",
        F.col("_p.payload").alias("outputs"),
    )
    return Matches(result, callbacks.join(winners, "callback_id", "left_anti"))
