"""Reuse of earlier results by content key, and resuming of unfinished runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddlework.functions.fingerprint import input_key
from heddlework.session import Staging
from heddlework.sources.logs import new_step_runs


def newest_completed(
    step_runs: DataFrame, key: str = "input_hash", columns: list[str] | None = None
) -> DataFrame:
    """Per key the COMPLETED row that ended last; equal times go to the larger id.

    ``max_by`` keeps one row per key on the map side, so a key that holds a large
    part of the log sends one row per task through the shuffle. Only ``columns``
    (all by default) are read beside the key and the ranking.
    """
    done = step_runs.filter((F.col("status") == "COMPLETED") & F.col(key).isNotNull())
    kept = [name for name in columns or done.columns if name != key]
    rank = F.struct("completed_at", "id")
    return done.groupBy(key).agg(F.max_by(F.struct(*kept), rank).alias("_s")).select(key, "_s.*")


@dataclass(frozen=True)
class CachedStep:
    """``results``: the requests with ``outputs`` and ``cached``.
    ``computed``: what the caller's function has worked out, one row per key.
    ``rejects``: requests without a key, with a ``reason``; neither computed nor logged."""

    results: DataFrame
    computed: DataFrame
    rejects: DataFrame

    def log_rows(self) -> DataFrame:
        """Step-run rows to append: all COMPLETED, with the ``cached`` flag."""
        return new_step_runs(self.results.withColumn("status", F.lit("COMPLETED")))


def with_input_key(requests: DataFrame, action: str = "action", inputs: str = "resolved_inputs") -> DataFrame:
    return requests.withColumn("input_hash", input_key(F.col(action), F.try_parse_json(inputs)))


def cached_step(
    requests: DataFrame,
    step_runs: DataFrame,
    compute: Callable[[DataFrame], DataFrame],
    use_cache: str | None = None,
) -> CachedStep:
    """Answer requests from the log where possible and compute the rest.

    ``requests`` holds ``action`` and ``resolved_inputs`` (JSON text) beside its
    own columns. ``compute`` gets one row per distinct key still to be worked out
    (``input_hash``, ``action``, ``resolved_inputs``) and returns ``input_hash``
    and ``outputs``. ``use_cache`` names a boolean column; rows where it is not
    true never read the log, though their results are logged.

    Requests meet the log only after both are down to one row per key, so equal
    requests cannot blow the join up. The join back has one row per key on its
    right side; its left side may be skewed, which AQE splits. What is to be
    computed and its results are written to the shared folder, so the log is read
    once and ``compute`` runs once, however often the results are used.

    Inputs that are missing, no JSON or repeat a key have no key. These requests
    leave before the grouping, so that they never count as equal to each other.
    """
    stage = Staging(requests.sparkSession, "cached-step")
    every = with_input_key(requests)
    reason = F.when(F.col("resolved_inputs").isNull(), "missing_inputs").otherwise("unreadable_inputs")
    rejects = every.filter(F.col("input_hash").isNull()).drop("input_hash").withColumn("reason", reason)
    keyed = every.filter(F.col("input_hash").isNotNull())
    flag = F.coalesce(F.col(use_cache), F.lit(False)) if use_cache else F.lit(True)
    asked = keyed.groupBy("input_hash").agg(
        F.min("action").alias("action"),
        F.min("resolved_inputs").alias("resolved_inputs"),
        F.bool_or(~flag).alias("_must"),
    )
    kept = newest_completed(step_runs, columns=["outputs"]).select("input_hash", F.struct("outputs").alias("_old"))
    looked_up = stage.put(asked.join(kept, "input_hash", "left"), "keys")
    missing = looked_up.filter(F.col("_old").isNull() | F.col("_must"))
    computed = stage.put(compute(missing.select("input_hash", "action", "resolved_inputs")), "computed")
    fresh = computed.select("input_hash", F.col("outputs").alias("_new"))
    answers = looked_up.join(fresh, "input_hash", "left").select("input_hash", "_old", "_new")
    hit = flag & F.col("_old").isNotNull()
    results = (
        keyed.join(answers, "input_hash", "left")
        .withColumn("outputs", F.when(hit, F.col("_old.outputs")).otherwise(F.col("_new")))
        .withColumn("cached", hit)
        .drop("_old", "_new")
    )
    return CachedStep(results, computed, rejects)


def completed_outputs(step_runs: DataFrame) -> DataFrame:
    """Outputs a resumed run keeps: per run and step those of the last COMPLETED row."""
    done = step_runs.filter(F.col("status") == "COMPLETED")
    last = F.max_by(F.struct("outputs"), F.struct("created_at", "id"))
    return done.groupBy("run_id", "step_id").agg(last.alias("_o")).select("run_id", "step_id", "_o.outputs")


def steps_to_rerun(runs: DataFrame, steps: DataFrame, step_runs: DataFrame) -> DataFrame:
    """Steps of the given runs without a COMPLETED row.

    ``runs``: run_id, workflow_id. ``steps``: workflow_id, step_id.
    """
    done = step_runs.filter(F.col("status") == "COMPLETED").select("run_id", "step_id")
    return runs.join(steps, "workflow_id").join(done, ["run_id", "step_id"], "left_anti")
