"""Run logs: folding events to current state, nested reports and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddlework import schemas as S
from heddlework.functions.ordering import PAGE_ROWS, paged, scan_within

STEP_REPORT_FIELDS = (
    "id",
    "step_id",
    "status",
    "input_hash",
    "raw_inputs",
    "resolved_inputs",
    "outputs",
    "error_trace",
    "duration_ms",
    "cached",
    "started_at",
    "completed_at",
)
_TIMES = ("created_at", "started_at", "completed_at")


# --- folding -------------------------------------------------------------------


def _state(rank: Column, kept: list[str]) -> list[Column]:
    """Aggregates of the fold; every one combines on the map side."""
    terminal = F.col("status").isin(*S.TERMINAL)
    folded = [
        F.max_by("status", rank).alias("status"),
        F.min(F.when(F.col("status") == "RUNNING", F.col("ts"))).alias("started_at"),
        F.max(F.when(terminal, F.col("ts"))).alias("completed_at"),
    ]
    return folded + [F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in kept]


def fold_runs(events: DataFrame) -> DataFrame:
    """Current state of each run from status events.

    ``events``: event_id, run_id, ts, status, outputs, error_message. The last
    status stands, the first RUNNING starts the run, the last terminal status
    ends it, and a null never overwrites outputs or error.
    """
    rank = F.struct("ts", "event_id")
    return events.groupBy("run_id").agg(*_state(rank, ["outputs", "error_message"]))


def fold_step_runs(events: DataFrame) -> DataFrame:
    """The same per step run; ``cached`` in an event is never stored."""
    rank = F.struct("ts", "event_id")
    return events.groupBy("step_run_id").agg(*_state(rank, ["outputs", "error_trace", "duration_ms"]))


def duration_ms(start: str = "started_at", end: str = "completed_at") -> Column:
    """Milliseconds between two timestamp columns, to the microsecond."""
    return (F.unix_micros(F.col(end)) - F.unix_micros(F.col(start))) / F.lit(1000.0)


# --- reports --------------------------------------------------------------------


def iso_text(column: str) -> Column:
    """ISO text of a UTC timestamp; the fraction is left out when it is zero."""
    stamp = F.col(column)
    whole = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(stamp, ".SSSSSS")
    return F.concat(whole, F.when(fraction != ".000000", fraction).otherwise(""), F.lit("+00:00"))


def run_report(runs: DataFrame, step_runs: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Runs with their step runs nested in creation order.

    A run of up to ``page_rows`` steps is one row (page 0). A longer one takes
    further rows with the same run columns, so no row or task has to hold a whole
    run. A run without steps has one row with an empty array.
    """
    numbered = paged(step_runs, ["run_id"], ["created_at", "id"], page_rows)
    shown = [iso_text(f).alias(f) if f in _TIMES else F.col(f) for f in STEP_REPORT_FIELDS]
    nested = (
        numbered.groupBy("run_id", "page")
        .agg(F.sort_array(F.collect_list(F.struct("position", F.struct(*shown).alias("step")))).alias("_l"))
        .select(F.col("run_id").alias("id"), "page", F.col("_l.step").alias("step_runs"))
    )
    empty = F.array().cast(nested.schema["step_runs"].dataType)
    heads = runs.select(*[iso_text(c).alias(c) if c in _TIMES else F.col(c) for c in runs.columns])
    return heads.join(nested, "id", "left").withColumns(
        {"page": F.coalesce("page", F.lit(0)), "step_runs": F.coalesce("step_runs", empty)}
    )


def run_outputs(step_runs: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Per run a map from step id to its last COMPLETED output, page by page."""
    done = step_runs.filter(F.col("status") == "COMPLETED")
    last = done.groupBy("run_id", "step_id").agg(
        F.max_by(F.struct("outputs"), F.struct("created_at", "id")).alias("_o")
    )
    numbered = paged(last, ["run_id"], ["step_id"], page_rows)
    entry = F.struct("step_id", F.col("_o.outputs"))
    return numbered.groupBy("run_id", "page").agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("outputs")
    )


def display_status(runs: DataFrame, steps: DataFrame, step_runs: DataFrame) -> DataFrame:
    """What a viewer shows for each declared step of each run.

    ``runs``: run_id, workflow_id. ``steps``: workflow_id, step_id.
    """
    last = step_runs.groupBy("run_id", "step_id").agg(
        F.max_by(F.struct("status", "cached", "duration_ms"), F.struct("created_at", "id")).alias("_s")
    )
    shown = runs.join(steps, "workflow_id").join(last, ["run_id", "step_id"], "left")
    label = F.when(F.col("_s").isNull(), "PENDING").when(F.col("_s.cached"), "CACHED").otherwise(F.col("_s.status"))
    spent = F.col("_s.duration_ms")
    took = F.when(spent.isNull(), "-").otherwise(F.format_string("%.1f ms", spent))
    return shown.select("run_id", "workflow_id", "step_id", label.alias("display"), took.alias("duration"))


def run_outcome(runs: DataFrame, steps: DataFrame, step_runs: DataFrame) -> DataFrame:
    """COMPLETED when every declared step is; FAILED with the step that failed first.

    Steps are compared by id, so a completed step that is not declared counts for nothing.

    ``runs``: run_id, workflow_id, error_message. ``step_runs``: the newest row
    per run and step. A run whose error names no step row (its inputs could not be
    filled) is FAILED with that error.
    """
    declared = runs.select("run_id", "workflow_id").join(steps.select("workflow_id", "step_id"), "workflow_id")
    done_steps = step_runs.where(F.col("status") == "COMPLETED").select("run_id", "step_id")
    missing = declared.join(done_steps, ["run_id", "step_id"], "left_anti")
    missing = missing.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_missing"))
    failed = F.col("status") == "FAILED"
    first = F.min(F.when(failed, F.struct("completed_at", "step_id", "error_trace")))
    seen = step_runs.groupBy("run_id").agg(first.alias("_f"))
    joined = runs.join(missing, "run_id", "left").join(seen, "run_id", "left")
    broken = F.col("_f").isNotNull() | F.col("error_message").isNotNull()
    done = F.col("n_missing").isNull()
    error = F.when(
        F.col("_f").isNotNull(),
        F.concat(
            F.lit("Workflow failed at step '"), F.col("_f.step_id"), F.lit("': "), F.coalesce("_f.error_trace", F.lit(""))
        ),
    ).otherwise(F.col("error_message"))
    outcome = F.when(F.col("_f").isNotNull(), "FAILED").when(done, "COMPLETED").when(broken, "FAILED").otherwise("RUNNING")
    return joined.select(
        "run_id",
        "workflow_id",
        outcome.alias("outcome"),
        F.col("_f.step_id").alias("failed_step"),
        F.when(outcome == "FAILED", error).alias("error"),
    )


def cancel_siblings(step_runs: DataFrame) -> DataFrame:
    """Open steps of a run with a failed step become CANCELLED at that moment."""
    failed = step_runs.filter(F.col("status") == "FAILED")
    broken = failed.groupBy("run_id").agg(F.min("completed_at").alias("_at"), F.lit(True).alias("_broken"))
    joined = step_runs.join(broken, "run_id", "left")
    cut = F.coalesce("_broken", F.lit(False)) & F.col("status").isin(*S.OPEN)
    return joined.withColumns(
        {
            "status": F.when(cut, "CANCELLED").otherwise(F.col("status")),
            "error_trace": F.when(cut, S.CANCELLED_TEXT).otherwise(F.col("error_trace")),
            "completed_at": F.when(cut, F.col("_at")).otherwise(F.col("completed_at")),
        }
    ).drop("_at", "_broken")


# --- audits ---------------------------------------------------------------------


def overlap_counts(step_runs: DataFrame) -> DataFrame:
    """For each finished step the number of other steps of its run it overlapped.

    Two steps overlap when each starts before the other ends. Counting needs no
    pairs: the steps that started before my end, less those that ended by my
    start, less myself. Both are running sums over the run's starts and ends in
    time order.
    """
    spans = step_runs.filter(F.col("started_at").isNotNull() & F.col("completed_at").isNotNull())
    point = F.col("started_at") == F.col("completed_at")
    # At one moment: ends first, then zero-length steps, then starts.
    marks = F.when(point, F.array(_mark("started_at", 1))).otherwise(
        F.array(_mark("completed_at", 0), _mark("started_at", 2))
    )
    events = spans.select("run_id", "id", F.explode(marks).alias("_m")).select("run_id", "id", "_m.at", "_m.kind")
    kind = F.col("kind")
    running = scan_within(
        events,
        ["run_id"],
        ["at", "kind", "id"],
        totals={
            "ended": (kind == 0).cast("long"),
            "points": (kind == 1).cast("long"),
            "begun": (kind == 2).cast("long"),
        },
        keep=[],
    )
    share = (
        F.when(kind == 0, F.col("begun") + F.col("points") - 1)
        .when(kind == 1, F.col("begun") - F.col("ended"))
        .otherwise(-(F.col("ended") + F.col("points")))
    )
    return running.groupBy("run_id", "id").agg(F.sum(share).alias("n_overlaps"))


def _mark(column: str, kind: int) -> Column:
    return F.struct(F.col(column).alias("at"), F.lit(kind).alias("kind"))


def overlaps(pairs: DataFrame, step_runs: DataFrame) -> DataFrame:
    """Whether two named steps of a run overlapped; ``pairs``: run_id, step_a, step_b."""

    def side(name: str) -> DataFrame:
        return step_runs.select(
            "run_id",
            F.col("step_id").alias(f"step_{name}"),
            F.col("started_at").alias(f"{name}_from"),
            F.col("completed_at").alias(f"{name}_to"),
        )

    both = pairs.join(side("a"), ["run_id", "step_a"]).join(side("b"), ["run_id", "step_b"])
    test = (F.col("a_from") < F.col("b_to")) & (F.col("b_from") < F.col("a_to"))
    return both.select("run_id", "step_a", "step_b", test.alias("overlap"))


def barrier_violations(runs: DataFrame, edges: DataFrame, step_runs: DataFrame) -> DataFrame:
    """Steps that started before one of their dependencies had ended.

    ``runs``: run_id, workflow_id. ``edges``: workflow_id, src, dst.
    """
    began = step_runs.select("run_id", F.col("step_id").alias("dst"), "started_at")
    ended = step_runs.select("run_id", F.col("step_id").alias("src"), F.col("completed_at").alias("dep_completed_at"))
    due = began.join(runs.select("run_id", "workflow_id"), "run_id").join(edges, ["workflow_id", "dst"])
    early = due.join(ended, ["run_id", "src"]).filter(F.col("started_at") < F.col("dep_completed_at"))
    return early.select("run_id", F.col("dst").alias("step_id"), F.col("src").alias("dependency"))
