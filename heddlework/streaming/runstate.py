"""Current run state as a running table over status events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from heddlework import schemas as S
from heddlework.operators.runlog import fold_runs, fold_step_runs
from heddlework.streaming.common import pickled_by_value

_ROWS = "run_id string, status string, started_us long, completed_us long, outputs string, error_message string"
_KEPT = ("outputs", "error_message")
_NO_TIME = -(2**62)


def live_runs(events: DataFrame) -> DataFrame:
    """``fold_runs`` over a stream; write it in update mode.

    Every aggregate of the fold is combined before the shuffle and kept as one
    row of state per run. The state never ends; see ``live_runs_ending``.
    """
    return fold_runs(events)


def live_step_runs(events: DataFrame) -> DataFrame:
    return fold_step_runs(events)


class RunProcessor(StatefulProcessor):
    """State of one run: its fold, and one timer once it has ended."""

    def __init__(self, keep_us: int):
        self._keep_us = keep_us

    def init(self, handle) -> None:
        self._handle = handle
        ranked = ", ".join(f"{c} string, {c}_at long, {c}_id string" for c in ("status", *_KEPT))
        self._run = handle.getValueState("run", f"{ranked}, started long, completed long, timer boolean")

    def handleInputRows(self, key, rows, timerValues):
        held = self._run.get()
        best = {c: held[3 * i : 3 * i + 3] for i, c in enumerate(("status", *_KEPT))} if held else {}
        started, completed, timer = held[9:] if held else (None, None, False)
        for batch in rows:
            for row in batch.itertuples(index=False):
                rank = (row.at_us, row.event_id)
                for column in ("status", *_KEPT):
                    value = getattr(row, column)
                    known = column in best and best[column][1] is not None
                    if (value is not None or column == "status") and (not known or rank > tuple(best[column][1:])):
                        best[column] = (value, *rank)
                if row.at_us == _NO_TIME:
                    continue
                if row.status == "RUNNING":
                    started = row.at_us if started is None else min(started, row.at_us)
                elif row.status in S.TERMINAL:
                    completed = row.at_us if completed is None else max(completed, row.at_us)
        status = best["status"][0]
        if status in S.TERMINAL and not timer:
            timer = self._set_timer(best["status"][1])
        cells = [x for c in ("status", *_KEPT) for x in best.get(c, (None, None, None))]
        self._run.update((*cells, started, completed, timer))
        texts = [best.get(c, (None,))[0] for c in _KEPT]
        names = [field.split()[0] for field in _ROWS.split(", ")]
        row = pd.DataFrame([(*key, status, started, completed, *texts)], columns=names)
        yield row.astype({"started_us": "Int64", "completed_us": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self._run.get()
        if held and held[0] in S.TERMINAL and held[1] + self._keep_us <= timerValues.getCurrentWatermarkInMs() * 1000:
            self._run.clear()
        elif held:
            # A run that goes on, or ended again later, waits for its own end.
            again = held[0] in S.TERMINAL and self._set_timer(held[1])
            self._run.update((*held[:11], again))
        return iter([])

    def close(self) -> None:
        pass

    def _set_timer(self, last_us: int) -> bool:
        self._handle.registerTimer(max(-(-(last_us + self._keep_us) // 1000), 0))
        return True


def live_runs_ending(events: DataFrame, delay: str = "10 minutes", keep_seconds: int = 86_400) -> DataFrame:
    """``live_runs`` with state that ends; write it in update mode.

    A run's state is dropped ``keep_seconds`` after its last event once that was a
    terminal one and the watermark has passed. Until then later events, late ones too, go
    into the same fold. A run that is taken up again after that begins anew: its rows
    are folded from the events since. Open runs stay, so the state holds open and lately
    ended runs only. Needs the RocksDB state store (``streaming.waits.STATE_STORE``).
    """
    rows = events.withWatermark("ts", delay).select(
        "run_id", F.coalesce("event_id", F.lit("")).alias("event_id"),
        F.coalesce(F.unix_micros("ts"), F.lit(_NO_TIME)).alias("at_us"), "status", *_KEPT,
    )
    with pickled_by_value(__name__):
        folded = rows.groupBy("run_id").transformWithStateInPandas(
            RunProcessor(keep_seconds * 1_000_000), outputStructType=_ROWS, outputMode="update", timeMode="eventTime"
        )
    times = [F.timestamp_micros(f"{name}_us").alias(f"{name}_at") for name in ("started", "completed")]
    return folded.select("run_id", "status", *times, *_KEPT)
