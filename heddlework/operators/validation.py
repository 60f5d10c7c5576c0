"""Defaults and row rules for workflow definitions and their steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddlework import schemas as S


def fill_definition_defaults(definitions: DataFrame) -> DataFrame:
    return definitions.withColumns(
        {
            "version": F.coalesce("version", F.lit(S.DEFAULT_VERSION)),
            "trigger": F.coalesce("trigger", F.create_map(F.lit("type"), F.lit(S.DEFAULT_TRIGGER))),
            "input_schema": F.coalesce("input_schema", F.lit("{}")),
        }
    )


def fill_step_defaults(steps: DataFrame) -> DataFrame:
    """Defaults of one-row-per-step tables; an absent retry policy means no retry."""
    retries = F.coalesce(F.col("retry_policy.max_retries"), F.lit(S.DEFAULT_MAX_RETRIES))
    backoff = F.coalesce(F.col("retry_policy.backoff_factor"), F.lit(S.DEFAULT_BACKOFF_FACTOR))
    return steps.withColumns(
        {
            "depends_on": F.coalesce("depends_on", F.array().cast("array<string>")),
            "inputs": F.coalesce("inputs", F.lit("{}")),
            "cache_executed_step": F.coalesce("cache_executed_step", F.lit(False)),
            "timeout_seconds": F.coalesce("timeout_seconds", F.lit(S.DEFAULT_TIMEOUT_SECONDS)),
            "retry_policy": F.struct(retries.alias("max_retries"), backoff.alias("backoff_factor")),
        }
    )


def _codes(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(broken, F.lit(code)) for code, broken in rules.items()]))


def step_errors() -> Column:
    """Codes of the rules a step row breaks; empty for a good row."""
    return _codes(
        {
            "id_missing": F.col("id").isNull(),
            "id_format": ~F.col("id").rlike(S.STEP_ID_PATTERN),
            "type_missing": F.col("type").isNull(),
            "type_unknown": ~F.col("type").isin(*S.STEP_TYPES),
            "action_missing": F.col("action").isNull(),
            "retries_negative": F.col("retry_policy.max_retries") < 0,
            "backoff_negative": F.col("retry_policy.backoff_factor") < 0,
            "timeout_not_positive": F.col("timeout_seconds") <= 0,
        }
    )


def definition_errors() -> Column:
    return _codes(
        {
            "malformed": F.col("malformed"),
            "workflow_id_missing": F.col("workflow_id").isNull(),
            "steps_missing": F.col("steps").isNull(),
        }
    )


def split_valid(rows: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected rows with their ``errors``."""
    checked = rows.withColumn("errors", errors)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)
