"""Table schemas and closed value sets of workflow data (fixed values)."""

from pyspark.sql import types as T

STEP_TYPES = ("HTTP_DISPATCH", "PYTHON_WORKER", "LLM_AGENT", "DATA_TRANSFORM")
STATUSES = ("PENDING", "RUNNING", "COMPLETED", "FAILED", "CANCELLED", "WAITING_WEBHOOK")
TERMINAL = ("COMPLETED", "FAILED", "CANCELLED")
OPEN = ("PENDING", "RUNNING", "WAITING_WEBHOOK")
STEP_ID_PATTERN = "(?d)^[a-zA-Z0-9_]+$"
DEFAULT_VERSION = "1.0.0"
DEFAULT_TRIGGER = "manual"
DEFAULT_TIMEOUT_SECONDS = 300
DEFAULT_MAX_RETRIES = 0
DEFAULT_BACKOFF_FACTOR = 1.0
CANCELLED_TEXT = "Cancelled due to sibling task failure"


def _fields(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


_text, _time = T.StringType(), T.TimestampType()

RETRY_POLICY = _fields(max_retries=T.IntegerType(), backoff_factor=T.DoubleType())

STEP = _fields(
    id=_text,
    type=_text,
    depends_on=T.ArrayType(_text),
    action=_text,
    inputs=_text,  # JSON text, whose key order a merge depends on
    cache_executed_step=T.BooleanType(),
    retry_policy=RETRY_POLICY,
    timeout_seconds=T.IntegerType(),
)

DEFINITION = _fields(
    workflow_id=_text,
    version=_text,
    trigger=T.MapType(_text, _text),
    input_schema=_text,
    steps=T.ArrayType(STEP),
)

WORKFLOW_DEFINITIONS = _fields(
    workflow_id=_text, version=_text, definition_json=_text, created_at=_time, updated_at=_time
)

WORKFLOW_RUNS = _fields(
    id=_text,
    workflow_id=_text,
    status=_text,
    inputs=_text,
    outputs=_text,
    error_message=_text,
    created_at=_time,
    started_at=_time,
    completed_at=_time,
)

STEP_RUNS = _fields(
    id=_text,
    run_id=_text,
    step_id=_text,
    status=_text,
    input_hash=_text,
    raw_inputs=_text,
    resolved_inputs=_text,
    outputs=_text,
    error_trace=_text,
    duration_ms=T.DoubleType(),
    cached=T.BooleanType(),
    created_at=_time,
    started_at=_time,
    completed_at=_time,
)

CALLBACKS = _fields(callback_id=_text, run_id=_text, step_id=_text, ts=_time, payload=_text)

WAITS = _fields(
    wait_id=_text, run_id=_text, step_id=_text, started_at=_time, timeout_seconds=T.IntegerType()
)
