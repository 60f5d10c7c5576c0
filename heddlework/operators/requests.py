"""Bulk requests and responses as tables; sending them is the caller's business."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
METHOD_URL = r"(?i)^(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+(https?://\S+)$"
BODY_METHODS = ("POST", "PUT", "PATCH")
CONTROL_KEYS = ("method", "url", "headers", "params", "timeout")

_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def stripped(text: Column) -> Column:
    """Text without white space of any script at either end."""
    return F.regexp_replace(text, _EDGE_SPACE, "")


def parse_action(action: Column) -> Column:
    """``METHOD URL`` as a struct; any other text is a GET of that text."""
    text = stripped(action)
    method = F.regexp_extract(text, METHOD_URL, 1)
    url = F.regexp_extract(text, METHOD_URL, 2)
    return F.struct(
        F.when(method == "", "GET").otherwise(F.upper(method)).alias("method"),
        F.when(method == "", text).otherwise(url).alias("url"),
    )


def build_requests(df: DataFrame, action: str, inputs: str, timeout: str = "timeout_seconds") -> DataFrame:
    """One request per row from an action text and a JSON object of inputs.

    Inputs override method, URL and timeout. ``json`` beats ``data``, which beats
    the leftover keys; those are the body of POST, PUT and PATCH, and the query
    of a GET without params. JSON parts come back as JSON text.
    """
    held = F.coalesce(
        F.try_variant_get(F.try_parse_json(inputs), "$", "map<string,variant>"),
        F.create_map().cast("map<string,variant>"),
    )
    rows = df.select("*", parse_action(F.col(action)).alias("_a"), held.alias("_in"))

    def given(name: str) -> Column:
        return F.try_element_at("_in", F.lit(name))

    def text(name: str) -> Column:
        return given(name).cast("string")

    method = F.upper(F.coalesce(text("method"), "_a.method"))
    rows = rows.select(
        *df.columns,
        "_in",
        method.alias("method"),
        F.coalesce(text("url"), "_a.url").alias("url"),
        F.coalesce(F.to_json(given("headers")), F.lit("{}")).alias("headers"),
        F.coalesce(text("timeout").cast("double"), F.col(timeout).cast("double")).alias("timeout"),
    )
    control = F.array(*[F.lit(key) for key in CONTROL_KEYS])
    spare = F.map_filter("_in", lambda key, _: ~F.array_contains(control, key))
    spare_json = F.when(F.size(spare) > 0, F.to_json(F.to_variant_object(spare)))
    has_json, has_data = given("json").isNotNull(), given("data").isNotNull()
    params = given("params")
    no_params = params.isNull() | F.is_variant_null(params)
    body = F.when(has_json, F.to_json(given("json"))).when(
        ~has_data & F.col("method").isin(*BODY_METHODS), spare_json
    )
    query = F.when(~no_params, F.to_json(params)).when(
        ~has_json & ~has_data & (F.col("method") == "GET"), spare_json
    )
    return rows.select(
        *df.columns,
        "method",
        "url",
        "headers",
        query.alias("params"),
        body.alias("json_body"),
        F.when(~has_json & has_data, F.to_json(given("data"))).alias("data_body"),
        "timeout",
    )


def shape_response(status: Column, content_type: Column, text: Column, headers: Column) -> Column:
    """The JSON value of a response, else its status, text and headers; VARIANT.

    JSON is tried where the content type names it or the text begins like it.
    """
    tried = F.coalesce(content_type, F.lit("")).contains("application/json") | text.startswith("{") | text.startswith("[")
    plain = F.to_variant_object(
        F.struct(status.alias("status_code"), text.alias("text"), headers.alias("headers"))
    )
    return F.coalesce(F.when(tried, F.try_parse_json(text)), plain)


def response_error(url: Column, status: Column, text: Column) -> Column:
    """Error text of a response whose status is no success, else NULL."""
    failed = (status < 200) | (status > 299)
    message = F.concat(
        F.lit("HTTP request to '"), url, F.lit("' failed with status "), status.cast("string"), F.lit(": "), text
    )
    return F.when(failed, message)


def split_responses(df: DataFrame, url: str, status: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Successful responses, and failed ones with ``error``."""
    checked = df.withColumn("error", response_error(F.col(url), F.col(status), F.col(text)))
    return checked.filter(F.col("error").isNull()).drop("error"), checked.filter(F.col("error").isNotNull())
