"""Queries on paths, templates, transforms and content keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddlework.functions.binding import with_once
from heddlework.functions.fingerprint import input_key, row_key
from heddlework.functions.paths import extract, path_error, segments_col
from heddlework.functions.templates import render_documents as fill_documents
from heddlework.functions.templates import (
    Scope,
    explode_references,
    render,
    render_column,
    render_document,
    split_resolved,
    template_errors,
)
from heddlework.operators import transforms as P
from heddlework.operators.cache import newest_completed
from heddlework.plans.catalog import joined, micros, query, table

# Events as nested documents, so that paths have somewhere to go.
_DOC_SQL = "CAST(props->>'$.k' AS INTEGER)"


def nested_events(spark, folder):
    e = table(spark, folder, "events", spread=True)
    text = F.concat(
        F.lit('{"user":{"id":'), F.col("user_id").cast("string"),
        F.lit('},"items":['), F.col("props"), F.lit(',{"type":"'), F.col("event_type"),
        F.lit('"}],"0":{"z":'), F.col("event_id").cast("string"), F.lit('},"note":null,"flag":true}'),
    )
    return e.withColumn("doc", text).withColumn("v", F.try_parse_json("doc"))


@query(
    "typed_event_flow",
    """
    WITH e AS (
      SELECT event_id, ts, user_id, event_type, CAST(props->>'$.k' AS INTEGER) AS k,
             sha256('{"action":"' || event_type || '","inputs":{"k":' || (props->>'$.k') || '}}') AS input_hash
      FROM events WHERE event_type IS NOT DISTINCT FROM 'purchase')
    SELECT input_hash, event_id, user_id, k, epoch_us(ts) AS ts_us,
           'user ' || user_id || ' bought at k=' || k AS label
    FROM e QUALIFY row_number() OVER (PARTITION BY input_hash ORDER BY ts DESC, event_id DESC) = 1
    """,
)
def typed_event_flow(spark, folder):
    bought = P.filter_rows(table(spark, folder, "events"), "event_type", "purchase")
    v = F.try_parse_json("props")
    scope = Scope(inputs=v, outputs={"user": F.to_variant_object(F.struct("user_id"))})
    keyed = bought.select(
        F.col("event_id").alias("id"), "user_id", F.lit("COMPLETED").alias("status"), F.col("ts").alias("completed_at"),
        extract(v, "k", "int").alias("k"),
        input_key(F.col("event_type"), v).alias("input_hash"),
        render("user ${user.output.user_id} bought at k=${workflow.input.k}", scope).alias("label"),
    )
    newest = newest_completed(keyed, columns=["id", "user_id", "completed_at", "k", "label"])
    return newest.select("input_hash", F.col("id").alias("event_id"), "user_id", "k", micros("completed_at").alias("ts_us"), "label")


@query(
    "path_extract",
    f"""
    SELECT event_id, CAST(user_id AS INTEGER) AS user_id_at_path, {_DOC_SQL} AS k_bracket, {_DOC_SQL} AS k_dot,
           event_type AS type_text, event_id AS zero_key, TRUE AS note_is_null, TRUE AS missing_is_absent,
           TRUE AS flag, '{{"k":' || (props->>'$.k') || '}}' AS item_json
    FROM events
    """,
)
def path_extract(spark, folder):
    v = F.col("v")
    return nested_events(spark, folder).select(
        "event_id",
        extract(v, "user.id", "int").alias("user_id_at_path"),
        extract(v, "items[0].k", "int").alias("k_bracket"),
        extract(v, "items.0.k", "int").alias("k_dot"),
        extract(v, "items[1]['type']", "string").alias("type_text"),
        extract(v, "0.z", "long").alias("zero_key"),
        F.is_variant_null(extract(v, "note")).alias("note_is_null"),
        extract(v, "missing.x").isNull().alias("missing_is_absent"),
        extract(v, "flag", "boolean").alias("flag"),
        F.to_json(extract(v, "items[0]")).alias("item_json"),
    )


@query(
    "path_column",
    """
    SELECT event_id,
           CASE event_type WHEN 'click' THEN 'user,id' WHEN 'view' THEN 'items,0,k' WHEN 'purchase' THEN 'items,1,type'
                WHEN 'signup' THEN '0,z' ELSE 'items,7,k' END AS path_segments,
           CASE event_type WHEN 'click' THEN CAST(user_id AS VARCHAR) WHEN 'view' THEN props->>'$.k'
                WHEN 'purchase' THEN event_type WHEN 'signup' THEN CAST(event_id AS VARCHAR) END AS found
    FROM events
    """,
)
def path_column(spark, folder):
    kind = F.col("event_type")
    path = (
        F.when(kind == "click", "user.id").when(kind == "view", "items[0].k")
        .when(kind == "purchase", "items.1['type']").when(kind == "signup", "0.z").otherwise("items[7].k")
    )
    return nested_events(spark, folder).select(
        "event_id", joined(segments_col(path)).alias("path_segments"), extract(F.col("v"), path, "string").alias("found")
    )


@query(
    "resolve_errors",
    """
    SELECT event_id, CAST(NULL AS VARCHAR) AS good, 'key_missing' AS no_key, 'index_out_of_range' AS far_index,
           'index_not_numeric' AS named_index, 'null_in_path' AS past_null, 'unsupported_type' AS into_number,
           'key_missing,workflow_output,step_unknown,step_not_complete' AS codes
    FROM events
    """,
)
def resolve_errors(spark, folder):
    v = F.col("v")
    scope = Scope(inputs=v, known=frozenset({"later"}))
    text = "${workflow.input.user.age} ${workflow.output.x} ${nobody.output} ${later.output.y} ${workflow.input.user.id}"
    return nested_events(spark, folder).select(
        "event_id",
        path_error(v, "items[1].type").alias("good"),
        path_error(v, "user.age").alias("no_key"),
        path_error(v, "items[5].k").alias("far_index"),
        path_error(v, "items.first").alias("named_index"),
        path_error(v, "note.text").alias("past_null"),
        path_error(v, "user.id.x").alias("into_number"),
        joined(template_errors(text, scope)).alias("codes"),
    )


@query(
    "resolve_split",
    """
    SELECT event_id, event_type <> 'error' AS resolved,
           CASE WHEN event_type <> 'error' THEN 'k is ' || (props->>'$.k') END AS label,
           CASE WHEN event_type <> 'error' THEN '' ELSE 'step_not_complete' END AS codes
    FROM events
    """,
)
def resolve_split(spark, folder):
    e = table(spark, folder, "events").withColumn(
        "out", F.when(F.col("event_type") != "error", F.try_parse_json("props"))
    )
    scope = Scope(inputs=F.parse_json(F.lit("{}")), outputs={"load": F.col("out")}, known=frozenset({"load"}))
    good, bad = split_resolved(e, "k is ${load.output.k}", scope, "filled")
    left = good.select("event_id", F.lit(True).alias("resolved"), F.col("filled").cast("string").alias("label"), F.lit("").alias("codes"))
    right = bad.select("event_id", F.lit(False).alias("resolved"), F.lit(None).cast("string").alias("label"), joined("error_codes").alias("codes"))
    return left.unionByName(right)


def _customers(spark, folder):
    c, n = table(spark, folder, "customer", spread=True), table(spark, folder, "nation")
    both = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    about = F.struct(
        F.col("c_name").alias("name"), F.col("c_custkey").alias("key"),
        (F.col("c_acctbal") > 0).alias("active"), F.array("c_mktsegment", F.lit("all")).alias("groups"),
    )
    where = F.struct("n_name", F.col("n_regionkey").alias("region"))
    return both.withColumn("about", F.to_variant_object(about)).withColumn("place", F.to_variant_object(where))


@query(
    "render_template",
    """
    SELECT c_custkey, 'Customer ' || c_name || ' of ' || n_name || ': active=' ||
           CASE WHEN c_acctbal > 0 THEN 'True' ELSE 'False' END || ', group=' || c_mktsegment || ' ${place.output[0]}' AS label,
           c_custkey AS key_typed
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    """,
)
def render_template(spark, folder):
    scope = Scope(inputs=F.col("about"), outputs={"place": F.col("place")})
    text = (
        "Customer ${workflow.input.name} of ${place.output.n_name}: active=${workflow.input.active}, "
        "group=${workflow.input.groups[0]} ${place.output[0]}"
    )
    return _customers(spark, folder).select(
        "c_custkey",
        render(text, scope).alias("label"),
        F.try_variant_get(render(" ${workflow.input.key} ", scope), "$", "long").alias("key_typed"),
    )


@query(
    "render_document",
    """
    SELECT c_custkey,
           '{"header":"For ' || c_name || '","nested":{"ids":[' || c_custkey || ',"fixed"],"place":{"n_name":"' || n_name ||
           '","region":' || n_regionkey || '}},"static":7}' AS document
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    """,
)
def render_document_query(spark, folder):
    scope = Scope(inputs=F.col("about"), outputs={"place": F.col("place")})
    document = {
        "static": 7,
        "header": "For ${workflow.input.name}",
        "nested": {"ids": ["${workflow.input.key}", "fixed"], "place": "${place.output}"},
    }
    return _customers(spark, folder).select("c_custkey", F.to_json(render_document(document, scope)).alias("document"))


@query(
    "render_template_column",
    """
    SELECT c_custkey,
           CASE c_mktsegment
             WHEN 'BUILDING' THEN 'plain text'
             WHEN 'MACHINERY' THEN 'R' || n_regionkey || ' and ' || c_name
             WHEN 'HOUSEHOLD' THEN CASE WHEN c_acctbal > 0 THEN 'True' ELSE 'False' END || c_custkey || '!'
             WHEN 'FURNITURE' THEN NULL
             ELSE n_name END AS label
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    """,
)
def render_template_column(spark, folder):
    segment = F.col("c_mktsegment")
    text = (
        F.when(segment == "BUILDING", "plain text")
        .when(segment == "MACHINERY", "R${place.output.region} and ${workflow.input.name}")
        .when(segment == "HOUSEHOLD", "${workflow.input.active}${workflow.input.key}!")
        .when(segment == "FURNITURE", "lost ${nobody.output.x}")
        .otherwise("${place.output.n_name}")
    )
    outputs = F.create_map(F.lit("place"), F.col("place"))
    return _customers(spark, folder).select("c_custkey", render_column(text, F.col("about"), outputs).alias("label"))


@query(
    "extract_references",
    r"""
    WITH t AS (
      SELECT p_partkey, 'use ${part_' || p_size || '.output.items[0]} and ${workflow.input.' || lower(p_type) ||
             '} or ${workflow.input} not ${x.y.z} ${a.output[''k'']}' AS text FROM part),
    r AS (
      SELECT p_partkey, regexp_extract_all(text, '\$\{([a-zA-Z0-9_]+)\.(input|output)(?:\.([a-zA-Z0-9_\[\].\-]+))?\}', 1) AS s,
             regexp_extract_all(text, '\$\{([a-zA-Z0-9_]+)\.(input|output)(?:\.([a-zA-Z0-9_\[\].\-]+))?\}', 2) AS k,
             regexp_extract_all(text, '\$\{([a-zA-Z0-9_]+)\.(input|output)(?:\.([a-zA-Z0-9_\[\].\-]+))?\}', 3) AS p FROM t),
    u AS (SELECT p_partkey, unnest(range(len(s))) AS i, s, k, p FROM r)
    SELECT p_partkey, CAST(i AS INTEGER) AS ref_pos, s[i + 1] AS source, k[i + 1] AS kind, nullif(p[i + 1], '') AS path FROM u
    """,
)
def extract_references(spark, folder):
    p = table(spark, folder, "part", spread=True)
    text = F.concat(
        F.lit("use ${part_"), F.col("p_size").cast("string"), F.lit(".output.items[0]} and ${workflow.input."),
        F.lower("p_type"), F.lit("} or ${workflow.input} not ${x.y.z} ${a.output['k']}"),
    )
    return explode_references(p.select("p_partkey", text.alias("text")), "text").drop("text")


# --- select, filter, merge -------------------------------------------------------


@query("select_fields", "SELECT o_orderpriority, o_orderkey FROM orders")
def select_fields(spark, folder):
    return P.select_fields(table(spark, folder, "orders"), ["o_orderpriority", "absent", "o_orderkey", "o_orderpriority"])


@query(
    "select_keys",
    """
    SELECT o_orderkey, 'priority=' || o_orderpriority || ',status=' || coalesce(nullif(o_orderstatus, 'P'), '?') AS picked
    FROM orders
    """,
)
def select_keys(spark, folder):
    o = table(spark, folder, "orders", spread=True)
    held = F.create_map(
        F.lit("key"), F.col("o_orderkey").cast("string"), F.lit("status"), F.nullif("o_orderstatus", F.lit("P")),
        F.lit("priority"), F.col("o_orderpriority"),
    )
    picked = P.select_keys(held, ["priority", "absent", "status", "priority"])
    shown = F.transform(F.map_entries(picked), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("?"))))
    return o.select("o_orderkey", joined(shown).alias("picked"))


@query(
    "select_json",
    """
    SELECT event_id, CASE WHEN event_type = 'error' THEN '[1,2]' ELSE
           '{"type":"' || event_type || '","note":null,"k":' || (props->>'$.k') || '}' END AS picked
    FROM events
    """,
)
def select_json(spark, folder):
    e = table(spark, folder, "events", spread=True)
    text = F.concat(
        F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"more":{"a":1},"note":null,"type":"'), F.col("event_type"), F.lit('"}')
    )
    source = F.try_parse_json(F.when(F.col("event_type") == "error", "[1, 2]").otherwise(text))
    return e.select("event_id", P.select_json(source, ["type", "absent", "note", "k", "type"]).alias("picked"))


@query(
    "filter_rows",
    "SELECT event_id, event_type FROM (SELECT event_id, nullif(event_type, 'view') AS event_type FROM events) WHERE event_type IS NOT DISTINCT FROM NULL",
)
def filter_rows(spark, folder):
    e = table(spark, folder, "events").select("event_id", F.nullif("event_type", F.lit("view")).alias("event_type"))
    return P.filter_rows(e, "event_type", F.lit(None).cast("string"))


@query(
    "filter_structs",
    """
    SELECT l_orderkey, l_linenumber, l_partkey,
           CASE WHEN l_returnflag = 'R' THEN 'flag' ELSE '' END ||
           CASE WHEN l_returnflag = 'R' AND l_linestatus = 'R' THEN ',' ELSE '' END ||
           CASE WHEN l_linestatus = 'R' THEN 'status' ELSE '' END AS kept,
           CASE WHEN l_linestatus = 'O' THEN 'status' ELSE '' END AS unset
    FROM lineitem
    """,
)
def filter_structs(spark, folder):
    items = F.array(
        F.struct(F.lit("flag").alias("name"), F.col("l_returnflag").alias("value")),
        F.struct(F.lit("status").alias("name"), F.nullif("l_linestatus", F.lit("O")).alias("value")),
        F.lit(None),
    )

    def names(value):
        return joined(F.transform(P.filter_structs(items, "value", value), lambda item: item["name"]))

    return table(spark, folder, "lineitem", spread=True).select(
        "l_orderkey", "l_linenumber", "l_partkey", names("R").alias("kept"), names(F.lit(None).cast("string")).alias("unset")
    )


@query(
    "filter_items",
    """
    SELECT event_id,
           CASE WHEN event_type = 'error' THEN '{"k":1}'
                ELSE '[{"at":1,"k":' || (props->>'$.k') || '},{"at":2,"k":' || (props->>'$.k') || '}]' END AS by_number,
           CASE WHEN event_type = 'error' THEN '{"k":1}' ELSE '[{"at":3,"k":"' || (props->>'$.k') || '"}]' END AS by_text,
           CASE WHEN event_type = 'error' THEN '{"k":1}' ELSE '[{"at":4}]' END AS by_null,
           CASE WHEN event_type = 'error' THEN '{"k":1}' ELSE '[{"at":1,"k":' || (props->>'$.k') || '}]' END AS by_true
    FROM events
    """,
)
def filter_items(spark, folder):
    e = table(spark, folder, "events", spread=True)
    k = F.get_json_object("props", "$.k")
    text = F.concat(
        F.lit('[{"at":1,"k":'), k, F.lit('},{"at":2,"k":'), k, F.lit('.0},{"at":3,"k":"'), k, F.lit('"},{"at":4},7,"x",null,[1]]')
    )
    items = F.try_parse_json(F.when(F.col("event_type") == "error", '{"k": 1}').otherwise(text))

    def kept(key: str, value) -> F.Column:
        return F.to_json(P.filter_items(items, key, F.try_parse_json(value)))

    e = with_once(e, {"k": k, "items": items})
    k, items = F.col("k"), F.col("items")
    return e.select(
        "event_id",
        kept("k", k).alias("by_number"),
        kept("k", F.concat(F.lit('"'), k, F.lit('"'))).alias("by_text"),
        kept("k", F.lit("null")).alias("by_null"),
        kept("at", F.lit("true")).alias("by_true"),
    )


@query(
    "merge_maps",
    """
    SELECT o_orderkey, o_orderpriority AS a, o_orderstatus AS b, 'last' AS c, CAST(3 AS BIGINT) AS n_keys FROM orders
    """,
)
def merge_maps(spark, folder):
    first = F.create_map(F.lit("a"), F.col("o_orderstatus"), F.lit("b"), F.col("o_orderstatus"))
    second = F.create_map(F.lit("a"), F.col("o_orderpriority"), F.lit("c"), F.col("o_orderstatus"))
    merged = P.merge_maps(first, second, F.create_map(F.lit("c"), F.lit("last")))
    rows = table(spark, folder, "orders").select("o_orderkey", merged.alias("m"))
    return rows.select("o_orderkey", F.col("m.a"), F.col("m.b"), F.col("m.c"), F.size("m").cast("long").alias("n_keys"))


@query(
    "merge_document",
    """
    SELECT event_id, '{"k":"' || event_type || '","list":[1,{"x":2}],"n":' || event_id || ',"user":' || user_id || '}' AS merged
    FROM events
    """,
)
def merge_document(spark, folder):
    # "zz" is written first, so the later "k" wins although its name sorts first.
    text = F.concat(
        F.lit('{"zz":'), F.col("props"), F.lit(',"n":0,"list":[1,{"x":2}],"body":{"user":'), F.col("user_id").cast("string"),
        F.lit(',"n":'), F.col("event_id").cast("string"), F.lit('},"k":"'), F.col("event_type"), F.lit('"}'),
    )
    return table(spark, folder, "events", spread=True).select("event_id", F.to_json(P.merge_document(text)).alias("merged"))


@query(
    "merge_rows",
    """
    SELECT user_id, event_type, arg_max(event_id, event_id) AS last_event FROM events GROUP BY user_id, event_type
    """,
)
def merge_rows(spark, folder):
    e = table(spark, folder, "events").select("user_id", "event_type", "event_id", F.col("event_id").alias("last_event"))
    return P.merge_rows(e, ["user_id"], "event_id", "event_type", "last_event")


@query(
    "merge_columns",
    "SELECT c_custkey AS custkey, n_name AS name, c_mktsegment, n_regionkey AS region FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def merge_columns(spark, folder):
    c, n = table(spark, folder, "customer"), table(spark, folder, "nation")
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.struct(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name")).alias("who"),
        "c_mktsegment",
        F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("where"),
    )
    return P.merge_columns(rows, ["who", "c_mktsegment", "where"])


@query("passthrough", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def passthrough(spark, folder):
    return P.passthrough(table(spark, folder, "nation"))


# --- content keys ---------------------------------------------------------------


@query(
    "fingerprint",
    """
    SELECT o_orderkey,
           sha256('{"action":"price","inputs":{"a":[' || o_custkey || '],"z":{"p":"' || o_orderpriority || '","s":"' || o_orderstatus || '"}}}') AS input_hash,
           TRUE AS same_when_reordered
    FROM orders
    """,
)
def fingerprint(spark, folder):
    o = table(spark, folder, "orders", spread=True)
    s, p, c = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey").cast("string")
    one = F.concat(F.lit('{"z":{"s":"'), s, F.lit('","p":"'), p, F.lit('"},"a":['), c, F.lit("]}"))
    two = F.concat(F.lit('{ "a" : [ '), c, F.lit('.0 ], "z": {"p":"'), p, F.lit('", "s":"'), s, F.lit('"}}'))
    keys = [input_key(F.lit("price"), F.try_parse_json(text)) for text in (one, two)]
    return o.select("o_orderkey", keys[0].alias("input_hash"), (keys[0] == keys[1]).alias("same_when_reordered"))


@query(
    "row_fingerprint",
    """
    SELECT o_orderkey, sha256('{"action":"row","inputs":{"o_custkey":' || o_custkey || ',"status":' ||
           CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}}') AS row_hash
    FROM orders
    """,
)
def row_fingerprint(spark, folder):
    o = table(spark, folder, "orders", spread=True).withColumn("status", F.nullif("o_orderstatus", F.lit("P")))
    return o.select("o_orderkey", row_key(o, F.lit("row"), ["status", "o_custkey"]).alias("row_hash"))


_DOCUMENTS = (
    '{"z":" ${workflow.input.k} ","a":["n ${s.output.name}!",{"o":"${workflow.input.o}"}],"${workflow.input.k}":"kept"}',
    r'{"b":"${workflow.input.o.b} \"q\" ${workflow.input.k}"}',
    '{"m":"${workflow.input.missing} ${t.output}","i":"${workflow.output}","s":"${s.output.name.x}"}',
)


@query(
    "render_documents",
    r"""
    SELECT c_custkey, CASE c_nationkey % 3
             WHEN 0 THEN '{"z":' || c_custkey || ',"a":["n ' || c_name || '!",{"o":{"b":true}}],"${workflow.input.k}":"kept"}'
             WHEN 1 THEN '{"b":"True \"q\" ' || c_custkey || '"}' END AS resolved,
           CASE c_nationkey % 3 WHEN 2 THEN 'key_missing,step_unknown,workflow_output,unsupported_type' ELSE '' END AS error_codes
    FROM customer
    """,
)
def render_documents(spark, folder):
    c = table(spark, folder, "customer", spread=True)
    third = F.col("c_nationkey") % 3
    document = F.when(third == 0, _DOCUMENTS[0]).when(third == 1, _DOCUMENTS[1]).otherwise(_DOCUMENTS[2])
    inputs = F.parse_json(F.concat(F.lit('{"k":'), F.col("c_custkey").cast("string"), F.lit(',"o":{"b":true}}')))
    outputs = F.create_map(F.lit("s"), F.to_variant_object(F.struct(F.col("c_name").alias("name"))))
    done = c.select("c_custkey", fill_documents(document, inputs, outputs).alias("d"))
    return done.select("c_custkey", "d.resolved", joined("d.error_codes").alias("error_codes"))
