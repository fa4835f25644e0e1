"""Relations that whole bodies, summaries and stores state, on the driver's tables.

part stands for functions and types, lineitem for their uses, customer for stored cards, events for a store's changes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from traceloom.functions import ids
from traceloom.operators import graph, history, joins, ledger, summary_types
from traceloom.plans.registry import query, spread, table, tasks_for
from traceloom.scratch import materialize, scratch_dir
from traceloom.sources import files, tables
from traceloom.streaming import stateful

_FUNCTIONS = """
    SELECT split_part(p_name, ' ', 1) AS module, concat(split_part(p_name, ' ', 2), '_', p_size % 7) AS name,
        CASE WHEN p_size % 3 = 0 THEN 'public(package)' ELSE 'public' END AS visibility,
        CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('0x2::', split_part(p_name, ' ', 1), '::', split_part(p_name, ' ', 2), '_', p_size % 7, '(1);')
            WHEN 2 THEN concat('x', split_part(p_name, ' ', 2), '_', p_partkey % 7, '(a) + b(c)') ELSE concat('re', split_part(p_name, ' ', 1), '::ring_', p_size % 5, 'th; ', p_type, '::') END AS body
    FROM part
"""


@query(
    "package_relationships",
    f"""
    WITH f AS ({_FUNCTIONS}), t AS (SELECT DISTINCT module, name FROM f WHERE visibility = 'public(package)')
    SELECT DISTINCT f.module AS source_module, f.name AS source_function, t.module AS target_module, t.name AS target_function
    FROM f JOIN t ON contains(f.body, concat(t.module, '::', t.name)) OR (f.module = t.module AND contains(f.body, concat(t.name, '(')))
    """,
)
def package_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers of functions that their package alone may call, by the text of their bodies."""
    name = F.split("p_name", " ")
    own, size = F.get(name, F.lit(1)), (F.col("p_size") % 7).cast("string")
    target = F.concat(own, F.lit("_"), size)
    body = (
        F.when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("0x2::"), name[0], F.lit("::"), target, F.lit("(1);")))
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("x"), own, F.lit("_"), (F.col("p_partkey") % 7).cast("string"), F.lit("(a) + b(c)")))
        .when(F.col("p_partkey") % 4 == 3, F.concat(F.lit("re"), name[0], F.lit("::ring_"), (F.col("p_size") % 5).cast("string"), F.lit("th; "), F.col("p_type"), F.lit("::")))
    )
    visibility = F.when(F.col("p_size") % 3 == 0, "public(package)").otherwise("public")
    return joins.package_relationships(table(spark, sf_dir, "part").select(name[0].alias("module"), target.alias("name"), visibility.alias("visibility"), body.alias("body")))


#: The thirteen parts of a type edge's key, stated alike for both engines.
_TYPE_KEY = {
    "source": "l_partkey", "target": "l_suppkey", "relationship": "l_returnflag", "field_name": "nullif(l_linestatus, 'O')", "variant_name": "CASE WHEN l_linenumber = 1 THEN l_returnflag END",
    "function_name": "CASE WHEN l_linenumber > 4 THEN l_linestatus END", "parameter_name": "CASE WHEN l_linenumber = 6 THEN 'p' END", "type_argument_index": "nullif(l_linenumber % 3, 0)",
    "is_mutable": "l_linenumber % 2 = 0", "is_reference": "l_linenumber % 4 = 0", "declaring_type_id": "CASE WHEN l_linestatus = 'F' THEN l_partkey END",
    "declaring_field_name": "CASE WHEN l_linestatus = 'F' THEN l_returnflag END", "type_argument_name": "CASE WHEN l_linenumber % 3 = 1 THEN 'T' END",
}
_UNRESOLVED_KEY = {
    "source": "l_partkey % 500", "raw_target": "l_returnflag", "call_kind": "l_linestatus", "file_path": "l_suppkey % 10", "reason": "CASE WHEN l_linenumber > 3 THEN 'ambiguous' ELSE 'unknown' END"
}


def _edge_sql(key: dict[str, str], kept: dict[str, str]) -> str:
    parts = ", ".join(f"{sql} AS {name}" for name, sql in {**key, **kept}.items())
    firsts = "".join(f"first({name} ORDER BY l_shipdate, l_orderkey, {', '.join(kept)}) AS {name}, " for name in kept)
    return (
        f"SELECT {', '.join(key)}, {firsts}count(*) AS n_spans, min(l_shipdate) AS first_span, max(l_shipdate) AS last_span "
        f"FROM (SELECT l_shipdate, l_orderkey, {parts} FROM lineitem) GROUP BY {', '.join(key)}"
    )


def _edges(spark: SparkSession, sf_dir: str, key: dict[str, str], kept: dict[str, str]) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_orderkey", *(F.expr(sql).alias(name) for name, sql in {**key, **kept}.items()))
    return graph.keyed_edges(rows, list(key), list(kept), ["l_shipdate", "l_orderkey"], "l_shipdate")


_KEPT = {"type_expression": "l_quantity", "confidence": "CASE WHEN l_linenumber > 2 THEN 'exact' ELSE 'heuristic' END"}


@query("type_edges", _edge_sql(_TYPE_KEY, _KEPT))
def type_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of types as edges by all thirteen parts of their key, eight of which may be null."""
    return _edges(spark, sf_dir, _TYPE_KEY, _KEPT)


@query("unresolved_edges", _edge_sql(_UNRESOLVED_KEY, {}))
def unresolved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses without a target, by five parts."""
    return _edges(spark, sf_dir, _UNRESOLVED_KEY, {})


_SUMMARY_SQL = """
    WITH s AS (SELECT p_partkey % 5 AS form, p_size, concat('type:0x2::m', p_partkey % 50, '::S', p_partkey) AS owner FROM part),
    e AS (
        SELECT owner AS source, CASE form WHEN 0 THEN 'builtin:type:u64' WHEN 1 THEN 'builtin:type:vector' WHEN 2 THEN 'external:type:datatype:0x1::coin::Coin'
                ELSE concat('known:', p_size) END AS target, 'field' AS relationship, 'x' AS field_name, NULL AS type_argument_index, form = 2 AS is_mutable, form = 2 AS is_reference,
            NULL AS type_argument_name, owner, CASE form WHEN 0 THEN 'u64' WHEN 1 THEN 'vector' WHEN 2 THEN '0x1::coin::Coin' ELSE concat('0x2::k::T', p_size) END AS type_expression
        FROM s WHERE form <> 3
        UNION ALL SELECT 'builtin:type:vector', 'builtin:type:u8', 'genericArgument', NULL, NULL, false, false, 'T', owner, 'u8' FROM s WHERE form = 1
        UNION ALL SELECT 'external:type:datatype:0x1::coin::Coin', 'external:type:summaryType:_::summary::Own', 'genericArgument', NULL, 1, false, false, NULL, owner, 'Own' FROM s WHERE form = 2
        UNION ALL SELECT concat('known:', p_size), 'builtin:type:bool', 'genericArgument', NULL, 0, false, false, 'Key', owner, 'bool' FROM s WHERE form = 4)
    SELECT source, target, relationship, field_name, NULL::VARCHAR AS variant_name, NULL::VARCHAR AS function_name, NULL::VARCHAR AS parameter_name, type_argument_index::INTEGER AS type_argument_index,
        is_mutable, is_reference, owner AS declaring_type_id, 'x' AS declaring_field_name, type_argument_name, type_expression, 'heuristic' AS confidence FROM e
"""


@query("summary_types", _SUMMARY_SQL)
def summary_types_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary for each part, with one struct whose field is of one of five forms."""
    form, part = F.col("p_partkey") % 5, table(spark, sf_dir, "part")
    typed = (
        F.when(form == 0, '"u64"').when(form == 1, '{"vector":"u8"}').when(form == 3, '{"TypeParameter":0}')
        .when(form == 2, '{"Reference":[true,{"Datatype":{"module":{"address":"0x1","name":"coin"},"name":"Coin","type_arguments":[{"argument":7},{"argument":"Own"}]}}]}')
        .otherwise(F.concat(F.lit('{"Datatype":{"module":{"address":"0x2","name":"k"},"name":"T'), "p_size", F.lit('","type_arguments":[{"argument":"bool"}]}}')))
    )
    body = F.concat(F.lit('{"fields":{"fields":{"x":{"type_":'), typed, F.lit('},"y":{"doc":"untyped"}}}}'))
    none = F.lit(None).cast("map<string,string>")
    modules = part.select(
        F.struct(F.lit("0x2").alias("address"), F.concat(F.lit("m"), F.col("p_partkey") % 50).alias("name")).alias("id"),
        F.create_map(F.concat(F.lit("S"), "p_partkey"), body).alias("structs"), none.alias("enums"), none.alias("functions"),
    )
    known = part.select(
        F.lit("0x2").alias("address"), F.lit("k").alias("module"), F.concat(F.lit("T"), "p_size").alias("name"), F.concat(F.lit("known:"), "p_size").alias("id"), F.array(F.lit("Key")).alias("parameters")
    ).distinct()
    return summary_types.summary_edges(summary_types.usages(modules), known)


@query(
    "update_cards",
    """
    SELECT c_custkey, c_nationkey, CASE WHEN last IS NULL THEN c_mktsegment ELSE last.status END AS c_mktsegment, CASE WHEN last IS NULL THEN c_acctbal ELSE last.total END AS c_acctbal
    FROM customer LEFT JOIN (SELECT o_custkey, max({'k': o_orderkey, 'status': nullif(o_orderstatus, 'P'), 'total': o_totalprice}) AS last FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
    """,
)
def update_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cards that orders rewrite: the last order's status, null for a pending one, and total."""
    cards = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    changes = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.expr("nullif(o_orderstatus, 'P')").alias("c_mktsegment"), F.col("o_totalprice").alias("c_acctbal")
    )
    return tables.update_by_key(cards, changes, "c_custkey", ["c_mktsegment", "c_acctbal"], "o_orderkey")


_STAGES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_WORK = f"""
    WITH items AS (SELECT (o_custkey % 50)::BIGINT AS run, o_orderkey AS item, o_orderpriority AS stage, o_orderkey % 11 = 0 AS gap, o_orderkey % 3 = 0 AS asks FROM orders),
    claims AS (SELECT (l_suppkey % 50)::BIGINT AS run, CASE WHEN l_suppkey % 2 = 1 THEN {list(_STAGES)!r}[1 + (l_partkey % 5)::INT] ELSE '' END AS queue, concat('w', l_partkey % 3) AS claimed_by, l_orderkey AS claimed_at
        FROM lineitem WHERE l_linenumber = 1),
    waiting AS (SELECT *, CASE WHEN run % 2 = 1 THEN stage ELSE '' END AS queue, row_number() OVER (PARTITION BY run, CASE WHEN run % 2 = 1 THEN stage ELSE '' END ORDER BY item) AS k FROM items),
    asking AS (SELECT *, row_number() OVER (PARTITION BY run, queue ORDER BY claimed_at, claimed_by) AS k FROM claims),
    held AS (SELECT run, item, stage, gap, asks, claimed_by, claimed_at FROM waiting LEFT JOIN asking USING (run, queue, k)),
    lines AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2),
    first AS (SELECT held.*, l_linenumber AS line, 2 * l_orderkey + l_linenumber AS time, asks AND l_suppkey % 4 < 2 AND l_linestatus <> 'O' AND l_partkey % 9 <> 0 AS proven,
        CASE WHEN l_linenumber = 7 THEN 'invalid_status' WHEN l_partkey % 9 = 0 THEN 'evidence_not_found' WHEN claimed_at IS NULL OR claimed_at > 2 * l_orderkey + l_linenumber OR claimed_by <> concat('w', l_partkey % 3) THEN 'claimed_by_other'
        WHEN l_returnflag = 'A' THEN 'failed' WHEN l_returnflag = 'N' THEN 'blocked' WHEN gap THEN 'unavailable_capabilities'
        WHEN asks AND NOT (l_suppkey % 4 < 2 AND l_linestatus <> 'O') THEN 'missing_evidence' ELSE 'completed' END AS outcome
        FROM lines JOIN held ON l_orderkey = item WHERE l_linenumber > 1),
    outcomes AS (SELECT * EXCLUDE (outcome), CASE WHEN outcome = 'missing_evidence' AND coalesce(bool_or(proven AND outcome IN ('completed', 'failed', 'blocked'))
        OVER (PARTITION BY item ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'completed' ELSE outcome END AS outcome FROM first),
    accepted AS (SELECT item, max_by(outcome, time) AS status, max(time) AS time, count(*) AS n FROM outcomes WHERE outcome IN ('completed', 'failed', 'blocked') GROUP BY item),
    state AS (SELECT run, held.item AS item, stage, coalesce(status, CASE WHEN claimed_by IS NULL THEN 'pending' ELSE 'claimed' END) AS status, claimed_by, (claimed_by IS NOT NULL)::BIGINT AS attempts,
        claimed_at, coalesce(time, claimed_at) AS updated_at, coalesce(n, 0)::BIGINT AS n_evidence FROM held LEFT JOIN accepted USING (item))
"""


def _replayed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as work items of fifty runs, first lines as claims, later ones as requests to finish that cite
    themselves; lines that share order and number are one request."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    run, none = (F.col("o_custkey") % 50).cast("long"), F.array().cast("array<string>")
    items = orders.select(
        run.alias("run"), F.col("o_orderkey").alias("item"), F.col("o_orderkey").alias("place"), F.col("o_orderpriority").alias("stage"),
        F.when(F.col("o_orderkey") % 11 == 0, F.array(F.lit("shell"))).alias("unavailable"), F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("m0"), F.lit("m1"))).otherwise(none).alias("methods"), none.alias("evidence"),
    )
    worker, named = F.concat(F.lit("w"), F.col("l_partkey") % 3), F.get(F.array(*(F.lit(s) for s in _STAGES)), (F.col("l_partkey") % 5).cast("int"))
    claims = lines.where("l_linenumber = 1").select((F.col("l_suppkey") % 50).cast("long").alias("run"), worker.alias("worker"), F.when(F.col("l_suppkey") % 2 == 1, named).alias("stage"), F.col("l_orderkey").alias("time"))
    wanted = lines.where("l_linenumber > 1").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    later = spread(wanted, lines, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")))
    later = materialize(later.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), run.alias("run")), "l_orderkey"), "requests")
    own = F.concat_ws(":", "l_orderkey", "l_linenumber")
    status = F.when(F.col("l_linenumber") == 7, "pending").when(F.col("l_returnflag") == "R", "completed").when(F.col("l_returnflag") == "A", "failed").otherwise("blocked")
    finishes = later.select(own.alias("request"), "run", F.col("l_orderkey").alias("item"), worker.alias("worker"), status.alias("status"), F.array(own).alias("cited"), (2 * F.col("l_orderkey") + F.col("l_linenumber")).alias("time"))
    stored = later.where("l_partkey % 9 <> 0").select("run", own.alias("evidence"), F.col("l_orderkey").alias("item"), F.concat(F.lit("m"), F.col("l_suppkey") % 4).alias("method"), (F.col("l_linestatus") == "O").alias("submitted_by_model"))
    return ledger.replayed_work(items, claims, finishes, stored, tasks_for(lines))


@query("work_outcomes", f"{_WORK} SELECT concat(item, ':', line) AS request, item, outcome FROM outcomes")
def work_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each request to finish led to, against the state that claims and earlier requests had left."""
    return _replayed(spark, sf_dir)[0].select("request", "item", "outcome")


@query("work_items", f"{_WORK} SELECT run, item, stage, status, claimed_by, attempts, updated_at, n_evidence FROM state")
def work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's items as all claims and finishes leave them."""
    return _replayed(spark, sf_dir)[1].select("run", "item", "stage", "status", "claimed_by", "attempts", "updated_at", "n_evidence")


@query(
    "work_runs",
    f"""{_WORK}, r AS (SELECT run, arg_min(stage, item) FILTER (status = 'pending') AS next, arg_max(stage, claimed_at) FILTER (claimed_at IS NOT NULL) AS last, max(claimed_at) AS claim,
        max(updated_at) FILTER (status IN ('completed', 'failed', 'blocked')) AS finish, max(updated_at) AS updated_at, count(*) FILTER (status = 'pending') AS n_pending, count(*) FILTER (status = 'claimed') AS n_claimed,
        count(*) FILTER (status = 'completed') AS n_completed, count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (status = 'blocked') AS n_blocked FROM state GROUP BY run)
    SELECT run, CASE WHEN finish >= claim AND n_pending > 0 THEN next ELSE last END AS current_stage, updated_at, n_pending, n_claimed, n_completed, n_failed, n_blocked FROM r""",
)
def work_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each run stands behind its last event."""
    return ledger.run_states(_replayed(spark, sf_dir)[1])


@query("forwarded_events", "SELECT event_id, CASE event_type WHEN 'error' THEN 'audit/status' ELSE 'audit/activity' END AS method, user_id AS audit_id, event_type AS category, props AS message FROM events")
def forwarded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store's events as notifications, handed on by batches until nothing is left."""
    folder = f"{scratch_dir(spark)}/forward-{uuid.uuid4().hex}"
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    method = F.when(F.col("event_type") == "error", "audit/status").otherwise("audit/activity")
    notes = rows.select("event_id", method.alias("method"), F.col("user_id").alias("audit_id"), F.col("event_type").alias("category"), F.col("props").alias("message"))
    stateful.forward(notes, folder, every=None).awaitTermination()
    return spark.read.schema(notes.schema).option("recursiveFileLookup", True).parquet(f"{folder}/sent")


@query("bytecode_modules", "SELECT concat('m', p_size) AS module, min(p_partkey) AS key FROM part GROUP BY p_size")
def bytecode_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' sizes as compiled modules of one package, written to where a build leaves them and found again."""
    root = f"{scratch_dir(spark)}/package-{uuid.uuid4().hex}"
    keys = table(spark, sf_dir, "part").groupBy("p_size").agg(F.min("p_partkey").alias("key")).select(F.to_json(F.struct("p_size", "key")).alias("value"))
    keys.write.text(f"{root}/build/p/bytecode_modules/own")
    keys.write.text(f"{root}/build/p/sources")
    keys.write.text(f"{root}/build/p/bytecode_modules/dependencies/other")
    found = files.bytecode_files(spark, [root, f"{root}/build/p/bytecode_modules"], glob="*.txt")
    lines = found.select(F.explode(F.split(F.trim(F.decode("content", "UTF-8")), "\n")).alias("line")).where("line <> ''")
    return lines.select(F.from_json("line", "p_size int, key bigint").alias("line")).select(F.concat(F.lit("m"), "line.p_size").alias("module"), "line.key")


@query(
    "token_totals",
    """
    WITH t AS (SELECT conv_id, turn, role, strlen(coalesce(text, '')) AS size, ceil(strlen(coalesce(text, '')) / 4)::BIGINT AS tokens, CASE WHEN role = 'assistant' AND turn % 4 <> 3 THEN 100 + turn END AS usage FROM conversations),
    m AS (SELECT *, max(turn) FILTER (role = 'assistant') OVER w AS model, max(turn) FILTER (role = 'user') OVER w AS boundary FROM t WINDOW w AS (PARTITION BY conv_id)),
    g AS (SELECT conv_id, coalesce(arg_max(usage, turn) FILTER (usage IS NOT NULL), 0)::BIGINT AS last_usage, sum(size)::BIGINT AS all_bytes, coalesce(sum(tokens) FILTER (turn > model), 0)::BIGINT AS tokens_since,
        coalesce(sum(size) FILTER (turn > model), 0)::BIGINT AS bytes_since, coalesce(sum(tokens) FILTER (role = 'assistant' AND size % 2 = 0 AND turn < boundary), 0)::BIGINT AS reasoning FROM m GROUP BY conv_id)
    SELECT *, last_usage + tokens_since + reasoning AS total, last_usage + tokens_since AS total_if_counted FROM g
    """,
)
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories' totals; assistants' turns report usage, those of even size stand for encrypted reasoning."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "conversations").withColumn("size", F.octet_length(text)).withColumn("tokens", ids.estimate_tokens(text))
    model = F.col("role") == "assistant"
    rows = rows.withColumn("usage", F.when(model & (F.col("turn") % 4 != 3), F.col("turn") + 100))
    return history.token_totals(rows, "conv_id", "turn", model, F.col("role") == "user", model & (F.col("size") % 2 == 0), "tokens", "size", "usage")


@query(
    "capability_gaps",
    """
    SELECT user_id, '[' || string_agg(text, ',' ORDER BY first) || ']' AS gaps FROM (
        SELECT user_id, min(event_id) AS first, to_json({'capability': event_type, 'reason': arg_max(props, event_id), 'updatedAt': max(event_id)})::VARCHAR AS text FROM events GROUP BY user_id, event_type)
    GROUP BY user_id
    """,
)
def capability_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of missing capabilities merged into one JSON array a user, the last report of each counting."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("capability"), F.col("props").alias("reason"), F.col("event_id").alias("updatedAt"))
    return ledger.merged_gaps(rows, "user_id", "event_id", ["reason", "updatedAt"])


@query(
    "finish_outcomes",
    """
    WITH l AS (SELECT l_orderkey, bool_or(l_linenumber = 2 AND l_returnflag <> 'A' AND l_linestatus = 'F') AS proven, bool_or(l_linenumber = 1) AS stored FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey AS request, CASE WHEN o_orderkey % 11 = 0 THEN 'invalid_status' WHEN NOT coalesce(stored, false) THEN 'evidence_not_found' WHEN o_orderkey % 7 = 0 THEN 'item_not_found'
        WHEN o_custkey % 3 = 0 THEN 'claimed_by_other' WHEN o_orderstatus <> 'F' THEN CASE o_orderstatus WHEN 'O' THEN 'failed' ELSE 'blocked' END WHEN o_custkey % 5 = 0 THEN 'unavailable_capabilities'
        WHEN NOT coalesce(proven, false) THEN 'missing_evidence' ELSE 'completed' END AS outcome
    FROM orders LEFT JOIN l ON l_orderkey = o_orderkey
    """,
)
def finish_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as work items that a worker wants to finish, their lines as evidence; line 1 is cited, line 2 held."""
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    status = F.when(key % 11 == 0, "pending").when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("blocked")
    place = lambda n: F.array(F.concat(key.cast("string"), F.lit(f":{n}")))
    requests = orders.select(key.alias("request"), F.lit("r").alias("run"), key.alias("item"), F.lit("w").alias("worker"), status.alias("status"), place(1).alias("cited"))
    items = orders.where(key % 7 != 0).select(
        F.lit("r").alias("run"), key.alias("item"), F.when(F.col("o_custkey") % 3 != 0, "w").alias("claimed_by"),
        F.when(F.col("o_custkey") % 5 == 0, F.array(F.lit("shell"))).alias("unavailable"), F.array(F.lit("F")).alias("methods"), place(2).alias("evidence"),
    )
    lines = table(spark, sf_dir, "lineitem").select(
        F.lit("r").alias("run"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("evidence"), F.col("l_orderkey").alias("item"),
        F.when(F.col("l_linenumber") == 2, F.col("l_linestatus")).otherwise("none").alias("method"), (F.col("l_returnflag") == "A").alias("submitted_by_model"),
    )
    return ledger.finish_outcomes(requests, items, lines)
