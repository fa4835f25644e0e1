"""Predicates, times, health, capabilities, scans and jobs on the driver's tables.

part stands for functions, lineitem for packages' facts, orders for jobs' items, events for outputs with metadata and times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from traceloom.functions import predicates, times
from traceloom.operators import reports
from traceloom.plans.registry import query, table


def _columns(shapes: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in shapes.items())


def _shaped(rows: DataFrame, shapes: dict[str, str]) -> DataFrame:
    return rows.select("*", *(F.expr(sql).alias(name) for name, sql in shapes.items()))


# Functions in words that both engines read: path, attribute, name, signature, body, visibility.
_FUNCTION = {
    "path": "concat('a/', CASE p_size % 10 WHEN 0 THEN 'tests' ELSE p_brand END, '/m')",
    "attribute": "CASE p_partkey % 9 WHEN 0 THEN 'Test_only' ELSE p_type END",
    "name": "concat(replace(p_name, ' ', '_'), CASE p_partkey % 7 WHEN 0 THEN '_Mint' WHEN 1 THEN '_set' ELSE '' END)",
    "signature": "concat('cap_', p_size, '(a: (u8, ', p_type, '), b: ', CASE p_size % 6 WHEN 0 THEN 'AdminCap' WHEN 1 THEN 'Treasury<T>' ELSE 'u64' END, '): Authority (x)')",
    "body": "CASE p_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN concat('{ ASSERT!(', p_size, ') }') WHEN 2 THEN '{ let s = Tx_Context::sender(ctx); }' WHEN 3 THEN '{ coin::take(x) }' ELSE concat('{ read(', p_brand, ') }') END",
    "visibility": "CASE p_size % 4 WHEN 0 THEN 'private' WHEN 1 THEN 'public(package)' ELSE 'public' END",
    "is_entry": "p_size % 8 = 0",
}


def _any_sql(text: str, words: tuple[str, ...]) -> str:
    return "coalesce(" + " OR ".join(f"contains(lower({text}), '{word}')" for word in words) + ", false)"


@query(
    "function_predicates",
    f"""
    WITH f AS (SELECT p_partkey, {_columns(_FUNCTION)} FROM part), p AS (SELECT *, regexp_extract(signature, '\\(((?:[^()]|\\([^()]*\\))*)\\)', 1) AS parameters FROM f),
    q AS (SELECT p_partkey, list_contains(string_split(path, '/'), 'tests') OR {_any_sql("attribute", ("test", "test_only", "random_test", "expected_failure"))} AS is_test,
        {_any_sql("parameters", predicates.GUARD_PARAMETERS)} OR {_any_sql("body", predicates.GUARD_BODY)} AS is_guarded,
        {_any_sql("name", predicates.PRIVILEGED_NAMES)} OR {_any_sql("body", predicates.PRIVILEGED_BODY)} AS is_privileged,
        is_entry OR visibility IN ('public', 'public(package)') AS is_reachable FROM p)
    SELECT *, is_reachable AND is_privileged AND NOT is_guarded AND NOT is_test AS is_open FROM q
    """,
)
def function_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests, guards by twelve signals, privileges by names and bodies, reach; open functions are privileged, reachable and unguarded."""
    rows = _shaped(table(spark, sf_dir, "part"), _FUNCTION)
    flags = rows.select(
        "p_partkey",
        predicates.is_test(F.col("path"), F.array("attribute")).alias("is_test"),
        predicates.is_guarded(F.col("signature"), F.col("body")).alias("is_guarded"),
        predicates.is_privileged(F.col("name"), F.col("body")).alias("is_privileged"),
        predicates.is_reachable(F.col("visibility"), F.col("is_entry"), F.lit(False)).alias("is_reachable"),
    )
    return flags.withColumn("is_open", F.expr("is_reachable AND is_privileged AND NOT is_guarded AND NOT is_test"))


# Counters of a package's facts: conditions on its lines.
_COUNTS = {
    "summary_artifact_count": "l_linenumber = 6 AND l_tax > 0.04", "function_count": "l_returnflag = 'A'", "operation_count": "l_suppkey % 3 > 0 AND l_quantity > 0",
    "operation_exact_span_count": "l_suppkey % 3 = 2 AND l_quantity >= 25", "operation_source_span_count": "l_quantity < 25", "call_operation_count": "l_discount > 0.05",
    "call_edge_with_operation_count": "l_discount > 0.05 AND (l_suppkey % 2 = 0 OR l_linestatus = 'O')", "dangling_operation_edge_count": "l_suppkey % 5 = 0 AND l_tax = 0",
    "dangling_semantic_tag_target_count": "l_suppkey % 7 = 0 AND l_discount = 0", "prohibited_tag_count": "l_suppkey % 11 = 0 AND l_tax > 0.07",
}
_STATES = {
    "full_mode": "l_suppkey % 4 < 3", "known": "l_suppkey % 2 = 0", "clean": "l_suppkey % 9 = 0",
    "metadata": "CASE l_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN concat('{\"owner\":', l_suppkey, '}') ELSE concat('[', l_suppkey, ']') END",
}


@query(
    "index_health",
    "WITH c AS (SELECT l_suppkey, " + ", ".join(f"count(*) FILTER ({when}) AS {name}" for name, when in _COUNTS.items()) + f" FROM lineitem GROUP BY l_suppkey), s AS (SELECT *, {_columns(_STATES)} FROM c), "
    "r AS (SELECT *, CASE WHEN summary_artifact_count = 0 THEN 'missing_summary_artifacts' WHEN full_mode AND operation_count > 0 THEN 'compiler_backed' ELSE 'summary_pointer' END AS readiness, "
    "CASE WHEN clean THEN 'fresh' WHEN known THEN 'changed' ELSE 'first_index' END AS freshness, concat_ws(',', "
    + ", ".join(f"CASE WHEN {when} THEN '{severity}:{code}' END" for code, severity, when, _ in reports.HEALTH)
    + ") AS diagnostics, concat('{\"index_health\":{\"freshness\":\"', freshness, '\",\"readiness\":\"', readiness, '\"}') AS health FROM s) "
    "SELECT l_suppkey, readiness, freshness, diagnostics, concat(health, CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat(',\"owner\":', l_suppkey) ELSE concat(',\"previousMetadata\":[', l_suppkey, ']') END, '}') AS metadata FROM r",
)
def index_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readiness, freshness and seven diagnostics of each package, written into its metadata."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*(F.count_if(F.expr(when)).alias(name) for name, when in _COUNTS.items()))
    rows = _shaped(counts, _STATES).withColumn("codes", F.array().cast("array<string>"))
    given = F.array_join(F.transform("diagnostics", lambda d: F.concat(d["severity"], F.lit(":"), d["code"])), ",")
    return reports.index_health(rows).select("l_suppkey", "readiness", "freshness", given.alias("diagnostics"), "metadata")


@query(
    "merged_metadata",
    """
    WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events),
    entries AS (SELECT user_id, nth, 'k' AS key, json_extract(props, '$.k')::VARCHAR AS value FROM e WHERE event_id % 5 = 1
        UNION ALL SELECT user_id, nth, 'c', event_id::VARCHAR FROM e WHERE event_id % 5 = 2 UNION ALL SELECT user_id, nth, 'k', 'null' FROM e WHERE event_id % 5 = 2
        UNION ALL SELECT user_id, nth, 't' || event_id % 3, '{"type":"' || event_type || '"}' FROM e WHERE event_id % 5 = 4)
    SELECT user_id, key, arg_max(value, nth) AS value FROM entries WHERE user_id IN (SELECT user_id FROM e WHERE nth = 1 AND event_id % 5 IN (1, 2, 4)) GROUP BY ALL
    """,
)
def merged_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's metadata objects merged in order of time; some of them are null or lists."""
    text = F.expr(
        """CASE event_id % 5 WHEN 1 THEN props WHEN 2 THEN concat('{"c":', event_id, ',"k":null}') WHEN 3 THEN '[1]' WHEN 4 THEN concat('{"t', event_id % 3, '":{"type":"', event_type, '"}}') END"""
    )
    return reports.merged_metadata(table(spark, sf_dir, "events").withColumn("metadata", text), "user_id", ["ts", "event_id"], "metadata")


_BINDING_SQL = """
    WITH l AS (SELECT *, 'c' || l_partkey % 3 AS capability FROM lineitem),
    b AS (SELECT l_orderkey, capability, arg_min({'available': l_returnflag = 'N', 'provider': l_suppkey, 'diagnostic': nullif(l_linestatus, 'O')}, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS b FROM l WHERE l_linenumber % 2 = 0 GROUP BY 1, 2),
    d AS (SELECT l_orderkey, l_linenumber, l_partkey, capability, CASE WHEN b.available THEN 'available' WHEN b IS NOT NULL THEN 'unavailable' ELSE 'unbound' END AS state,
        CASE WHEN b.available THEN b.provider END AS provider, CASE WHEN b IS NOT NULL AND NOT b.available THEN coalesce(b.diagnostic, 'capability provider is unavailable') END AS reason
        FROM l LEFT JOIN b USING (l_orderkey, capability) WHERE l_linenumber % 2 = 1 AND l_quantity > 10)
"""


def _bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("capability", F.expr("concat('c', l_partkey % 3)"))
    bindings = lines.where("l_linenumber % 2 = 0").select(
        "l_orderkey", "capability", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("place"),
        (F.col("l_returnflag") == "N").alias("available"), F.col("l_suppkey").alias("provider"), F.nullif("l_linestatus", F.lit("O")).alias("diagnostic"),
    )
    desired = lines.where("l_linenumber % 2 = 1 AND l_quantity > 10").select("l_orderkey", "l_linenumber", "l_partkey", "capability")
    return reports.bound_capabilities(desired, bindings, ["l_orderkey"], "place")


@query("bound_capabilities", _BINDING_SQL + " SELECT * FROM d")
def bound_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each stage (an order) wants, by the first binding of it: odd lines want what even ones bind."""
    return _bound(spark, sf_dir)


@query(
    "stage_actions",
    _BINDING_SQL
    + """, n AS (SELECT o_orderkey, count(d.l_orderkey) AS n_desired, count(*) FILTER (d.state = 'available') AS n_available, count(*) FILTER (d.state = 'unavailable') AS n_unavailable
        FROM orders LEFT JOIN d ON d.l_orderkey = o_orderkey GROUP BY o_orderkey)
    SELECT *, CASE WHEN n_desired = 0 THEN 'ModelOnly' WHEN n_unavailable = 0 THEN 'UseAvailableCapabilities' WHEN n_unavailable < n_desired THEN 'UseAvailableCapabilitiesWithGaps' ELSE 'RecordUnavailableAndContinue' END AS action FROM n
    """,
)
def stage_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do with each stage, those that want nothing included."""
    stages = table(spark, sf_dir, "orders").select("o_orderkey")
    return reports.stage_actions(stages, _bound(spark, sf_dir).withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"])


_FINDING = {
    "kind": "CASE l_returnflag WHEN 'N' THEN 'unit' WHEN 'A' THEN 'invariant' ELSE 'spec' END", "file": "concat('f', l_orderkey % 20)", "name": "concat('n', l_partkey % 20)",
    "detail": "l_linenumber % 2", "fallback": "l_linestatus = 'O'",
}
_KINDS = ("unit", "invariant", "spec")


@query(
    "test_scan",
    f"WITH f AS (SELECT l_suppkey, {_columns(_FINDING)} FROM lineitem), k AS (SELECT l_suppkey, kind, file, name, count(DISTINCT detail) FILTER (NOT fallback) AS own FROM f GROUP BY ALL) SELECT l_suppkey, "
    + ", ".join(
        f"coalesce(sum(greatest(own, 1)) FILTER (kind = '{kind}'), 0)::BIGINT AS {kind}_count, count(*) FILTER (kind = '{kind}') > 0 AS has_{kind}, count(*) FILTER (kind = '{kind}' AND own = 0) AS {kind}_added" for kind in _KINDS
    )
    + " FROM k GROUP BY l_suppkey",
)
def test_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests of three kinds that each package has: those that a parser found, and those that only a fallback did."""
    return reports.scan_counts(_shaped(table(spark, sf_dir, "lineitem"), _FINDING), "l_suppkey", _KINDS)


_STATUS = "CASE WHEN o_orderkey % 7 > 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'completed' ELSE 'failed' END WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'running' END"
_TIMEOUT_DAYS = 900


@query(
    "job_progress",
    f"""
    WITH i AS (SELECT o_custkey, o_orderdate, {_STATUS} AS status FROM orders), n AS (SELECT o_custkey, count(*) AS n_items, count(*) FILTER (status = 'pending') AS n_pending, count(*) FILTER (status = 'running') AS n_running,
        count(*) FILTER (status = 'completed') AS n_completed, count(*) FILTER (status = 'failed') AS n_failed,
        count(*) FILTER (status = 'running' AND o_orderdate <= TIMESTAMP '2001-08-01' - INTERVAL {_TIMEOUT_DAYS} DAY) AS n_stale FROM i GROUP BY o_custkey)
    SELECT *, n_pending = 0 AND n_running = 0 AS done, n_running = 0 AS cancellable FROM n
    """,
)
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a job's items: by status, stale ones, and whether the job is done."""
    items = table(spark, sf_dir, "orders").select("o_custkey", F.expr(_STATUS).alias("status"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    return reports.job_progress(items, "o_custkey", F.lit("2001-08-01 00:00:00").cast("timestamp"), _TIMEOUT_DAYS * 86_400)


_ZONE = "CASE event_id % 6 WHEN 0 THEN 'Z' WHEN 1 THEN '+05:30' WHEN 2 THEN '-08:00' WHEN 3 THEN '' WHEN 4 THEN 'z' ELSE '+1:00' END"


@query(
    "rfc3339_times",
    """
    WITH e AS (SELECT event_id, epoch_us(ts) AS own, CASE event_id % 6 WHEN 0 THEN 0 WHEN 1 THEN -19800 WHEN 2 THEN 28800 WHEN 4 THEN 0 END AS seconds, epoch_us(TIMESTAMP '2024-01-20') AS now FROM events),
    t AS (SELECT *, own + seconds * 1000000::BIGINT AS us FROM e)
    SELECT event_id, us, strftime(make_timestamp(us // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS text, coalesce(now - us >= 86400000000, false) AS is_stale, now - own // 1000000 * 1000000 >= 604800000000 AS is_expired FROM t
    """,
)
def rfc3339_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of events as text in six zones, some of them malformed, read and written again; stale ones, and files that a name's time lets expire."""
    written = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.expr(_ZONE))
    name = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH-mm-ss"), F.lit("-notes.md"))
    at, now = times.parse_rfc3339(F.col("written")), times.parse_rfc3339(F.lit("2024-01-20T00:00:00Z"))
    return table(spark, sf_dir, "events").select("event_id", written.alias("written"), name.alias("name")).select(
        "event_id", F.unix_micros(at).alias("us"), times.format_rfc3339(at).alias("text"), times.is_stale(at, now, 86_400).alias("is_stale"), times.is_expired(F.col("name"), now, 7).alias("is_expired")
    )
