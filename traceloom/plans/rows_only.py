"""Queries that SQL can't state: sequential simulations, streams, folds, text rules. Tests hold them against fixtures."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from traceloom.functions import scoring
from traceloom.operators import dataflow, sequence, source_rules
from traceloom.plans.registry import ORACLES, query, table
from traceloom.plans import trace  # noqa: F401  its SQL states the result of the stream of rollbacks
from traceloom.scratch import scratch_dir
from traceloom.sources import snapshots, tables, threads
from traceloom.streaming import retraction, stateful


@query("dataflow_edges")
def dataflow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as instructions: each pushes one value, returned lines take two."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    code = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("fn"), F.row_number().over(order).alias("pos"), F.when(F.col("l_returnflag") == "R", 2).otherwise(0).alias("pops"), F.lit(1).alias("pushes")
    )
    return dataflow.stack_edges(code)


@query("budget_cascade")
def budget_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as context packs, roles and turns standing for sections."""
    section = F.element_at(F.array(*(F.lit(x) for x in ("signature", *dataflow.CASCADE))), (F.col("turn") % (len(dataflow.CASCADE) + 1) + 1).cast("int"))
    packs = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), section.alias("section"), "text")
    return dataflow.trim_packs(packs, 500)


_BODIES = ("LIMIT", "if (k.x == true) { LIMIT } else { 2 }", "(k.x / 2) * 3", "loop { k.x = LIMIT; }", "while (true) { break; LIMIT }")
_TAILS = ("", "fun alone() { 1 }", "struct Lost { x: u64 } // struct Comment")


@query(
    "source_findings",
    """
    SELECT 'bool_judgement' AS rule, 'info' AS severity, p_partkey AS module, 'true' AS name FROM part WHERE p_size % 5 = 1
    UNION ALL SELECT 'precision_loss', 'warning', p_partkey, '*' FROM part WHERE p_size % 5 = 2
    UNION ALL SELECT 'unused_const', 'info', p_partkey, 'LIMIT' FROM part WHERE p_size % 5 = 2
    UNION ALL SELECT 'infinite_loop', 'warning', p_partkey, 'loop' FROM part WHERE p_size % 5 = 3
    UNION ALL SELECT 'unused_private_function', 'info', p_partkey, 'alone' FROM part WHERE p_partkey % 3 = 1
    UNION ALL SELECT 'unused_struct', 'info', p_partkey, 'Lost' FROM part WHERE p_partkey % 3 = 2
    """,
)
def source_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module for each part, put together from pieces that hold findings and pieces that hold none."""
    pick = lambda pieces, at: F.element_at(F.array(*(F.lit(x) for x in pieces)), (at + 1).cast("int"))
    head = F.lit("module a::m { const LIMIT: u64 = 1; struct Kept { x: u64 } public fun run(k: Kept): u64 { ")
    text = F.concat(head, pick(_BODIES, F.col("p_size") % 5), F.lit(" }\n"), pick(_TAILS, F.col("p_partkey") % 3), F.lit("\n}"))
    return source_rules.all_findings(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("module"), text.alias("text")))


@query("csv_roundtrip", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name || ', \"quoted\"' AS n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, with commas and quotes in it, and read again."""
    path = f"{scratch_dir(spark)}/csv-{uuid.uuid4().hex}"
    tables.write_csv(table(spark, sf_dir, "nation").withColumn("n_name", F.concat("n_name", F.lit(', "quoted"'))), path)
    return tables.read_csv(spark, path)


def _streamed(spark: SparkSession, sf_dir: str, make, schema: str) -> DataFrame:
    """All events through a streaming query, whose output is written and read."""
    folder = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    # A pattern for the table's own path: by a plain path, streams read folders only.
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    out = make(events).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")


@query("stream_hysteresis")
def stream_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's queue, sampled at the events."""

    def make(events: DataFrame) -> DataFrame:
        queue = events.select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_id") % 12).alias("lines"), F.floor("value").alias("age"))
        return stateful.hysteresis(queue, "user_id")

    return _streamed(spark, sf_dir, make, "user_id bigint, at bigint, mode string")


@query("stream_idle_timeout")
def stream_idle_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' streams that a signup completes."""

    def make(events: DataFrame) -> DataFrame:
        rows = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("event"))
        return stateful.idle(rows, "user_id", "ts", 6 * 3_600_000, "signup")

    return _streamed(spark, sf_dir, make, "user_id bigint, n bigint, outcome string")


@query("stream_sessions")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debounced bursts as the stream closes them."""
    make = lambda events: stateful.debounced(events.select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", "6 hours")
    return _streamed(spark, sf_dir, make, "user_id bigint, start timestamp, end timestamp, n bigint")


@query("stream_rollbacks", ORACLES["rollback_turns"])
def stream_rollbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks that no later error took back, as four batches of events add them and take them back."""
    folder = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").where("event_type IN ('click', 'error')").select("user_id", "event_id", F.when(F.col("event_type") == "error", 1).alias("n"))
    last = events.agg(F.max("event_id").alias("last")).first()["last"] or 0
    # Each batch is all that was written since the one before, in as many files as there are tasks.
    for k in range(4):
        events.where(F.floor(F.col("event_id") * 4 / (last + 1)) == k).write.mode("append").parquet(f"{folder}/events")
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/events")
        retraction.keep_changes(retraction.rollback_changes(stream, "user_id", "event_id", "n"), folder).awaitTermination()
    return retraction.standing(spark, folder, "user_id", "event_id")


@query(
    "package_snapshots",
    """
    WITH one AS (SELECT 'suppliers' AS tab, s_nationkey::VARCHAR AS package_id, s_acctbal AS v FROM supplier UNION ALL SELECT 'customers', c_nationkey::VARCHAR, c_acctbal FROM customer),
    two AS (SELECT * FROM one WHERE package_id::INTEGER % 3 <> 0 UNION ALL SELECT tab, package_id, v + 1 FROM one WHERE package_id::INTEGER % 3 = 0 AND NOT (tab = 'customers' AND package_id = '3') AND package_id <> '6')
    SELECT 1 AS snapshot, tab, package_id, count(*) AS n, round(sum(v), 2) AS total FROM one GROUP BY ALL UNION ALL SELECT 2, tab, package_id, count(*), round(sum(v), 2) FROM two GROUP BY ALL
    """,
)
def package_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as packages of two tables: every third one is replaced at once, one of them without customers, one is removed;
    the snapshot before stays as it was."""
    root = f"{scratch_dir(spark)}/packages-{uuid.uuid4().hex}"
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("package_id"), F.col("s_acctbal").alias("v"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("package_id"), F.col("c_acctbal").alias("v"))
    snapshots.commit(spark, root, {"suppliers": suppliers, "customers": customers})
    again = lambda rows: rows.where("package_id % 3 = 0 AND package_id <> 6").withColumn("v", F.col("v") + 1)
    snapshots.commit(spark, root, {"suppliers": again(suppliers), "customers": again(customers).where("package_id <> 3")}, removed=spark.createDataFrame([("6",)], "package_id string"))
    read = lambda k, name: snapshots.read(spark, root, name, k).select(F.lit(k).alias("snapshot"), F.lit(name).alias("tab"), "package_id", "v")
    rows = read(1, "suppliers").unionByName(read(1, "customers")).unionByName(read(2, "suppliers")).unionByName(read(2, "customers"))
    return rows.groupBy("snapshot", "tab", "package_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("total"))


@query(
    "graph_digests",
    """
    WITH e AS (SELECT l_returnflag AS graph, l_orderkey AS src, l_partkey AS dst, l_linenumber AS span, nullif(l_linestatus, 'O') AS field FROM lineitem),
    p AS (SELECT graph, sha256(concat_ws('|', row_number() OVER (PARTITION BY graph ORDER BY src, dst, span, field NULLS FIRST) - 1,
        octet_length(src::VARCHAR::BLOB) || ':' || src, octet_length(dst::VARCHAR::BLOB) || ':' || dst, octet_length(span::VARCHAR::BLOB) || ':' || span, coalesce(octet_length(field::BLOB) || ':' || field, '-'))) AS h FROM e)
    SELECT graph, count(*) AS n, sha256(concat_ws('|', count(*), sum(('0x' || substr(h, 1, 15))::BIGINT), sum(('0x' || substr(h, 16, 15))::BIGINT), sum(('0x' || substr(h, 31, 15))::BIGINT), sum(('0x' || substr(h, 46, 15))::BIGINT))) AS digest
    FROM p GROUP BY graph
    """,
)
def graph_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each graph's edges in their canonical order."""
    edges = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("graph"), F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("span"), F.nullif("l_linestatus", F.lit("O")).alias("field")
    )
    return sequence.sequence_digests(edges, ["graph"], ["src", "dst", "span", "field"])


@query(
    "edge_spans",
    """
    SELECT src, dst, span, row_number() OVER (PARTITION BY src, dst ORDER BY span) - 1 AS place, n_times
    FROM (SELECT l_suppkey AS src, l_partkey % 10 AS dst, l_quantity::INTEGER AS span, count(*) AS n_times FROM lineitem GROUP BY ALL)
    """,
)
def edge_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct spans of each edge in order, beside the edges."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 10).alias("dst"), F.col("l_quantity").cast("int").alias("span"))
    return sequence.spans_of_edges(lines, ["src", "dst"], ["span"])


_SOURCES = ("cli", "vscode", "exec", "subagent:review", "subagent:other:x")
_REQUESTS = (("none", ()), ("interactive", ("vscode",)), ("mixed", ("cli", "subAgent")), ("sub", ("subAgentOther", "exec")))


@query(
    "thread_sources",
    f"""
    WITH t AS (SELECT conv_id AS thread, {list(_SOURCES)}[conv_id % 5 + 1] AS source FROM conversations),
    w AS (SELECT * FROM (VALUES ('none', 'cli'), ('none', 'vscode'), ('interactive', 'vscode'), ('mixed', 'cli'), ('mixed', 'subagent:review'), ('mixed', 'subagent:other:x'), ('sub', 'exec'), ('sub', 'subagent:other:x')) v(request, source))
    SELECT request, thread, source, count(*) AS n_turns FROM t JOIN w USING (source) GROUP BY ALL
    """,
)
def thread_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as logs by source; requests for interactive kinds read only their folders, others are filtered after."""
    folder = f"{scratch_dir(spark)}/threads-{uuid.uuid4().hex}"
    source = F.element_at(F.array(*(F.lit(x) for x in _SOURCES)), (F.col("conv_id") % 5 + 1).cast("int"))
    table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread"), "turn", "role", "text", source.alias("source")).write.partitionBy("source").json(folder)
    found = None
    for request, kinds in _REQUESTS:
        own = threads.thread_logs(spark, folder, kinds).select(F.lit(request).alias("request"), "thread", "source")
        found = own if found is None else found.unionByName(own)
    return found.groupBy("request", "thread", "source").agg(F.count(F.lit(1)).alias("n_turns"))


_PIECES = ("k.x", "if (k.x == 1) { while_ } else { abort 1 }", "assert!(k.x > 0 && k.y || k.z, 1)", "transfer::share_object(k); object::new(ctx)", "loop { match (k) { table::add(t) } }", "#while (true) { bag::x /* if */ }")
_POINTS = (0, 2, 3, 3, 3, 1)


@query(
    "function_complexity",
    f"""
    WITH f AS (SELECT p_partkey AS function, p_brand AS module, 1 + {list(_POINTS)}[p_size % 6 + 1] + {list(_POINTS)}[p_partkey % 6 + 1] * (p_size % 4) + p_size % 3 + CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 0 END AS score, p_partkey % 5 = 0 AS callable FROM part)
    SELECT function, module, score, score > CASE WHEN callable THEN 12 ELSE 15 END AS above, sum(score) OVER (PARTITION BY module) AS module_score, sum(score) OVER (PARTITION BY module) > 80 AS module_above FROM f
    """,
)
def function_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The complexity of each part's function by what its source says, and of its module, against their thresholds."""
    pick = lambda at: F.element_at(F.array(*(F.lit(x) for x in _PIECES)), (at % 6 + 1).cast("int"))
    key, size = F.col("p_partkey"), F.col("p_size")
    source = F.concat(F.lit("fun f() { "), pick(size), F.lit("; "), F.repeat(F.concat(pick(key), F.lit("; ")), size % 4), F.lit("// while &&\n}"))
    parts = table(spark, sf_dir, "part").select(key.alias("function"), F.col("p_brand").alias("module"), source.alias("source"), (size % 3).alias("types"), (key % 5 == 0).alias("callable"))
    return scoring.complexities(parts.withColumn("source", source_rules.sanitized(F.col("source"))), "module", "source", F.col("types"), F.col("callable")).select("function", "module", "score", "above", "module_score", "module_above")
