"""Listings, forks, string functions and wide edge keys, stated on the driver's tables.

part stands for types, orders for functions, lineitem for their instructions, conversations for threads, nation for a
catalogue of models, events for rollout items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from traceloom.functions import strings
from traceloom.operators import dataflow, graph, sequence
from traceloom.plans.registry import query, table
from traceloom.plans.trace import events


@query(
    "fork_turns",
    """
    WITH RECURSIVE o AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    r(user_id, n, turns, forks) AS (SELECT user_id, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM (SELECT DISTINCT user_id FROM events)
        UNION ALL SELECT o.user_id, o.n,
            CASE WHEN event_type = 'error' THEN turns[1:greatest(len(turns) - 2, 0)] WHEN event_type IN ('click', 'view') THEN list_append(turns, event_id) ELSE turns END,
            CASE WHEN event_type = 'error' AND len(turns) > 0 THEN list_filter(forks, lambda f: f < turns[greatest(len(turns) - 1, 1)])
                WHEN event_type IN ('click', 'signup') THEN list_append(forks, event_id) ELSE forks END
        FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
    SELECT user_id, unnest(forks) AS event_id FROM (SELECT user_id, arg_max(forks, n) AS forks FROM r GROUP BY user_id)
    """,
)
def fork_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks are turns and forks, views turns only, signups forks only; an error takes the last two turns back."""
    kind = F.col("event_type")
    return sequence.fork_turns(events(spark, sf_dir), "user_id", "event_id", kind.isin("click", "view"), kind.isin("click", "signup"), F.when(kind == "error", 2))


@query("keyset_page_back", "SELECT o_orderdate, o_orderkey FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1996-06-01', 100) ORDER BY o_orderdate, o_orderkey LIMIT 50")
def keyset_page_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page before a cursor of date and key."""
    return sequence.page_before(table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], ["1996-06-01", 100], 50)


@query(
    "catalog_priority",
    """
    SELECT n_name, place, shown AND place = min(place) FILTER (shown) OVER () AS is_default
    FROM (SELECT n_name, n_nationkey % 4 <> 0 AS shown, row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS place FROM nation)
    """,
)
def catalog_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue by priority, ties as they come; the first one shown is the default. A catalogue has tens of rows."""
    placed = table(spark, sf_dir, "nation").withColumn("place", F.row_number().over(Window.orderBy("n_regionkey", "n_nationkey"))).withColumn("shown", F.col("n_nationkey") % 4 != 0)
    first = F.min(F.when(F.col("shown"), F.col("place"))).over(Window.partitionBy())
    return placed.select("n_name", "place", (F.col("shown") & (F.col("place") == first)).alias("is_default"))


_FUZZY = "t.*?r.*?e.*?s"


@query(
    "fuzzy_subsequence",
    f"""
    SELECT page_id, url, (64 + CASE WHEN regexp_matches(url, '(?is)^(.*?[^a-z0-9])?{_FUZZY}') THEN 8 ELSE 0 END - (length(span) - 4))::BIGINT AS score
    FROM (SELECT page_id, url, regexp_extract(url, '(?is){_FUZZY}', 0) AS span FROM pages) WHERE length(span) > 0 ORDER BY score DESC, url, page_id LIMIT 50
    """,
)
def fuzzy_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best paths that hold the letters of a query in their order, by score, then by path."""
    scored = table(spark, sf_dir, "pages").select("page_id", "url", strings.subsequence_score(F.col("url"), "tres").alias("score"))
    return scored.where("score IS NOT NULL").orderBy(F.col("score").desc(), "url", "page_id").limit(50)


@query(
    "thread_list",
    """
    SELECT conv_id, role AS source_kind, (conv_id % 3)::INTEGER AS provider FROM conversations
    WHERE turn = 0 AND role IN ('user', 'system') AND conv_id % 3 IN (0, 2) AND conv_id % 5 <> 0 AND contains(lower(text), 'the')
    """,
)
def thread_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads by kind of source, provider, archive flag and a search term in any case."""
    threads = table(spark, sf_dir, "conversations").where("turn = 0").withColumn("provider", (F.col("conv_id") % 3).cast("int")).withColumn("archived", F.col("conv_id") % 5 == 0)
    asked = F.col("role").isin("user", "system") & F.col("provider").isin(0, 2) & ~F.col("archived") & F.lower("text").contains("the")
    return threads.where(asked).select("conv_id", F.col("role").alias("source_kind"), "provider")


_KINDS = ("bool", "u8", "u64", "address", "vector<u8>", "string")


@query(
    "shareable_constants",
    f"""
    SELECT p_partkey FROM (SELECT p_partkey, {list(_KINDS)}[1 + p_size % 6] AS kind, CASE WHEN p_partkey % 2 = 0 THEN '0x' || p_partkey ELSE p_name END AS value FROM part)
    WHERE kind IN ('bool', 'u8', 'u16', 'u32', 'u64', 'u128', 'u256', 'address') AND regexp_full_match(value, '[A-Za-z0-9_@]*')
    """,
)
def shareable_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*(F.lit(k) for k in _KINDS)), 1 + F.col("p_size") % 6)
    value = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("0x"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").where(strings.shareable_constant(kind, value)).select("p_partkey")


_OPCODES = ("BrTrue", "BrFalse", "Branch", "VariantSwitch", "Call", "Ret")


@query(
    "cfg_edge_kinds",
    f"""
    WITH c AS (SELECT l_orderkey AS fn, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
    i AS (SELECT fn, pos, n, {list(_OPCODES)}[1 + l_partkey % 6] AS op, l_suppkey % n AS j, l_partkey % n AS k FROM c),
    s AS (SELECT fn, pos, n, op, CASE WHEN op = 'VariantSwitch' THEN [j, k] WHEN op IN ('BrTrue', 'BrFalse', 'Branch') THEN [j] ELSE []::BIGINT[] END AS jumps,
        unnest(list_distinct(CASE op WHEN 'VariantSwitch' THEN [j, k] WHEN 'Branch' THEN [j] WHEN 'Ret' THEN []::BIGINT[] WHEN 'Call' THEN [pos + 1] ELSE [j, pos + 1] END)) AS target FROM i)
    SELECT fn, pos AS source_offset, target AS target_offset, CASE WHEN op = 'BrTrue' THEN CASE WHEN list_contains(jumps, target) THEN 'true' ELSE 'false' END
        WHEN op = 'BrFalse' THEN CASE WHEN list_contains(jumps, target) THEN 'false' ELSE 'true' END WHEN op = 'Branch' THEN 'branch' WHEN op = 'VariantSwitch' THEN 'variant'
        ELSE 'fallthrough' END AS kind FROM s WHERE target < n
    """,
)
def cfg_edge_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successors of instructions with their labels; jumps go to an instruction of the same function."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    code = table(spark, sf_dir, "lineitem").withColumn("at", (F.row_number().over(order) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")))
    op = F.element_at(F.array(*(F.lit(o) for o in _OPCODES)), (1 + F.col("l_partkey") % 6).cast("int"))
    code = code.select(F.col("l_orderkey").alias("fn"), "at", "n", op.alias("op"), (F.col("l_suppkey") % F.col("n")).alias("j"), (F.col("l_partkey") % F.col("n")).alias("k"))
    none = F.array().cast("array<bigint>")
    jumps = F.when(F.col("op") == "VariantSwitch", F.array("j", "k")).when(F.col("op").isin("BrTrue", "BrFalse", "Branch"), F.array("j")).otherwise(none)
    falls = F.when(F.col("op").isin("BrTrue", "BrFalse", "Call"), F.array(F.col("at") + 1)).otherwise(none)
    edges = code.withColumn("jumps", jumps).withColumn("target", F.explode(F.array_distinct(F.concat("jumps", falls)))).where("target < n")
    kind = graph.edge_kind(F.col("op"), F.col("at"), F.col("target"), F.col("jumps"))
    return edges.select("fn", F.col("at").alias("source_offset"), F.col("target").alias("target_offset"), kind.alias("kind"))


@query("property_edges", "SELECT 'call:' || (row_number() OVER (ORDER BY src, dst) - 1) || ':' || src || ':' || dst AS id, src, dst FROM (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem)")
def property_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a generic graph, named by kind, place and ends."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    return graph.positional_ids(edges, "call", ["src", "dst"])


@query(
    "state_edges",
    """
    SELECT l_partkey AS source, l_suppkey AS target, l_returnflag AS access_kind, l_linestatus AS field_name, l_linenumber AS via_function, count(*) AS n_spans, min(l_shipdate) AS first_span,
        list_sort(list(DISTINCT 'discount:' || (l_discount > 0.05) || ',tax:' || (l_tax > 0.04))) AS evidence FROM lineitem GROUP BY 1, 2, 3, 4, 5
    """,
)
def state_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses by a key of five columns; kinds of evidence, of which there are few, sorted and once each."""
    evidence = F.concat(F.lit("discount:"), (F.col("l_discount") > 0.05).cast("string"), F.lit(",tax:"), (F.col("l_tax") > 0.04).cast("string"))
    key = {"source": "l_partkey", "target": "l_suppkey", "access_kind": "l_returnflag", "field_name": "l_linestatus", "via_function": "l_linenumber"}
    return table(spark, sf_dir, "lineitem").groupBy(*(F.col(c).alias(name) for name, c in key.items())).agg(
        F.count(F.lit(1)).alias("n_spans"), F.min("l_shipdate").alias("first_span"), F.sort_array(F.collect_set(evidence)).alias("evidence")
    )


@query(
    "program_totals",
    "SELECT (SELECT count(*) FROM nation) AS modules, (SELECT count(*) FROM orders) AS functions, (SELECT count(*) FROM lineitem) AS instructions, (SELECT count(*) FROM part) AS types, (SELECT sum(p_size) FROM part)::BIGINT AS fields",
)
def program_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a package's view; only one row of each table's counts is joined."""
    names = {"modules": "nation", "functions": "orders", "instructions": "lineitem", "types": "part"}
    counts = [table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n") for name, t in names.items()]
    rows = counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])
    rows = rows.unionByName(table(spark, sf_dir, "part").agg(F.sum("p_size").cast("long").alias("n")).select(F.lit("fields").alias("what"), "n"))
    return rows.agg(*(F.max(F.when(F.col("what") == name, F.col("n"))).alias(name) for name in (*names, "fields")))


@query(
    "search_ranges",
    """
    WITH p AS (SELECT doc_id, unnest(string_split(lower(text), 'license')) AS piece, generate_subscripts(string_split(lower(text), 'license'), 1) AS k, len(string_split(lower(text), 'license')) AS n FROM documents),
    e AS (SELECT doc_id, k, n, (sum(length(piece) + 7) OVER (PARTITION BY doc_id ORDER BY k))::INTEGER AS stop FROM p)
    SELECT doc_id, stop - 7 AS start, stop AS "end" FROM e WHERE k < n
    """,
)
def search_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a term stands in each whole text, in any case."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(strings.match_ranges(F.col("text"), "License")).alias("r"))
    return found.select("doc_id", "r.start", "r.end")


_SIGNATURE = "'public fun f' || p_partkey || '<T: store>(x: &mut pool::' || p_type || ', y: vector<' || p_brand || '>, z: Map<u64, (T, bool)>): ' || p_type"


@query(
    "parameters",
    f"""
    WITH s AS (SELECT p_partkey, p_type, p_brand, p_size, {_SIGNATURE} AS sig FROM part), a AS (SELECT *, regexp_extract(sig, '\\((.*)\\): ', 1) AS params FROM s)
    SELECT p_partkey, params, ['x: &mut pool::' || p_type, ' y: vector<' || p_brand || '>', ' z: Map<u64, (T, bool)>'] AS parts,
        list_contains(string_split_regex(params, '[\\s&,:<>()\\[\\]{{}};]'), CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'pools' END) AS has_type FROM a
    """,
)
def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signature's parameters, cut at the commas outside brackets, and whether they name a type."""
    signed = table(spark, sf_dir, "part").withColumn("sig", F.expr(_SIGNATURE)).withColumn("params", strings.function_parameters(F.col("sig")))
    wanted = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("pool::"), F.col("p_type"))).otherwise("m::pools")
    return signed.select("p_partkey", "params", strings.split_top_level(F.col("params"), ",").alias("parts"), strings.refers_to_type(F.col("params"), wanted).alias("has_type"))


@query(
    "csv_values",
    """
    SELECT event_id, event_type AS text_cell, user_id::VARCHAR AS number_cell, (value > 50)::VARCHAR AS bool_cell, '[' || user_id || ',' || event_id || ']' AS array_cell,
        '{"user":' || user_id || ',"kind":"' || event_type || '"}' AS object_cell, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS null_cell FROM events
    """,
)
def csv_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON values of every type as CSV cells."""
    rows = events(spark, sf_dir).select(
        "event_id", F.col("event_type").alias("text_cell"), F.col("user_id").alias("number_cell"), (F.col("value") > 50).alias("bool_cell"), F.array("user_id", "event_id").alias("array_cell"),
        F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind")).alias("object_cell"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("null_cell"),
    )
    return rows.select("event_id", *(strings.csv_value(F.col(c), rows.schema[c].dataType).alias(c) for c in rows.columns[1:]))


_ALIASES = (("2", "sui"), ("2a", "pool"), ("2ab", "vault"))
_CALL = "'call 0x00' || ['2', '2A', '2ab', '3'][1 + l_partkey % 4] || '::m::f(@0x' || ['2', '2a', '2AB', '3'][1 + l_suppkey % 4] || ') 02a::x'"


@query(
    "rewritten_addresses",
    f"""
    WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_CALL} AS source FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'call ' || ['sui', 'pool', 'vault', '0x003'][1 + l_partkey % 4] || '::m::f(@' || ['sui', 'pool', 'vault', '0x3'][1 + l_suppkey % 4] || ') pool::x' AS source FROM s
    """,
)
def rewritten_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, c: F.element_at(F.array(*(F.lit(v) for v in values)), (1 + F.col(c) % 4).cast("int"))
    source = F.concat(F.lit("call 0x00"), pick(("2", "2A", "2ab", "3"), "l_partkey"), F.lit("::m::f(@0x"), pick(("2", "2a", "2AB", "3"), "l_suppkey"), F.lit(") 02a::x"))
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(*keys, strings.rewrite_addresses(source, _ALIASES).alias("source"))


@query(
    "enriched_functions",
    """
    WITH c AS (SELECT l_partkey AS module, l_suppkey AS name, count(*) AS n_instructions FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2),
    i AS (SELECT l_partkey AS module, l_suppkey AS name, min(l_orderkey) AS id FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
    SELECT id, module, name, n_instructions FROM i JOIN c USING (module, name)
    """,
)
def enriched_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed functions that have code, by module and name; the others are left out."""
    lines = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_partkey": "module", "l_suppkey": "name"})
    code = lines.where("l_linestatus = 'O'").groupBy("module", "name").agg(F.count(F.lit(1)).alias("n_instructions"))
    indexed = lines.where("l_returnflag = 'R'").groupBy("module", "name").agg(F.min("l_orderkey").alias("id"))
    return indexed.join(code, ["module", "name"]).select("id", "module", "name", "n_instructions")


_SECTIONS = ("operations", "operations", "operations", "operations", "source_excerpts", "callers", "callees", "reachable_callees", "related_types", "diagnostics", "operation_histogram", "field_access")
_STEP_SQL = """
    WITH p AS (SELECT user_id AS id, event_id AS place, {sections}[1 + event_id % 12] AS section,
        CASE event_type WHEN 'click' THEN 'Call' WHEN 'purchase' THEN 'WriteField' WHEN 'view' THEN 'Branch' WHEN 'error' THEN 'Abort' ELSE 'Const' END AS kind,
        CASE WHEN event_id % 12 = 4 THEN repeat(event_type || chr(10), 12) ELSE event_type || ':' || user_id END AS text,
        CASE WHEN event_id % 12 < 4 THEN props END AS metadata, CASE WHEN event_id % 3 = 0 THEN event_type END AS span FROM events),
    z AS (SELECT *, strlen(text) AS own, coalesce(strlen(metadata), 0) AS meta, coalesce(strlen(span), 0) AS sp, CASE WHEN section = 'source_excerpts' THEN 8 * strlen(split_part(text, chr(10), 1)) + 7 END AS short FROM p),
    a AS (SELECT id, 1 AS step, 0 AS sub, meta AS saves FROM z WHERE section = 'operations' AND metadata IS NOT NULL
        UNION ALL SELECT id, 2, 0, own - short FROM z WHERE section = 'source_excerpts'
        UNION ALL SELECT id, 3, -place, own + sp FROM z WHERE section = 'operations' AND kind = 'Const'
        UNION ALL SELECT id, CASE section WHEN 'callers' THEN 4 WHEN 'callees' THEN 5 WHEN 'reachable_callees' THEN 6 WHEN 'related_types' THEN 7 WHEN 'diagnostics' THEN 8 WHEN 'operation_histogram' THEN 10 ELSE 11 END, 0, own + meta + sp
            FROM z WHERE section NOT IN ('operations', 'source_excerpts')
        UNION ALL SELECT id, 9, 0, short FROM z WHERE section = 'source_excerpts'
        UNION ALL SELECT id, 12, 0, sp FROM z WHERE section = 'operations' AND kind <> 'Const' AND span IS NOT NULL
        UNION ALL SELECT id, CASE WHEN kind IN ('Branch', 'Abort') THEN 13 ELSE 14 END, -place, own FROM z WHERE section = 'operations' AND kind <> 'Const'),
    g AS (SELECT id, step, sub, sum(saves) AS saves FROM a GROUP BY 1, 2, 3), t AS (SELECT id, sum(own + meta + sp) AS total FROM z GROUP BY id),
    b AS (SELECT g.*, total - coalesce(sum(saves) OVER (PARTITION BY id ORDER BY step, sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g JOIN t USING (id)),
    d AS (SELECT id, sum(saves) AS saved, list_sort(list(DISTINCT {steps}[step])) AS reasons FROM b WHERE (before + 3) // 4 > {budget} GROUP BY id)
    SELECT id, ((total - coalesce(saved, 0) + 3) // 4)::BIGINT AS tokens, coalesce(reasons, []) AS reasons FROM t LEFT JOIN d USING (id)
    """


@query("budget_steps", _STEP_SQL.format(sections=list(_SECTIONS), steps=list(dataflow.STEPS), budget=150))
def budget_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context packs of a user's events, cut to 150 tokens by the fourteen steps."""
    slot = F.col("event_id") % 12
    kinds = {"click": "Call", "purchase": "WriteField", "view": "Branch", "error": "Abort"}
    kind = F.coalesce(*(F.when(F.col("event_type") == e, k) for e, k in kinds.items()), F.lit("Const"))
    text = F.when(slot == 4, F.repeat(F.concat("event_type", F.lit("\n")), 12)).otherwise(F.concat_ws(":", "event_type", "user_id"))
    parts = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), F.col("event_id").alias("place"), F.element_at(F.array(*(F.lit(s) for s in _SECTIONS)), (1 + slot).cast("int")).alias("section"), kind.alias("kind"), text.alias("text"),
        F.when(slot < 4, F.col("props")).alias("metadata"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("span"),
    )
    return dataflow.trim_steps(parts, 150)
