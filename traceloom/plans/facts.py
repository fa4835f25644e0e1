"""Queries on nested facts, evidence sets, predicates and text positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from traceloom.functions import scoring
from traceloom.operators import patterns
from traceloom.plans.registry import query, table


@query("nest_fields", "SELECT n_name, coalesce(list(s_name ORDER BY s_name) FILTER (s_name IS NOT NULL), []) AS fields FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def nest_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types with their fields nested, those without any included."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier").select("s_nationkey", "s_name")
    joined = nation.join(supplier, nation.n_nationkey == supplier.s_nationkey, "left")
    return joined.groupBy("n_name").agg(F.array_sort(F.collect_list("s_name")).alias("fields"))


@query(
    "reverse_calls_substring",
    """
    WITH calls AS (SELECT l_orderkey AS caller, CASE l_linenumber % 4 WHEN 0 THEN 'm' || p_size % 8 || '::' || name || '(x); ' WHEN 1 THEN name || '<u64>(x); '
        WHEN 2 THEN 'my_' || name || '(x); ' ELSE name || ' + 1; ' END AS call FROM lineitem JOIN (SELECT *, replace(p_name, ' ', '_') AS name FROM part) ON l_partkey = p_partkey),
    bodies AS (SELECT caller, 'm' || caller % 8 AS module, string_agg(call, '') AS body FROM calls GROUP BY caller),
    names AS (SELECT 'm' || p_size % 8 AS module, replace(p_name, ' ', '_') AS name, count(*) AS n FROM part GROUP BY 1, 2)
    SELECT caller, names.module AS callee_module, name AS callee, n AS n_functions FROM bodies JOIN names
    ON contains(body, names.module || '::' || name || '(') OR contains(body, names.module || '::' || name || '<')
    OR (names.module = bodies.module AND (contains(body, name || '(') OR contains(body, name || '<')))
    """,
)
def reverse_calls_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers of functions by the text of their calls: orders are bodies, their lines call parts. Functions of one name in
    one module are one callee with their number."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.concat(F.lit("m"), F.col("p_size") % 8).alias("module"))
    name, line = F.col("name"), F.col("l_linenumber") % 4
    call = (
        F.when(line == 0, F.concat("module", F.lit("::"), name, F.lit("(x); "))).when(line == 1, F.concat(name, F.lit("<u64>(x); ")))
        .when(line == 2, F.concat(F.lit("my_"), name, F.lit("(x); "))).otherwise(F.concat(name, F.lit(" + 1; ")))
    )
    lines = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("caller"), call.alias("call"))
    source = F.concat(F.lit("fun small_ring(x) { "), F.array_join(F.collect_list("call"), ""), F.lit("}"))
    bodies = lines.groupBy("caller").agg(source.alias("source")).withColumn("module", F.concat(F.lit("m"), F.col("caller") % 8))
    sized = parts.groupBy(F.col("module").alias("callee_module"), F.col("name").alias("callee")).agg(F.count(F.lit(1)).alias("n_functions"))
    return patterns.reverse_calls(bodies, parts).join(sized, ["callee_module", "callee"]).select("caller", "callee_module", "callee", "n_functions")


@query(
    "wrapper_evidence",
    "WITH w AS (SELECT DISTINCT p_name AS name, unnest(string_split(p_name, ' ')) AS token FROM part) SELECT DISTINCT a.name AS object, b.name AS wrapper FROM w a JOIN w b USING (token) WHERE a.name <> b.name",
)
def wrapper_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that hold a token of another type; an equi-join on tokens. Names that share several meet at the least of them, so
    that each pair is made once."""
    words = table(spark, sf_dir, "part").select(F.col("p_name").alias("object")).distinct().withColumn("tokens", F.array_distinct(F.split("object", " ")))
    words = words.withColumn("token", F.explode("tokens"))
    other = words.select(F.col("object").alias("wrapper"), F.col("tokens").alias("_tokens"), "token")
    least = F.array_min(F.array_intersect("tokens", "_tokens"))
    return words.join(other, "token").where((F.col("object") != F.col("wrapper")) & (F.col("token") == least)).select("object", "wrapper")


@query(
    "admin_findings",
    """
    SELECT p_partkey, list_sort(list_intersect(list_distinct(string_split(p_name, ' ')), ['red', 'bolt', 'gear'])) AS capabilities, CASE WHEN p_size > 25 THEN 'high' ELSE 'medium' END AS severity
    FROM part WHERE list_has_any(string_split(p_name, ' '), ['red', 'bolt', 'gear'])
    """,
)
def admin_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Privileged names with the capabilities that they have, higher if guarded."""
    words, wanted = F.split("p_name", " "), F.array(*(F.lit(x) for x in ("red", "bolt", "gear")))
    found = table(spark, sf_dir, "part").where(F.arrays_overlap(words, wanted))
    return found.select("p_partkey", F.array_sort(F.array_intersect(words, wanted)).alias("capabilities"), scoring.first_match([(F.col("p_size") > 25, "high")], "medium").alias("severity"))


@query("unchecked_returns", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderstatus <> 'F'")
def unchecked_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select("o_orderkey", "o_orderstatus")
    return orders.join(returned, orders.o_orderkey == returned.l_orderkey, "left_semi")


@query(
    "noop_casts",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey",
)
def noop_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations whose source and target have one type."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    orders, customer = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.join(supplier, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "edge_evidence",
    "SELECT l_suppkey, l_returnflag, list(DISTINCT l_linestatus ORDER BY l_linestatus) AS evidence, count(*) AS n, min(l_partkey) AS first_target FROM lineitem GROUP BY l_suppkey, l_returnflag",
)
def edge_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges on a composite key, their evidence sorted and distinct."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.array_sort(F.collect_set("l_linestatus")).alias("evidence"), F.count(F.lit(1)).alias("n"), F.min("l_partkey").alias("first_target")
    )


@query("capability_merge", "SELECT user_id, event_type AS capability, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def capability_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata merged per capability, the last one wins."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("capability")).agg(F.max_by("value", "event_id").alias("value"))


@query(
    "diagnostics_top",
    "SELECT event_id, severity FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'Error' WHEN 'purchase' THEN 'Warning' ELSE 'Info' END AS severity FROM events) ORDER BY severity, event_id LIMIT 200",
)
def diagnostics_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics in the order of the severity's text, not its rank."""
    severity = scoring.first_match([(F.col("event_type") == "error", "Error"), (F.col("event_type") == "purchase", "Warning")], "Info")
    return table(spark, sf_dir, "events").select("event_id", severity.alias("severity")).orderBy("severity", "event_id").limit(200)


@query(
    "severity_ranked",
    """
    SELECT user_id, severity, n, row_number() OVER (PARTITION BY user_id ORDER BY CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, severity) AS place FROM (
        SELECT user_id, CASE WHEN value > 80 THEN 'high' WHEN value > 30 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n FROM events GROUP BY ALL)
    """,
)
def severity_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = scoring.first_match([(F.col("value") > 80, "high"), (F.col("value") > 30, "medium")], "low")
    found = table(spark, sf_dir, "events").groupBy("user_id", severity.alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    rank = scoring.ranked(F.col("severity"), {"high": 3, "medium": 2, "low": 1})
    return found.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(rank.desc(), "severity")))


@query("collection_caps", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 10")
def collection_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most ten artifacts of each collection, the largest first."""
    order = Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id")
    return table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars").withColumn("n", F.row_number().over(order)).where("n <= 10").select("source", "doc_id")


@query(
    "line_positions",
    """
    WITH p AS (SELECT doc_id, text, instr(text, 'License') AS place FROM documents), h AS (SELECT doc_id, substr(text, 1, place - 1) AS head FROM p WHERE place > 0)
    SELECT doc_id, (length(head) - length(replace(head, chr(10), '')) + 1)::BIGINT AS line, (length(string_split(head, chr(10))[-1]) + 1)::BIGINT AS col FROM h
    """,
)
def line_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line and column of an offset."""
    found = table(spark, sf_dir, "documents").select("doc_id", "text", F.instr("text", "License").alias("at")).where("at > 0")
    head = F.substr("text", F.lit(1), F.col("at") - 1)
    found = found.select("doc_id", head.alias("head"))
    line = F.length("head") - F.length(F.replace("head", F.lit("\n"), F.lit(""))) + 1
    return found.select("doc_id", line.cast("long").alias("line"), (F.length(F.substring_index("head", "\n", -1)) + 1).cast("long").alias("col"))


@query("line_excerpts", "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:3], chr(10)) AS excerpt FROM documents WHERE len(string_split(text, chr(10))) >= 2")
def line_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines two and three."""
    lines = F.split("text", "\n")
    return table(spark, sf_dir, "documents").where(F.size(lines) >= 2).select("doc_id", F.array_join(F.slice(lines, 2, 2), "\n").alias("excerpt"))


@query(
    "predicate_flags",
    """
    SELECT page_id, regexp_matches(url, '^https://') AS is_external, list_contains(string_split(url, '/'), 'fr') AS is_test, regexp_matches(lower(html), '<script|onclick') AS is_guarded,
        NOT regexp_matches(lower(url), 'vulnerable|safe|exploit|bug|malicious|critical|risk') AS is_neutral FROM pages
    """,
)
def predicate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reachability, test path, guard and neutrality predicates."""
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.col("url").rlike("^https://").alias("is_external"),
        F.array_contains(F.split("url", "/"), "fr").alias("is_test"),
        F.lower("html").rlike("<script|onclick").alias("is_guarded"),
        scoring.neutral(F.col("url")).alias("is_neutral"),
    )
