"""Queries on the program index and its graphs, stated on the driver's tables.

region and nation stand for packages and modules, part for types and call-graph nodes, orders for functions, lineitem
for operations, customer and supplier for symbols, events for diagnostics and logs, documents for source text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from traceloom.functions import ids, scoring
from traceloom.operators import closure, graph, joins, patterns, sequence
from traceloom.plans.registry import query, spread, table


@query(
    "package_overview",
    """
    SELECT r_name, count(DISTINCT n_nationkey) AS n_modules,
        (SELECT count(*) FROM customer JOIN nation n2 ON c_nationkey = n2.n_nationkey WHERE n2.n_regionkey = r_regionkey) AS n_customers,
        (SELECT count(*) FROM supplier JOIN nation n3 ON s_nationkey = n3.n_nationkey WHERE n3.n_regionkey = r_regionkey) AS n_suppliers
    FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey
    """,
)
def package_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    customers = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("c"))
    suppliers = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("s"))
    modules = nation.join(customers, nation.n_nationkey == customers.c_nationkey, "left").join(suppliers, nation.n_nationkey == suppliers.s_nationkey, "left")
    modules = modules.groupBy("n_regionkey").agg(
        F.countDistinct("n_nationkey").alias("n_modules"), F.sum(F.coalesce("c", F.lit(0))).alias("n_customers"), F.sum(F.coalesce("s", F.lit(0))).alias("n_suppliers")
    )
    region = table(spark, sf_dir, "region")
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return region.join(modules, region.r_regionkey == modules.n_regionkey, "left").select("r_name", zero("n_modules"), zero("n_customers"), zero("n_suppliers"))


@query(
    "coverage_counters",
    """
    SELECT l_partkey, count(*) AS n_ops, count(*) FILTER (l_returnflag = 'R') AS n_returns, count(*) FILTER (l_discount > 0.05) AS n_discounted,
        count(*) FILTER (l_quantity >= 25) AS n_large, count(*) FILTER (l_linestatus = 'O') > 0 AS has_open
    FROM lineitem GROUP BY l_partkey
    """,
)
def coverage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = table(spark, sf_dir, "lineitem")
    return ops.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n_ops"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_returns"),
        F.count_if(F.col("l_discount") > 0.05).alias("n_discounted"),
        F.count_if(F.col("l_quantity") >= 25).alias("n_large"),
        F.bool_or(F.col("l_linestatus") == "O").alias("has_open"),
    )


@query(
    "index_layers",
    """
    SELECT layer, n, CASE WHEN n = 0 THEN 'Missing' WHEN n < 1000 THEN 'Partial' ELSE 'Complete' END AS status FROM (
        SELECT 'packages' AS layer, count(*) AS n FROM region UNION ALL SELECT 'modules', count(*) FROM nation
        UNION ALL SELECT 'types', count(*) FROM part UNION ALL SELECT 'functions', count(*) FROM orders UNION ALL SELECT 'operations', count(*) FROM lineitem)
    """,
)
def index_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = {"packages": "region", "modules": "nation", "types": "part", "functions": "orders", "operations": "lineitem"}
    counts = [table(spark, sf_dir, name).agg(F.lit(layer).alias("layer"), F.count(F.lit(1)).alias("n")) for layer, name in layers.items()]
    out = counts[0]
    for own in counts[1:]:
        out = out.unionByName(own)
    return out.withColumn("status", scoring.first_match([(F.col("n") == 0, "Missing"), (F.col("n") < 1000, "Partial")], "Complete"))


@query(
    "symbol_search",
    """
    SELECT * FROM (SELECT c_name AS name, 'customer' AS kind, c_custkey AS id FROM customer UNION ALL SELECT s_name, 'supplier', s_suppkey FROM supplier
        UNION ALL SELECT p_name, 'part', p_partkey FROM part) WHERE name ILIKE '%BOLT%' OR name ILIKE '%er#00000001_' ORDER BY name, kind, id LIMIT 50
    """,
)
def symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring search without regard to case; wildcards in the pattern hold."""
    kinds = {"customer": ("c_name", "c_custkey"), "supplier": ("s_name", "s_suppkey"), "part": ("p_name", "p_partkey")}
    found = [table(spark, sf_dir, kind).select(F.col(name).alias("name"), F.lit(kind).alias("kind"), F.col(key).alias("id")) for kind, (name, key) in kinds.items()]
    every = found[0].unionByName(found[1]).unionByName(found[2])
    return every.where(F.col("name").ilike("%BOLT%") | F.col("name").ilike("%er#00000001_")).orderBy("name", "kind", "id").limit(50)


@query("ops_by_tag", "SELECT doc_id, lang, source, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS tag FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def ops_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("tag"))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(tags, "doc_id")


@query("entry_points", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'")
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "derive_tags",
    """
    SELECT p_partkey, unnest(list_filter([CASE WHEN p_name LIKE '%ring%' THEN 'ring' END, CASE WHEN p_name LIKE 'red%' OR p_name LIKE 'blue%' THEN 'coloured' END,
        CASE WHEN p_type = 'PROMO' THEN 'promoted' END, CASE WHEN p_size > 40 THEN 'oversize' END, CASE WHEN p_retailprice < 950 THEN 'cheap' END], lambda x: x IS NOT NULL)) AS tag
    FROM part
    """,
)
def derive_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        (F.col("p_name").contains("ring"), "ring"),
        (F.col("p_name").startswith("red") | F.col("p_name").startswith("blue"), "coloured"),
        (F.col("p_type") == "PROMO", "promoted"),
        (F.col("p_size") > 40, "oversize"),
        (F.col("p_retailprice") < 950, "cheap"),
    ]
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(scoring.all_matches(rules)).alias("tag"))


@query(
    "classify_role",
    """
    SELECT 'c' || c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'debtor' WHEN c_mktsegment = 'BUILDING' THEN 'builder' WHEN c_acctbal > 9000 THEN 'key' ELSE 'plain' END AS role FROM customer
    UNION ALL SELECT 's' || s_suppkey, CASE WHEN s_acctbal < 0 THEN 'debtor' WHEN s_acctbal > 9000 THEN 'key' ELSE 'plain' END FROM supplier
    """,
)
def classify_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    rules = [(F.col("c_acctbal") < 0, "debtor"), (F.col("c_mktsegment") == "BUILDING", "builder"), (F.col("c_acctbal") > 9000, "key")]
    a = c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), scoring.first_match(rules, "plain").alias("role"))
    rules = [(F.col("s_acctbal") < 0, "debtor"), (F.col("s_acctbal") > 9000, "key")]
    b = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), scoring.first_match(rules, "plain").alias("role"))
    return a.unionByName(b)


@query(
    "stable_ids",
    """
    SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, 'op:' || substr(sha256(strlen(l_orderkey::VARCHAR) || ':' || l_orderkey || ';' || strlen(l_linenumber::VARCHAR) || ':' || l_linenumber || ';'
        || strlen(l_partkey::VARCHAR) || ':' || l_partkey || ';'), 1, 24) AS id, 'op:' || l_orderkey || '::' || l_linenumber AS readable FROM lineitem
    """,
)
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    return ops.withColumn("id", ids.stable_id("op", "l_orderkey", "l_linenumber", "l_partkey")).withColumn("readable", ids.logical_id("op", "l_orderkey", "l_linenumber"))


def co_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between parts of one order, from the smaller key to the larger. An order has a handful of lines."""
    stored = table(spark, sf_dir, "lineitem")
    lines = spread(stored.select("l_orderkey", "l_partkey"), stored, "l_orderkey").distinct()
    other = lines.withColumnRenamed("l_partkey", "dst")
    pairs = lines.withColumnRenamed("l_partkey", "src").join(other, "l_orderkey").where("src < dst")
    return pairs.select("l_orderkey", "src", "dst")


def co_orders_by(spark: SparkSession, sf_dir: str, end: str) -> DataFrame:
    """The same edges, dealt out by one of their ends."""
    return spread(co_orders(spark, sf_dir), table(spark, sf_dir, "lineitem"), end)


_CO = """e AS (SELECT DISTINCT a.l_orderkey, a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b
    ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)"""


def _walk(steps: int, fanout: int, cap: int) -> str:
    """SQL of a bounded walk from every source, one table w1, w2, ... for each step, and ``walk`` for all."""
    told = [_CO, f"near AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS edge FROM e QUALIFY edge <= {fanout})", "w0 AS (SELECT DISTINCT src AS seed, src AS node, 0 AS depth, 0 AS place FROM e)"]
    for k in range(1, steps + 1):
        seen = " UNION ALL ".join(f"SELECT * FROM w{j}" for j in range(k))
        told.append(
            f"""w{k} AS (SELECT seed, node, {k} AS depth, found + row_number() OVER (PARTITION BY seed ORDER BY via) AS place
            FROM (SELECT seed, dst AS node, min(place * {fanout + 1} + edge) AS via FROM w{k - 1} JOIN near ON src = node GROUP BY seed, dst)
            JOIN (SELECT seed, max(place) AS found FROM ({seen}) GROUP BY seed) USING (seed) WHERE (seed, node) NOT IN (SELECT (seed, node) FROM ({seen})) QUALIFY place <= {cap})"""
        )
    told.append("walk AS (" + " UNION ALL ".join(f"SELECT * FROM w{j}" for j in range(steps + 1)) + ")")
    return ", ".join(told)


@query("neighbors_topk", f"WITH {_CO} SELECT src, dst, place FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS place FROM e) WHERE place <= 3")
def neighbors_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three neighbours; duplicate edges use up the limit."""
    return graph.neighbours(co_orders_by(spark, sf_dir, "src").select("src", "dst"), 3)


@query("distinct_targets", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()


_TRADE = """t AS (SELECT c_nationkey AS src, s_nationkey AS dst, l_shipdate, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations as edges from the customer's nation to the supplier's."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("src", "dst", "l_shipdate", "l_quantity")


@query(
    "edge_aggregate",
    f"WITH {_TRADE} SELECT src, dst, count(*) AS call_count, sum(l_quantity)::BIGINT AS quantity, min(l_shipdate) AS first_span, max(l_shipdate) AS last_span FROM t GROUP BY src, dst",
)
def edge_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade(spark, sf_dir).groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("call_count"), F.sum("l_quantity").cast("long").alias("quantity"), F.min("l_shipdate").alias("first_span"), F.max("l_shipdate").alias("last_span")
    )


@query("rollup_trade", f"WITH {_TRADE} SELECT src, dst, count(*) AS n, grouping_id(src, dst) AS level FROM t GROUP BY ROLLUP (src, dst)")
def rollup_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: the edge counts with subtotals."""
    return trade(spark, sf_dir).rollup("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


_NATION_EDGES = f"""{_TRADE}, edges AS (SELECT src, dst, count(*) AS n FROM t WHERE src <> dst GROUP BY src, dst)"""


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of nations that trade with each other."""
    return trade(spark, sf_dir).where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(
    "dep_graph",
    f"""
    WITH RECURSIVE {_NATION_EDGES}, r(node) AS (SELECT 3 UNION SELECT dst FROM r JOIN edges ON src = node)
    SELECT src, dst, n, src = 3 AS is_root FROM edges WHERE src IN (SELECT node FROM r) AND dst IN (SELECT node FROM r)
    """,
)
def dep_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = nation_edges(spark, sf_dir)
    seed = spark.range(3, 4).select(F.col("id").cast("int").alias("node"))
    nodes = graph.closure(edges, seed).select("node").unionByName(seed)
    return graph.within(edges, nodes).withColumn("is_root", F.col("src") == 3)


@query(
    "transitive_closure",
    f"""
    WITH RECURSIVE {_NATION_EDGES}, r(seed, node) AS (SELECT DISTINCT src, dst FROM edges UNION SELECT seed, dst FROM r JOIN edges ON src = node)
    SELECT seed, node FROM r WHERE seed <> node
    """,
)
def transitive_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = nation_edges(spark, sf_dir)
    return graph.closure(edges, edges.select(F.col("src").alias("node"))).select("seed", "node")


_PART_EDGES = """
    e(src, dst) AS (SELECT p.p_partkey, q.p_partkey FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1
        UNION SELECT p_partkey, p_partkey - 7 FROM part WHERE p_partkey % 100 = 50 UNION SELECT p_partkey, p_partkey - 450 FROM part WHERE p_partkey % 1000 = 900)
"""


@query(
    "part_closure",
    f"""
    WITH RECURSIVE {_PART_EDGES}, r(a, b) AS (SELECT src, src FROM e UNION SELECT dst, dst FROM e UNION SELECT a, dst FROM r JOIN e ON b = src),
    c AS (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1)
    SELECT a AS seed, component, count(*) AS n_nodes FROM r JOIN c ON node = b WHERE a % 400 = 0 GROUP BY 1, 2
    """,
)
def part_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What some parts reach on one long path through all parts with steps back, as strong components and their sizes."""
    key, parts = F.col("p_partkey"), table(spark, sf_dir, "part").select("p_partkey")
    ahead = parts.join(parts.select((key - 1).alias("p_partkey")), "p_partkey", "left_semi").select(key.alias("src"), (key + 1).alias("dst"))
    back = parts.where(key % 100 == 50).select(key, key - 7).union(parts.where(key % 1000 == 900).select(key, key - 450))
    reached, _ = closure.component_closure(ahead.union(back), parts.where(key % 400 == 0).select(key.alias("node")), sized=True)
    return reached


@query("reach_depth_n", f"WITH {_walk(3, 3, 8)} SELECT seed, node, depth::INTEGER AS depth FROM walk WHERE depth > 0")
def reach_depth_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callees of every function within three steps, three of each at most, eight in all."""
    edges = co_orders_by(spark, sf_dir, "src")
    return graph.bounded_reach(edges, edges.select(F.col("src").alias("node")), 3, 3, 8).select("seed", "node", "depth")


@query(
    "call_graph",
    f"""
    WITH {_walk(2, 3, 8)}, d AS (SELECT src, count(*) AS degree FROM near GROUP BY src)
    SELECT seed, count(*) AS n_nodes, coalesce(sum(degree) FILTER (depth < 2), 0)::BIGINT AS n_edges,
        CASE WHEN count(*) > 8 THEN ['call_depth_limited', 'callee_count_limited'] ELSE ['call_depth_limited'] END AS trim_reasons
    FROM walk LEFT JOIN d ON src = node GROUP BY seed
    """,
)
def call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounded graph around every function: asked for three steps, two are allowed."""
    edges = co_orders_by(spark, sf_dir, "src")
    return graph.call_graph(edges, edges.select(F.col("src").alias("node")), 3, 2, 3, 8)


@query(
    "reverse_paths",
    f"""
    WITH RECURSIVE {_CO}, d AS (SELECT DISTINCT src, dst FROM e), goal AS (SELECT max(dst) AS node FROM d),
    r(caller, path, depth) AS (SELECT node, [node], 0 FROM goal UNION SELECT src, list_prepend(src, path), depth + 1 FROM r JOIN d ON dst = caller WHERE depth < 3)
    SELECT (SELECT node FROM goal) AS target, caller, depth::INTEGER AS depth, path FROM (
        SELECT caller, depth, path, row_number() OVER (PARTITION BY caller ORDER BY depth, path) AS n FROM r WHERE depth > 0) WHERE n = 1
    """,
)
def reverse_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = co_orders_by(spark, sf_dir, "dst")
    return graph.reverse_paths(edges, edges.agg(F.max("dst").alias("node")), 3)


_LINES = """o AS (SELECT l_orderkey AS fn, l_returnflag AS kind, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS pos FROM lineitem)"""


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of functions in their order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    stored = table(spark, sf_dir, "lineitem")
    lines = spread(stored.select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"), stored, "l_orderkey")
    return lines.select(F.col("l_orderkey").alias("fn"), F.col("l_returnflag").alias("kind"), (F.row_number().over(order) - 1).alias("pos"))


@query(
    "basic_blocks",
    f"""
    WITH {_LINES}, m AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS lead FROM o WINDOW w AS (PARTITION BY fn ORDER BY pos)),
    b AS (SELECT *, sum(lead) OVER (PARTITION BY fn ORDER BY pos) - 1 AS block FROM m)
    SELECT fn, block::BIGINT AS block, min(pos) AS start, max(pos) AS end, min(kind) AS kind, count(*) AS size FROM b GROUP BY fn, block
    """,
)
def basic_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.blocks(operations(spark, sf_dir), ["fn"], "pos", "kind")


@query(
    "cfg_successors",
    f"""
    WITH {_LINES}, m AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS lead FROM o WINDOW w AS (PARTITION BY fn ORDER BY pos)),
    b AS (SELECT *, sum(lead) OVER (PARTITION BY fn ORDER BY pos) - 1 AS block FROM m),
    k AS (SELECT fn, min(pos) AS start, min(kind) AS kind FROM b GROUP BY fn, block)
    SELECT fn, start AS src, nxt AS dst, 'fallthrough' AS kind FROM (SELECT fn, start, lead(start) OVER (PARTITION BY fn ORDER BY start) AS nxt FROM k) WHERE nxt IS NOT NULL
    UNION ALL SELECT fn, start, 0, 'branch' FROM k WHERE kind = 'R'
    """,
)
def cfg_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of returned lines branch back to the start."""
    found = sequence.blocks(operations(spark, sf_dir), ["fn"], "pos", "kind")
    return graph.successors(found.select("fn", "start", F.when(F.col("kind") == "R", F.lit(0)).alias("target")))


@query("resolve_or_raw", "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(s_name, l_suppkey::VARCHAR) AS target FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey")
def resolve_or_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    known = table(spark, sf_dir, "supplier").where("s_acctbal > 0")
    return joins.resolve_or_keep(lines, known, "l_suppkey", "s_suppkey", "s_name", "target").drop("l_suppkey")


@query(
    "resolve_two_tier",
    """
    WITH r AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS scope FROM part),
    t AS (SELECT s_suppkey AS tid, 'Brand#' || (s_suppkey % 25) AS scope, name FROM supplier JOIN (SELECT p_partkey, p_name AS name FROM part) ON p_partkey = s_suppkey * 7)
    SELECT id, coalesce((SELECT min(tid) FROM t WHERE t.scope = r.scope AND t.name = r.name),
        CASE WHEN r.scope IS NULL THEN (SELECT CASE WHEN count(*) = 1 THEN min(tid) END FROM t WHERE t.name = r.name) END) AS target FROM r
    """,
)
def resolve_two_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("scope"))
    names = part.select("p_partkey", F.col("p_name").alias("name"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tid"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25).cast("string")).alias("scope"))
    targets = supplier.join(names, names.p_partkey == supplier.tid * 7)
    return joins.resolve_two_tier(rows, targets, "scope", "name", "tid", "target").select("id", "target")


@query("unused_decls", "SELECT doc_id, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def unused_decls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations (documents) that nothing (no label) refers to."""
    used = table(spark, sf_dir, "labels").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(used, "doc_id", "left_anti")


@query("external_calls", "SELECT DISTINCT l_suppkey AS target FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 10)")
def external_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = table(spark, sf_dir, "supplier").where("s_nationkey < 10").select("s_suppkey")
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("target")).distinct()
    return joins.dangling(calls, "target", (local, "s_suppkey"))


@query(
    "related_types_theta",
    """
    WITH names AS (SELECT DISTINCT name FROM (SELECT unnest(string_split(text, ' ')) AS name FROM benchmark) WHERE length(name) >= 4),
    r AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY name) AS place, count(*) OVER (PARTITION BY doc_id) AS n_related FROM documents JOIN names ON contains(text, name))
    SELECT doc_id, name, place, n_related FROM r WHERE place <= 6
    """,
)
def related_types_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names (words of the benchmark) that texts hold anywhere, the first six of each text, and how many there are."""
    names = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("name")).where("length(name) >= 4").distinct()
    found = patterns.pattern_matches(table(spark, sf_dir, "documents"), names, "doc_id", "text", "name").select("doc_id", F.col("pattern").alias("name"))
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("name")).cast("long"))
    return ranked.withColumn("n_related", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).where("place <= 6")


@query(
    "integrity_check",
    """
    SELECT 'labels_without_document' AS problem, count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT 'lines_without_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'orders_without_lines', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT 'symbols_without_nation', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)
    """,
)
def integrity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    checks = {
        "labels_without_document": joins.dangling(t("labels"), "doc_id", (t("documents"), "doc_id")),
        "lines_without_order": joins.dangling(t("lineitem"), "l_orderkey", (t("orders"), "o_orderkey")),
        "orders_without_lines": joins.dangling(t("orders"), "o_orderkey", (t("lineitem"), "l_orderkey")),
        "symbols_without_nation": joins.dangling(t("customer"), "c_nationkey", (t("nation"), "n_nationkey")),
    }
    out = None
    for name, rows in checks.items():
        own = rows.agg(F.lit(name).alias("problem"), F.count(F.lit(1)).alias("n"))
        out = own if out is None else out.unionByName(own)
    return out


@query("set_difference", "SELECT l_partkey AS key FROM lineitem WHERE l_returnflag = 'A' EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), "l_returnflag")
    return lines.where("l_returnflag = 'A'").select("key").exceptAll(lines.where("l_returnflag = 'R'").select("key"))


@query(
    "fallback_fill",
    """
    SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, CASE WHEN n_chars >= 200 THEN 1 ELSE 0 END FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    """,
)
def fallback_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "labels").select("doc_id", "quality")
    guessed = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") >= 200).cast("int").alias("quality"))
    return joins.fallback_fill(given, guessed, ["doc_id"])


@query("dup_literal", "SELECT 'lit_' || substr(sha256(text), 1, 10) AS name, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def dup_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")
    return found.select(F.concat(F.lit("lit_"), F.substring(F.sha2("text", 256), 1, 10)).alias("name"), "n", "first_id")


@query(
    "attack_surface_rollup",
    """
    SELECT c_nationkey, count(*) AS n, count(DISTINCT CASE WHEN c_acctbal > 0 THEN c_mktsegment END) AS n_segments, count(*) FILTER (c_acctbal < 0) AS n_debtors,
        greatest(count(*) FILTER (c_mktsegment = 'BUILDING'), count(*) FILTER (c_mktsegment = 'MACHINERY')) AS widest FROM customer GROUP BY c_nationkey
    """,
)
def attack_surface_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    segment = lambda name: F.count_if(F.col("c_mktsegment") == name)
    return c.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))).alias("n_segments"),
        F.count_if(F.col("c_acctbal") < 0).alias("n_debtors"),
        F.greatest(segment("BUILDING"), segment("MACHINERY")).alias("widest"),
    )


_SCORE = """s AS (SELECT doc_id, source, (1 + len(string_split(text, 'tion')) - 1 + len(string_split(text, '. ')) - 1)::BIGINT AS score FROM documents)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", "source", scoring.weighted_count(text, (), ("tion", ". ")).alias("score"))


@query("complexity_score", f"WITH {_SCORE} SELECT doc_id, score FROM s WHERE score > 15")
def complexity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions above their threshold."""
    return scores(spark, sf_dir).where("score > 15").select("doc_id", "score")


@query("module_complexity", f"WITH {_SCORE} SELECT source, sum(score)::BIGINT AS score FROM s GROUP BY source HAVING sum(score) > 80")
def module_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules above their threshold."""
    return scores(spark, sf_dir).groupBy("source").agg(F.sum("score").alias("score")).where("score > 80")


_STAGES = """p AS (SELECT l_orderkey, bool_or(l_linestatus = 'O') AS created, bool_or(l_linestatus = 'F') AS shipped, bool_or(l_returnflag = 'R') AS returned, sum(l_quantity) AS q
    FROM lineitem GROUP BY l_orderkey)"""


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.bool_or(F.col("l_linestatus") == "O").alias("created"),
        F.bool_or(F.col("l_linestatus") == "F").alias("shipped"),
        F.bool_or(F.col("l_returnflag") == "R").alias("returned"),
        F.sum("l_quantity").alias("q"),
    )


@query(
    "lifecycle_stages",
    f"WITH {_STAGES} SELECT l_orderkey, unnest(list_filter([CASE WHEN created THEN 'created' END, CASE WHEN shipped THEN 'shipped' END, CASE WHEN returned THEN 'returned' END], lambda x: x IS NOT NULL)) AS stage FROM p",
)
def lifecycle_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = scoring.all_matches([(F.col(x), x) for x in ("created", "shipped", "returned")])
    return stages(spark, sf_dir).select("l_orderkey", F.explode(names).alias("stage"))


@query(
    "lifecycle_risks",
    f"""
    WITH {_STAGES}, r AS (SELECT l_orderkey, unnest(list_filter([CASE WHEN created AND NOT shipped THEN 'createdWithoutDeletion' END, CASE WHEN returned AND q > 150 THEN 'deletionTooAccessible' END,
        CASE WHEN q > 250 THEN 'longLivedReceiptOrPosition' END], lambda x: x IS NOT NULL)) AS risk FROM p)
    SELECT *, CASE risk WHEN 'deletionTooAccessible' THEN 'high' ELSE 'medium' END AS severity FROM r
    """,
)
def lifecycle_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        (F.col("created") & ~F.col("shipped"), "createdWithoutDeletion"),
        (F.col("returned") & (F.col("q") > 150), "deletionTooAccessible"),
        (F.col("q") > 250, "longLivedReceiptOrPosition"),
    ]
    risks = stages(spark, sf_dir).select("l_orderkey", F.explode(scoring.all_matches(rules)).alias("risk"))
    return risks.withColumn("severity", scoring.first_match([(F.col("risk") == "deletionTooAccessible", "high")], "medium"))


_OVERRIDES = (("error", "high", True), ("click", None, False), ("purchase", "low", True))


@query(
    "severity_override",
    """
    SELECT event_id, event_type AS rule, coalesce(o.severity, CASE WHEN value > 50 THEN 'medium' ELSE 'info' END) AS severity
    FROM events LEFT JOIN (VALUES ('error', 'high', true), ('click', NULL, false), ('purchase', 'low', true)) o(rule, severity, active) ON event_type = o.rule WHERE coalesce(o.active, true)
    """,
)
def severity_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that the configuration turns off give no findings; its severities replace the default ones."""
    config = spark.createDataFrame(_OVERRIDES, "rule string, _severity string, _active boolean")
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("rule"), F.when(F.col("value") > 50, "medium").otherwise("info").alias("_default"))
    joined = events.join(config, "rule", "left").where(F.coalesce("_active", F.lit(True)))
    return joined.select("event_id", "rule", F.coalesce("_severity", "_default").alias("severity"))


@query(
    "invalidation_plan",
    """
    WITH h AS (SELECT source, lang, n_chars, md5(doc_id || ':' || coalesce(text, '')) AS h FROM documents),
    a AS (SELECT source, lang, sum(('0x' || substr(h, 1, 12))::BIGINT)::VARCHAR || ':' || sum(('0x' || substr(h, 13, 12))::BIGINT)::VARCHAR AS f FROM h GROUP BY source, lang),
    b AS (SELECT source, lang, sum(('0x' || substr(h, 1, 12))::BIGINT)::VARCHAR || ':' || sum(('0x' || substr(h, 13, 12))::BIGINT)::VARCHAR AS f FROM h WHERE n_chars < 5000 AND lang <> 'es' GROUP BY source, lang)
    SELECT source, lang, a.f AS old_value, b.f AS new_value, a.f IS DISTINCT FROM b.f AS refresh FROM a FULL JOIN b USING (source, lang)
    """,
)
def invalidation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of all sources (all documents; without long and Spanish ones) compared by fingerprints: sums of two
    lanes of row hashes, which need no order and add up before they are shuffled."""
    hashed = F.md5(F.concat_ws(":", "doc_id", F.coalesce("text", F.lit(""))))
    docs = table(spark, sf_dir, "documents").select("source", "lang", "n_chars", hashed.alias("h"))
    lane = lambda at: F.sum(F.conv(F.substr("h", F.lit(at), F.lit(12)), 16, 10).cast("decimal(38,0)")).cast("string")

    def state(rows: DataFrame) -> DataFrame:
        return rows.groupBy("source", "lang").agg(F.concat_ws(":", lane(1), lane(13)).alias("f"))

    return joins.changed(state(docs), state(docs.where("n_chars < 5000 AND lang <> 'es'")), ["source", "lang"], "f")


@query(
    "health_status",
    """
    SELECT source, count(*) AS n, count(*) FILTER (n_chars = 0) AS n_empty, count(DISTINCT lang) AS n_langs,
        CASE WHEN count(*) FILTER (n_chars < 20) > 0 THEN 'degraded' WHEN count(DISTINCT lang) < 4 THEN 'partial' ELSE 'ready' END AS status FROM documents GROUP BY source
    """,
)
def health_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") == 0).alias("n_empty"), F.countDistinct("lang").alias("n_langs"), F.count_if(F.col("n_chars") < 20).alias("_short")
    )
    return found.withColumn("status", scoring.first_match([(F.col("_short") > 0, "degraded"), (F.col("n_langs") < 4, "partial")], "ready")).drop("_short")
