"""Rule sets over program facts: tags, lifecycles, coverage, layers, invalidation, evidence and string functions.

On the driver's tables part stands for object types, orders for functions, lineitem for a function's operations and
events for log rows. What the rules read (call targets, bodies, signatures) is put together from their columns; names,
thresholds and orders of the rules are fixed values and stand together at the top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from traceloom.functions.scoring import all_matches, first_match
from traceloom.operators import ledger
from traceloom.operators.containment import superset_counts
from traceloom.plans.registry import query, table

# Modules of call targets and their tags, in order; lifecycle stages in order; layers in order.
CALL_TAGS = ("transfer", "coin", "balance", "dynamic_field", "table", "clock", "tx_context")
STAGES = ("created", "owned", "transferred", "shared", "immutable", "party", "mutated", "wrapped", "deleted")
LAYERS = ("artifact_pointer", "symbol_card", "summary_card", "function_signature", "type_field", "operation", "graph_edge", "diagnostic", "context_pack_cache")

_TARGET = "'0x2::' || ['transfer','coin','balance','dynamic_field','table','clock','tx_context','vector'][1 + (l_partkey + l_linenumber) % 8] || '::Call'"


def call_tag(target: Column) -> Column:
    """The tag of a call target: the first known module in it, else an external call."""
    low = F.lower(target)
    return first_match([(low.contains(f"::{name}::"), f"{name}_api_call_detected") for name in CALL_TAGS], "package_external_call_detected")


@query(
    "call_tags",
    "SELECT l_orderkey, CASE "
    + " ".join(f"WHEN contains(lower({_TARGET}), '::{name}::') THEN '{name}_api_call_detected'" for name in CALL_TAGS)
    + " ELSE 'package_external_call_detected' END AS tag, count(*) AS n FROM lineitem GROUP BY 1, 2",
)
def call_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of a function's calls, and how many calls have each."""
    modules = F.array(*(F.lit(name) for name in (*CALL_TAGS, "vector")))
    module = F.element_at(modules, (1 + (F.col("l_partkey") + F.col("l_linenumber")) % 8).cast("int"))
    target = F.concat(F.lit("0x2::"), module, F.lit("::Call"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", call_tag(target).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "function_tags",
    """
    SELECT o_orderkey, tag FROM (SELECT o_orderkey, unnest(list_filter([
        CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'F' THEN 'public_entry_detected' END, CASE WHEN o_orderstatus = 'F' THEN 'public_function_detected' END,
        CASE WHEN o_orderstatus = 'O' THEN 'friend_function_detected' END, CASE WHEN o_orderpriority LIKE '5%' THEN 'native_function_detected' END,
        CASE WHEN o_orderkey % 50 = 0 THEN 'init_function_detected' END, CASE WHEN n_open > 0 THEN 'tx_context_parameter_detected' END,
        CASE WHEN n_mut > 0 THEN 'mutable_reference_parameter_detected' END, CASE WHEN n_large > 0 THEN 'generic_function_detected' END], lambda x: x IS NOT NULL)) AS tag
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) FILTER (l_linestatus = 'O') AS n_open, count(*) FILTER (l_returnflag = 'R') AS n_mut,
        count(*) FILTER (l_quantity >= 45) AS n_large FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
    """,
)
def function_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of functions by visibility, kind and parameters (a function's lines stand for its parameters)."""
    parameters = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(F.col("l_linestatus") == "O").alias("n_open"), F.count_if(F.col("l_returnflag") == "R").alias("n_mut"), F.count_if(F.col("l_quantity") >= 45).alias("n_large")
    )
    public = F.col("o_orderstatus") == "F"
    rules = [
        (public & (F.col("o_orderkey") % 3 == 0), "public_entry_detected"), (public, "public_function_detected"), (F.col("o_orderstatus") == "O", "friend_function_detected"),
        (F.col("o_orderpriority").startswith("5"), "native_function_detected"), (F.col("o_orderkey") % 50 == 0, "init_function_detected"),
        (F.col("n_open") > 0, "tx_context_parameter_detected"), (F.col("n_mut") > 0, "mutable_reference_parameter_detected"), (F.col("n_large") > 0, "generic_function_detected"),
    ]
    joined = table(spark, sf_dir, "orders").join(parameters, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", F.explode(all_matches(rules)).alias("tag"))


@query(
    "type_tags",
    """
    SELECT p_partkey, tag FROM (SELECT p_partkey, unnest(list_filter([CASE WHEN p_size > 25 THEN 'ability_key_detected' END, CASE WHEN p_size % 2 = 0 THEN 'store_type_detected' END,
        CASE WHEN p_retailprice > 950 THEN 'uid_field_detected' END, CASE WHEN p_retailprice > 950 THEN 'key_object_type_detected' END,
        CASE WHEN contains(lower(p_type), 'ec') THEN 'capability_named_type_detected' END, CASE WHEN contains(lower(p_name), 'gear') THEN 'witness_named_type_detected' END], lambda x: x IS NOT NULL)) AS tag FROM part)
    """,
)
def type_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of types by abilities, fields and names."""
    identity = F.col("p_retailprice") > 950
    rules = [
        (F.col("p_size") > 25, "ability_key_detected"), (F.col("p_size") % 2 == 0, "store_type_detected"), (identity, "uid_field_detected"), (identity, "key_object_type_detected"),
        (F.lower("p_type").contains("ec"), "capability_named_type_detected"), (F.lower("p_name").contains("gear"), "witness_named_type_detected"),
    ]
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(all_matches(rules)).alias("tag"))


# A function body holds one operation for each line; its kind follows from the line. What shows each stage.
_BODY = "['object::new','public_transfer','share_object','freeze_object','party::move','&mut self','table::add','object::delete','noop'][1 + (l_suppkey + l_linenumber) % 9]"
_SIGNS = (("created", "object::new"), ("transferred", "public_transfer"), ("owned", "public_transfer"), ("shared", "share_object"), ("immutable", "freeze_object"), ("party", "party::"), ("mutated", "&mut"), ("wrapped", "table::add"), ("deleted", "object::delete"))
_EVENTS_SQL = f"""
    SELECT DISTINCT l_partkey, stage, l_orderkey, l_tax < 0.04 AS guarded, l_linestatus = 'O' AS external FROM (
        SELECT *, unnest(list_filter([{', '.join(f"CASE WHEN contains(body, '{sign}') THEN '{stage}' END" for stage, sign in _SIGNS)}], lambda x: x IS NOT NULL)) AS stage
        FROM (SELECT *, {_BODY} AS body FROM lineitem))
"""


def lifecycle_event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(object, stage, function, guarded, external): each operation on an object tells the stages that it shows."""
    bodies = ("object::new", "public_transfer", "share_object", "freeze_object", "party::move", "&mut self", "table::add", "object::delete", "noop")
    lines = table(spark, sf_dir, "lineitem")
    body = F.element_at(F.array(*(F.lit(b) for b in bodies)), (1 + (F.col("l_suppkey") + F.col("l_linenumber")) % 9).cast("int"))
    stages = all_matches([(F.col("body").contains(sign), stage) for stage, sign in _SIGNS])
    events = lines.withColumn("body", body).withColumn("stage", F.explode(stages))
    return events.select("l_partkey", "stage", "l_orderkey", (F.col("l_tax") < 0.04).alias("guarded"), (F.col("l_linestatus") == "O").alias("external")).distinct()


@query(
    "lifecycle_events",
    f"SELECT l_partkey, stage, list_position({list(STAGES)!r}, stage)::BIGINT AS place, count(DISTINCT l_orderkey) AS n_functions, min(l_orderkey) AS first_function FROM ({_EVENTS_SQL}) GROUP BY 1, 2",
)
def lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine stages of each object, in their order, with how many functions show them."""
    place = F.array_position(F.array(*(F.lit(s) for s in STAGES)), F.col("stage")).alias("place")
    found = lifecycle_event_rows(spark, sf_dir).groupBy("l_partkey", "stage").agg(F.countDistinct("l_orderkey").alias("n_functions"), F.min("l_orderkey").alias("first_function"))
    return found.select("l_partkey", "stage", place, "n_functions", "first_function")


@query(
    "object_risks",
    f"""
    WITH s AS (SELECT l_partkey, bool_or(stage = 'created') AS created, bool_or(stage = 'deleted') AS deleted, bool_or(stage = 'shared') AS shared,
        bool_or(stage IN ('owned', 'transferred', 'shared', 'wrapped')) AS leaves, bool_or(stage = 'deleted' AND external AND NOT guarded) AS open_delete,
        bool_or(stage IN ('transferred', 'shared', 'party') AND external AND NOT guarded) AS open_move,
        bool_or(stage IN ('owned', 'transferred', 'shared', 'wrapped') AND external AND NOT guarded) AS open_leak FROM ({_EVENTS_SQL}) GROUP BY 1)
    SELECT l_partkey, risk.kind AS kind, risk.severity AS severity FROM (SELECT l_partkey, unnest(list_filter([
        CASE WHEN created AND NOT deleted THEN {{'kind': 'createdWithoutDeletion', 'severity': 'medium'}} END, CASE WHEN open_delete THEN {{'kind': 'deletionTooAccessible', 'severity': 'high'}} END,
        CASE WHEN open_move THEN {{'kind': 'unguardedOwnershipChange', 'severity': 'high'}} END, CASE WHEN contains(p_name, 'bolt') AND NOT deleted THEN {{'kind': 'longLivedReceiptOrPosition', 'severity': 'medium'}} END,
        CASE WHEN contains(lower(p_type), 'ec') AND leaves AND (open_leak OR shared) THEN {{'kind': 'privilegedObjectLeak', 'severity': CASE WHEN shared THEN 'high' ELSE 'medium' END}} END], lambda x: x IS NOT NULL)) AS risk
        FROM s JOIN part ON p_partkey = l_partkey)
    """,
)
def object_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five risks of objects by the stages that they have, and by functions that reach these unguarded."""
    stage, unguarded = F.col("stage"), F.col("external") & ~F.col("guarded")
    any_of = lambda *names: stage.isin(*names)
    leaving = ("owned", "transferred", "shared", "wrapped")
    found = lifecycle_event_rows(spark, sf_dir).groupBy("l_partkey").agg(
        F.bool_or(stage == "created").alias("created"), F.bool_or(stage == "deleted").alias("deleted"), F.bool_or(stage == "shared").alias("shared"), F.bool_or(any_of(*leaving)).alias("leaves"),
        F.bool_or((stage == "deleted") & unguarded).alias("open_delete"), F.bool_or(any_of("transferred", "shared", "party") & unguarded).alias("open_move"), F.bool_or(any_of(*leaving) & unguarded).alias("open_leak"),
    )
    risk = lambda when, kind, severity: F.when(when, F.struct(F.lit(kind).alias("kind"), severity.alias("severity")))
    medium, high = F.lit("medium"), F.lit("high")
    risks = F.array_compact(F.array(
        risk(F.col("created") & ~F.col("deleted"), "createdWithoutDeletion", medium), risk(F.col("open_delete"), "deletionTooAccessible", high),
        risk(F.col("open_move"), "unguardedOwnershipChange", high), risk(F.col("p_name").contains("bolt") & ~F.col("deleted"), "longLivedReceiptOrPosition", medium),
        risk(F.lower("p_type").contains("ec") & F.col("leaves") & (F.col("open_leak") | F.col("shared")), "privilegedObjectLeak", F.when(F.col("shared"), high).otherwise(medium)),
    ))
    return found.join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).select("l_partkey", F.explode(risks).alias("risk")).select("l_partkey", "risk.kind", "risk.severity")


# Counters of one pass over operations: a name and the condition, in words that both engines read.
_COUNTERS = (
    ("summary_artifact_count", "l_linenumber = 1"), ("root_card_count", "l_linenumber = 1 AND l_discount = 0"), ("root_card_ready_count", "l_linenumber = 1 AND l_discount = 0 AND l_linestatus = 'F'"),
    ("direct_dependency_card_count", "l_linenumber = 2"), ("direct_dependency_ready_count", "l_linenumber = 2 AND l_linestatus = 'F'"), ("pointer_only_summary_count", "l_tax = 0"),
    ("expanded_summary_count", "l_tax > 0"), ("failed_summary_count", "l_tax >= 0.08"), ("source_file_count", "l_returnflag = 'N'"), ("hashed_source_file_count", "l_returnflag = 'N' AND l_quantity > 5"),
    ("function_count", "l_returnflag = 'A'"), ("function_file_span_count", "l_returnflag = 'A' AND l_quantity > 10"), ("operation_count", "l_quantity > 0"), ("operation_exact_span_count", "l_quantity >= 25"),
    ("call_operation_count", "l_discount > 0.05"), ("call_edge_with_operation_count", "l_discount > 0.05 AND l_linestatus = 'O'"), ("diagnostic_count", "l_returnflag = 'R' AND l_discount > 0.08"),
)


@query("coverage_all", "SELECT l_suppkey, " + ", ".join(f"count(*) FILTER ({when}) AS {name}" for name, when in _COUNTERS) + " FROM lineitem GROUP BY l_suppkey")
def coverage_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seventeen coverage counters of each package in one aggregation."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*(F.count_if(F.expr(when)).alias(name) for name, when in _COUNTERS))


# Each layer's table stand-in and condition; a layer is ready with any fact, summary cards by their share.
_LAYER_FACTS = (("artifact_pointer", "region", "true"), ("symbol_card", "nation", "true"), ("summary_card", "customer", "c_acctbal > 0"), ("function_signature", "orders", "o_orderstatus = 'F'"), ("type_field", "part", "p_size > 1"), ("operation", "lineitem", "true"), ("graph_edge", "lineitem", "l_discount > 0.05"), ("diagnostic", "events", "event_type = 'error'"), ("context_pack_cache", "supplier", "s_acctbal < -99999"))


@query(
    "layers_all",
    "SELECT layer, place, facts, CASE WHEN facts = 0 THEN 'missing' WHEN layer = 'summary_card' AND facts < total THEN 'partial' ELSE 'ready' END AS status FROM ("
    + " UNION ALL ".join(f"SELECT '{name}' AS layer, {i} AS place, count(*) FILTER ({when}) AS facts, count(*) AS total FROM {of}" for i, (name, of, when) in enumerate(_LAYER_FACTS))
    + ")",
)
def layers_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine index layers with their numbers of facts and status."""
    rows = [
        table(spark, sf_dir, of).agg(F.count_if(F.expr(when)).alias("facts"), F.count(F.lit(1)).alias("total")).select(F.lit(name).alias("layer"), F.lit(i).alias("place"), "facts", "total")
        for i, (name, of, when) in enumerate(_LAYER_FACTS)
    ]
    out = rows[0]
    for own in rows[1:]:
        out = out.unionByName(own)
    return out.select("layer", "place", "facts", first_match([(F.col("facts") == 0, "missing"), ((F.col("layer") == "summary_card") & (F.col("facts") < F.col("total")), "partial")], "ready").alias("status"))


_SURFACE = (("modules", "l_linenumber = 1"), ("entry_functions", "l_returnflag = 'A'"), ("public_functions", "l_returnflag = 'N'"), ("friend_functions", "l_returnflag = 'R'"), ("shared_objects", "l_linestatus = 'O'"), ("capabilities", "l_tax > 0.06"), ("external_calls", "l_discount > 0.05"), ("dynamic_fields", "l_quantity > 40"), ("findings", "l_discount > 0.08"), ("high_findings", "l_discount > 0.09"))


@query(
    "surface_all",
    "SELECT l_suppkey, " + ", ".join(f"count(*) FILTER ({when}) AS {name}" for name, when in _SURFACE)
    + ", greatest(count(*) FILTER (l_returnflag = 'A'), count(*) FILTER (l_linestatus = 'O')) AS widest FROM lineitem GROUP BY l_suppkey",
)
def surface_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten counts of a package's attack surface, and the greater of entries and shared objects."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*(F.count_if(F.expr(when)).alias(name) for name, when in _SURFACE))
    return counts.withColumn("widest", F.greatest("entry_functions", "shared_objects"))


# What is compared, and the refresh flags that a difference in each sets.
FINGERPRINTS = ("move_toml_hash", "package_summaries_hash", "source_hash", "dependency_metadata_hash", "compiler_version", "indexer_version", "extraction_config_hash")
REFRESH = (
    ("refresh_summary_pointers", ("move_toml_hash", "package_summaries_hash")), ("refresh_root_cards", ("package_summaries_hash", "indexer_version")),
    ("refresh_dependency_cards", ("package_summaries_hash", "dependency_metadata_hash")), ("refresh_full_body_index", ("source_hash",)),
    ("refresh_dependency_resolution", ("move_toml_hash", "dependency_metadata_hash")), ("refresh_compiler_backed_facts", ("compiler_version", "indexer_version")),
    ("tag_only_reindex", ("extraction_config_hash",)),
)
_STATE = (("move_toml_hash", "min(l_partkey)"), ("package_summaries_hash", "max(l_linenumber)"), ("source_hash", "sum(l_partkey % 1000)"), ("dependency_metadata_hash", "min(l_suppkey)"), ("compiler_version", "max(l_linestatus)"), ("indexer_version", "max(l_returnflag)"), ("extraction_config_hash", "count(*)"))


def refresh_flags() -> list[Column]:
    """Flags from columns old_<fingerprint> and new_<fingerprint>; without an old state all but the tags are refreshed."""
    changed = {name: ~F.col(f"old_{name}").eqNullSafe(F.col(f"new_{name}")) for name in FINGERPRINTS}
    flags = []
    for flag, names in REFRESH:
        own = F.lit(False)
        for name in names:
            own = own | changed[name]
        flags.append(F.when(F.col("known"), own).otherwise(F.lit(flag != "tag_only_reindex")).alias(flag))
    return flags


@query(
    "refresh_plan",
    f"""
    WITH new AS (SELECT l_orderkey AS id, {', '.join(f"{value}::VARCHAR AS new_{name}" for name, value in _STATE)} FROM lineitem GROUP BY 1),
    old AS (SELECT l_orderkey AS id, true AS found, {', '.join(f"{value}::VARCHAR AS old_{name}" for name, value in _STATE)} FROM lineitem WHERE l_quantity < 48 AND l_tax < 0.08 GROUP BY 1)
    SELECT id, {', '.join("CASE WHEN found THEN " + ' OR '.join(f"old_{n} IS DISTINCT FROM new_{n}" for n in names) + f" ELSE {'false' if flag == 'tag_only_reindex' else 'true'} END AS {flag}" for flag, names in REFRESH)}
    FROM new LEFT JOIN old USING (id)
    """,
)
def refresh_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven fingerprints of two states compared, as seven refresh flags."""
    lines = table(spark, sf_dir, "lineitem")
    state = lambda rows, side: rows.groupBy(F.col("l_orderkey").alias("id")).agg(*(F.expr(value).cast("string").alias(f"{side}_{name}") for name, value in _STATE))
    both = state(lines, "new").join(state(lines.where("l_quantity < 48 AND l_tax < 0.08"), "old").withColumn("found", F.lit(True)), "id", "left")
    both = both.withColumn("known", F.coalesce("found", F.lit(False)))
    return both.select("id", *refresh_flags())


# Codes of health diagnostics, their severity and when they are given.
_HEALTH = (
    ("missing_summary_artifacts", "warning", "summary_artifact_count = 0"), ("body_operations_unavailable", "info", "function_count > 0 AND operation_exact_span_count = 0"),
    ("exact_operation_spans_unavailable", "info", "operation_count > 0 AND operation_exact_span_count = 0"), ("call_edge_parity_mismatch", "warning", "call_operation_count <> call_edge_with_operation_count"),
    ("dangling_operation_edges", "error", "diagnostic_count > 2"), ("dangling_semantic_tag_targets", "error", "failed_summary_count > 40"), ("non_neutral_semantic_tags", "error", "pointer_only_summary_count > 60"),
)


@query(
    "health_diagnostics",
    "SELECT l_suppkey, d.code AS code, d.severity AS severity FROM (SELECT l_suppkey, unnest(list_filter(["
    + ", ".join(f"CASE WHEN {when} THEN {{'code': '{code}', 'severity': '{severity}'}} END" for code, severity, when in _HEALTH)
    + "], lambda x: x IS NOT NULL)) AS d FROM (SELECT l_suppkey, " + ", ".join(f"count(*) FILTER ({when}) AS {name}" for name, when in _COUNTERS) + " FROM lineitem GROUP BY l_suppkey))",
)
def health_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven diagnostics of a package's index, from its coverage."""
    rows = F.array_compact(F.array(*(F.when(F.expr(when), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, when in _HEALTH)))
    return coverage_all(spark, sf_dir).select("l_suppkey", F.explode(rows).alias("d")).select("l_suppkey", "d.code", "d.severity")


@query(
    "missing_evidence",
    "SELECT l_orderkey, l_suppkey AS evidence FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') r WHERE NOT EXISTS (SELECT 1 FROM lineitem e WHERE e.l_suppkey = r.l_suppkey AND e.l_orderkey <> r.l_orderkey AND e.l_returnflag = 'A')",
)
def missing_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to evidence that no other function of the run has gathered."""
    lines = table(spark, sf_dir, "lineitem")
    refs = lines.where("l_returnflag = 'R'").select("l_orderkey", F.col("l_suppkey").alias("evidence")).distinct()
    # Of each piece of evidence, its first and last function say whether there is another one.
    gathered = lines.where("l_returnflag = 'A'").groupBy(F.col("l_suppkey").alias("evidence")).agg(F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high"))
    other = (F.col("low") != F.col("l_orderkey")) | (F.col("high") != F.col("l_orderkey"))
    return refs.join(gathered, "evidence", "left").where(~F.coalesce(other, F.lit(False))).select("l_orderkey", "evidence")


_FINDINGS = "SELECT l_orderkey AS finding, l_suppkey AS evidence FROM lineitem WHERE l_quantity >= 40 GROUP BY 1, 2"
_CONCLUSIONS = "SELECT l_orderkey AS conclusion, l_suppkey AS evidence FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2"
_COVERED = """
    n AS (SELECT finding, count(*) AS n FROM f GROUP BY 1),
    held AS (SELECT finding, count(*) AS n_supersets FROM (SELECT finding, conclusion FROM f JOIN c USING (evidence) JOIN n USING (finding) GROUP BY finding, conclusion, n HAVING count(*) = n) GROUP BY 1)
"""


def _cited(lines: DataFrame, name: str) -> DataFrame:
    """Each order's suppliers as a set of evidence; an order has few lines."""
    return lines.groupBy(F.col("l_orderkey").alias(name)).agg(F.collect_set("l_suppkey").alias("evidence"))


@query(
    "confirmed_findings",
    f"""
    WITH f AS ({_FINDINGS}), c AS ({_CONCLUSIONS}), {_COVERED}
    SELECT finding, n AS n_evidence, coalesce(n_supersets, 0) AS n_supersets, finding % 7 = 0 AS named, n_supersets IS NOT NULL OR finding % 7 = 0 AS confirmed
    FROM n LEFT JOIN held USING (finding)
    """,
)
def confirmed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that a conclusion names, or whose evidence the conclusion on any order covers."""
    lines = table(spark, sf_dir, "lineitem")
    findings, conclusions = _cited(lines.where("l_quantity >= 40"), "finding"), _cited(lines.where("l_returnflag <> 'N'"), "conclusion")
    found = superset_counts(findings, conclusions, "finding", "evidence")
    sized = found.withColumnRenamed("n_items", "n_evidence").withColumn("named", F.col("finding") % 7 == 0)
    return sized.withColumn("confirmed", (F.col("n_supersets") > 0) | F.col("named"))


_METHODS = ("ExploitReplay", "FormalProof", "HumanReview", "GeneratedTest", "StaticAnalysis")
_ATTESTATIONS = ("AdapterReplay", "ModelSubmitted", "ToolOutput")


@query(
    "finding_gate",
    f"""
    WITH f AS ({_FINDINGS}), c AS (SELECT * FROM ({_CONCLUSIONS}) WHERE conclusion % 4 < 2), {_COVERED},
    e AS (SELECT s_suppkey AS evidence, {list(_METHODS)}[s_suppkey % 5 + 1] AS method, {list(_ATTESTATIONS)}[s_suppkey // 5 % 3 + 1] AS attestation, s_acctbal > 0 AS traced FROM supplier WHERE s_suppkey % 50 <> 49),
    g AS (SELECT finding, count(DISTINCT method) FILTER (attestation <> 'ModelSubmitted' AND method NOT IN ('HumanReview', 'GeneratedTest')) AS n_methods,
        coalesce(bool_or(method = 'ExploitReplay' AND attestation = 'AdapterReplay' AND traced), false) AS replayed, bool_or(method IS NULL) AS missing
        FROM f LEFT JOIN e USING (evidence) GROUP BY finding),
    named AS (SELECT conclusion // 3 AS finding, count(*) AS n_named FROM (SELECT DISTINCT conclusion FROM c) GROUP BY 1),
    r AS (SELECT finding, n_methods, replayed, missing, coalesce(n_named, 0) AS n_named, coalesce(n_supersets, 0) AS n_supersets FROM g LEFT JOIN named USING (finding) LEFT JOIN held USING (finding))
    SELECT finding, n_methods, replayed, n_named, n_supersets, CASE WHEN missing THEN 'evidence_not_found' WHEN n_methods < 2 THEN 'one_method'
        WHEN NOT replayed THEN 'no_replay' WHEN n_named + n_supersets = 0 THEN 'no_conclusion' END AS problem FROM r
    """,
)
def finding_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps an order's finding from being confirmed: suppliers are evidence, other orders' lines are conclusions."""
    pick = lambda values, at: F.element_at(F.array(*(F.lit(v) for v in values)), (at + 1).cast("int"))
    key, lines = F.col("s_suppkey"), table(spark, sf_dir, "lineitem")
    evidence = table(spark, sf_dir, "supplier").where(key % 50 != 49).select(
        key.alias("evidence"), pick(_METHODS, key % 5).alias("method"), pick(_ATTESTATIONS, F.floor(key / 5) % 3).alias("attestation"), F.when(F.col("s_acctbal") > 0, "trace").alias("trace")
    )
    conclusions = _cited(lines.where("l_returnflag <> 'N'"), "conclusion")
    status = pick(("Accepted", "Supported", "Rejected", "Open"), F.col("conclusion") % 4)
    conclusions = conclusions.select("evidence", status.alias("status"), F.array(F.floor(F.col("conclusion") / 3)).alias("candidates"))
    return ledger.finding_gate(_cited(lines.where("l_quantity >= 40"), "finding"), evidence, conclusions)


@query("enumerated_items", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS place, 'work:' || l_orderkey || ':' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1) AS id FROM lineitem")
def enumerated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work items numbered from 0 within their audit, with ids made of the numbers."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    place = (F.row_number().over(order) - 1).cast("long")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", place.alias("place"), F.concat_ws(":", F.lit("work"), "l_orderkey", place).alias("id"))


@query(
    "retention",
    """
    WITH r AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
    SELECT event_id, user_id, n <= 5 AS kept, CASE WHEN n > 5 AND ts < TIMESTAMP '2024-01-03' THEN (n - 6) // 200 END AS batch FROM r
    """,
)
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user the newest rows stay; older ones before the cut-off are pruned in batches of 200."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())).cast("long")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", n.alias("n"))
    batch = F.when((F.col("n") > 5) & (F.col("ts") < F.lit("2024-01-03").cast("timestamp")), F.floor((F.col("n") - 6) / 200))
    return rows.select("event_id", "user_id", (F.col("n") <= 5).alias("kept"), batch.alias("batch"))


_SOURCE = "'call(' || replace(p_name, ' ', '::') || '); a::b::c{' || p_brand || '::' || p_type || '}'"


def call_targets(source: Column) -> Column:
    """Tokens of a source text that have exactly one ``::``, in order."""
    tokens = F.transform(F.split(source, r"[\s(){};,]+"), F.trim)
    return F.filter(tokens, lambda t: (F.length(t) - F.length(F.replace(t, F.lit("::"), F.lit("")))) == 2)


@query("call_targets", f"SELECT p_partkey, unnest(list_filter(string_split_regex({_SOURCE}, '[\\s(){{}};,]+'), lambda t: length(t) - length(replace(t, '::', '')) = 2)) AS target FROM part")
def call_targets_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.concat(F.lit("call("), F.replace("p_name", F.lit(" "), F.lit("::")), F.lit("); a::b::c{"), "p_brand", F.lit("::"), "p_type", F.lit("}"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(call_targets(source)).alias("target"))


def hook_kind(name: Column, prefix: str = "hook_") -> Column:
    """Kind and target of a test hook by its name's prefix; null for other functions."""
    tail = lambda head: F.substr(name, F.lit(len(prefix + head) + 1))
    kind = lambda value, target: F.struct(F.lit(value).alias("kind"), target.cast("string").alias("target"))
    none, ptb = F.lit(None), F.lit("ptb")
    named = lambda head: name.startswith(prefix + head) & (tail(head) != "")
    return (
        F.when(name == f"{prefix}init", kind("init", none)).when(name == f"{prefix}pre_ptb", kind("sequence_pre", ptb)).when(name == f"{prefix}post_ptb", kind("sequence_post", ptb))
        .when(named("pre_"), kind("function_pre", tail("pre_"))).when(named("post_"), kind("function_post", tail("post_"))).when(name.startswith(f"{prefix}oracle"), kind("oracle", none))
    )


_HOOK = "'hook_' || ['init', 'pre_ptb', 'post_ptb', 'pre_' || p_type, 'post_' || p_brand, 'oracle_x', 'pre_', 'other'][1 + p_partkey % 8]"


@query(
    "hook_kinds",
    f"""
    SELECT p_partkey, CASE WHEN h = 'hook_init' THEN 'init' WHEN h = 'hook_pre_ptb' THEN 'sequence_pre' WHEN h = 'hook_post_ptb' THEN 'sequence_post' WHEN h LIKE 'hook#_pre#__%' ESCAPE '#' THEN 'function_pre'
        WHEN h LIKE 'hook#_post#__%' ESCAPE '#' THEN 'function_post' WHEN starts_with(h, 'hook_oracle') THEN 'oracle' END AS kind,
        CASE WHEN h IN ('hook_pre_ptb', 'hook_post_ptb') THEN 'ptb' WHEN h LIKE 'hook#_pre#__%' ESCAPE '#' THEN substr(h, 10) WHEN h LIKE 'hook#_post#__%' ESCAPE '#' THEN substr(h, 11) END AS target
    FROM (SELECT p_partkey, {_HOOK} AS h FROM part)
    """,
)
def hook_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [F.lit("init"), F.lit("pre_ptb"), F.lit("post_ptb"), F.concat(F.lit("pre_"), "p_type"), F.concat(F.lit("post_"), "p_brand"), F.lit("oracle_x"), F.lit("pre_"), F.lit("other")]
    name = F.concat(F.lit("hook_"), F.element_at(F.array(*names), (1 + F.col("p_partkey") % 8).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", hook_kind(name).alias("h")).select("p_partkey", "h.kind", "h.target")


@query("signatures", "SELECT o_orderkey, 'fn_' || o_orderkey || '(' || coalesce(string_agg('a' || l_linenumber || ': T' || l_partkey, ', ' ORDER BY l_linenumber, l_partkey), '') || ')' AS signature FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions rendered with their parameters, whose number an order's lines bound."""
    parameters = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("p"))
    joined = table(spark, sf_dir, "orders").join(parameters, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    shown = F.array_join(F.transform("p", lambda x: F.concat(F.lit("a"), x["l_linenumber"], F.lit(": T"), x["l_partkey"])), ", ")
    return joined.select("o_orderkey", F.concat(F.lit("fn_"), "o_orderkey", F.lit("("), F.coalesce(shown, F.lit("")), F.lit(")")).alias("signature"))


@query(
    "address_aliases",
    "WITH a AS (SELECT p_partkey, p_brand, right(md5(p_brand), 8) AS base FROM part) SELECT p_partkey, 'a_' || base || CASE WHEN row_number() OVER w = 1 THEN '' ELSE '_' || row_number() OVER w END AS alias FROM a WINDOW w AS (PARTITION BY base ORDER BY p_partkey)",
)
def address_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last eight hex digits of an address as its alias, with a number where it is taken."""
    base = F.substr(F.md5("p_brand"), F.lit(25), F.lit(8))
    n = F.row_number().over(Window.partitionBy("base").orderBy("p_partkey"))
    suffix = F.when(F.col("n") == 1, "").otherwise(F.concat(F.lit("_"), "n"))
    return table(spark, sf_dir, "part").select("p_partkey", base.alias("base")).withColumn("n", n).select("p_partkey", F.concat(F.lit("a_"), "base", suffix).alias("alias"))


@query("decoded_bytes", "SELECT p_partkey, p_name AS from_hex, p_brand AS from_base64, octet_length(p_name::BLOB) AS n FROM part")
def decoded_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module bytes come as hex or base64; both are decoded back to what they were made from."""
    given = table(spark, sf_dir, "part").select("p_partkey", F.hex(F.encode("p_name", "utf-8")).alias("h"), F.base64(F.encode("p_brand", "utf-8")).alias("b"))
    return given.select("p_partkey", F.decode(F.unhex("h"), "utf-8").alias("from_hex"), F.decode(F.unbase64("b"), "utf-8").alias("from_base64"), F.octet_length(F.unhex("h")).cast("long").alias("n"))


# Edge types by the graph's kind, and for state access by the edge's kind.
_EDGE_TYPES = (("call", "", "Calls"), ("controlFlow", "", "ControlFlow"), ("dataFlow", "", "DataFlow"), ("dependency", "", "DependsOnModule"), ("type", "", "ReferencesType"), ("stateAccess", "read", "ReadsField"), ("stateAccess", "write", "WritesField"), ("stateAccess", "borrow", "BorrowsField"), ("stateAccess", "borrowMut", "BorrowsFieldMut"))
_GRAPH = "['call','controlFlow','dataFlow','dependency','type','stateAccess','other'][1 + l_partkey % 7]"
_EDGE = "['read','writes','borrow','borrowMut','touch'][1 + l_suppkey % 5]"


@query(
    "typed_edges",
    "SELECT graph, type, count(*) AS n, min(src) AS low, max(dst) AS high FROM (SELECT graph, CASE "
    + " ".join(f"WHEN graph = '{g}'" + (f" AND kind IN ('{k}', '{k + 's' if k != 'borrowMut' else 'borrowsMut'}')" if k else "") + f" THEN '{t}'" for g, k, t in _EDGE_TYPES)
    + f" ELSE 'AnalysisRelation' END AS type, src, dst FROM (SELECT {_GRAPH} AS graph, {_EDGE} AS kind, l_orderkey AS src, l_partkey AS dst FROM lineitem)) GROUP BY 1, 2",
)
def typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of six graphs mapped to ten types."""
    pick = lambda names, at: F.element_at(F.array(*(F.lit(n) for n in names)), (1 + at).cast("int"))
    lines = table(spark, sf_dir, "lineitem").select(
        pick(("call", "controlFlow", "dataFlow", "dependency", "type", "stateAccess", "other"), F.col("l_partkey") % 7).alias("graph"),
        pick(("read", "writes", "borrow", "borrowMut", "touch"), F.col("l_suppkey") % 5).alias("kind"), F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"),
    )
    both = lambda k: F.col("kind").isin(k, "borrowsMut" if k == "borrowMut" else k + "s") if k else F.lit(True)
    kind = first_match([((F.col("graph") == g) & both(k), t) for g, k, t in _EDGE_TYPES], "AnalysisRelation")
    return lines.withColumn("type", kind).groupBy("graph", "type").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("low"), F.max("dst").alias("high"))


@query(
    "external_nodes",
    "SELECT DISTINCT 'external:' || l_partkey % 4000 || ':' || l_returnflag AS id, 'external' AS kind FROM lineitem WHERE l_partkey % 4000 NOT IN (SELECT p_partkey FROM part) UNION SELECT DISTINCT 'node:' || p_partkey, 'known' FROM part",
)
def external_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a graph: the known ones, and one for each call target outside of it."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))
    targets = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 4000).alias("key"), "l_returnflag").distinct().join(part, "key", "left_anti")
    outside = targets.select(F.concat_ws(":", F.lit("external"), "key", "l_returnflag").alias("id"), F.lit("external").alias("kind"))
    return outside.distinct().unionByName(part.select(F.concat(F.lit("node:"), "key").alias("id"), F.lit("known").alias("kind")).distinct())


@query(
    "log_filters",
    "SELECT event_id, event_type, (event_type IN ('error', 'click') AND user_id % 5 < 3) AS pushed, contains(lower(props), '\"k\": 1') AS searched FROM events WHERE event_type IN ('error', 'click', 'signup') AND (len([]::VARCHAR[]) = 0 OR false)",
)
def log_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by source kind, and an allow list that lets all pass when it is empty."""
    allowed = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "click", "signup") & ((F.size(allowed) == 0) | F.array_contains(allowed, F.col("event_type"))))
    return rows.select("event_id", "event_type", (F.col("event_type").isin("error", "click") & (F.col("user_id") % 5 < 3)).alias("pushed"), F.lower("props").contains('"k": 1').alias("searched"))
