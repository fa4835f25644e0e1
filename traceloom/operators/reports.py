"""Reports on packages, stages, scans and jobs: health of an index, bound capabilities, merged metadata, counts of findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from traceloom.functions import scoring, times

# A diagnostic's code and severity, when it is given, and the counters that it reports.
HEALTH = (
    ("missing_summary_artifacts", "warning", "summary_artifact_count = 0", ()),
    ("body_operations_unavailable", "info", "full_mode AND function_count > 0 AND operation_count = 0", ("function_count", "operation_count")),
    ("exact_operation_spans_unavailable", "info", "operation_count > 0 AND operation_exact_span_count = 0", ("operation_count", "operation_source_span_count")),
    ("call_edge_parity_mismatch", "warning", "call_operation_count <> call_edge_with_operation_count", ("call_operation_count", "call_edge_with_operation_count")),
    ("dangling_operation_edges", "error", "dangling_operation_edge_count > 0", ("dangling_operation_edge_count",)),
    ("dangling_semantic_tag_targets", "error", "dangling_semantic_tag_target_count > 0", ("dangling_semantic_tag_target_count",)),
    ("non_neutral_semantic_tags", "error", "prohibited_tag_count > 0", ("prohibited_tag_count",)),
)


def _entries(text: Column) -> Column:
    """A JSON object as a map of values; null for all else."""
    return F.when(F.ltrim(text).startswith("{"), F.from_json(text, "map<string,variant>"))


def _any_json(text: Column) -> Column:
    """A JSON value; text that isn't JSON is a value of its own."""
    return F.coalesce(F.try_parse_json(text), text.cast("variant"))


def _object(entries: Column) -> Column:
    """A map as JSON with its keys in order."""
    written = F.transform(F.map_entries(entries), lambda e: F.struct(e["key"], F.to_json(e["value"]).alias("value")))
    parts = F.transform(F.array_sort(written), lambda e: F.concat(F.to_json(e["key"].cast("variant")), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def merge_objects(left: Column, right: Column) -> Column:
    """JSON objects merged, the right one's values winning; where one of them is none, the left text stays."""
    mine, more = _entries(left), _entries(right)
    both = F.map_zip_with(mine, more, lambda k, own, other: F.coalesce(other, own))
    return F.when(mine.isNotNull() & more.isNotNull(), _object(both)).otherwise(left)


def with_entry(metadata: Column, name: str, value: Column) -> Column:
    """Metadata (JSON) with one more entry. Missing metadata is an empty object, and what isn't an object is kept as ``previousMetadata``."""
    held = F.to_json(F.create_map(F.lit("previousMetadata"), _any_json(metadata)))
    base = F.when(metadata.isNull(), F.lit("{}")).when(_entries(metadata).isNotNull(), metadata).otherwise(held)
    return merge_objects(base, F.to_json(F.create_map(F.lit(name), F.parse_json(value))))


def readiness() -> Column:
    return scoring.first_match(
        [(F.col("summary_artifact_count") == 0, "missing_summary_artifacts"), (F.col("full_mode") & (F.col("operation_count") > 0), "compiler_backed"), (F.col("summary_artifact_count") > 0, "summary_pointer")], "partial"
    )


def freshness(known: Column, clean: Column) -> Column:
    """The state of an index by its invalidation plan and by whether there were fingerprints before."""
    return scoring.first_match([(clean, "fresh"), (known, "changed")], "first_index")


def index_health(packages: DataFrame) -> DataFrame:
    """Add ``readiness``, ``freshness`` and ``diagnostics`` (code, severity, reported counters as JSON) to packages that have the
    counters above, ``full_mode``, ``known`` and ``clean``, and put the first two into ``metadata`` as ``index_health``.

    ``codes``, an array of diagnostics given before, keeps them from being given again."""
    rows = packages.withColumn("readiness", readiness()).withColumn("freshness", freshness(F.col("known"), F.col("clean")))
    report = lambda names: F.to_json(F.struct(*names)) if names else F.to_json(F.struct("readiness"))
    given = [
        F.when(F.expr(when) & ~F.coalesce(F.array_contains("codes", code), F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), report(names).alias("metadata")))
        for code, severity, when, names in HEALTH
    ]
    health = F.to_json(F.struct("freshness", "readiness"))
    return rows.withColumn("diagnostics", F.array_compact(F.array(*given))).withColumn("metadata", with_entry(F.col("metadata"), "index_health", health))


def merged_metadata(outputs: DataFrame, bundle: str, order: Sequence[str], metadata: str) -> DataFrame:
    """(bundle, key, value): the metadata objects of each bundle's outputs merged, later ones winning; values are JSON.

    An output without an object changes nothing; a bundle whose first output has none keeps none. Outputs are exploded to
    entries, of which the last of each key is found before the shuffle and behind it, so no bundle is held whole. Outputs
    that tie in ``order`` should agree."""
    place = F.struct(*order)
    rows = outputs.select(F.col(bundle), place.alias("_at"), _entries(F.col(metadata)).alias("_entries"))
    first = rows.groupBy(bundle).agg(F.min_by(F.col("_entries").isNotNull(), "_at").alias("_open")).where("_open").select(bundle)
    entries = rows.select(bundle, "_at", F.explode("_entries").alias("key", "value")).select(bundle, "key", "_at", F.to_json("value").alias("value"))
    return entries.groupBy(bundle, "key").agg(F.max_by("value", "_at").alias("value")).join(first, bundle, "left_semi")


def bound_capabilities(desired: DataFrame, bindings: DataFrame, keys: Sequence[str], place: str) -> DataFrame:
    """Add ``state`` (``available``, ``unavailable``, ``unbound``), ``provider`` and ``reason`` to desired capabilities, by the first
    binding of each in its stage. Bindings have ``place``, ``available``, ``provider`` and ``diagnostic``."""
    first = bindings.groupBy(*keys, "capability").agg(F.min_by(F.struct("available", "provider", "diagnostic"), place).alias("_bound"))
    joined = desired.join(first, [*keys, "capability"], "left")
    has, usable = F.col("_bound").isNotNull(), F.coalesce(F.col("_bound.available"), F.lit(False))
    reason = F.coalesce("_bound.diagnostic", F.lit("capability provider is unavailable"))
    return joined.select(
        *desired.columns,
        F.when(usable, "available").when(has, "unavailable").otherwise("unbound").alias("state"),
        F.when(usable, F.col("_bound.provider")).alias("provider"),
        F.when(has & ~usable, reason).alias("reason"),
    )


def stage_actions(stages: DataFrame, bound: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each stage's ``action`` by how many of its desired capabilities can't be used; unbound ones are passed over in silence."""
    counts = bound.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_desired"), F.count_if(F.col("state") == "available").alias("n_available"), F.count_if(F.col("state") == "unavailable").alias("n_unavailable"))
    rows = stages.join(counts, list(keys), "left").fillna(0, ["n_desired", "n_available", "n_unavailable"])
    rules = [
        (F.col("n_desired") == 0, "ModelOnly"),
        (F.col("n_unavailable") == 0, "UseAvailableCapabilities"),
        (F.col("n_unavailable") < F.col("n_desired"), "UseAvailableCapabilitiesWithGaps"),
    ]
    return rows.withColumn("action", scoring.first_match(rules, "RecordUnavailableAndContinue"))


def scan_counts(findings: DataFrame, package: str, kinds: Sequence[str]) -> DataFrame:
    """``<kind>_count``, ``has_<kind>`` and ``<kind>_added`` of each package, from findings (kind, file, name, detail, fallback).

    Findings that agree in all but the package count once. One of a fallback counts, and is added, where no other has its
    file and name. Null is a value like others."""
    key = F.struct("kind", "file", "name")
    detail = F.when(~F.col("fallback"), F.struct("detail"))
    found = findings.groupBy(package, key.alias("_key")).agg(F.count_distinct(detail).alias("_own"))
    parts = []
    for kind in kinds:
        mine = F.col("_key.kind") == kind
        parts += [F.coalesce(F.sum(F.when(mine, F.greatest("_own", F.lit(1)))), F.lit(0)).alias(f"{kind}_count"), F.coalesce(F.bool_or(mine), F.lit(False)).alias(f"has_{kind}"), F.count_if(mine & (F.col("_own") == 0)).alias(f"{kind}_added")]
    return found.groupBy(package).agg(*parts)


def job_progress(items: DataFrame, job: str, now: Column, timeout_seconds: int) -> DataFrame:
    """Each job's items by ``status``, those running without an update for the timeout (``n_stale``), and whether it is ``done``:
    nothing pending or running. ``cancellable`` is a job of which nothing runs."""
    counts = [F.count_if(F.col("status") == status).alias(f"n_{status}") for status in ("pending", "running", "completed", "failed")]
    stale = F.count_if((F.col("status") == "running") & times.is_stale(F.col("updated_at"), now, timeout_seconds)).alias("n_stale")
    found = items.groupBy(job).agg(F.count(F.lit(1)).alias("n_items"), *counts, stale)
    idle = F.col("n_running") == 0
    return found.withColumn("done", (F.col("n_pending") == 0) & idle).withColumn("cancellable", idle)
