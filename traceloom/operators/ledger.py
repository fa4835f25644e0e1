"""Work queues and audit gates as batch operators over ordered items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from traceloom.operators.containment import item_set, superset_counts
from traceloom.operators.sequence import numbered
from traceloom.scratch import materialize


def queue_head(items: DataFrame, key: str, order: Sequence[str], item: str, done: Column) -> DataFrame:
    """(key, claimed): the first item of each queue that isn't done."""
    return items.where(~done).groupBy(key).agg(F.min_by(item, F.struct(*order)).alias("claimed"))


def may_run(items: DataFrame, key: str, order: Sequence[str], failed: Column) -> DataFrame:
    """Add ``may_run``: whether no earlier item of the queue has failed."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumn("may_run", F.coalesce(F.sum(failed.cast("int")).over(before), F.lit(0)) == 0)


def terminal_status(items: DataFrame, key: str, failed: Column, gap: Column) -> DataFrame:
    """(key, status, n_gaps): completed with gaps, if any item has failed or is missing."""
    found = items.groupBy(key).agg(F.bool_or(failed | gap).alias("_gaps"), F.count_if(failed).alias("n_gaps"))
    return found.withColumn("status", F.when(F.col("_gaps"), "CompletedWithGaps").otherwise("Completed")).drop("_gaps")


def confirmed(findings: DataFrame, evidence: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings that two independent methods support, one of them a replay with a trace, and a positive verdict covers.

    findings: finding, evidence (array); evidence: evidence, method, has_trace; verdicts: candidate, positive, evidence (array)."""
    cited = findings.select("finding", F.explode("evidence").alias("item")).join(evidence, F.col("item") == F.col("evidence"))
    supported = cited.groupBy("finding").agg(F.countDistinct("method").alias("methods"), F.bool_or((F.col("method") == "replay") & F.col("has_trace")).alias("replayed"))
    supported = supported.where("methods >= 2 AND replayed").select("finding")
    positive = verdicts.where("positive")
    named = findings.join(positive.select(F.col("candidate").alias("finding")), "finding", "left_semi").select("finding")
    held = superset_counts(findings, positive.select("evidence"), "finding", "evidence").where("n_supersets > 0").select("finding")
    return findings.join(named.unionByName(held), "finding", "left_semi").join(supported, "finding", "left_semi")


# What does not count as an independent method, and how a replay is marked.
NOT_INDEPENDENT = ("HumanReview", "GeneratedTest")
MODEL, REPLAY, REPLAYED = "ModelSubmitted", "ExploitReplay", "AdapterReplay"
POSITIVE = ("Accepted", "Supported")


def finding_gate(findings: DataFrame, evidence: DataFrame, conclusions: DataFrame) -> DataFrame:
    """(finding, n_methods, replayed, n_named, n_supersets, problem): what keeps each finding from being confirmed, the first of
    evidence_not_found, one_method, no_replay and no_conclusion; null if nothing does.

    findings: finding, evidence (array); evidence: evidence, method, attestation, trace; conclusions: status, candidates and
    evidence (arrays). A positive conclusion counts if it names the finding, or holds all that the finding cites."""
    cited = findings.select("finding", F.explode(item_set(F.col("evidence"))).alias("evidence"))
    known = evidence.select(F.col("evidence").cast("string"), "method", "attestation", "trace").withColumn("_known", F.lit(True))
    counts = (F.col("attestation") != MODEL) & ~F.col("method").isin(*NOT_INDEPENDENT)
    replay = (F.col("method") == REPLAY) & (F.col("attestation") == REPLAYED) & F.col("trace").isNotNull()
    found = cited.join(known, "evidence", "left").groupBy("finding").agg(
        F.countDistinct(F.when(counts, F.col("method"))).alias("n_methods"), F.bool_or(F.coalesce(replay, F.lit(False))).alias("replayed"), F.bool_or(F.col("_known").isNull()).alias("_missing")
    )
    positive = conclusions.where(F.col("status").isin(*POSITIVE))
    named = positive.select(F.explode(item_set(F.col("candidates"))).alias("_named")).groupBy("_named").agg(F.count(F.lit(1)).alias("n_named"))
    held = superset_counts(findings, positive, "finding", "evidence")
    none, no = F.lit(0).cast("long"), F.lit(False)
    rows = findings.select("finding").withColumn("_name", F.col("finding").cast("string")).join(found, "finding", "left")
    rows = rows.join(named, rows["_name"] == named["_named"], "left").join(held, "finding").select(
        "finding", F.coalesce("n_methods", none).alias("n_methods"), F.coalesce("replayed", no).alias("replayed"), F.coalesce("n_named", none).alias("n_named"), "n_supersets", F.coalesce("_missing", no).alias("_missing")
    )
    problem = (
        F.when(F.col("_missing"), "evidence_not_found").when(F.col("n_methods") < 2, "one_method")
        .when(~F.col("replayed"), "no_replay").when(F.col("n_named") + F.col("n_supersets") == 0, "no_conclusion")
    )
    return rows.withColumn("problem", problem).drop("_missing")


def merged_gaps(gaps: DataFrame, key: str, order: str, values: Sequence[str]) -> DataFrame:
    """(key, gaps): a JSON array with one object for each capability, in the order of their first reports.

    ``gaps`` has (key, order, capability, values...); an object says what its capability's last report says, nulls left out."""
    last = gaps.groupBy(key, "capability").agg(F.min(F.struct(order, "capability")).alias("_first"), F.max(F.struct(order, *values)).alias("_last"))
    one = F.struct(F.col("_first").alias("first"), F.to_json(F.struct("capability", *(F.col(f"_last.{c}").alias(c) for c in values))).alias("text"))
    texts = F.transform(F.array_sort(F.collect_list(one)), lambda x: x["text"])
    return last.groupBy(key).agg(F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")).alias("gaps"))


def finish_outcomes(requests: DataFrame, items: DataFrame, evidence: DataFrame) -> DataFrame:
    """(request, outcome): what each request to finish an item leads to, against the state ahead of all of them.

    requests: request, run, item, worker, status, cited (array); items: run, item, claimed_by, unavailable, methods, evidence
    (arrays); evidence: run, evidence, item, method, submitted_by_model. The first of these applies: invalid_status,
    evidence_not_found (in the run), item_not_found, claimed_by_other, and for a completion unavailable_capabilities and
    missing_evidence (methods are asked for, and no evidence of the item that the model did not submit itself uses one
    of them); else the new status. A null array is empty, and request is a key."""
    return _judged(requests, items, evidence, ["request", "run", "item", "cited"]).select("request", "outcome")


def _judged(requests: DataFrame, items: DataFrame, evidence: DataFrame, kept: Sequence[str], timed: bool = False, tasks: int | None = None) -> DataFrame:
    """Requests (``kept`` of their columns) with their outcomes, and whether their own or their item's evidence proves it (proven);
    ``timed`` if a claim counts only from its item's claimed_at on; joins have ``tasks`` partitions, if given. What the item alone decides is settled before references are looked up, so that rows go once by
    their references and once by their items; the outcome stays dealt out by (run, item)."""
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    states = items.select(
        "run", "item", F.col("claimed_by").alias("_holder"), *([F.col("claimed_at").alias("_since")] if timed else []), (F.size(listed("unavailable")) > 0).alias("_lacks"),
        listed("methods").alias("_methods"), listed("evidence").alias("_held"), F.lit(True).alias("_known"),
    )
    worker = F.when(F.col("_since") <= F.col("time"), F.col("worker")) if timed else F.col("worker")
    completes = F.col("status") == "completed"
    settled = (
        F.when(~F.coalesce(F.col("status").isin(*FINISHED), F.lit(False)), "invalid_status").when(F.col("_known").isNull(), "item_not_found")
        .when(~F.col("_holder").eqNullSafe(worker) | F.col("_holder").isNull(), "claimed_by_other").when(completes & F.col("_lacks"), "unavailable_capabilities").otherwise(F.col("status"))
    )
    deal = lambda rows, *keys: rows.repartition(*([tasks] if tasks else []), *keys)
    wanted = deal(requests, "run", "item").join(states, ["run", "item"], "left").withColumn("cited", listed("cited"))
    every = [*kept, "_settled", "_asks"]
    refs = wanted.withColumns({"_settled": settled, "_asks": F.coalesce(F.size("_methods") > 0, F.lit(False))}).select(*every, "_methods", F.explode_outer(F.array_union("cited", listed("_held"))).alias("_ref"))
    stored = deal(evidence.select(F.col("run").alias("_run"), F.col("evidence").alias("_stored"), F.col("item").alias("_of"), "method", "submitted_by_model"), "_run", "_stored")
    proves = (F.col("_of") == F.col("item")) & ~F.col("submitted_by_model") & F.array_contains("_methods", F.col("method"))
    missing = F.col("_stored").isNull() & F.array_contains("cited", F.col("_ref"))
    found = refs.join(stored, (F.col("run") == F.col("_run")) & (F.col("_ref") == F.col("_stored")), "left")
    found = found.select(*every, F.coalesce(missing, F.lit(False)).alias("_missing"), F.coalesce(proves, F.lit(False)).alias("_proves"))
    checked = deal(found, "run", "item").groupBy(*every).agg(F.bool_or("_missing").alias("_missing"), F.bool_or("_proves").alias("proven"))
    outcome = (
        F.when(F.col("_missing") & (F.col("_settled") != "invalid_status"), "evidence_not_found")
        .when((F.col("_settled") == "completed") & F.col("_asks") & ~F.col("proven"), "missing_evidence").otherwise(F.col("_settled"))
    )
    return checked.select(*kept, outcome.alias("outcome"), "proven")


FINISHED = ("completed", "failed", "blocked")


def claimed_items(items: DataFrame, claims: DataFrame) -> DataFrame:
    """Items with claimed_by and claimed_at, null if no claim got them.

    items: run, item, place, stage; claims: run, worker, stage, time. A claim takes the first item (by place, item) of its run and
    stage that is still pending, of any stage if it names none; with nothing pending it takes nothing. Claimed items never become
    pending again, so the k-th claim of a queue (by time, worker) takes its k-th item. In a run, either all claims name a
    stage or none does; a run with both has no such order, and the job fails."""
    kinds = claims.groupBy("run").agg(F.bool_and(F.col("stage").isNull()).alias("_any"), F.count_if(F.col("stage").isNull()).alias("_none"), F.count(F.lit(1)).alias("_all"))
    both = (F.col("_none") > 0) & (F.col("_none") < F.col("_all"))
    kinds = kinds.select("run", F.when(both, F.raise_error(F.concat(F.lit("claims with and without stages in run "), F.col("run").cast("string"))).cast("boolean")).otherwise(F.col("_any")).alias("_any"))
    queued = items.join(kinds, "run", "left").withColumn("_queue", F.when(F.col("_any"), "").otherwise(F.col("stage"))).drop("_any")
    queues = F.col("run").isNotNull() & F.col("_queue").isNotNull()
    waiting = numbered(queued.where(queues), ["run", "_queue"], ["place", "item"], "_k")
    asking = numbered(claims.select("run", F.col("worker").alias("claimed_by"), F.col("time").alias("claimed_at"), F.coalesce("stage", F.lit("")).alias("_queue")), ["run", "_queue"], ["claimed_at", "claimed_by"], "_k")
    taken = waiting.join(asking, ["run", "_queue", "_k"], "left").select(*items.columns, "claimed_by", "claimed_at")
    # Items without a queue meet no claim.
    return taken.unionByName(queued.where(~queues).select(*items.columns), allowMissingColumns=True)


def replayed_work(items: DataFrame, claims: DataFrame, finishes: DataFrame, evidence: DataFrame, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A ledger's claims and finishes, replayed in order of time without going through them one by one: outcomes and items.

    items: run, item, place, stage, unavailable, methods, evidence (arrays), all pending at first; claims as ``claimed_items`` takes
    them; finishes: request, run, item, worker, status, cited (array), time; evidence as ``finish_outcomes`` takes it.

    outcomes: request, run, item, cited, time and ``outcome`` of the finishes, dealt out by (run, item) into ``tasks``. A finish meets the claims up to its own time. What earlier accepted finishes of
    its item cited counts as the item's evidence: a completion that lacks a proof is complete if one of these brought it.
    items: run, item, stage, place, status (pending, claimed, or that of the last accepted finish), claimed_by, attempts,
    updated_at and n_evidence (different evidence held and cited by accepted finishes)."""
    held = materialize(claimed_items(items, claims), "claimed")
    judged = _judged(finishes, held, evidence, ["request", "run", "item", "cited", "time"], timed=True, tasks=tasks)
    before = Window.partitionBy("run", "item").orderBy("time", "request").rowsBetween(Window.unboundedPreceding, -1)
    brought = F.coalesce(F.bool_or(F.col("proven") & F.col("outcome").isin(*FINISHED)).over(before), F.lit(False))
    outcome = F.when((F.col("outcome") == "missing_evidence") & brought, "completed").otherwise(F.col("outcome"))
    outcomes = judged.withColumn("outcome", outcome).drop("proven")

    # Outcomes stand by their items, so neither this nor the join moves them again.
    accepted = outcomes.where(F.col("outcome").isin(*FINISHED))
    last = accepted.groupBy("run", "item").agg(F.max_by("outcome", F.struct("time", "request")).alias("_status"), F.max("time").alias("_time"), F.flatten(F.collect_list("cited")).alias("_cited"))
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    state = held.join(last, ["run", "item"], "left").withColumn("n_evidence", F.size(F.array_union(listed("_cited"), listed("evidence"))).cast("long"))
    claimed = F.col("claimed_by").isNotNull()
    return outcomes, state.select(
        "run", "item", "stage", "place", F.coalesce("_status", F.when(claimed, "claimed").otherwise("pending")).alias("status"), "claimed_by", claimed.cast("long").alias("attempts"),
        "claimed_at", F.coalesce("_time", "claimed_at").alias("updated_at"), "n_evidence",
    )


def run_states(state: DataFrame) -> DataFrame:
    """(run, current_stage, updated_at, n_pending, n_claimed, n_completed, n_failed, n_blocked) of replayed items.

    The stage is that of the last claimed item; behind a finish, that of the first pending item if there is one."""
    place = F.struct("place", "item")
    pending, claimed = F.col("status") == "pending", F.col("claimed_at").isNotNull()
    found = state.groupBy("run").agg(
        F.min_by("stage", F.when(pending, place)).alias("_next"), F.max_by("stage", F.when(claimed, F.struct("claimed_at", "place", "item"))).alias("_last"),
        F.max("claimed_at").alias("_claim"), F.max(F.when(F.col("status").isin(*FINISHED), F.col("updated_at"))).alias("_finish"), F.max("updated_at").alias("updated_at"),
        *(F.count_if(F.col("status") == status).alias(f"n_{status}") for status in ("pending", "claimed", *FINISHED)),
    )
    stage = F.when((F.col("_finish") >= F.col("_claim")) & (F.col("n_pending") > 0), F.col("_next")).otherwise(F.col("_last"))
    return found.select("run", stage.alias("current_stage"), "updated_at", *(f"n_{status}" for status in ("pending", "claimed", *FINISHED)))
