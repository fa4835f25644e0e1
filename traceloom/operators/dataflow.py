"""Sequential algorithms that are grouped by function or pack: stack simulation and budget trimming."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from traceloom.functions.ids import estimate_tokens


def stack_edges(instructions: DataFrame) -> DataFrame:
    """(fn, src, dst): from the instruction that pushed a value to the one that takes it.

    instructions: fn, pos, pops, pushes. Functions are dealt out whole and sorted, and each partition is one pass in
    which the stack starts anew with every function. Taking from an empty stack gives no edge."""
    kind = instructions.schema["fn"].dataType.simpleString()

    def simulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, stack = None, []
        for batch in batches:
            edges = []
            for fn, pos, pops, pushes in zip(*(column.to_pylist() for column in batch.columns)):
                if fn != current:
                    current, stack = fn, []
                for _ in range(min(pops, len(stack))):
                    edges.append((fn, stack.pop(), pos))
                stack.extend([pos] * pushes)
            columns = list(zip(*edges)) or [(), (), ()]
            kinds = (batch.schema.field(0).type, pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["fn", "src", "dst"])

    rows = instructions.select("fn", F.col("pos").cast("long"), F.col("pops").cast("int"), F.col("pushes").cast("int"))
    return rows.repartition("fn").sortWithinPartitions("fn", "pos").mapInArrow(simulate, f"fn {kind}, src bigint, dst bigint")


#: What is taken out of a context pack, in this order, until it fits.
CASCADE = ("source_excerpt", "raw_operations", "reachable", "diagnostics", "related_types", "callers", "callees", "operations", "docs")


def trim_packs(packs: DataFrame, budget: int) -> DataFrame:
    """Context packs (id, section, text) within a budget of tokens: (id, kept, reasons, tokens).

    Sections go in the order of CASCADE while the pack is over budget; sections that are not listed always stay.
    A running sum over each pack's sections, last to go first, says how much stays with each."""
    order = F.array_position(F.array(*(F.lit(x) for x in CASCADE)), F.col("section"))
    rank = F.when(order == 0, F.lit(len(CASCADE) + 1)).otherwise(order)
    sized = packs.select("id", "section", estimate_tokens(F.coalesce("text", F.lit(""))).alias("tokens"), rank.alias("rank"))
    grouped = sized.groupBy("id").agg(F.sum("tokens").alias("total"), F.array_sort(F.collect_list(F.struct("rank", "section", "tokens"))).alias("sections"))
    start = F.struct(F.col("total").alias("left"), F.array().cast("array<string>").alias("gone"))
    fold = F.aggregate(
        "sections",
        start,
        lambda s, x: F.when(
            (s["left"] > budget) & (x["rank"] <= len(CASCADE)),
            F.struct((s["left"] - x["tokens"]).alias("left"), F.concat(s["gone"], F.array(x["section"])).alias("gone")),
        ).otherwise(s),
    )
    names = F.transform("sections", lambda x: x["section"])
    return grouped.withColumn("_f", fold).select("id", F.array_except(names, F.col("_f.gone")).alias("kept"), F.col("_f.gone").alias("reasons"), F.col("_f.left").alias("tokens"))


#: What a pack loses while it is over budget, in this order: section or state, and the reason that is noted. Fixed values.
STEPS = (
    "operation_metadata_trimmed", "source_excerpts_trimmed", "low_signal_operations_collapsed", "callers_trimmed", "callees_trimmed",
    "reachable_callees_trimmed", "related_types_trimmed", "diagnostics_trimmed", "source_excerpts_removed", "operation_histogram_trimmed",
    "field_access_lists_trimmed", "operation_spans_trimmed", "support_operations_trimmed", "operations_trimmed",
)
CORE_KINDS = ("Call", "Assert", "ReadField", "WriteField", "BorrowFieldMut", "BorrowGlobalMut", "MoveFrom", "MoveTo", "Pack", "Unpack")
SIGNAL_KINDS = (*CORE_KINDS, "Abort", "Branch", "BranchIf")
_WHOLE = {"callers": 4, "callees": 5, "reachable_callees": 6, "related_types": 7, "diagnostics": 8, "operation_histogram": 10, "field_access": 11}
_LINES = 8


def trim_steps(parts: DataFrame, budget: int) -> DataFrame:
    """Context packs (id, section, place, kind, text, metadata, span) cut to a budget of tokens: (id, tokens, reasons).

    Size only falls, so a step is reached only after all before it were taken, and what each saves is known beforehand: a
    part is taken if the pack is still over budget after all parts before it. Operations go one by one, the last first;
    other sections go whole; sections that no step names stay. A pack is one window, which spills."""
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    own, meta, span = size("text"), size("metadata"), size("span")
    short = size(F.array_join(F.slice(F.split(F.regexp_replace("text", "\n$", ""), "\n"), 1, _LINES), "\n"))
    atom = lambda step, sub, saves: F.struct(F.lit(step).alias("step"), sub.cast("long").alias("sub"), saves.alias("saves"))
    once, last_first = F.lit(0), -F.col("place")
    signal, core = F.col("kind").isin(*SIGNAL_KINDS), F.col("kind").isin(*CORE_KINDS)
    operation, excerpt = F.col("section") == "operations", F.col("section") == "source_excerpts"
    atoms = F.array_compact(F.array(
        F.when(operation & F.col("metadata").isNotNull(), atom(1, once, meta)), F.when(excerpt, atom(2, once, own - short)), F.when(operation & ~signal, atom(3, last_first, own + span)),
        *(F.when(F.col("section") == name, atom(step, once, own + meta + span)) for name, step in _WHOLE.items()), F.when(excerpt, atom(9, once, short)),
        F.when(operation & signal & F.col("span").isNotNull(), atom(12, once, span)), F.when(operation & signal & ~core, atom(13, last_first, own)), F.when(operation & core, atom(14, last_first, own)),
    ))
    rows = parts.withColumn("kind", F.coalesce("kind", F.lit("")))
    totals = rows.groupBy("id").agg(F.sum(own + meta + span).alias("total"))
    taken = rows.select("id", F.explode(atoms).alias("_a")).groupBy("id", "_a.step", "_a.sub").agg(F.sum("_a.saves").alias("saves"))
    before = Window.partitionBy("id").orderBy("step", "sub").rowsBetween(Window.unboundedPreceding, -1)
    running = taken.withColumn("_before", F.coalesce(F.sum("saves").over(before), F.lit(0))).join(totals, "id")
    gone = running.where(F.floor((F.col("total") - F.col("_before") + 3) / 4) > budget)
    reason = F.element_at(F.array(*(F.lit(x) for x in STEPS)), F.col("step"))
    cut = gone.groupBy("id").agg(F.sum("saves").alias("saved"), F.sort_array(F.collect_set(reason)).alias("reasons"))
    left = F.col("total") - F.coalesce("saved", F.lit(0))
    return totals.join(cut, "id", "left").select("id", F.floor((left + 3) / 4).alias("tokens"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))
