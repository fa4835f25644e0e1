"""Mixing sources to target weights by entropy balancing. Native: DataFrame functions only.

Every document gets a rate w between 0 and MOST_COPIES, the number of times that the mix takes it. Of all rates that meet
the token constraints (for each source s, the sum of rate * size is its target T_s) entropy balancing takes those of least
relative entropy to the corpus' own token distribution; besides, the mix is to keep the corpus' mean of z, the logarithm
of the size, standardised over tokens, as far as the bounds allow (a penalty PENALTY * tokens on its multiplier). The dual

    D(lambda, mu) = sum over documents of size * c(lambda_s + mu z) - sum over s of T_s lambda_s + penalty * mu^2 / 2

with c' = min(exp, MOST_COPIES) is convex, and its solution tilts the documents exponentially: w = min(exp(lambda_s + mu z),
MOST_COPIES). Newton's method solves it. In each iteration Spark sums gradient and curvature over the corpus' classes of
equally long documents of a source, for each source and, through the one multiplier that all share, over all; steps that
do not lower the dual are halved, and the iteration ends when no constraint is off by more than TOLERANCE of the tokens.

Rates become whole copies by systematic rounding: a source's documents are ordered by size, and the first k of them get
together the rounded sum of their rates, so that neighbours of nearly the same size make up for each other; the words that
are then still lacking or too many are made up by copies of documents that fit, from the largest to the smallest.
The documents of one source and size are numbered in hash buckets, so that no hot source or size is numbered in one task.

Defined cases: a null text counts as empty (size 0); null sources are one source, ordered last; a source without words has
target 0; null and repeated ids are documents like others, told apart by their texts, and rows that repeat id and text are
numbered in any order, which changes no sum; an empty table gives an empty result; columns of the input other than id, text
and source are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from traceloom.llm.common import WORD, materialize

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: The mix' words as a share of the corpus'.
SHARE = 1.5
#: The most copies of a document, and with it the most of a source.
MOST_COPIES = 2
#: Of the shared multiplier, as a share of the corpus' tokens; it bounds the multiplier where the mean can't be kept.
PENALTY = 0.05
#: Where Newton's iteration ends: the largest error of a constraint as a share of all tokens, or that many steps. What
#: is then left is made up when rates are rounded.
TOLERANCE, ITERATIONS = 1e-9, 60
#: Hash buckets of a class of equally long documents.
BUCKETS = 1024
#: Where systematic rounding starts.
OFFSET = 0.5


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def numbered(sources: DataFrame, by: str) -> DataFrame:
    """Add ``_place``, from 0, in the order of a column (null last): rows are sorted in ranges and numbered in each."""
    ordered = materialize(sources.orderBy(F.col(by).asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # One row for each partition.
    counts = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = ordered.withColumn("_part", part).join(before.select("_part", "_before"), "_part")
    return joined.withColumn("_place", F.col("_before") + row).drop("_part", "_at", "_before")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """Add ``target`` to (source, source_size): shares by weight, those over ``most`` times the size cut there and their
    excess reshared by weight, until none is above: a level t at which the sum of min(cap, weight * t) is the total."""
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_place") % len(weights)).cast("int") + 1)
    known = numbered(sources, "source").withColumn("_weight", weight).withColumn("_cap", most * F.col("source_size").cast("double"))
    total = share * float(known.agg(F.sum("source_size").alias("n")).first()["n"] or 0)
    level, open_ = 0.0, -1
    while True:
        full = F.col("_cap") <= F.col("_weight") * level
        own = known.agg(F.sum(F.when(full, F.col("_cap"))).alias("full"), F.sum(F.when(~full, F.col("_weight"))).alias("weight"), F.count_if(~full).alias("n")).first()
        if own["n"] == open_ or not own["weight"]:
            break
        # Fewer sources are open in each round, so this ends.
        level, open_ = (total - (own["full"] or 0.0)) / own["weight"], own["n"]
    all_full = F.lit(not own["weight"])
    return known.withColumn("target", F.when(all_full, F.col("_cap")).otherwise(F.least("_cap", F.col("_weight") * level))).select("source", "source_size", "target")


def rate_of(tilt: Column, most: float = MOST_COPIES) -> Column:
    return F.when(tilt >= F.log(F.lit(float(most))), F.lit(float(most))).otherwise(F.exp(tilt))


def balance(classes: DataFrame, solved: DataFrame, most: int = MOST_COPIES) -> tuple[DataFrame, float]:
    """(source, lambda) and mu of the dual's minimum.

    classes: source, size, _docs, z; solved: source, source_size, target. Sources whose target is 0 or all that they
    can give have no multiplier: their rates are 0 or ``most``."""
    cap = most * F.col("source_size").cast("double")
    state = F.when(F.col("target") <= 0, F.lit("none")).when(F.col("target") >= cap * (1 - 1e-12), F.lit("full")).otherwise("open")
    known = _join(classes, solved.withColumn("_state", state), ["source"]).where("size > 0")
    known = materialize(known.select("source", "target", "_state", "z", (F.col("size") * F.col("_docs")).cast("double").alias("_mass"), "source_size"), "classes")
    total = float(known.agg(F.sum("_mass").alias("n")).first()["n"] or 0)
    opened = known.where("_state = 'open'").drop("target")
    found = known.where("_state = 'open'").groupBy("source").agg(F.first("target").alias("target"), F.log(F.first("target") / F.sum("_mass")).alias("lambda"))
    found = found.withColumn("move", F.lit(0.0))
    of_full = float(known.where("_state = 'full'").agg(F.sum(F.col("_mass") * F.col("z") * most).alias("n")).first()["n"] or 0.0)
    mu, move, scale, value = 0.0, 0.0, 1.0, math.inf
    if not total or found.isEmpty():
        return found.select("source", "lambda"), mu
    penalty, limit = PENALTY * total, math.log(most)
    for _ in range(ITERATIONS):
        at, at_mu = F.col("lambda") - scale * F.col("move"), mu - scale * move
        tilt = at + at_mu * F.col("z")
        taken = F.col("_mass") * rate_of(tilt, most)
        free = F.when(tilt < limit, taken).otherwise(0.0)
        area = F.col("_mass") * F.when(tilt < limit, F.exp(tilt)).otherwise(most * (1 + tilt - limit))
        sums = _join(opened, found, ["source"]).groupBy("source").agg(
            F.first("target").alias("target"), F.first(at).alias("lambda"),
            (F.sum(area) - F.first(F.col("target") * at)).alias("d"), (F.sum(taken) - F.first("target")).alias("g"), F.sum(free).alias("h"),
            F.sum(taken * F.col("z")).alias("gz"), F.sum(free * F.col("z")).alias("hz"), F.sum(free * F.col("z") * F.col("z")).alias("hzz"),
        )
        sums = materialize(sums, "sums")
        # Each source's multiplier is eliminated from the one equation that all share.
        own, both = F.greatest("h", F.lit(1e-9 * total)), F.col("hz")
        whole = sums.agg(
            F.sum("d").alias("d"), F.max(F.abs("g")).alias("off"), F.sum("gz").alias("gz"), F.sum("hzz").alias("hzz"),
            F.sum(both * F.col("g") / own).alias("cross"), F.sum(both * both / own).alias("less"),
        ).first()
        reached = whole["d"] + of_full * at_mu + penalty * at_mu**2 / 2
        if reached > value + 1e-13 * abs(value) and scale > 1e-4:
            scale /= 2  # too far: the same direction again, half as long
            continue
        value, mu, scale = reached, at_mu, 1.0
        slope = whole["gz"] + of_full + penalty * mu
        move = max(-4.0, min(4.0, (slope - whole["cross"]) / (max(whole["hzz"] - whole["less"], 0.0) + penalty)))
        moves = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (F.col("g") - both * move) / own))
        found = sums.select("source", "target", "lambda", moves.alias("move"))
        if whole["off"] <= TOLERANCE * total and abs(slope) <= TOLERANCE * total:
            break
    return found.select("source", "lambda"), mu


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    most: int = MOST_COPIES,
) -> DataFrame:
    """One row per input row: id, size, source_size, target, rate, copies, taken (copies * size) and text_hash, which with
    the id tells rows apart."""
    sizes = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("_tie"))
    sizes = materialize(sizes, "sizes")
    classes = materialize(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("_docs")), "lengths")
    solved = targets(classes.groupBy("source").agg(F.sum(F.col("size") * F.col("_docs")).alias("source_size")), weights, share, most)
    mass, log = F.col("size") * F.col("_docs"), F.log(F.col("size").cast("double"))
    moments = classes.where("size > 0").agg(F.sum(mass).alias("n"), F.sum(mass * log).alias("s"), F.sum(mass * log * log).alias("q")).first()
    mean = (moments["s"] / moments["n"]) if moments["n"] else 0.0
    spread = (max(0.0, moments["q"] / moments["n"] - mean * mean) ** 0.5 if moments["n"] else 0.0) or 1.0
    classes = classes.withColumn("z", F.when(F.col("size") > 0, (log - mean) / spread).otherwise(0.0))
    tilts, mu = balance(classes, solved, most)
    rated = _join(_join(classes, solved, ["source"]), tilts, ["source"], "left")
    rate = F.when((F.col("size") == 0) | (F.col("target") <= 0), 0.0).when(F.col("lambda").isNull(), float(most)).otherwise(rate_of(F.col("lambda") + mu * F.col("z"), most))
    # Sums of doubles depend on their order in the last digits, which a rerun may change.
    rate = F.round(rate, 9)
    copies = materialize(copies_of_classes(rated.withColumn("rate", rate), most), "copies")
    placed = sizes.withColumn("_bucket", F.pmod(F.xxhash64("_id", "_tie"), F.lit(BUCKETS)).cast("int"))
    key = ["source", "size", "_bucket"]
    earlier = Window.partitionBy("source", "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    buckets = buckets.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    buckets = _join(buckets, copies, ["source", "size"])
    within = Window.partitionBy(*key).orderBy("_id", "_tie")
    rank = F.col("_before") + F.row_number().over(within) - 1
    # Copies of a class spread evenly over its documents: none gets more than the mean, rounded up.
    even = F.floor(((rank + 1) * F.col("_copies")) / F.col("_docs")) - F.floor((rank * F.col("_copies")) / F.col("_docs"))
    return (
        _join(placed, buckets, key)
        .withColumn("copies", even)
        .select(
            F.col("_id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "rate", "copies",
            (F.col("copies") * F.col("size")).alias("taken"), F.col("_tie").alias("text_hash"),
        )
    )


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which null equals null; the keys come from the left."""
    right = right.withColumnsRenamed({key: f"_r_{key}" for key in keys})
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    return left.join(right, same, how).drop(*(f"_r_{key}" for key in keys))


def _lack(classes: DataFrame) -> DataFrame:
    """The words that each source lacks, or has too much if below 0."""
    return classes.groupBy("source").agg((F.first("target") - F.sum(F.col("_copies") * F.col("size"))).alias("lack"))


def copies_of_classes(classes: DataFrame, most: int) -> DataFrame:
    """Copies that the documents of one source and size get together; classes: source, size, _docs, rate, target.

    Systematic rounding down the sizes first; then what the source still lacks (or has too much) is made up by copies
    more or less of some documents. In the last step each power of two offers the documents of one size, so a source's
    list has as many entries as a size has bits."""
    before = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    wish = F.col("_docs") * F.col("rate")
    classes = classes.withColumn("_wish", F.coalesce(F.sum(wish).over(before), F.lit(0.0)))
    classes = classes.withColumn("_copies", F.floor(F.col("_wish") + wish + OFFSET) - F.floor(F.col("_wish") + OFFSET))
    classes = classes.withColumn("_copies", F.greatest(F.lit(0).cast("long"), F.least(F.col("_copies"), F.col("_docs") * most)))
    # A large lack is made up class by class, from the largest size that fits it on, until the next class is too much.
    classes = materialize(_join(classes, _lack(classes), ["source"]), "rounded")
    up, down = F.col("_docs") * most - F.col("_copies"), F.col("_copies")
    can = F.when((F.col("size") == 0) | (F.col("rate") <= 0) | (F.col("size") > F.abs("lack")), F.lit(0)).when(F.col("lack") > 0, up).otherwise(down)
    classes = classes.withColumn("_can", can).withColumn("_used", F.coalesce(F.sum(F.col("_can") * F.col("size")).over(before), F.lit(0)))
    some = F.greatest(F.lit(0).cast("long"), F.least(F.col("_can"), F.floor((F.abs("lack") - F.col("_used")) / F.col("size"))))
    classes = classes.withColumn("_copies", F.col("_copies") + F.when(F.col("_can") == 0, 0).otherwise(F.signum("lack").cast("long") * some)).drop("lack")
    classes = materialize(classes, "filled")
    # What is left is less than some document's size; it is made up from the largest power of two of sizes on.
    room = F.least(up, F.lit(8)) + F.least(down, F.lit(8))
    offers = classes.where((F.col("size") > 0) & (F.col("rate") > 0)).withColumn("_bits", F.floor(F.log2("size")))
    offers = offers.groupBy("source", "_bits").agg(F.max_by(F.struct("size", up.alias("up"), down.alias("down")), F.struct(room, -F.col("size"))).alias("of"))
    listed = _join(offers.groupBy("source").agg(F.sort_array(F.collect_list("of"), asc=False).alias("of")), _lack(classes), ["source"])
    start = F.struct(F.col("lack").alias("lack"), F.array().cast("array<struct<size:bigint,more:bigint>>").alias("changes"))

    def step(state, of):
        more = F.least(of["up"], F.greatest(-of["down"], (state["lack"] / of["size"]).cast("long")))
        change = F.array(F.struct(of["size"].alias("size"), more.alias("more")))
        return F.struct((state["lack"] - (more * of["size"]).cast("double")).alias("lack"), F.concat(state["changes"], change).alias("changes"))

    changes = listed.select("source", F.explode(F.aggregate("of", start, step)["changes"]).alias("change")).select("source", "change.size", "change.more")
    return _join(classes, changes, ["source", "size"], "left").select(
        "source", "size", "source_size", "target", "rate", "_docs", (F.col("_copies") + F.coalesce("more", F.lit(0))).alias("_copies")
    )
