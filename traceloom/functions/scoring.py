"""Text scores and classifications as column functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# What the complexity score counts, one point each.
BRANCH_WORDS = ("if", "while", "loop", "match", "abort")
STORAGE_PHRASES = ("transfer::", "share_object", "freeze_object", "dynamic_field", "table::", "bag::", "object::new")


def word_count(text: Column, word: str) -> Column:
    """Occurrences of a whole word that no ``#`` precedes."""
    return F.regexp_count(text, F.lit(rf"(?<![#A-Za-z0-9_]){word}(?![A-Za-z0-9_])")).cast("long")


def phrase_count(text: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of a phrase."""
    gone = F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))
    return (gone / len(phrase)).cast("long")


def weighted_count(text: Column, words: Sequence[str], phrases: Sequence[str]) -> Column:
    """One point for the text itself and for every word and phrase in it."""
    total = F.lit(1).cast("long")
    for word in words:
        total = total + word_count(text, word)
    for phrase in phrases:
        total = total + phrase_count(text, phrase)
    return total


def complexity(source: Column, type_parameters: Column, callable_: Column) -> Column:
    """The complexity of a function's sanitized source."""
    counted = weighted_count(source, BRANCH_WORDS, ("assert!", "&&", "||", *STORAGE_PHRASES))
    return counted + type_parameters + F.when(callable_, 2).otherwise(0)


# Scores above which a function, one that transactions call, and a module are reported.
FUNCTION_LIMIT, ENTRY_LIMIT, MODULE_LIMIT = 15, 12, 80


def complexities(functions: DataFrame, module: str, source: str, type_parameters: Column, callable_: Column) -> DataFrame:
    """Add ``score`` and ``above`` of each function, and ``module_score`` and ``module_above`` of all functions of its module;
    modules' sums are aggregated and joined back."""
    scored = functions.withColumn("score", complexity(F.col(source), type_parameters, callable_)).withColumn("above", F.col("score") > F.when(callable_, ENTRY_LIMIT).otherwise(FUNCTION_LIMIT))
    sums = scored.groupBy(module).agg(F.sum("score").alias("module_score"))
    return scored.join(sums, module).withColumn("module_above", F.col("module_score") > MODULE_LIMIT)


def first_match(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """The label of the first rule that holds."""
    chosen = F.lit(default)
    for condition, name in reversed(rules):
        chosen = F.when(condition, F.lit(name)).otherwise(chosen)
    return chosen


def all_matches(rules: Sequence[tuple[Column, str]]) -> Column:
    """The labels of all rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(condition, F.lit(name)) for condition, name in rules)))


def ranked(value: Column, ranks: Mapping[str, int], default: int = -1) -> Column:
    """The rank of an ordered label."""
    chosen = F.lit(default)
    for name, rank in ranks.items():
        chosen = F.when(value == name, F.lit(rank)).otherwise(chosen)
    return chosen


def neutral(tag: Column) -> Column:
    """Whether a tag is free of words that judge."""
    # Fixed values.
    return ~F.lower(tag).rlike("vulnerable|safe|exploit|bug|malicious|critical|risk")
