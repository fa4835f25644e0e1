"""String functions on signatures, addresses and values, as column functions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType


def _scan(text: Column, opens: str, closes: str, wanted: str) -> Column:
    """(start, size) of the pieces before each ``wanted`` that stands at nesting 0 once it is counted itself, and of the rest. The
    text is read once, up to a mark at a time; only pieces found are kept, so long texts take time in proportion."""
    marks = "".join(c if c.isalnum() else "\\" + c for c in dict.fromkeys(opens + closes + wanted))
    chunks = F.regexp_extract_all(text, F.lit(f"[^{marks}]*[{marks}]|[^{marks}]+"), F.lit(0))
    piece = lambda start, end: F.array(F.struct(start.alias("start"), (end - start).alias("size")))

    def add(s: Column, chunk: Column) -> Column:
        mark = F.right(chunk, F.lit(1))
        depth = s["depth"] + F.when(F.instr(F.lit(opens), mark) > 0, 1).when(F.instr(F.lit(closes), mark) > 0, -1).otherwise(0)
        cut, after = (mark == wanted) & (depth == 0), s["after"] + F.length(chunk)
        found = F.when(cut, F.concat(s["found"], piece(s["start"], after - 1))).otherwise(s["found"])
        return F.struct(depth.alias("depth"), F.when(cut, after).otherwise(s["start"]).alias("start"), after.alias("after"), found.alias("found"))

    none = F.array().cast("array<struct<start:int,size:int>>")
    zero = F.struct(F.lit(0).alias("depth"), F.lit(1).alias("start"), F.lit(1).alias("after"), none.alias("found"))
    return F.aggregate(chunks, zero, add, lambda s: F.concat(s["found"], piece(s["start"], s["after"])))


def split_top_level(text: Column, delimiter: str) -> Column:
    """Pieces between delimiters that no bracket of <([ encloses; for short texts such as signatures."""
    return F.transform(_scan(text, "<([", ">)]", delimiter), lambda p: F.substr(text, p["start"], p["size"]))


def function_parameters(signature: Column) -> Column:
    """What stands in the first pair of matching parentheses; null without one."""
    rest = F.substr(signature, F.locate("(", signature))
    # The first piece ends where the first parenthesis is closed; a rest alone has no closing one.
    pieces = F.when(F.locate("(", signature) > 0, _scan(rest, "(", ")", ")"))
    inside = F.transform(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: p["size"])
    return F.substr(rest, F.lit(2), F.get(inside, F.lit(0)) - 1)


def refers_to_type(source: Column, type_name: Column) -> Column:
    """Whether a type is named by a token of ``source``, in short or with its module."""
    tokens = F.split(source, r"[\s&,:<>()\[\]{};]")
    return F.array_contains(tokens, F.try_element_at(F.split(type_name, "::"), F.lit(-1))) | F.array_contains(tokens, type_name)


def match_ranges(text: Column, wanted: str) -> Column:
    """(start, end) of each match from the left, without overlaps and in any case, counted in the text's own characters from 0."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    if not wanted:
        return none
    pattern = "(?iu)" + re.escape(wanted)
    pieces, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("before"), found.alias("match"))
    last = lambda ranges: F.coalesce(F.try_element_at(ranges, F.lit(-1))["end"], F.lit(0))

    def add(ranges: Column, x: Column) -> Column:
        start = last(ranges) + F.length(x["before"])
        return F.concat(ranges, F.array(F.struct(start.alias("start"), (start + F.length(x["match"])).alias("end"))))

    return F.aggregate(both, none, add)


#: An address before a module's name, or after an at sign; with its prefix, or bare where it begins a word.
ADDRESS = r"(?i)(?<=@)0x[0-9a-f]+\b|\b0x[0-9a-f]+(?=::)|(?<![a-z0-9_])[0-9a-f]+(?=::)"


def rewrite_addresses(source: Column, aliases: Iterable[tuple[str, str]]) -> Column:
    """Addresses replaced by their aliases, given as (hex digits, alias), leading zeros and case apart; of several aliases of
    an address the least. All addresses of a text are found at once and looked up by their digits; what stands between them is cut
    at a mark put in their place, which texts may hold as well: there it is written otherwise meanwhile."""
    hidden = [("\x02", "\x02\x03"), ("\x01", "\x02\x04")]
    hide = lambda text: text.replace(*hidden[0]).replace(*hidden[1])
    known = {digits.lower().lstrip("0"): hide(alias) for digits, alias in sorted(aliases, reverse=True)}
    if not known:
        return source
    names = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    safe = source
    for plain, other in hidden:
        safe = F.replace(safe, F.lit(plain), F.lit(other))
    pieces = F.arrays_zip(F.split(F.regexp_replace(safe, ADDRESS, "\x01"), "\x01").alias("before"), F.regexp_extract_all(safe, F.lit(ADDRESS), F.lit(0)).alias("address"))
    alias = lambda address: F.coalesce(F.try_element_at(names, F.ltrim(F.lower(address), F.lit("0x"))), address, F.lit(""))
    out = F.array_join(F.transform(pieces, lambda x: F.concat(x["before"], alias(x["address"]))), "")
    for plain, other in reversed(hidden):
        out = F.replace(out, F.lit(other), F.lit(plain))
    return out


def csv_value(value: Column, kind: DataType) -> Column:
    """A JSON value as a CSV cell: null is empty, text stays, arrays and objects are JSON."""
    nested = kind.typeName() in ("array", "struct", "map")
    return F.coalesce(F.to_json(value) if nested else value.cast("string"), F.lit(""))


def typed_json(text: Column, schema: str) -> Column:
    """JSON as a typed value; a text that isn't of the type fails the query. Null stays null."""
    return F.from_json(text, schema, {"mode": "FAILFAST"})


#: Types whose constants may be shared.
SHAREABLE = ("bool", "u8", "u16", "u32", "u64", "u128", "u256", "address")


def shareable_constant(type_name: Column, value: Column) -> Column:
    return type_name.isin(*SHAREABLE) & value.rlike(r"^[A-Za-z0-9_@]*\z")


def subsequence_score(text: Column, wanted: str) -> Column:
    """Score of ``wanted`` as a subsequence of ``text`` in any case; null where it isn't one.

    16 for each character, 8 if the match starts a word, less 1 for each character skipped in the match from the leftmost start."""
    span = F.regexp_extract(text, "(?is)" + ".*?".join(re.escape(c) for c in wanted), 0)
    starts = text.rlike("(?is)^(.*?[^a-z0-9])?" + ".*?".join(re.escape(c) for c in wanted))
    score = 16 * len(wanted) + F.when(starts, 8).otherwise(0) - (F.length(span) - len(wanted))
    return F.when(F.length(span) > 0, score.cast("long"))
