"""Identity rules as column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _column(part: Column | str) -> Column:
    return F.col(part) if isinstance(part, str) else part


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """``prefix:`` and 24 hex digits of the SHA-256 of every part, each preceded by its length in bytes."""
    texts = [_column(part).cast("string") for part in parts]
    framed = [x for text in texts for x in (F.octet_length(text).cast("string"), F.lit(":"), text, F.lit(";"))]
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(F.concat(*framed), 256), 1, 24))


def logical_id(prefix: str, *parts: Column | str) -> Column:
    """``prefix:`` and the parts joined by ``::``, characters outside the allowed set replaced."""
    clean = [sanitize(_column(part).cast("string")) for part in parts]
    return F.concat(F.lit(prefix + ":"), F.concat_ws("::", *clean))


def sanitize(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_\-.:<>]", "_")


def label(text: Column) -> Column:
    """A label of letters, digits and underscores."""
    return F.regexp_replace(text, "[^A-Za-z0-9]", "_")


def estimate_tokens(text: Column) -> Column:
    """A quarter of the text's bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def git_blob_sha1(text: Column) -> Column:
    data = text.cast("binary")
    return F.sha1(F.concat(F.lit("blob ").cast("binary"), F.octet_length(data).cast("string").cast("binary"), F.unhex(F.lit("00")), data))


def first_integer(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "([0-9]+)", 1), F.lit("")).cast("long")


def hex_address(text: Column) -> Column:
    """A lower-case address with one 0x and no leading zeros; null if it isn't one of up to 64 digits."""
    digits = F.regexp_replace(F.lower(F.trim(text)), "^0x", "")
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when(digits.rlike("^[0-9a-f]{1,64}$"), F.concat(F.lit("0x"), short))


def csv_escape(text: Column) -> Column:
    """Quoted where it holds a comma, a quote or a line break; quotes doubled."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\\r\\n]'), quoted).otherwise(text)
