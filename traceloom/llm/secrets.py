"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty.

The base kinds are three patterns. The method adds ``novel`` spans: strings that stand in a sensitive context
(after a word such as key, token or credential) and are incompressible. A candidate's novelty is its marginal
cost: the bytes that zstandard takes for it with a dictionary of common identifiers and of the text around it,
less what an empty frame takes, per character. Names, paths and prose repeat what stands around them and cost
little; random strings cost nearly all their bytes.

All offsets are code points, ends exclusive. Defined cases: a null text equals the empty text, which has no
span; ids and repeated rows pass through as they are; an empty table gives an empty result; columns other than
id and text are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from traceloom.llm.common import tidy

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "novel")

# The patterns of the base kinds and the fewest characters of what they find.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

#: Any of these must be in the lower-cased text before a pattern is tried.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
SENSITIVE_WORDS = (*ASSIGN_WORDS, "auth", "bearer", "credential", "private", "access", "signature", "pwd", "key")

#: A sensitive word, at most 24 characters that a value may be set off by, and the candidate.
SENSITIVE = re.compile(
    r"(?ai)(?<![a-z])(?:pass(?:word|wd)|pwd|secret|token|(?:api|access|private)?[_-]?key|auth(?:orization)?|bearer|credentials?|signature)(?![a-z])"
    r"[^\nA-Za-z0-9]{1,4}(?:(?:is|was|id|value|bearer|basic)[^\nA-Za-z0-9]{1,4}){0,2}(?P<value>[A-Za-z0-9+/_=-]{16,})"
)
#: Identifiers that code around secrets is made of; a candidate built from them is not novel.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key authorization bearer credential signature "
    "username client_id client_secret public_key session_id request response config environment variable default "
    "localhost example placeholder changeme undefined function return import export string value number object "
    "https://www.example.com/ application/json content-type user-agent 0123456789 abcdefghijklmnopqrstuvwxyz"
)
#: Characters of the text before and after a candidate that go into its dictionary.
CONTEXT = 256
#: Marginal bytes per character from which a candidate is reported.
NOVELTY = 0.7


def marginal_bytes(value: str, context: str) -> int:
    """Bytes that ``value`` adds to a zstandard frame primed with identifiers and ``context``."""
    primed = zstandard.ZstdCompressionDict((IDENTIFIERS + "\n" + context).encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=3, dict_data=primed, write_checksum=False, write_content_size=False)
    return len(packer.compress(value.encode())) - len(packer.compress(b""))


def novelty(text: str, start: int, end: int) -> float:
    around = text[max(0, start - CONTEXT) : start] + "\n" + text[end : end + CONTEXT]
    return marginal_bytes(text[start:end], around) / (end - start)


def scan(text: str) -> list[tuple[int, int, str]]:
    """All spans of a text, as (start, end, kind), by start and then by kind as listed."""
    low = text.lower()
    spans = []
    if any(word in low for word in ASSIGN_WORDS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if any(word in low for word in SENSITIVE_WORDS):
        found = [(m.start("value"), m.end("value")) for m in SENSITIVE.finditer(text)]
        base = list(spans)
        for start, end in found:
            value = text[start:end]
            mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
            if mixed and not any(a < end and start < b for a, b, _ in base) and novelty(text, start, end) >= NOVELTY:
                spans.append((start, end, "novel"))
    return sorted(spans, key=lambda span: (span[0], KINDS.index(span[2])))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): spans as array<struct<kind, start, end>> in order."""
    source = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One text at a time as a Python string; the batch itself stays in Arrow's memory.
            found = [[{"kind": k, "start": a, "end": b} for a, b, k in scan(text.as_py())] for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["_id", "spans"])

    schema = f"_id {source.schema[0].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return source.mapInArrow(tidy(run), schema).withColumnRenamed("_id", id_col)
