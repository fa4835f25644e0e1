"""Language identification with a string kernel.

Kernel: the blended-spectrum presence kernel. k(x, y) counts the different n-grams of 1 to MAX_N symbols that both
texts have, divided by the geometric mean of how many each has. A symbol is one of a-z (either case), one byte of any
other letter or sign in UTF-8, or a gap for a run of anything else. Nystroem landmarks, training texts chosen by hash
and by language, stand for the whole kernel: a text is mapped to K(text, landmarks) W^(-1/2), and one-versus-rest
kernel ridge regression in that space gives one score per language. Scoring is batched matrix products: a matrix of
presences of all the landmarks' n-grams, times the landmarks' presences with the regression's weights folded in.

Training uses at most TRAINING_ROWS rows of each language, taken by hash of the id, whole texts; held-out rows never.
The landmarks' sets of n-grams come to the driver, LANDMARKS for each language; of the other rows only their kernel values
with the landmarks do, as texts are read and compared by tasks.

Defined cases: a text that is null or has no letter is ``und`` with score 0; rows without a language are never
learned from; without any row to learn from all texts are ``und``; equal scores go to the language that sorts first;
repeated rows are scored alike; an empty table gives an empty result; columns other than id and text are not looked
at when scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from traceloom.llm.common import materialize, tidy, utf8_parts

MAX_N = 3
#: Rows per language that training looks at, and those of them that are landmarks; languages, at most that many by rows.
TRAINING_ROWS, LANDMARKS = 400, 40
#: Buckets in which a language's rows are ranked first.
BUCKETS = 64
RIDGE = 1e-3
UNKNOWN = "und"

#: Bytes as letters of a reduced alphabet: a-z (either case), each byte of a non-ASCII letter, one gap for all else.
_ALPHABET = np.zeros(256, np.int64)
_ALPHABET[97:123] = np.arange(1, 27)
_ALPHABET[65:91] = np.arange(1, 27)
_ALPHABET[128:] = np.arange(27, 155)
_BASE = 155


def grams(data: np.ndarray) -> np.ndarray:
    """Codes of all n-grams of a text's bytes, in any order and with repeats; runs of gaps count as one gap."""
    code = _ALPHABET[data]
    code = code[np.r_[True, (code[1:] > 0) | (code[:-1] > 0)]] if len(code) else code
    found, whole = [code[code > 0] + 1], code
    for n in range(2, MAX_N + 1):
        whole = whole[:-1] * _BASE + code[n - 1 :]
        found.append(whole + _BASE**n * 2)
    return np.concatenate(found)


def presences(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Presence matrix over the known n-grams (the last column of ``table``'s targets is for unknown ones), and each
    text's number of different n-grams."""
    rows = len(offsets) - 1
    out, norms = np.zeros((rows, width + 1), np.float32), np.zeros(rows)
    seen = np.zeros(len(table), bool)
    for i in range(rows):
        codes = grams(data[offsets[i] : offsets[i + 1]])
        seen[codes] = True  # marks instead of sorting: each code once
        own = np.flatnonzero(seen) if len(codes) > 200_000 else codes[_first(codes, seen)]
        seen[codes] = False
        norms[i] = len(own)
        out[i, table[own]] = 1
    return out[:, :width], norms


def _first(codes: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Positions of one occurrence of each code; ``seen`` is True at all of them."""
    place = _PLACES
    place[codes] = np.arange(len(codes), dtype=np.int32)
    return np.flatnonzero(place[codes] == np.arange(len(codes)))


_SIZE = _BASE**MAX_N * 2 + _BASE**MAX_N
_PLACES = np.zeros(0, np.int32)


def _prepare() -> None:
    global _PLACES
    if not len(_PLACES):
        _PLACES = np.zeros(_SIZE, np.int32)


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # the landmarks' n-grams
    folded: np.ndarray  # (n-grams, languages): their presences in the landmarks times the weights of these
    bias: np.ndarray

    def scores(self, present: np.ndarray, norms: np.ndarray) -> np.ndarray:
        return (present @ self.folded) / np.sqrt(np.maximum(norms, 1))[:, None] + self.bias


@dataclass
class Landmarks:
    codes: np.ndarray  # the known n-grams
    present: np.ndarray  # their presences in the landmarks, (n-grams, landmarks)
    norms: np.ndarray  # the landmarks' numbers of n-grams

    def kernel(self, present: np.ndarray, norms: np.ndarray) -> np.ndarray:
        return (present @ self.present) / np.sqrt(np.maximum(norms, 1)[:, None] * np.maximum(self.norms, 1)[None, :])


def table_of(codes: np.ndarray) -> np.ndarray:
    """For every possible n-gram its place among the known ones, or behind them."""
    table = np.full(_SIZE, len(codes), np.int32)
    table[codes] = np.arange(len(codes), dtype=np.int32)
    return table


def has_letter(texts: list[str | None]) -> list[bool]:
    return [text is not None and any(map(str.isalpha, text)) for text in texts]


def landmarks_of(sets: list[np.ndarray]) -> Landmarks:
    codes = np.unique(np.concatenate(sets))
    present = np.zeros((len(codes), len(sets)), np.float32)
    for j, own in enumerate(sets):
        present[np.searchsorted(codes, own), j] = 1
    return Landmarks(codes, present, np.array([len(own) for own in sets], float))


def fit(marks: Landmarks, kernel: np.ndarray, languages: list[str]) -> Model:
    """Ridge regression on the Nystroem features of rows, given by their kernel values with the landmarks."""
    names = sorted(set(languages))
    among = marks.kernel(marks.present.T, marks.norms).astype(float)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    x = np.c_[kernel @ root, np.ones(len(languages))]
    y = np.array([[1.0 if own == name else -1.0 for name in names] for own in languages])
    # Each language counts alike, however many rows it has.
    rows = {name: languages.count(name) for name in names}
    share = np.array([1.0 / rows[own] for own in languages])[:, None]
    ridge = np.eye(x.shape[1]) * RIDGE
    ridge[-1, -1] = 0
    solved = np.linalg.solve(x.T @ (share * x) + ridge + 1e-12 * np.eye(len(ridge)), x.T @ (share * y))
    weights = (root @ solved[:-1]) / np.sqrt(np.maximum(marks.norms, 1))[:, None]
    return Model(names, marks.codes, marks.present.astype(float) @ weights, solved[-1])


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on a bounded sample of ``rows``, which has none of those that are held out."""
    known = rows.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).where(
        "_lang IS NOT NULL AND _text IS NOT NULL AND _id IS NOT NULL"
    )
    known = known.where(F.regexp_like("_text", F.lit(r"\p{L}")))
    # The first by hash in each bucket, then of those: a language with most of the rows is not ranked in one task.
    ids = known.select("_id", "_lang", F.pmod(F.xxhash64(F.lit("bucket"), "_id"), F.lit(BUCKETS)).alias("_bucket"))
    for key in (["_lang", "_bucket"], ["_lang"]):
        by_hash = Window.partitionBy(*key).orderBy(F.xxhash64("_id"), "_id")
        ids = ids.withColumn("_rank", F.row_number().over(by_hash)).where(F.col("_rank") <= TRAINING_ROWS)
    chosen = ids.select("_id", "_lang", (F.col("_rank") <= LANDMARKS).alias("_mark")).distinct()
    sample = materialize(known.join(F.broadcast(chosen), ["_id", "_lang"]), "sample")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_parts(batch.column(2))
            sets = [np.unique(grams(data[a:b])).astype("<i4").tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["_by", "_lang", "set"])

    by = F.xxhash64("_id", "_text").alias("_by")
    marked = sample.where("_mark").select(by, F.col("_lang").cast("string").alias("_lang"), "_text").mapInArrow(tidy(sets_of), "_by bigint, _lang string, set binary").toPandas()
    if marked.empty:
        return None
    marked = marked.sort_values(["_lang", "_by"], kind="stable")
    marks = landmarks_of([np.frombuffer(own, "<i4") for own in marked["set"]])
    shared = rows.sparkSession.sparkContext.broadcast(marks)

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _prepare()
        table = table_of(shared.value.codes)
        for batch in batches:
            for part in (batch.slice(i, 128) for i in range(0, len(batch), 128)):
                values = shared.value.kernel(*presences(*utf8_parts(part.column(2)), table, len(shared.value.codes)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([v.astype("<f8").tobytes() for v in values], pa.binary())], names=["_by", "_lang", "k"])

    seen = sample.select(by, F.col("_lang").cast("string").alias("_lang"), "_text").mapInArrow(tidy(kernels), "_by bigint, _lang string, k binary").toPandas()
    seen = seen.sort_values(["_lang", "_by"], kind="stable")
    return fit(marks, np.stack([np.frombuffer(own, "<f8") for own in seen["k"]]), seen["_lang"].tolist())


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): score is the best language's share of the scores' softmax, 0 to 1."""
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _prepare()
        own = shared.value
        table = table_of(own.codes) if own else None
        for batch in batches:
            for start in range(0, len(batch), 128):
                part = batch.slice(start, 128)
                letters = np.array(has_letter(part.column(1).to_pylist()), bool)
                names, best = [UNKNOWN] * len(part), np.zeros(len(part))
                if own and letters.any():
                    data, offsets = utf8_parts(part.column(1))
                    scores = own.scores(*presences(data, offsets, table, len(own.codes)))
                    odds = np.exp(4 * (scores - scores.max(axis=1, keepdims=True)))
                    top = scores.argmax(axis=1)
                    best = np.where(letters, 1 / odds.sum(axis=1), 0.0)
                    names = [own.languages[k] if ok else UNKNOWN for k, ok in zip(top, letters)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(best, pa.float64())], names=["_id", "lang_pred", "score"])

    kind = f"_id {source.schema[0].dataType.simpleString()}, lang_pred string, score double"
    return source.mapInArrow(tidy(run), kind).withColumnRenamed("_id", id_col)
