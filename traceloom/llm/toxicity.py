"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A text becomes a dozen densities: words of an insult lexicon (as they stand, and after undoing letter
substitutions), words whose stems mark toxic texts of the training sample, whatever their language,
second-person pronouns near them, capitals, punctuation, repeated letters and obfuscated words.
A bounded sample of labelled rows is cut in FOLDS by hash. Stems of a row are weighed by the other folds' counts, so that
no feature knows its own row's label. Boosted trees are fitted to the logistic loss on all rows, and once without each fold;
isotonic regression turns sums into probabilities, and is fitted on the sums that rows get from the trees without their
fold. It is one way at every size. Labels are learned from rows outside the held-out remainder only; label, language,
source and id are never features.

Defined cases: a null text equals the empty text, whose features are all 0, and is scored like any other; rows
without a label take no part in training; a label counts for the rows with its id, and of several labels of an
id the largest; without any labelled row every score is 0; an empty table gives an empty result; columns other
than id and text are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from traceloom.llm.common import materialize, tidy

# Insults, threats and second-person words.
INSULTS = frozenset(
    "idiot idiots stupid moron morons loser losers scum trash clown clowns pathetic worthless disgusting dumb dumbass "
    "imbecile cretin jerk bastard bitch asshole shit fuck fucking freak filth filthy garbage vermin parasite pig "
    "ugly useless retard retarded crap liar coward".split()
)
SECOND_PERSON = frozenset("you your yours yourself youre u ur ya du dich dir dein deine ihr euch tu te toi ton vous tú ti usted".split())
#: Digits and signs that stand for letters.
SUBSTITUTES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"})

#: What is taken off a token's ends before it is looked up.
_EDGES = ".,;:!?\"'()[]{}<>#$%&*-_~`/\\|+=«»“”‘’…"
#: A letter, signs that may stand for letters, a letter; and the token around it.
_ODD = re.compile(r"[^\W\d_][0-9@$!|*]+[^\W\d_]")
_ODD_TOKEN = re.compile(r"\S*[^\W\d_][0-9@$!|*]+[^\W\d_]\S*")
_SPELLED = re.compile(r"\b(?:[^\W\d_][.\-_*]){2,}[^\W\d_]\b")

_BYTES = np.arange(256)
_CAPITAL = (_BYTES >= 65) & (_BYTES <= 90)
_LETTER = _CAPITAL | (_BYTES >= 97) & (_BYTES <= 122) | (_BYTES >= 128)
_MARK = np.isin(_BYTES, np.frombuffer(b".,;:?!\"'()-*#$%&", np.uint8))
_JOINT = np.isin(_BYTES, np.frombuffer(b".-_*", np.uint8))
_SIGN = np.isin(_BYTES, np.frombuffer(b"0123456789@$!|*", np.uint8))

FEATURES = (
    "insults", "insult_density", "hidden_insults", "insults_near_you", "marked_words", "marked_density", "marked_weight", "marked_sum", "second_person", "capitals", "capital_words",
    "exclamations", "punctuation", "obfuscated", "repeated_letters", "log_words",
)

#: Rows that training looks at, at most; the sample is taken by hash of the id.
SAMPLE_ROWS = 20_000
#: Stems in the learned lexicon, at most; letters of a stem.
STEMS, STEM_LETTERS = 4_000, (4, 5, 6, 7, 8)
TREES, DEPTH, RATE, BINS = 60, 3, 0.15, 32
#: Gain of a split at least, about a chi-squared statistic: the best of many cuts on chance alone reaches 10 or so.
LEAST_GAIN = 15.0
#: Fewest rows of a leaf, and parts of the sample.
LEAF, FOLDS = 10, 5
#: A stem's rows at least, and how many standard deviations its toxic ones stand above chance.
STEM_ROWS, STEM_SIGMAS = 4, 5.0
THRESHOLD = 0.3


def stems(text: str) -> set[str]:
    """The first letters of a text's words."""
    words = {token.strip(_EDGES) for token in text.lower().split()}
    return {word[:n] for word in words for n in STEM_LETTERS if len(word) >= n}


class Lexicon:
    """Weights (log odds of toxic texts against others) of stems."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}
        self.first = {stem[: STEM_LETTERS[0]] for stem in self.weights}

    def of(self, words: list[str]) -> list[float]:
        """Weights of the words that have any."""
        first, n, get = self.first, STEM_LETTERS[0], self.weights.get
        if not first:
            return []
        found = [max(get(word[:k], 0.0) for k in STEM_LETTERS) for word in words if word[:n] in first]
        return [weight for weight in found if weight > 0]


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The dense features of one whole text."""
    low = text.lower()
    tokens = low.split()
    words = [token.strip(_EDGES) for token in tokens]
    count = max(1, len(words))
    at = [i for i, word in enumerate(words) if word in INSULTS]
    second = [i for i, word in enumerate(words) if word in SECOND_PERSON]
    near = 0
    if at and second:
        you, own = np.array(second), np.array(at)
        places = np.searchsorted(you, own)
        before = np.abs(you[np.maximum(places - 1, 0)] - own)
        behind = np.abs(you[np.minimum(places, len(you) - 1)] - own)
        near = int((np.minimum(before, behind) <= 5).sum())
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kinds = np.bincount(data, minlength=256)
    letter = _LETTER[data]
    odd, hidden = 0, 0
    if (letter[:-2] & _SIGN[data[1:-1]]).any():
        odd = len(_ODD.findall(low))
        if odd:
            found = [token.translate(SUBSTITUTES).strip(_EDGES) for token in _ODD_TOKEN.findall(low)]
            hidden = sum(word in INSULTS for word in found)
    joint = _JOINT[data]
    if (letter[:-3] & joint[1:-2] & letter[2:-1] & joint[3:]).any():
        found = [re.sub(r"[.\-_*]", "", word) for word in _SPELLED.findall(low)]
        odd += len(found)
        hidden += sum(word in INSULTS for word in found)
    same = data[1:] == data[:-1]
    repeated = int((same[1:] & same[:-1] & letter[2:]).sum())
    shouted = sum(map(str.isupper, text.split())) if kinds[_CAPITAL].sum() > count else 0
    size = max(1, len(data))
    marked = lexicon.of(words)
    return [
        float(min(len(at) + hidden, 50)), 100 * (len(at) + hidden) / count, float(hidden), float(near),
        float(min(len(marked), 50)), 100 * len(marked) / count, max(marked, default=0.0), min(sum(marked), 100.0), 100 * len(second) / count, float(kinds[_CAPITAL].sum()) / size,
        shouted / count, float(kinds[33]) / count, float(kinds[_MARK].sum()) / size, odd / count, repeated / count, float(np.log1p(len(words))),
    ]


@dataclass
class Booster:
    """Additive regression trees on binned features; a tree is its arrays of feature, threshold and leaf values."""

    edges: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    start: float = 0.0
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(edge, x[:, j], side="left") for j, edge in enumerate(self.edges)], axis=1)

    def sums(self, x: np.ndarray) -> np.ndarray:
        binned, total = self.bins(x), np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            total += leaf[node - (2**DEPTH - 1)]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return np.clip(np.interp(self.sums(x), *self.steps), 0.0, 1.0)


def _tree(binned: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One complete tree by histograms of gradients; returns each row's leaf besides."""
    inner = 2**DEPTH - 1
    feature, cut = np.zeros(inner, np.int64), np.full(inner, BINS)
    node = np.zeros(len(binned), np.int64)
    for level in range(DEPTH):
        first = 2**level - 1
        for own in range(first, 2 * first + 1):
            rows = np.flatnonzero(node == own)
            best = LEAST_GAIN
            g, h = gradient[rows], curvature[rows]
            whole = g.sum() ** 2 / (h.sum() + 1)
            for j in range(binned.shape[1]):
                gs = np.cumsum(np.bincount(binned[rows, j], g, BINS))
                hs = np.cumsum(np.bincount(binned[rows, j], h, BINS))
                ns = np.cumsum(np.bincount(binned[rows, j], minlength=BINS))
                gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - whole
                gain[(ns < least) | (ns[-1] - ns < least)] = 0
                if gain.max() > best:
                    best, feature[own], cut[own] = gain.max(), j, int(gain.argmax())
        node = 2 * node + 1 + (binned[np.arange(len(binned)), feature[node]] > cut[node])
    leaf = node - inner
    g, h = np.bincount(leaf, gradient, 2**DEPTH), np.bincount(leaf, curvature, 2**DEPTH)
    return feature, cut, -g / (h + 1), leaf


def isotonic(sums: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: the ends of each pool's sums, and its mean label, smoothed by one row of the prior."""
    order = np.argsort(sums, kind="stable")
    prior = labels.mean()
    pools: list[list[float]] = []  # label sum, rows, lowest and highest sum
    for s, y in zip(sums[order], labels[order]):
        pools.append([float(y), 1.0, s, s])
        while len(pools) > 1 and (pools[-2][3] == pools[-1][2] or pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]):
            y2, n2, _, high = pools.pop()
            pools[-1][0] += y2
            pools[-1][1] += n2
            pools[-1][3] = high
    x = np.array([v for p in pools for v in (p[2], p[3])])
    y = np.repeat([(p[0] + prior) / (p[1] + 1) for p in pools], 2)
    return x, np.maximum.accumulate(y)


def boost(x: np.ndarray, y: np.ndarray) -> Booster:
    """Trees on all given rows; their sums are not calibrated yet."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
    for j, edge in enumerate(edges):  # a feature that is 0 nearly everywhere still gets its own low cuts
        if len(edge) < 4 and len(positive := x[x[:, j] > 0, j]):
            edges[j] = np.unique(np.r_[0.0, np.quantile(positive, np.linspace(0, 1, BINS - 4)[:-1])])
    model = Booster(edges)
    binned = model.bins(x)
    rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    model.start = float(np.log(rate / (1 - rate)))
    total = np.full(len(y), model.start)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        feature, cut, value, leaf = _tree(binned, p - y, p * (1 - p), LEAF)
        model.trees.append((feature, cut, RATE * value))
        total += RATE * value[leaf]
    return model


def fit(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Booster:
    """Boost on all rows, and calibrate on the sums that each row gets from trees without its fold."""
    model, sums = boost(x, y), np.zeros(len(y))
    for own in np.unique(fold).tolist():
        inside = fold == own
        sums[inside] = (boost(x[~inside], y[~inside]) if not inside.all() else model).sums(x[inside])
    model.steps = isotonic(sums, y)
    return model


@dataclass
class Model:
    lexicon: Lexicon
    booster: Booster

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.array([features(text, self.lexicon) for text in texts], float).reshape(-1, len(FEATURES))
        return self.booster.scores(x)


def weights(k: np.ndarray, n: np.ndarray, toxic: float, rows: float) -> np.ndarray:
    """Log odds of stems found in n rows, k of them toxic, against the sample's; 0 for those that don't stand out."""
    p = toxic / rows if rows else 0.0
    if not 0 < p < 1:
        return np.zeros(len(k))
    out = np.log((k + 0.5) / (n - k + 0.5)) - np.log(p / (1 - p))
    return np.where((k >= STEM_ROWS) & (k > 0.6 * n) & (k - n * p > STEM_SIGMAS * np.sqrt(n * p * (1 - p))), out, 0.0)


def learn_lexicons(rows: DataFrame) -> list[Lexicon]:
    """From (_text, _y, _fold): stems that stand out in toxic texts, counted by Spark. A lexicon without each fold, and
    behind them the one of all rows; STEMS of each at most come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, len(batch), 500)):
                found = [list(stems(text or "")) for text in part.column(0).to_pylist()]
                sizes = [len(x) for x in found]
                own = [pa.array(np.repeat(part.column(i).to_numpy(zero_copy_only=False), sizes)) for i in (1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array([w for x in found for w in x], pa.string()), own[0].cast(pa.float64()), own[1].cast(pa.int64())], names=["stem", "_y", "_fold"])

    folds = range(FOLDS)
    of = lambda value, f: F.sum(F.when(F.col("_fold") == f, value).otherwise(0.0))
    sums = [of(F.col("_y"), f).alias(f"k{f}") for f in folds] + [of(F.lit(1.0), f).alias(f"n{f}") for f in folds]
    whole = rows.agg(*sums).first()
    whole = np.array([whole[name] or 0.0 for name in (*(f"k{f}" for f in folds), *(f"n{f}" for f in folds))]).reshape(2, -1)
    counted = rows.select(F.coalesce("_text", F.lit("")).alias("_text"), "_y", "_fold").mapInArrow(tidy(run), "stem string, _y double, _fold bigint").groupBy("stem").agg(*sums)
    k = sum((F.col(f"k{f}") for f in folds), F.lit(0.0))
    n = sum((F.col(f"n{f}") for f in folds), F.lit(0.0))
    # What is rare, or common in other texts, stands out in no set of folds.
    counted = counted.where((k >= STEM_ROWS) & (k > 0.5 * n)).orderBy(k.desc(), "stem").limit(STEMS).toPandas()
    counts = counted[[name for name in counted.columns if name != "stem"]].to_numpy(float).reshape(-1, 2, FOLDS)
    lexicons = []
    for left_out in (*folds, None):
        kept = [f for f in folds if f != left_out]
        own = weights(counts[:, 0, kept].sum(axis=1), counts[:, 1, kept].sum(axis=1), whole[0, kept].sum(), whole[1, kept].sum())
        lexicons.append(Lexicon({stem: float(w) for stem, w in zip(counted["stem"], own) if w > 0}))
    return lexicons


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Fit on at most SAMPLE_ROWS labelled rows; ``labels`` has none of those that are held out."""
    marked = labels.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("double").alias("_y")).where("_y IS NOT NULL AND _id IS NOT NULL")
    sample = marked.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_ROWS)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    rows = materialize(rows.withColumn("_fold", F.pmod(F.xxhash64(F.lit("fold"), "_id"), F.lit(FOLDS))), "labelled")
    lexicons = learn_lexicons(rows.select("_text", "_y", "_fold"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(text.as_py() or "", lexicons[fold.as_py()]) for text, fold in zip(batch.column(3), batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.float64()))], names=["_id", "_y", "_fold", "x"])

    kind = f"_id {rows.schema['_id'].dataType.simpleString()}, _y double, _fold bigint, x array<double>"
    seen = rows.select("_id", "_y", "_fold", "_text").mapInArrow(tidy(run), kind).toPandas()
    if seen.empty:
        return None
    x, y, fold = np.array(seen["x"].tolist(), float).reshape(-1, len(FEATURES)), seen["_y"].to_numpy(float), seen["_fold"].to_numpy()
    order = np.lexsort((*x.T, y, fold))
    return Model(lexicons[-1], fit(x[order], y[order], fold[order]))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row."""
    source = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.slice(start, 500)
                scores = own.scores(part.column(1).to_pylist()) if own else np.zeros(len(part))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["_id", "score"])

    return source.mapInArrow(tidy(run), f"_id {source.schema[0].dataType.simpleString()}, score double").withColumnRenamed("_id", id_col)


def keep_clean(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Rows whose score is below THRESHOLD, with all their columns; texts are scored where they are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in (batch.slice(start, 500) for start in range(0, len(batch), 500)):
                scores = own.scores([text or "" for text in part.column(at).to_pylist()]) if own else np.zeros(len(part))
                yield part.filter(pa.array(scores < THRESHOLD))

    return docs.mapInArrow(tidy(run), docs.schema)
