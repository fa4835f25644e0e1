"""BPE encoding and decoding with a pair occurrence index.

White space separates what the tokenizer may join, so a text is cut there and only the different words of a
partition are encoded. Their pieces lie in one symbol list, and an index maps every adjacent pair that has a
merge rank to all its positions. Ranks with positions are applied in ascending order, each to all its positions
at once, and a merge updates the lists of the pairs to its left and right. Where a merge can bring up a pair of a
lower rank than its own, only the first position of each piece is merged and the others go back into the index
behind what it brings up, which keeps the order within every word.

Words and pieces that were encoded stay in two tables of bounded size until the partition ends.

Defined cases: a null text equals the empty text, which has no tokens; the tokenizer's special strings become
their special ids, as its library does with them; null ids and repeated rows pass through as they are; an
empty table gives an empty result; columns other than id and text are not looked at.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from traceloom.llm.common import tidy

#: Words and pieces that a worker remembers; beyond that it starts anew.
REMEMBERED = 100_000
#: UTF-8 bytes of text whose new words are encoded together.
CHUNK_BYTES = 4 << 20
#: Bytes of ids that are decoded, and sent back, at a time.
DECODED_BYTES = 1 << 20

#: White space by Unicode's property, which the tokenizer's patterns use.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Only Python counts these as white space.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_WORDS = re.compile(f"[^{_SPACE}]+")
#: The tokenizer's pattern, within ASCII and after lower-casing.
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself, or the next free one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: How this kind of tokenizer normalises text and cuts it in pieces.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PATTERNS = [r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"]


def unsupported(own: dict) -> list[str]:
    """What of a tokenizer file the encoder does not do; it takes byte-level BPE on lower-cased words."""
    found = []
    model, cut = own["model"], own.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
        found.append("another model")
    if [step["type"] for step in (own.get("normalizer") or {}).get("normalizers", [])] != _NORMALIZERS:
        found.append("another normalizer")
    patterns = [step["pattern"].get("Regex") for step in cut.get("pretokenizers", []) if step["type"] == "Split"]
    if patterns != _PATTERNS or [step["type"] for step in cut.get("pretokenizers", [])] != ["Split", "ByteLevel"]:
        found.append("another way of cutting words")
    if any(x.get(flag) for x in own["added_tokens"] for flag in ("single_word", "lstrip", "rstrip")):
        found.append("added tokens that take white space")
    if own.get("decoder"):
        found.append("a decoder")
    return found


class PairIndexEncoder:
    """A BPE vocabulary with word ends, given as the JSON text of the tokenizers library."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        own = json.loads(definition)
        model = own["model"]
        if unsupported(own):
            raise ValueError(f"tokenizer file with {', '.join(unsupported(own))}")
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        pairs, merged = [], []
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            pairs.append((self.vocab[left], self.vocab[right]))
            merged.append(self.vocab[left + right])
        pairs, self.merged = np.array(pairs, np.int64).reshape(-1, 2), np.array(merged, np.int32)
        self.left, self.right = pairs[:, 0].astype(np.int32), pairs[:, 1].astype(np.int32)
        self.special = {x["content"]: x["id"] for x in own["added_tokens"]}
        self.specials = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        self.tokens = token_table(definition)
        self.base = 1 + max(self.tokens)
        self.keys, self.rank_of_key = np.unique(pairs[:, 0] * self.base + pairs[:, 1], return_index=True)
        self.rank_of_key = self.rank_of_key.astype(np.int32)
        # Ranks whose merge can bring up a pair of a lower rank, or whose positions can overlap.
        first_use = np.full(self.base, len(merged))
        np.minimum.at(first_use, self.left, np.arange(len(merged)))
        np.minimum.at(first_use, self.right, np.arange(len(merged)))
        self.one_by_one = (first_use[self.merged] < np.arange(len(merged))) | (self.left == self.right)
        self.letter_ids = {c: self.vocab[c] for c in byte_letters().values()}
        self.last_ids = {c: self.vocab[c + self.end] for c in byte_letters().values()}
        # Only how text is cut comes from the library, so that its copy of the vocabulary isn't needed.
        library = Tokenizer.from_str(json.dumps(own | {"added_tokens": [], "post_processor": None, "model": {"type": "BPE", "vocab": {}, "merges": []}}))
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.letters = {ord(chr(b)): c for b, c in byte_letters().items() if chr(b) != c}
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs, -1 for those without."""
        keys = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank_of_key[at], -1)

    def merge(self, pieces: list[str]) -> None:
        """Encode pieces, none of which is known yet, into the table of pieces."""
        if not pieces:
            return
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        stops = np.cumsum(lengths)
        symbols = np.fromiter(map(self.letter_ids.__getitem__, "".join(pieces)), np.int32, stops[-1])
        symbols[stops - 1] = [self.last_ids[piece[-1]] for piece in pieces]
        piece_of = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        after, before = np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols) - 1)
        after[stops - 1], before[stops - lengths] = -1, -1

        index: dict[int, list[np.ndarray]] = {}  # rank -> arrays of positions
        active: list[int] = []

        def add(ranks: np.ndarray, positions: np.ndarray) -> None:
            known = ranks >= 0
            ranks, positions = ranks[known], positions[known]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, a, b in zip(ranks[np.r_[0, cuts]].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(ranks)]):
                if rank in index:
                    index[rank].append(positions[a:b])
                else:
                    index[rank] = [positions[a:b]]
                    heapq.heappush(active, rank)

        pairs = np.flatnonzero(after >= 0)
        add(self.ranks(symbols[pairs], symbols[pairs + 1]), pairs)
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            follow = after[at]
            alive = (symbols[at] == self.left[rank]) & (follow >= 0) & (symbols[follow] == self.right[rank])
            at = at[alive]
            if len(at) > 1:
                at = np.unique(at)
                if self.one_by_one[rank]:  # the first position of each piece now, the others after what it brings up
                    first = np.r_[True, piece_of[at[1:]] != piece_of[at[:-1]]]
                    if not first.all():
                        index[rank] = [at[~first]]
                        heapq.heappush(active, rank)
                        at = at[first]
            if not len(at):
                continue
            follow = after[at]
            symbols[at], symbols[follow] = self.merged[rank], -1
            beyond = after[follow]
            after[at] = beyond
            right = beyond >= 0
            before[beyond[right]] = at[right]
            ahead = before[at]
            left = ahead >= 0
            to = np.concatenate([at[right], ahead[left]])
            add(self.ranks(symbols[to], symbols[np.concatenate([beyond[right], at[left]])]), to)
        kept = symbols >= 0
        ends = np.cumsum(np.add.reduceat(kept, stops - lengths)) * 4
        ids = symbols[kept].astype("<u4").tobytes()
        self.pieces.update(zip(pieces, map(ids.__getitem__, map(slice, [0, *ends[:-1].tolist()], ends.tolist()))))

    def pieces_of(self, word: str) -> list[str | int]:
        """A word's pieces in byte letters; special ids as integers."""
        low = word.lower()
        if low.isalpha():
            if low.isascii():
                return [low]
            if unicodedata.is_normalized("NFC", word) and "\u03a3" not in word:
                return [low.encode().decode("latin-1").translate(self.letters)]
        if self.specials and self.specials.search(word):
            found = []
            for part in self.specials.split(word):
                found.extend([self.special[part]] if part in self.special else self.pieces_of(part) if part else [])
            return found
        if word.isascii():
            pieces = _ASCII_PIECES.findall(low)
            return pieces if word.isprintable() else [piece.translate(self.letters) for piece in pieces]
        return [piece for piece, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(word))]

    def learn(self, words: Iterable[str]) -> None:
        """Encode words into the table of words."""
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        words, pieces = list(words), self.pieces
        cut = list(map(self.pieces_of, words))
        self.merge(list({p for of in cut for p in of if p.__class__ is str and p not in pieces}))
        for word, of in zip(words, cut):
            if len(of) == 1 and of[0].__class__ is str:
                self.words[word] = pieces[of[0]]
            else:
                self.words[word] = b"".join([p.to_bytes(4, "little") if p.__class__ is int else pieces[p] for p in of])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.words) > REMEMBERED:
            self.words.clear()
        words, new = self.words, set()
        for text in texts:
            new.update(_split(text))
        self.learn(new.difference(words))
        return [b"".join(map(words.__getitem__, _split(text))) for text in texts]

    def decode(self, ids: bytes) -> str:
        return join_tokens(self.tokens, ids)


def _split(text: str) -> list[str]:
    return _WORDS.findall(text) if _NOT_SPACE.search(text) else text.split()


def token_table(definition: str) -> dict[int, str]:
    """Token strings by id."""
    own = json.loads(definition)
    return {i: token for token, i in own["model"]["vocab"].items()} | {x["id"]: x["content"] for x in own["added_tokens"]}


def join_tokens(tokens: dict[int, str], ids: bytes) -> str:
    """Decoded text: a vocabulary without a decoder of its own has its tokens joined by spaces."""
    return " ".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[str, PairIndexEncoder] = {}


def encoder(definition: str) -> PairIndexEncoder:
    """This worker's encoder; made once for all tasks that it runs."""
    if definition not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[definition] = PairIndexEncoder(definition)
    return _ENCODERS[definition]


def by_bytes(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; a longer text is a slice of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    part = (np.cumsum(sizes) - 1) // limit
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _shared(docs: DataFrame, vocabulary: str):
    """A tokenizer file's text (a few MB, whatever the corpus holds), for all tasks."""
    with open(vocabulary, encoding="utf-8") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids): ids as little-endian unsigned 32-bit integers in one binary value; with ``decoded``, also the text
    that ``decode`` gives for them, by the same worker."""
    definition = _shared(docs, vocabulary)
    source = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(definition.value)
        for batch in batches:
            for part in by_bytes(batch, 1, DECODED_BYTES if decoded else CHUNK_BYTES):
                ids = own.encode(part.column(1).to_pylist())
                columns = {"_id": part.column(0), "ids": pa.array(ids, pa.binary())}
                if decoded:
                    columns["decoded"] = pa.array(list(map(own.decode, ids)), pa.string())
                yield pa.RecordBatch.from_pydict(columns)
        own.words.clear()
        own.pieces.clear()

    kind = f"_id {source.schema[0].dataType.simpleString()}, ids binary" + ", decoded string" * decoded
    return source.mapInArrow(tidy(run), kind).withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, decoded)"""
    definition = _shared(encoded, vocabulary)
    source = encoded.select(F.col(id_col).alias("_id"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = token_table(definition.value)
        for batch in batches:
            for part in by_bytes(batch, 1, DECODED_BYTES):
                texts = [join_tokens(own, ids) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["_id", "ids", "decoded"])

    return source.mapInArrow(tidy(run), f"_id {source.schema[0].dataType.simpleString()}, ids binary, decoded string").withColumnRenamed("_id", id_col)
