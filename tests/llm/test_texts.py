"""Operators that look at one text at a time: BPE, secrets, language, toxicity."""

import hashlib
import random

import numpy as np
import pytest

bpe = pytest.importorskip("traceloom.llm.bpe")
public_tokenizers = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402

from traceloom.llm import langid, queries, secrets, toxicity  # noqa: E402
from traceloom.llm.common import held_out, read  # noqa: E402

ODD = [
    "", None, "Hello, World's <|endoftext|>x don't éa  ñ 123 \x1c a\x00b ", "Σίσυφος ΟΔΥΣΣΕΥΣ İstanbul ǅ ﬁ é ½ ² ٣ 漢字かな 👨‍👩‍👧",
    "<|startoftext|><|endoftext|>><|endoftext|", "a" * 3000, "'S 'tis I'LL we'Ve ''s '''", "﻿x \u0085y \x1d\x1ez", "ſtraße K", "word " * 20_000,
]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe_equals_the_library(spark):
    rng = random.Random(1)
    noise = ["".join(rng.choice([chr(rng.randrange(32, 0x3000)), chr(rng.randrange(32, 127)), " ", "'", chr(rng.randrange(64))]) for _ in range(60)) for _ in range(200)]
    texts = ODD + noise
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = library()
    encoded = bpe.encode(rows, path)
    at_once = bpe.encode(rows, path, decoded=True).select(*bpe.decode(encoded, path).columns)
    assert sorted(map(repr, at_once.collect())) == sorted(map(repr, bpe.decode(encoded, path).collect()))
    for row in at_once.collect():
        expected = tokenizer.encode(texts[row["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(row["ids"], "<u4").tolist() == expected
        assert row["decoded"] == tokenizer.decode(expected, skip_special_tokens=False)


def test_bpe_tables_start_anew(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        own = bpe.PairIndexEncoder(file.read())
    tokenizer = library()
    for text in ("one two three four five", "six seven one", "two eight nine"):
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_bpe_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in read(spark, sf, "documents").collect()}
    tokenizer = library()
    for row in queries.op3_bpe(spark, sf).collect():
        ids = tokenizer.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ('password = "abcdefgh"', ["assign"]),
        ("token=secret: abcdefghij", []),
        ("API_KEY: 12345678", ["assign"]),
        ("passWORD:short", []),
        ("tokenſ=abcdefghij", []),
        ("AKIAABCDEFGHIJKL", ["access"]),
        ("AKIAABC AKIA", []),
        ("0" * 31 + "g" + "a" * 32, ["hex"]),
        ("the credential is a8Fk29dKq0ZpLm37XwTy here", ["novel"]),
        ("the credential is get_access_token_credential1 here", []),
        (None, []),
        ("", []),
    ],
)
def test_secret_kinds(text, kinds):
    assert [kind for _, _, kind in secrets.scan(text or "")] == kinds


def base_by_hand(text):
    """Spans of the base kinds, read off the contract letter by letter."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    value = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
    run = lambda at, letters: next((i for i in range(at, len(text)) if text[i] not in letters), len(text))
    skip = lambda at, letters: at + (at < len(text) and text[at] in letters)
    found, at = [], 0
    while at < len(text):
        end = None
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(word, at):
                i = run(skip(at + len(word), "\"'"), " ")
                if i < len(text) and text[i] in ":=":
                    i = skip(run(i + 1, " "), "\"'")
                    stop = run(i, value)
                    if stop > i:
                        end = stop
                        if stop - i >= 8:
                            found.append((at, 0, f"assign:{at}:{stop}"))
                        break
        at = end or at + 1
    for kind, head, letters, least in (("access", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16), ("hex", "", "0123456789abcdef", 32)):
        at = 0
        while at < len(text):
            stop = run(at + len(head), letters) if text.startswith(head, at) else at
            if stop > at + len(head):
                if stop - at >= least:
                    found.append((at, 1 + (kind == "hex"), f"{kind}:{at}:{stop}"))
                at = stop
            else:
                at += 1
    return [span for _, _, span in sorted(found)]


def test_secret_base_columns_of_a_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in read(spark, sf, "documents").collect()}
    found = queries.op4_secret_scan(spark, sf).collect()
    assert len(found) == len(texts) and sum(r["n_assign"] + r["n_hex"] + r["n_access"] for r in found) > 0
    for row in found:
        base = base_by_hand(texts[row["doc_id"]] or "")
        assert row["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [row[f"n_{kind}"] for kind in ("assign", "access", "hex")] == [sum(s.startswith(kind) for s in base) for kind in ("assign", "access", "hex")]
        assert set(base) <= set(row["spans"].split(","))


def test_secrets_of_odd_tables(spark):
    schema = "doc_id bigint, text string, kind string"
    assert secrets.find_secrets(spark.createDataFrame([], schema)).count() == 0
    long = "word " * 200_000 + "token: abcdefgh1"
    rows = [(1, long, "x"), (1, long, "x"), (None, "AKIA" + "Z" * 12, None), (2, "the key is " + "abcdefghijklmnop" * 2, "x")]
    found = sorted(((r["doc_id"] or 0, [s["kind"] for s in r["spans"]]) for r in secrets.find_secrets(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert found == [(0, ["access"]), (1, ["assign"]), (1, ["assign"]), (2, [])]


def test_secret_offsets_are_code_points(spark):
    text = "é👍 token = abcdefgh1"
    rows = spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string").withColumn("spans", F.lit(1))
    found = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(rows).collect()}
    assert text[found[1][0]["start"] : found[1][0]["end"]] == "token = abcdefgh1" and found[2] == []


def test_novelty_rises_with_randomness():
    repeated = "config.default.value = config.default.value; x config.default.value"
    assert secrets.novelty(repeated, len(repeated) - 20, len(repeated)) < 0.5 < secrets.novelty("key q8Zr4TnW0xKd77Lm", 4, 20)


def test_language(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    model = langid.train(docs.where(~held_out(F.col("doc_id"))))
    found = langid.predict(docs.select("doc_id", "text"), model).join(docs.select("doc_id", "lang"), "doc_id").where(held_out(F.col("doc_id")))
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34"), (4, "der die und nicht " * 30_000)], "doc_id bigint, text string").withColumn("lang", F.lit("x"))
    rows = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and rows[4]["lang_pred"] == "de" and 0 <= rows[4]["score"] <= 1


def test_language_without_training_rows(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert langid.train(empty) is None
    assert langid.predict(spark.createDataFrame([(1, "abc")], "doc_id bigint, text string"), None).first()["lang_pred"] == "und"


def test_language_kernel_equals_a_plain_one():
    """Scores of the folded product against kernel ridge regression written out on sets of n-grams."""
    langid._prepare()
    rng = random.Random(2)
    words = {"aa": ["der", "und", "nicht", "straße"], "bb": ["the", "and", "not", "street"], "cc": ["le", "et", "été", "rue"]}
    texts = [(name, " ".join(rng.choice(own) for _ in range(rng.randrange(3, 12)))) for name, own in words.items() for _ in range(8)]
    arrays = [np.frombuffer(t.encode(), np.uint8) for _, t in texts]
    sets = [set(langid.grams(a).tolist()) for a in arrays]
    marks, names = [i for i in range(len(texts)) if i % 8 < 3], [n for n, _ in texts]
    k = lambda i, j: len(sets[i] & sets[j]) / (len(sets[i]) * len(sets[j])) ** 0.5
    of = langid.landmarks_of([np.array(sorted(sets[i])) for i in marks])
    plain = np.array([[k(i, j) for j in marks] for i in range(len(texts))])
    model = langid.fit(of, plain, names)
    values, vectors = np.linalg.eigh(plain[marks])
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    x = np.c_[plain @ root, np.ones(len(texts))]
    y = np.array([[1.0 if a == b else -1.0 for b in sorted(set(names))] for a in names])
    ridge = np.diag([langid.RIDGE] * (x.shape[1] - 1) + [0.0])
    expected = x @ np.linalg.solve(x.T @ x / 8 + ridge, x.T @ y / 8)
    data, offsets = np.concatenate(arrays), np.cumsum([0, *map(len, arrays)])
    scores = model.scores(*langid.presences(data, offsets, langid.table_of(model.codes), len(model.codes)))
    assert np.allclose(scores, expected, atol=1e-6)


def test_presences_count_each_gram_once():
    langid._prepare()
    data = np.frombuffer(b"abab ab", np.uint8)
    assert len(np.unique(langid.grams(data))) == len({"a", "b", "ab", "ba", "b ", " a", "aba", "bab", "ab ", "b a", " ab"})


def test_toxicity(spark):
    docs, labels = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")
    model = toxicity.train(docs, labels.where(~held_out(F.col("doc_id"))))
    planted = [(1, "you stupid idiot, what a pathetic worthless clown you are"), (2, "The committee met on Monday and agreed on the budget."), (3, None), (4, "")]
    found = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(planted, "doc_id bigint, text string"), model).collect()}
    assert found[1] >= toxicity.THRESHOLD > found[2] and all(0 <= found[i] < toxicity.THRESHOLD for i in (3, 4))
    kept = toxicity.keep_clean(spark.createDataFrame(planted, "doc_id bigint, text string"), model)
    assert {r["doc_id"] for r in kept.collect()} == {2, 3, 4}


def test_toxicity_of_held_out_rows(spark):
    labels = read(spark, "/root/testdata/sf0.1", "labels").where("toxic IS NOT NULL")
    found = queries.op9_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id")
    hit, toxic, wrong, clean = found.agg(*(F.count_if(F.expr(e)) for e in ("toxic = 1 AND predicted = 1", "toxic = 1", "toxic = 0 AND predicted = 1", "toxic = 0"))).first()
    assert hit >= 0.85 * toxic and wrong <= 0.01 * clean


def test_trees_equal_plain_ones(monkeypatch):
    """One tree against an exhaustive search over features and cuts."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (300, 3))
    g, h = rng.normal(size=300) + 2 * (x[:, 1] > 2) * (x[:, 0] > 3), np.full(300, 0.25)

    def plain(rows, depth):
        if depth == toxicity.DEPTH:
            return {i: -g[rows].sum() / (h[rows].sum() + 1) for i in rows}
        gain = lambda r: g[r].sum() ** 2 / (h[r].sum() + 1)
        best, cut = toxicity.LEAST_GAIN, None
        for j in range(3):
            for c in range(5):
                low, high = rows[x[rows, j] <= c], rows[x[rows, j] > c]
                if min(len(low), len(high)) >= 10 and gain(low) + gain(high) - gain(rows) > best + 1e-9:
                    best, cut = gain(low) + gain(high) - gain(rows), (low, high)
        return plain(cut[0], depth + 1) | plain(cut[1], depth + 1) if cut else {i: -g[rows].sum() / (h[rows].sum() + 1) for i in rows}

    _, _, value, leaf = toxicity._tree(x, g, h, 10)
    expected = plain(np.arange(300), 0)
    assert np.allclose(value[leaf], [expected[i] for i in range(300)])


def test_toxicity_of_odd_tables(spark):
    kind = "doc_id bigint, text string, score string, toxic string"
    docs = spark.createDataFrame([(i, ("you idiot " if i % 3 == 0 else "good day ") * 5, "x", "x") for i in range(90)] + [(0, "you idiot " * 5, "x", "x"), (500, "word " * 100_000, None, None)], kind)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(3, 0), (6, None)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    found = toxicity.score(docs, model).collect()
    assert len(found) == 92 and len({r["score"] for r in found if r["doc_id"] == 0}) == 1
    assert all((r["score"] >= toxicity.THRESHOLD) == (r["doc_id"] % 3 == 0) for r in found if r["doc_id"] < 90)
    assert toxicity.score(spark.createDataFrame([], kind), model).count() == 0


def test_toxicity_features_see_through_spelling():
    plain, hidden = toxicity.Lexicon(), ["you 1d1ot", "you s.t.u.p.i.d man"]
    assert all(toxicity.features(text, plain)[toxicity.FEATURES.index("hidden_insults")] == 1 for text in hidden)
    assert toxicity.features("", plain)[:12] == [0.0] * 12


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    assert toxicity.train(docs, spark.createDataFrame([], "doc_id bigint, toxic int")) is None
    assert toxicity.score(docs, None).first()["score"] == 0


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    x, y = toxicity.isotonic(rng.normal(size=500), (rng.random(500) < 0.3).astype(float))
    assert (np.diff(x) >= 0).all() and (np.diff(y) >= 0).all()
