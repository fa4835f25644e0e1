"""Prefix trie, document fingerprints and whitening, held to plain versions."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

prefix_trie = pytest.importorskip("traceloom.llm.prefix_trie")
from pyspark.sql import functions as F  # noqa: E402

from traceloom.llm import fingerprints, queries, whitening  # noqa: E402
from traceloom.llm.common import read  # noqa: E402

TURNS = "conv_id long, turn long, role string, text string, a int, place string, depth int"


@pytest.fixture(autouse=True)
def patched_modules_reach_workers():
    """Functions travel with what the test has set in their modules, instead of being imported anew by the workers."""
    from pyspark import cloudpickle

    for module in (prefix_trie, fingerprints, whitening):
        cloudpickle.register_pickle_by_value(module)
    yield
    for module in (prefix_trie, fingerprints, whitening):
        cloudpickle.unregister_pickle_by_value(module)


def trie_by_hand(rows):
    """Nodes as sets of members, subtrees by looking at all nodes."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns.setdefault(conv, []).append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [t[3:] for t in sorted(own)] for c, own in turns.items()}
    built = {}
    for c in turns:
        h, head = zlib.crc32(str(c).encode()) % 9, c - int(np.fmod(c, 5))
        built[c] = turns[c] if head == c else turns.get(head, [])[:h] + turns[c][h:]
    members = {}
    for c, own in built.items():
        for d in range(len(own) + 1):
            members.setdefault(tuple(own[:d]), []).append(c)
    out = set()
    for node, own in members.items():
        below = [v for v in members if v[: len(node)] == node]
        childless = [v for v in below if not any(len(w) == len(v) + 1 and w[: len(v)] == v for w in members)]
        ends = ",".join(str(c) for c in sorted(own) if len(built[c]) == len(node))
        out.add((
            min(own), len(node), min(members[node[:-1]]) if node else None, len(own), sum(len(v) == len(node) + 1 for v in below), len(childless),
            sum((len(members[v]) - 1) * len(v[-1][1].encode()) for v in below if v), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def trie_of(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TURNS)
    found = prefix_trie.prefix_trie(*prefix_trie.with_family_heads(prefix_trie.placed_turns(frame)))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = [tuple(r) for r in found.select(columns).collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def test_trie_of_odd_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PART_BYTES", 8)
    rng = random.Random(3)
    rows = [(None, 0, "user", "nobody's"), (7, None, None, None), (7, 3, "user", "é" * 50), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (11, 0, None, "")]
    rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "", None])) for c in (-7, -5, 0, 1, 2, 5, 6, 9) for t in range(rng.randrange(12))]
    # One conversation of most rows, copies of one conversation, and heads that are cut off.
    rows += [(20, t, "user", f"turn {t}") for t in range(300)] + [(c, t, "user", f"same {t}") for c in range(100, 160) for t in range(3)]
    assert trie_of(spark, rows) == trie_by_hand(rows)


def test_trie_without_turns(spark):
    assert trie_of(spark, []) == set()
    # Conversation 3 takes as many turns of an absent conversation as there are, and has none left.
    short = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    assert trie_of(spark, [(short, 0, "user", "x")]) == trie_by_hand([(short, 0, "user", "x")]) == {
        (short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())
    }


def chunks_by_hand(text):
    """How many bytes each chunk of a text covers, one byte at a time."""
    found, start = collections.Counter(), 0
    while start < len(text):
        end = len(text)
        for stop in range(start + fingerprints.LEAST, min(len(text), start + fingerprints.MOST) + 1):
            gear = 0
            for back, byte in enumerate(text[stop - fingerprints.WINDOW : stop][::-1]):
                gear = (gear + (int(fingerprints.GEAR[byte]) << back)) % 2**64
            bits = fingerprints.STRICT if stop - start < fingerprints.NORMAL else fingerprints.LOOSE
            if gear >> (64 - bits) == 0 or stop - start == fingerprints.MOST:
                end = stop
                break
        found[text[start:end]] += end - start
        start = end
    return found


def likeness_by_hand(a, b):
    return sum((a & b).values()) / sum(a.values()) if a else float(not b)


def test_fingerprints_by_hand(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "SLICE", 2_000)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghéü\n ") for _ in range(rng.randrange(1, 9)))
    texts = [" ".join(word() for _ in range(rng.choice([0, 1, 5, 60, 300]))) for _ in range(50)] + ["", None, "x", "ab" * 700, "long " * 5000]
    texts += [texts[4]] * 4 + [texts[3] + " tail"]
    rows = [(3 * k - 40, t) for k, t in enumerate(texts)] + [(None, "no id"), (None, "none"), (5, "tie"), (5, "tie"), (5, "other")]
    frame = spark.createDataFrame([(i, t, 1, True, 0) for i, t in rows], "doc_id long, text string, hash int, extra boolean, range int")
    hashes = [r[0] for r in spark.createDataFrame([(t,) for _, t in rows], "t string").select(F.xxhash64(F.coalesce("t", F.lit("")))).collect()]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, -(rows[k][0] or 0), hashes[k]))
    want = []
    for at, k in enumerate(order):
        own, after = rows[k][1] or "", rows[order[(at + 1) % len(order)]][1] or ""
        edited = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
        a, b, c = (chunks_by_hand(t.encode()) for t in (own, edited, after))
        want.append((rows[k][0], len(own), hashlib.sha256(edited.encode()).hexdigest(), likeness_by_hand(a, b), likeness_by_hand(a, c), len(a), len(b)))
    found = fingerprints.compare_with_next(frame).collect()
    size = lambda text: len(text) * 3 // 4 // 12
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"], size(r["fingerprint"]), size(r["edited_fingerprint"])) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    by_text = {}
    for r in found:
        by_text.setdefault(dict(rows).get(r["doc_id"]) if r["doc_id"] not in (None, 5) else r["doc_id"], set()).add(r["fingerprint"])
    assert len(by_text[texts[4]]) == 1


def test_fingerprints_of_few_documents(spark):
    schema = "doc_id long, text string"
    assert fingerprints.compare_with_next(spark.createDataFrame([], schema)).collect() == []
    (alone,) = fingerprints.compare_with_next(spark.createDataFrame([(1, "abcde")], schema)).collect()
    assert (alone["n_chars"], alone["near_next"]) == (5, 1.0) and alone["edited_sha256"] == hashlib.sha256(b"abcab").hexdigest()


def test_edits_leave_chunks_alone(spark, sf):
    """Half of a long text is kept by the edit, and unrelated texts share nothing."""
    rows = queries.op12_fingerprints(spark, sf).where("n_chars > 2000").select("near_edited", "near_next").collect()
    kept = sorted(r["near_edited"] for r in rows)
    assert len(rows) > 20 and kept[0] > 0.4 and 0.45 < kept[len(rows) // 2] < 0.55
    assert sorted(r["near_next"] for r in rows)[len(rows) // 2] < 0.05


def whitened_by_hand(vectors):
    x = np.floor(64 * np.asarray(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    centred = (n * x - sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return n, ((n * x - sums) ** 2).sum(1), values[::-1], centred @ axes[:, ::-1]


def test_whitening_of_the_table(spark, sf):
    table = read(spark, sf, "embeddings")
    ids, vectors = zip(*((r["vec_id"], r["embedding"]) for r in table.collect()))
    n, deviations, values, turned = whitened_by_hand(vectors)
    place = {v: k for k, v in enumerate(ids)}
    found = queries.op13_whitening(spark, sf).collect()
    assert len(found) == 32 * n and {r["component"] for r in found} == set(range(1, 33))
    for r in found:
        k, j = place[r["vec_id"]], r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviations[k])
        assert abs(r["explained"] / (values[j] / values.sum()) - 1) < 1e-10
        assert abs(abs(r["whitened"]) - abs(turned[k, j]) / np.sqrt(values[j])) < 1e-7
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    schema = "vec_id long, embedding array<float>, n int, x string"
    odd = [(1, None), (2, []), (3, [1.0, None, 2.0]), (4, [nan, 0.0, 0.0]), (5, [inf, 0.0, 0.0])]
    rows = odd + [(None, [1.0, 2.0, 5.0]), (6, [3.0, -1.0, 5.0]), (6, [3.0, -1.0, 5.0]), (7, [0.0, 8.0, 5.0])]
    found = whitening.whiten(spark.createDataFrame([(*r, 0, "") for r in rows], schema)).collect()
    n, deviations, values, turned = whitened_by_hand([v for _, v in rows[5:]])
    assert len(found) == 4 * 3 and sorted(r["deviation"] for r in found[::3]) == sorted(deviations)
    assert all(r["whitened"] == 0 and r["explained"] < 1e-12 for r in found if r["component"] == 3) and found[0]["identity_error"] < 1e-12
    assert np.allclose(sorted(abs(r["whitened"]) for r in found if r["component"] == 1), np.sort(np.abs(turned[:, 0])) / np.sqrt(values[0]))
    empty = spark.createDataFrame([(*r, 0, "") for r in odd], schema)
    assert whitening.whiten(empty).collect() == [] and len(whitening.whiten(empty).columns) == 7
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, "")], schema)).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, 0.0, 0.0, 0.0), (2, 0, 0.0, 0.0, 0.0)]
    with pytest.raises(ValueError, match="width"):
        whitening.whiten(spark.createDataFrame([(1, [1.0], 0, ""), (2, [1.0, 2.0], 0, "")], schema))
    big = whitening.whiten(spark.createDataFrame([(k, [1e12 * k, -1e12]) for k in range(3)], "vec_id long, embedding array<double>")).collect()
    assert [r["deviation"] for r in big] == [None, None, 0, 0, None, None]


def test_small_eigenvalues_are_accurate():
    """A graded matrix: its smallest eigenvalue is lost in the largest one's rounding unless small entries stay apart."""
    scale = np.diag([1e8, 1e4, 1.0, 1e-4])
    matrix = scale @ (np.eye(4) + 0.1 * np.ones((4, 4))) @ scale
    values, vectors = whitening.jacobi(matrix)
    from fractions import Fraction

    det = Fraction(1)
    rows = [[Fraction(float(v)) for v in row] for row in matrix]
    for k in range(4):
        det *= rows[k][k]
        for i in range(k + 1, 4):
            f = rows[i][k] / rows[k][k]
            rows[i] = [a - f * b for a, b in zip(rows[i], rows[k])]
    # The product of all eigenvalues is the determinant, to which each contributes its relative error.
    product = 1.0
    for v in values:
        product *= float(v)
    assert abs(product / float(det) - 1) < 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-14
