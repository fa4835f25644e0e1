"""Operators that compare texts or vectors: n-gram join, repeats, neighbours, components, the pipeline."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

ngram_join = pytest.importorskip("traceloom.llm.ngram_join")
from pyspark.sql import functions as F  # noqa: E402

from traceloom.llm import ann, components, queries, repeats  # noqa: E402
from traceloom.llm.common import read  # noqa: E402



@pytest.fixture(autouse=True)
def patched_modules_reach_workers():
    """Functions travel with what the test has set in their modules, instead of being imported anew by the workers."""
    from pyspark import cloudpickle

    from traceloom.llm import hashing

    for module in (ngram_join, repeats, ann, hashing):
        cloudpickle.register_pickle_by_value(module)
    yield
    for module in (ngram_join, repeats, ann, hashing):
        cloudpickle.unregister_pickle_by_value(module)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def joined_by_hand(rows):
    """Sizes and components by comparing all pairs."""
    sets = [(key, shingles(text)) for key, text in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(sets):
        least[root(i)] = min(key, least.get(root(i), key))
    return sorted((key, len(own), least[root(i)]) for i, (key, own) in enumerate(sets))


def near_copies(rng, words, count, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(count):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"w{rng.randrange(10**6)}"
        yield " ".join(own)


@pytest.mark.parametrize("run", [24, 3])
def test_ngram_join_finds_all_links(spark, monkeypatch, run):
    """With groups beyond RUN the stars and the blocks have to find what all pairs would."""
    monkeypatch.setattr(ngram_join, "RUN", run)
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    rng = random.Random(run)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [t for words, count, edits in ((40, 60, 2), (200, 40, 8), (12, 5, 1)) for t in near_copies(rng, words, count, edits)]
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(80)) + " " + passage for _ in range(30)]
    texts += [None, "", " \t", "one two", "ONE two", "one two three four five", "é é é é é é", "x " * 8000]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    given = spark.createDataFrame(rows + [rows[0]], "doc_id bigint, text string").withColumn("size", F.lit("x")).withColumn("class", F.lit(1)).repartition(5)
    found = sorted(map(tuple, ngram_join.jaccard_components(given).collect()))
    assert found == joined_by_hand(rows + [rows[0]])


def test_words_that_cancel_in_sums_of_powers_differ():
    """The Thue-Morse word over a and b, and its complement, have equal polynomial hashes modulo 2^64."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    for n in (64, 512, 1024, 4096):
        data = (word[:n] + other[:n]).encode()
        one, two = ngram_join.shingle_sets(np.frombuffer(data, np.uint8), np.array([0, n, 2 * n]))
        assert one.tolist() != two.tolist()


def test_hashes_depend_on_bytes_alone():
    from traceloom.llm.hashing import Hashes

    rng = np.random.default_rng(1)
    part = rng.integers(0, 4, 3000).astype(np.uint8)
    data = np.concatenate([rng.integers(0, 4, 77).astype(np.uint8), part, part[:5], part])
    for size in (1, 7, 8, 9, 64, 200, 511, 512, 513, 1500, 3000):
        for lane in (0, 1):
            a, b = Hashes(data).of(np.array([77, 77 + 3005]), np.array([77, 77 + 3005]) + size, lane)
            assert a == b == Hashes(part).of(np.array([0]), np.array([size]), lane)[0]
    seen = Hashes(np.tile(np.arange(250, dtype=np.uint8), 3)).of(np.arange(250), np.arange(250) + 40)
    assert len(set(seen.tolist())) == 250
    assert (Hashes(part).every(32)[5:9] == Hashes(part[5:]).every(32)[:4]).all()


def test_order_is_cut_evenly():
    rng = np.random.default_rng(4)
    levels = rng.integers(0, 5, 1 << ngram_join.SKETCH_BITS).astype(np.uint8)
    order = ngram_join.Order(levels, np.bincount(levels, minlength=64))
    shingles = rng.integers(0, 2**63, 200_000).astype(np.uint64) * np.uint64(2)
    where = order.fragment(shingles, 8)
    assert np.bincount(where, minlength=8).min() > 0.9 * len(shingles) / 8
    by = np.lexsort((where, order.level(shingles)))
    assert (np.diff(where[by]) >= 0).all()


def test_ngram_join_of_boilerplate(spark, monkeypatch):
    """Texts around one long passage: near the threshold on both sides, with repeated ids and rows."""
    monkeypatch.setattr(ngram_join, "RUN", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    rng = random.Random(11)
    texts = []
    for k in range(90):
        own = " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(2, 22)))
        texts.append(" ".join(f"p{i}" for i in range(rng.randrange(0, 6), 70)) + " " + own)
    rows = list(enumerate(texts))
    given = spark.createDataFrame(rows + rows[:9], "doc_id bigint, text string").repartition(3)
    assert sorted(map(tuple, ngram_join.jaccard_components(given).collect())) == joined_by_hand(rows + rows[:9])


def test_crowded_shingles_stay_out_of_prefixes(spark, monkeypatch):
    """Passages of some dozen texts are known by their counts where the sketch, as in a large corpus, tells nothing: no text
    with enough shingles of its own has one in its prefix, so that none is held against blocks of others."""
    rng = random.Random(5)
    passages = [" ".join(f"p{k}x{i}" for i in range(40)) for k in range(6)]
    texts = [f"{' '.join(f'u{rng.randrange(10**6)}' for _ in range(60))} {' . '.join(rng.sample(passages, 3))}" for _ in range(80)]
    texts += [texts[0] + " end", texts[1] + " end"]
    rows = list(enumerate(texts))
    sketch, materialize, seen = ngram_join.sketch, ngram_join.materialize, {}

    def flat(cells):
        order = sketch(cells)
        return ngram_join.Order(np.zeros_like(order.levels), np.array([order.total, *[0] * 63]))

    def noted(df, label, keep=False):
        made = materialize(df, label, keep)
        seen[label] = made.count() if label != "candidates" else made.where("shingle IS NOT NULL").count()
        return made

    monkeypatch.setattr(ngram_join, "sketch", flat)
    monkeypatch.setattr(ngram_join, "materialize", noted)
    given = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(map(tuple, ngram_join.jaccard_components(given).collect())) == joined_by_hand(rows)
    assert seen["candidates"] == seen["crowded"] == 0 and "asks" not in seen


def test_common_shingles_are_counted(spark, monkeypatch):
    """The list has every shingle of LEAST classes or more, copies counting once; where it is full, the most common ones."""
    shared = {n: [f"s{n}x{i}" for i in range(9)] for n in (2, 3, 4, 5, 17, 40)}
    texts = [" ".join([f"o{k}", *(w for n, words in shared.items() if k < n for w in words)]) for k in range(45)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:30])), "_id bigint, _text string").repartition(4)
    data = [t.encode() for t in texts]
    sets = ngram_join.shingle_sets(np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(d) for d in data])])
    keys, times = np.unique(np.concatenate(sets) >> np.uint64(64 - ngram_join.COUNT_BITS), return_counts=True)
    for most, least in ((ngram_join.LISTED, ngram_join.LEAST), (20, 17)):
        monkeypatch.setattr(ngram_join, "LISTED", most)
        order = ngram_join.Order(np.zeros(1 << ngram_join.SKETCH_BITS, np.uint8), np.zeros(64, np.int64))
        ngram_join.list_common(docs, spark.createDataFrame([(k,) for k in range(45)], "rep bigint"), order)
        held = times >= least
        assert order.listed.tolist() == keys[held].tolist()
        assert order.common.tolist() == np.floor(4 * np.log2(times[held])).astype(int).tolist()


def test_ngram_join_empty(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 180)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {found[i] for i in range(41)} == {0} and {found[i] for i in range(100, 180)} == {100}


def test_components_of_chains_of_random_ids(spark):
    rng = random.Random(5)
    ids = [rng.randrange(-(2**63), 2**63) for _ in range(1300)]
    chains = [ids[:1000], ids[1000:]]
    edges = [pair for chain in chains for pair in zip(chain, chain[1:])]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {node: min(chain) for chain in chains for node in chain}


def cut_by_hand(rows, least=200):
    data = [(text or "").encode() for _, text in rows]
    count = collections.Counter(own[i : i + least] for own in data for i in range(len(own) - least + 1))
    out = []
    for (key, _), own in zip(rows, data):
        gone = np.zeros(len(own), bool)
        for i in range(len(own) - least + 1):
            if count[own[i : i + least]] > 1:
                gone[i : i + least] = True
        kept = bytes(np.frombuffer(own, np.uint8)[~gone])
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(own) else 0
        out.append((key, len(own), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("crowd", "window"), [(4096, 1 << 22), (3, 1 << 22), (1, 400)])
def test_repeats_equal_brute_force(spark, monkeypatch, crowd, window):
    """Whole, with crowded cores expanded in rounds, and with texts hashed in windows, also within a task's counts."""
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "WINDOW", window)
    monkeypatch.setattr(repeats, "SLICE", min(repeats.SLICE, window))
    monkeypatch.setattr(repeats, "COUNTED", 100 if window < 1000 else repeats.COUNTED)
    rng = random.Random(crowd)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(60), text(300)
    texts = [text(rng.randrange(1, 80)) + passage[: rng.randrange(190, len(passage))] + text(rng.randrange(1, 80)) for _ in range(12)]
    texts += [base, base, base[:500] + "#" + base[501:], base[250:900], base[100:299], base[100:300], "ab" * 500, "z" * 450, passage + passage, None, "", "é" * 150]
    rows = list(enumerate(texts))
    given = spark.createDataFrame(rows + [rows[3]], "doc_id bigint, text string").withColumn("kind", F.lit(9)).withColumn("payload", F.lit("x")).repartition(4)
    assert sorted(map(tuple, repeats.remove_repeats(given).collect()), key=str) == cut_by_hand(rows + [rows[3]])


def test_repeats_tell_colliding_texts_apart(spark, monkeypatch):
    """With core and span hashes of a few bits, what stands next to them still tells spans apart."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(150, 900))) for _ in range(60)]
    texts += [texts[0] + "x", texts[1][:300] + texts[2]]
    rows = list(enumerate(texts))
    whole = repeats.Hashes.of

    def narrow(self, start, end, lane=0):
        found = whole(self, start, end, lane)
        return found & np.uint64(7) if lane == 0 else found

    monkeypatch.setattr(repeats.Hashes, "of", narrow)
    given = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    source, stretches = repeats.repeated_stretches(given)
    assert sorted(map(tuple, repeats.remove_repeats(given).collect()), key=str) == cut_by_hand(rows)


def test_repeats_of_nothing(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_expansion_finds_borders_of_short_prefixes():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(97, 99, 400), 255).astype(np.uint8)
    least = 6
    order, border = repeats.expand(text, least)
    twice = np.concatenate([text, text])
    prefixes = [twice[i : i + least].tobytes() for i in order]
    assert prefixes == sorted(prefixes)
    assert [a != b for a, b in zip(prefixes, prefixes[1:])] == border[1:-1].tolist()


def nearest_by_hand(vectors, query, top=20):
    q = vectors[query]
    scored = sorted(((-float(np.dot(v, q)), key) for key, v in vectors.items() if key != query))
    return [key for _, key in scored[:top]]


@pytest.mark.parametrize("kind", ["outlier", "mixed", "opposite", "tiny"])
def test_neighbours_of_any_norm(spark, kind):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6 if kind == "tiny" else 3000, 64))
    if kind == "opposite":  # all but the queries lie in one narrow cone, the queries point away from it
        x = x[0] + 0.01 * x
        x[:20] *= -1
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "mixed":
        x *= np.exp(rng.normal(size=len(x)))[:, None]
    elif kind != "opposite":
        x[-1] *= 50
    vectors = dict(enumerate(x))
    given = spark.createDataFrame([(k, v.tolist()) for k, v in vectors.items()], "vec_id bigint, embedding array<double>")
    found = collections.defaultdict(set)
    for row in ann.nearest(given, F.col("vec_id") < 20).collect():
        found[row["query_id"]].add(row["vec_id"])
    hits = [len(found[q] & set(nearest_by_hand(vectors, q))) / min(20, len(x) - 1) for q in range(min(20, len(x)))]
    assert np.mean(hits) >= (1 if kind in ("opposite", "tiny") else 0.95)


def test_neighbours_recall_and_order(spark, sf):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in read(spark, sf, "embeddings").collect()}
    found = collections.defaultdict(list)
    for row in queries.op1_nearest_neighbours(spark, sf).orderBy("query_id", "rank").collect():
        found[row["query_id"]].append((row["vec_id"], row["score"]))
    hits = []
    for query, rows in found.items():
        assert query % 20 == 0 and len(rows) == 20 and query not in [k for k, _ in rows]
        assert all(abs(s - float(np.dot(vectors[k], vectors[query]))) < 1e-12 for k, s in rows)
        assert [s for _, s in rows] == sorted((s for _, s in rows), reverse=True)
        hits.append(len({k for k, _ in rows} & set(nearest_by_hand(vectors, query))) / 20)
    assert len(found) == sum(k % 20 == 0 for k in vectors) and np.mean(hits) >= 0.9


def test_neighbours_of_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    same = [1.0, 2.0, 0.0]
    rows = [(i, same) for i in range(60)] + [(100 + i, rng.normal(size=3).tolist()) for i in range(5)]
    rows += [(200, None), (220, [0.0, 0.0, 0.0]), (240, [1.0, float("nan"), 0.0]), (260, [1.0, None, 0.0]), (280, []), (300, [float("inf"), 0.0, 1.0]), (320, [1.0, 1.0])]
    given = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("x"))
    found = collections.defaultdict(list)
    for row in ann.nearest(given, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        found[row["query_id"]].append(row["vec_id"])
    vectors = {k: np.array(v, float) for k, v in rows if k < 200}
    assert set(found) == {0, 20, 40, 100}
    for query in (0, 20, 40):
        assert found[query] == nearest_by_hand(vectors, query)


@pytest.mark.parametrize("count", [1, 5, 15, 21])
def test_neighbours_of_few_vectors(spark, count):
    """With fewer candidates than TOP all come back, at the tables' width."""
    rng = np.random.default_rng(count)
    x = rng.normal(size=(count, 64))
    given = spark.createDataFrame([(20 * k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    found = collections.Counter(r["query_id"] for r in ann.nearest(given, F.lit(True)).collect())
    assert all(found[20 * k] == min(20, count - 1) for k in range(count))


def test_neighbours_in_cut_groups(spark, monkeypatch):
    """Groups that are cut in blocks give what whole ones give, and probes of all buckets give brute force."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8))
    given = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    for name, value in (("CANDIDATES", 30), ("QUERIES", 3), ("PAIRS", 50), ("HELD", 100), ("CHUNK", 16)):
        monkeypatch.setattr(ann, name, value)
    found = collections.defaultdict(list)
    for row in ann.nearest(given, F.col("vec_id") % 20 == 0, probes_share=100.0).orderBy("query_id", "rank").collect():
        found[row["query_id"]].append(row["vec_id"])
    vectors = dict(enumerate(x))
    assert all(found[q] == nearest_by_hand(vectors, q) for q in range(0, 400, 20))


def test_axes_grow_with_the_vectors():
    sizes = [2_000, 50_000, 10**6, 10**9]
    shapes = [ann.shape(n, 64) for n in sizes]
    assert all(own.buckets <= n <= 4 * ann.BUCKET * own.buckets for n, own in zip(sizes, shapes))
    share = [own.probes / own.buckets for own in shapes]
    assert share == sorted(share, reverse=True) and share[-1] < 0.02 * share[0]


def test_neighbours_of_nothing(spark):
    assert ann.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


def test_pipeline_stages(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = read(spark, sf, "documents")
    columns, kept = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = _written(spark, stage(spark, docs, sf))
        frames[name] = docs
        if name != "bpe":
            assert docs.columns == columns
    after = {r["doc_id"]: r["text"] for r in frames["toxicity"].collect()}
    unique = {}
    for key in sorted(after):
        unique.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", after[key]), key)
    assert {r["doc_id"] for r in frames["exact_dedup"].collect()} == set(unique.values())
    linked = joined_by_hand([(k, after[k]) for k in sorted(unique.values())])
    assert {r["doc_id"] for r in frames["ngram_join"].collect()} == {key for key, _, component in linked if key == component}
    mixed = collections.Counter(r["doc_id"] for r in frames["mixing"].collect())
    assert set(mixed.values()) <= {1, 2} and set(mixed) <= set(kept)
    assert collections.Counter(r["doc_id"] for r in frames["bpe"].collect()) == mixed


def test_pipeline_stages_on_odd_rows(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    near = " ".join(f"w{i}" for i in range(40))
    rows = [(1, near, "en", "a", 1, 7), (2, near + " more", "en", "a", 1, 7), (None, near, "en", "a", 1, 7), (None, "alone without an id", None, None, None, None)]
    rows += [(3, None, None, "b", 0, 7), (4, "", None, "b", 0, 7), (5, "some  other\ttext", "en", None, 9, 7), (6, "some other text", "en", None, 9, 7), (7, "ein Satz " * 3000, "de", "b", 2, 7)]
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, _id bigint"
    for given in (rows, []):
        docs = _written(spark, spark.createDataFrame(given, kind).withColumn("copies", F.lit("clash")).withColumn("_row", F.lit(0.5)))
        columns = docs.columns
        found = {}
        for name, stage in corpus_pipeline.STAGES:
            docs = _written(spark, stage(spark, docs, sf))
            assert name == "bpe" or docs.columns == columns
            found[name] = docs.collect()
        if given:
            by_id = lambda name: sorted(r["doc_id"] or 0 for r in found[name])
            assert by_id("toxicity") == sorted(r[0] or 0 for r in rows)
            assert by_id("exact_dedup") == [0, 1, 2, 3, 5, 7]
            assert by_id("ngram_join") == [0, 1, 3, 5, 7]
            assert all(r["copies"] == "clash" and r["_row"] == 0.5 for r in found["mixing"])
            assert max(collections.Counter(by_id("mixing")).values()) <= 2 and by_id("bpe") == by_id("mixing")
        else:
            assert not any(found.values())


def _written(spark, df):
    from traceloom.llm.common import materialize

    return materialize(df, "stage")


@pytest.mark.parametrize("n", [60, 400, 1_000, 5_000, 200_000])
def test_recall_has_a_floor(n):
    """Random directions, the worst case: the buckets that the vectors and some queries meet hold their nearest ones."""
    asked = 20
    x = np.random.default_rng(1).normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    own, directions = ann.shape(n, 64), ann.directions(x)
    scores = x[:asked] @ x.T
    scores[np.arange(asked), np.arange(asked)] = -9
    nearest = np.argpartition(-scores, ann.TOP, axis=1)[:, : ann.TOP]
    met = np.zeros(nearest.shape, bool)
    for table in range(ann.TABLES):
        probed = ann.probes(directions[:asked], own, table)
        for k in range(asked):
            met[k] |= np.isin(ann.buckets(directions[nearest[k]], own, table), probed[k])
    assert met.mean() >= 0.93


def test_prefix_entries_are_not_left_on_disk(spark):
    """The join deletes what only one of its steps needs; what stays is a row a document or class."""
    import os

    from traceloom.scratch import scratch_dir

    words = [f"w{k}" for k in range(3_000)]
    docs = spark.createDataFrame([(k, " ".join(words[7 * k : 7 * k + 200])) for k in range(300)] + [(300 + k, " ".join([*words[7 * k : 7 * k + 199], "end"])) for k in range(300)], "doc_id long, text string")
    folder = scratch_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs).collect()}
    assert all(found[300 + k] == found[k] for k in range(300))
    made = {name[:-33] for name in set(os.listdir(folder)) - before}
    assert not made & {"prefixes", "counted", "candidates", "routes", "route", "overlap-routes", "overlap-route", "sets", "blocks", "placed"}


def test_closed_scratch_tables_leave_the_outer_ones(spark):
    """A context of no tables, within another of none, closes itself and not the other."""
    import os

    from traceloom import scratch

    with scratch.scratch_tables(spark):
        with scratch.scratch_tables(spark):
            inner = scratch.materialize(spark.range(3), "inner").inputFiles()[0].removeprefix("file:")
            outer = scratch.materialize(spark.range(3), "outer", keep=True).inputFiles()[0].removeprefix("file:")
        assert not os.path.exists(inner) and os.path.exists(outer)
        with scratch.scratch_tables(spark):
            pass
        later = scratch.materialize(spark.range(3), "later").inputFiles()[0].removeprefix("file:")
    assert not os.path.exists(outer) and not os.path.exists(later)
