"""Containment and substring joins, closures, ranked search and alignment, held to plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from traceloom.operators import alignment, closure, containment, ledger, patterns, search


@pytest.mark.parametrize("work", [0, 64])
def test_supersets_by_hand(spark, work):
    """With ``work`` at 0 every key is hot, so that sets are settled by keys alone."""
    rng = random.Random(1)
    pick = lambda n: [rng.choice("aaabbcdefgh") for _ in range(rng.randrange(n))]
    asking = [(k, pick(5)) for k in range(60)] + [(60, None), (61, [None, "a", "a"]), (62, ["nowhere", "a"])]
    answering = [pick(8) for _ in range(80)] + [None, ["a", "b"]] + [["a", "b", "c"]] * 30
    found = containment.superset_counts(
        spark.createDataFrame([(*r, 0) for r in asking], "id int, items array<string>, n_supersets int"), spark.createDataFrame([(a, 1) for a in answering], "items array<string>, id int"), work=work
    )
    have = [{x for x in a or [] if x} for a in answering]
    want = {k: sum({x for x in own or [] if x} <= h for h in have) for k, own in asking}
    assert {r["id"]: r["n_supersets"] for r in found.collect()} == want and found.count() == len(want)
    nothing = spark.createDataFrame([], "id int, items array<string>")
    assert containment.superset_counts(nothing, nothing).count() == 0
    assert [r["n_supersets"] for r in containment.superset_counts(spark.createDataFrame([(1, ["a"]), (2, [])], "id int, items array<string>"), nothing).collect()] == [0, 0]


def test_supersets_by_longer_keys(spark, monkeypatch):
    """Groups of some dozens by some hundreds get keys of two items, and the answering sets are made once."""
    from itertools import combinations

    asking = [list(x) for x in combinations(range(40), 2)] + [[k] for k in range(40)] + [[0, 1, 2], [0, 1, 2, 3], [40], [0, 40], []]
    answering = random.Random(3).sample([list(x) for x in combinations(range(40), 3)], 4000) + [[0, 1, 2, 3, 4]] * 3 + [[], None]
    read, steps = spark.sparkContext.accumulator(0), []

    def one(held):
        read.add(1)
        return (held,)

    materialize = containment.materialize
    monkeypatch.setattr(containment, "materialize", lambda df, label: steps.append(label) or materialize(df, label))
    sets = spark.createDataFrame(spark.sparkContext.parallelize(answering, 4).map(one), "items array<int>")
    found = containment.superset_counts(spark.createDataFrame(list(enumerate(asking)), "id int, items array<int>"), sets)
    want = {k: (len(x), sum(set(x) <= set(held or []) for held in answering)) for k, x in enumerate(asking)}
    assert {r["id"]: (r["n_items"], r["n_supersets"]) for r in found.collect()} == want
    assert steps.count("groups") == 2 and read.value == len(answering)


def test_finding_gate(spark):
    evidence = [("r", "ExploitReplay", "AdapterReplay", "t"), ("q", "ExploitReplay", "AdapterReplay", None), ("s", "StaticAnalysis", "ToolOutput", None), ("h", "HumanReview", "ToolOutput", None), ("m", "FormalProof", "ModelSubmitted", None)]
    findings = [("ok", ["r", "s"]), ("named", ["r", "s", "m"]), ("gone", ["r", "x"]), ("one", ["r", "h", "m"]), ("still", ["q", "s"]), ("alone", ["r", "s", "h"]), ("bare", [])]
    conclusions = [("Accepted", ["named"], ["s"]), ("Supported", [], ["s", "r", "q"]), ("Rejected", ["alone"], ["r", "s", "h"])]
    found = ledger.finding_gate(
        spark.createDataFrame(findings, "finding string, evidence array<string>"), spark.createDataFrame(evidence, "evidence string, method string, attestation string, trace string"),
        spark.createDataFrame(conclusions, "status string, candidates array<string>, evidence array<string>"),
    )
    assert {r["finding"]: r["problem"] for r in found.collect()} == {
        "ok": None, "named": None, "gone": "evidence_not_found", "one": "one_method", "still": "no_replay", "alone": "no_conclusion", "bare": "one_method",
    }


@pytest.mark.parametrize("shapes", [2, 1000])
def test_patterns_in_texts_by_hand(spark, shapes):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("aabcé𝄞(<\n") for _ in range(rng.randrange(n)))
    texts = [(k, text(60)) for k in range(40)] + [(40, None), (41, ""), (41, "abc"), (None, "aaaaab"), (43, "ab" * 3000)]
    asked = [text(7) for _ in range(60)] + ["a", "ab", "é", "aaa", "aaa", "abc", "never there", "", None, "ab" * 50]
    found = patterns.pattern_matches(spark.createDataFrame([(*t, "x") for t in texts], "id int, text string, pattern string"), spark.createDataFrame([(a,) for a in asked], "pattern string"), "id", "text", shapes=shapes)
    want = [(k, a, n) for k, t in texts for a in {a for a in asked if a} if (n := sum((t or "").startswith(a, i) for i in range(len(t or ""))))]
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, want))
    none = spark.createDataFrame([], "id int, text string")
    assert patterns.pattern_matches(none, spark.createDataFrame([("a",)], "pattern string"), "id", "text").count() == 0
    assert patterns.pattern_matches(none, spark.createDataFrame([], "pattern string"), "id", "text").columns == ["id", "pattern", "n"]


def test_reverse_calls(spark):
    bodies = [("a", "m", "fun a() { send(x); n::take<T>(y) }"), ("b", "m", "fun send() { resend<T>() } tail("), ("c", "n", "send(x)"), ("d", "n", "fun take( { deep::m::send(z)"), ("e", "m", "} send( {"), ("f", "m", None)]
    callees = [("m", "send"), ("n", "take"), ("m", "tail"), ("n", "send"), ("m", "send")]
    found = patterns.reverse_calls(spark.createDataFrame(bodies, "caller string, module string, source string"), spark.createDataFrame(callees, "module string, name string"))
    assert {tuple(r) for r in found.collect()} == {("a", "m", "send"), ("a", "n", "take"), ("b", "m", "send"), ("c", "n", "send"), ("d", "m", "send"), ("d", "n", "send"), ("e", "m", "send")}
    assert found.count() == 7


def reached_by_hand(edges):
    ahead = {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
        ahead.setdefault(b, set())
    found = {}
    for node in ahead:
        seen, todo = {node}, [node]
        while todo:
            for near in ahead[todo.pop()] - seen:
                seen.add(near)
                todo.append(near)
        found[node] = seen
    return found


@pytest.mark.parametrize("seed, nodes, n, fan", [(1, 40, 45, 2)])
def test_components_and_closure_by_hand(spark, seed, nodes, n, fan):
    rng = random.Random(seed)
    edges = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)]
    reached = reached_by_hand(edges)
    frame = spark.createDataFrame(edges + edges[:5] + [(None, 1), (2, None)], "src int, dst int")
    found = {r["node"]: r["component"] for r in closure.strong_components(frame, fan).collect()}
    component = {a: min(b for b in own if a in reached[b]) for a, own in reached.items()}
    assert found == component
    seeds = spark.createDataFrame([(k,) for k in range(0, nodes + 5, 3)], "node int")
    pairs, _ = closure.component_closure(frame, seeds, fan)
    assert sorted(map(tuple, pairs.collect())) == sorted((k, c) for k in range(0, nodes + 5, 3) for c in ({component[b] for b in reached[k]} if k in reached else {k}))


def test_a_chain_of_20000(spark):
    """One path with one step back: 20,000 steps in some ten rounds."""
    chain = spark.range(20_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).union(spark.createDataFrame([(15_000, 5_000)], "src long, dst long"))
    reached, components = closure.component_closure(chain, spark.createDataFrame([(1,), (19_000,)], "node long"))
    sizes = components.groupBy("component").agg(F.count("*").alias("n"), F.max("node").alias("last"))
    found = reached.join(sizes, "component").groupBy("seed").agg(F.sum("n"), F.max("n"), F.max("last")).collect()
    assert sorted(map(tuple, found)) == [(1, 20_000, 10_001, 20_000), (19_000, 1_001, 1, 20_000)]


def test_closure_of_contracted_chains(spark, monkeypatch):
    """Chains, loops, branches and a cycle without a way in; the shortcuts are made of what is left of them."""
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(150)] + [(40, 33), (90, 60), (60, 55), (20, 120), (150, 150)]
    edges += [(200 + k, 200 + (k + 1) % 9) for k in range(9)] + [(300 + k, 301 + k) for k in range(20)] + [(310, 70), (12, 315)]
    rng.shuffle(edges)
    sizes, own = [], closure.shortcuts
    monkeypatch.setattr(closure, "shortcuts", lambda graph, fan: (sizes.append(graph.count()), own(graph, fan))[1])
    monkeypatch.setattr(closure, "BLOCK", 8)
    reached = reached_by_hand(edges)
    component = {a: min(b for b in near if a in reached[b]) for a, near in reached.items()}
    seeds = [*range(0, 330, 7), 999]
    pairs, components = closure.component_closure(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(k,) for k in seeds], "node long"), sized=True)
    assert {tuple(r) for r in components.collect()} == set(component.items())
    n = {c: list(component.values()).count(c) for c in component.values()}
    expected = {(k, c, n.get(c, 1)) for k in seeds for c in ({component[b] for b in reached[k]} if k in reached else {k})}
    found = [tuple(r) for r in pairs.select("seed", "component", "n_nodes").collect()]
    assert len(found) == len(expected) and set(found) == expected
    assert max(sizes) < 40


def ranked_by_hand(docs, queries, k):
    import collections
    import math
    import re

    words = {i: collections.Counter(w for w in re.split("[^a-z]+", (t or "").lower()) if w) for i, t in docs if i is not None}
    words = {i: w for i, w in words.items() if w}
    mean = sum(sum(w.values()) for w in words.values()) / max(1, len(words))
    out = []
    for q, terms in queries:
        scores = {}
        for term in {t for t in terms or [] if t}:
            df = sum(term in w for w in words.values())
            for i, w in words.items():
                if tf := w[term]:
                    weight = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sum(w.values()) / mean))
                    scores[i] = scores.get(i, 0) + math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * weight
        best = sorted((-round(s, 6), i) for i, s in scores.items())[:k]
        out += [(q, place, i, -s) for place, (s, i) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("blocks", [1, 7])
def test_ranked_queries_by_hand(spark, tmp_path, blocks):
    rng = random.Random(4)
    vocabulary = ["the"] * 30 + ["of"] * 9 + ["rare", "token", "key"] + [f"w{chr(97 + k)}" for k in range(20)]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 20, 200])))) for k in range(120)] + [(200, None), (None, "rare rare"), (201, "Rare, TOKEN")] + [(300 + k, "wa wb") for k in range(9)]
    queries = [(1, ["the", "rare"]), (2, ["token", "token", None]), (3, ["nowhere"]), (4, []), (5, None), (6, ["wa", "wb", "of"])]
    index = search.write_index(spark.createDataFrame([(*d, 1) for d in docs], "doc_id int, text string, n int"), "doc_id", "text", f"{tmp_path}/index", blocks=blocks)
    found = search.ranked(index, spark.createDataFrame(queries, "query int, terms array<string>"), 5, first=1)
    got = sorted((r["query"], r["place"], r["doc_id"], r["score"]) for r in found.collect())
    want = ranked_by_hand(docs, queries, 5)
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, want))


def test_postings_of_a_block_are_one_row(spark, tmp_path):
    """What is written and shuffled is a row for each term and block; lengths that fill several blocks are dealt out."""
    docs = spark.range(600).selectExpr("id", "IF(id < 500, 'a b b', concat('a ', repeat('c ', CAST(id AS INT)))) AS text")
    index = search.write_index(docs, "id", "text", f"{tmp_path}/index", blocks=6)
    postings = index.table("postings")
    assert postings.count() == postings.select("term", "block").distinct().count() < 6 * 3
    assert {r["term"]: r["n"] for r in postings.groupBy("term").agg(F.sum("n").alias("n")).collect()} == {"a": 600, "b": 500, "c": 100}
    sizes = [r["n"] for r in postings.where("term = 'a'").collect()]
    assert len(sizes) > 2 and sum(sizes) == 600
    assert all(len(r["docs"]) == len(r["tfs"]) == len(r["sizes"]) == r["n"] for r in postings.collect())


def test_a_rare_query_reads_few_postings(spark, sf, tmp_path):
    index = search.write_index(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text", f"{tmp_path}/index")
    asked = spark.createDataFrame([(1, ["apache"])], "query int, terms array<string>")
    postings = search.needed(index, "postings", search.asked_terms(index, asked))
    plan = postings._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,apache)" in plan
    buckets = index.table("postings").select("bucket").distinct().count()
    assert postings.select("bucket").distinct().count() == 1 < buckets and 0 < postings.count() < index.table("postings").count() / 50
    assert 0 < search.ranked(index, asked, 3).count() <= 3


def alignments_by_hand(path, query):
    """The best score over all ways to place the query's characters."""
    if query == query.lower():
        path = path.lower()
    best, found = None, [([], 0)]
    for char in query:
        ahead = []
        for places, score in found:
            for i in range(places[-1] + 1 if places else 0, len(path)):
                if path[i] == char:
                    bonus = 8 if path[i].isalnum() and (i == 0 or not path[i - 1].isalnum()) else 0
                    gap = i - places[-1] if places else None
                    ahead.append((places + [i], score + 16 + bonus + (0 if gap is None else 4 if gap == 1 else -3 - (gap - 2))))
        found = ahead
    for _, score in found:
        best = score if best is None else max(best, score)
    return best


def test_alignments_by_hand(spark, monkeypatch):
    rng = random.Random(6)
    paths = [(k, "".join(rng.choice("abA_/.b") for _ in range(rng.randrange(1, 12)))) for k in range(80)]
    paths += [(90, None), (91, ""), (92, "src/Éa/ab"), (None, "ab"), (93, "ab"), (93, "ab"), (94, "a" + "." * 60 + "b")]
    queries = ["ab", "aab", "A", "bab", "ab", "é", "zz", "", None, "a/b"]
    found = alignment.fuzzy_search(spark.createDataFrame([(*p, 1) for p in paths], "id int, path string, score int"), spark.createDataFrame([(q,) for q in queries], "query string"), "id", "path", 20).collect()
    for query in {q for q in queries if q}:
        scored = [(p, i, alignments_by_hand(p, query)) for i, p in paths if p is not None]
        want = sorted((-s, p, i is not None, i) for p, i, s in scored if s is not None and s >= 0)[:20]
        own = sorted((r for r in found if r["query"] == query), key=lambda r: r["place"])
        assert [(r["id"], r["path"], r["score"]) for r in own] == [(i, p, -s) for s, p, _, i in want], query
        for r in own:
            text = r["path"] if query != query.lower() else r["path"].lower()
            assert "".join(text[i] for i in r["places"]) == query and r["places"] == sorted(set(r["places"]))
            gaps = [b - a for a, b in zip(r["places"], r["places"][1:])]
            words = sum(8 for i in r["places"] if text[i].isalnum() and (i == 0 or not text[i - 1].isalnum()))
            assert r["score"] == 16 * len(query) + words + sum(4 if g == 1 else -3 - (g - 2) for g in gaps)


def test_pieces_are_handed_on_in_parts(spark, monkeypatch):
    """A batch of texts with many pieces leaves a task in several batches, and no piece is lost."""
    import pyarrow as pa

    from traceloom.operators import patterns

    monkeypatch.setattr(patterns, "PIECES", 10)
    shapes = spark.createDataFrame([("abc", 0, 4)], "gram string, at int, length int")
    texts = ["abcd abce abcf abcg"] * 20 + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(22)), pa.array(texts)], names=["id", "text"])
    out = list(patterns._cutter(shapes)(iter([batch])))
    assert max(len(b) for b in out) < 20 and sorted(x for b in out for x in b.column(0).to_pylist()) == sorted(4 * list(range(20)))
    assert {x for b in out for x in b.column(1).to_pylist()} == {"abcd", "abce", "abcf", "abcg"}
