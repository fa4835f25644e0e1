"""Bounded walks, rollbacks, trimming and string functions on literal frames and against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from traceloom.functions import strings
from traceloom.operators import dataflow, graph, sequence


def walked(edges, seed, depth, fanout, cap):
    near = {}
    for src, dst in sorted(edges):
        near.setdefault(src, []).append(dst)
    seen, found, frontier = {seed}, [], [seed]
    for step in range(1, depth + 1):
        following = []
        for node in frontier:
            for target in near.get(node, [])[:fanout]:
                if target not in seen and len(found) < cap:
                    seen.add(target)
                    found.append((seed, target, step))
                    following.append(target)
        frontier = following
    return found


def test_bounded_reach(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(150)]
    edges = spark.createDataFrame(pairs, "src int, dst int")
    seeds = spark.createDataFrame([(k,) for k in range(42)], "node int")
    got = graph.bounded_reach(edges, seeds, 3, 3, 6).collect()
    assert sorted((r["seed"], r["place"], r["node"], r["depth"]) for r in got) == sorted((s, k + 1, n, d) for seed in range(42) for k, (s, n, d) in enumerate(walked(pairs, seed, 3, 3, 6)))
    sized = {r["seed"]: r for r in graph.call_graph(edges, seeds, 2, 3, 3, 6).collect()}
    assert len(sized) == 42 and all(r["n_nodes"] == 1 + len(walked(pairs, s, 2, 3, 6)) for s, r in sized.items())
    assert sized[41]["n_edges"] == 0 and sized[41]["trim_reasons"] == []


def test_positional_ids(spark):
    edges = spark.range(500).select((F.col("id") % 7).alias("src"), F.col("id").alias("dst"))
    got = [r["id"] for r in graph.positional_ids(edges, "e", ["src", "dst"]).orderBy("src", "dst").collect()]
    assert got == [f"e:{k}:{s}:{d}" for k, (s, d) in enumerate(sorted((i % 7, i) for i in range(500)))]


@pytest.mark.parametrize("seed", range(4))
def test_rollbacks_and_forks(spark, seed):
    rng = random.Random(seed)
    rows = [(k, at, rng.random() < 0.5, rng.random() < 0.6, rng.choice([None, None, None, 0, 1, 2, 5])) for k in range(5) for at in range(40)]
    df = spark.createDataFrame(rows, "k int, at int, turn boolean, fork boolean, undo int")
    forks, kept = set(), set()
    for key in range(5):
        turns, held, stack = [], [], []
        for _, at, turn, fork, undo in (r for r in rows if r[0] == key):
            if undo:
                if turns:
                    start = turns[max(len(turns) - undo, 0)]
                    turns, held = turns[: max(len(turns) - undo, 0)], [f for f in held if f < start]
                stack = stack[: max(len(stack) - undo, 0)]
                continue
            turns += [at] * turn
            held += [at] * fork
            stack.append(at)
        forks |= {(key, at) for at in held}
        kept |= {(key, at) for at in stack}
    assert {tuple(r) for r in sequence.fork_turns(df, "k", "at", F.col("turn"), F.col("fork"), F.col("undo")).collect()} == forks
    assert {tuple(r) for r in sequence.replay_rollbacks(df, "k", "at", "undo").collect()} == kept


def trimmed(parts, budget):
    """The fourteen steps as a loop that estimates anew after each."""
    parts = [dict(p, cut=None) for p in parts]
    size = lambda: sum(len((p["text"] or "").encode()) + len(p["metadata"] or "") + len(p["span"] or "") for p in parts)
    over = lambda: -(-size() // 4) > budget
    ops = lambda test: [p for p in parts if p["section"] == "operations" and test(p["kind"])]
    reasons = set()
    if over() and any(p["metadata"] is not None for p in ops(lambda k: True)):
        reasons.add("operation_metadata_trimmed")
        for p in ops(lambda k: True):
            p["metadata"] = None
    if over() and any(p["section"] == "source_excerpts" for p in parts):
        reasons.add("source_excerpts_trimmed")
        for p in parts:
            if p["section"] == "source_excerpts":
                p["text"] = "\n".join(p["text"].splitlines()[:8])

    def one_by_one(test, reason):
        while over() and (found := ops(test)):
            reasons.add(reason)
            parts.remove(max(found, key=lambda p: p["place"]))

    one_by_one(lambda k: k not in dataflow.SIGNAL_KINDS, "low_signal_operations_collapsed")
    for step in range(4, 12):
        names = ["source_excerpts"] if step == 9 else [n for n, s in {"callers": 4, "callees": 5, "reachable_callees": 6, "related_types": 7, "diagnostics": 8, "operation_histogram": 10, "field_access": 11}.items() if s == step]
        if over() and any(p["section"] in names for p in parts):
            reasons.add(dataflow.STEPS[step - 1])
            parts[:] = [p for p in parts if p["section"] not in names]
    if over() and any(p["span"] is not None for p in ops(lambda k: True)):
        reasons.add("operation_spans_trimmed")
        for p in ops(lambda k: True):
            p["span"] = None
    one_by_one(lambda k: k not in dataflow.CORE_KINDS, "support_operations_trimmed")
    one_by_one(lambda k: True, "operations_trimmed")
    return -(-size() // 4), sorted(reasons)


def test_trim_steps(spark):
    rng = random.Random(3)
    sections = ["operations"] * 6 + ["source_excerpts", "callers", "callees", "reachable_callees", "related_types", "diagnostics", "operation_histogram", "field_access", "docs"]
    packs = {
        pack: [
            {"id": pack, "place": place, "section": rng.choice(sections), "kind": rng.choice(["Call", "Abort", "Const", "Pack", "Pop"]), "text": "ä line\n" * rng.randrange(1, 14),
             "metadata": rng.choice([None, "m" * rng.randrange(9)]), "span": rng.choice([None, "1:2"])}
            for place in range(rng.randrange(1, 30))
        ]
        for pack in range(60)
    }
    for rows in packs.values():
        for p in rows:
            if p["section"] != "operations":
                p["metadata"] = p["span"] = None
    df = spark.createDataFrame([tuple(p[c] for c in ("id", "section", "place", "kind", "text", "metadata", "span")) for rows in packs.values() for p in rows], "id int, section string, place int, kind string, text string, metadata string, span string")
    for budget in (5, 60, 120, 10_000):
        assert {r["id"]: (r["tokens"], r["reasons"]) for r in dataflow.trim_steps(df, budget).collect()} == {pack: trimmed(rows, budget) for pack, rows in packs.items()}
    assert dataflow.trim_steps(df.limit(0), 5).count() == 0


def test_strings(spark):
    texts = spark.createDataFrame([("f<A, B>(x: u8, y: (a, b)): C",), ("no parts",), ("",), (None,), ("open (a, b",)], "t string")
    got = [tuple(r) for r in texts.select(strings.function_parameters(F.col("t")), strings.split_top_level(F.col("t"), ",")).collect()]
    assert got == [("x: u8, y: (a, b)", ["f<A, B>(x: u8, y: (a, b)): C"]), (None, ["no parts"]), (None, [""]), (None, None), (None, ["open (a, b"])]
    ranges = texts.select(strings.match_ranges(F.col("t"), "A")).collect()
    assert [tuple(x) for x in ranges[0][0]] == [(k, k + 1) for k, c in enumerate("f<A, B>(x: u8, y: (a, b)): C") if c in "aA"]
    assert ranges[2][0] == [] and ranges[3][0] is None
    row = spark.createDataFrame([('{"a": 1}', '{"a": "x"}')], "good string, bad string")
    assert row.select(strings.typed_json(F.col("good"), "a int")).first()[0]["a"] == 1
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        row.select(strings.typed_json(F.col("bad"), "a int")).collect()


def test_text_functions_read_a_text_once(spark):
    """Pieces come of one scan, and addresses of one pattern; marks that texts hold themselves stay."""
    df = spark.createDataFrame([("f(a: m<u8, (b)>, c: [d, e]), g(h)",), ("(",), ("",), ("f)(x, é<y\n, z>)",), (None,), ("f((a)(b))(c)",)], "t string")
    columns = df.select(strings.function_parameters(F.col("t")).alias("p"), strings.split_top_level(F.col("t"), ",").alias("s"))
    assert [r["p"] for r in columns.collect()] == ["a: m<u8, (b)>, c: [d, e]", None, None, "x, é<y\n, z>", None, "(a)(b)"]
    assert [r["s"] for r in columns.collect()] == [["f(a: m<u8, (b)>, c: [d, e])", " g(h)"], ["("], [""], ["f)(x", " é<y\n, z>)"], None, ["f((a)(b))(c)"]]
    assert df.select(strings.split_top_level(F.col("t"), ",").alias("s"))._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    marked = spark.createDataFrame([("\x01@0x2\x02\x040x3::\x02\x03 0x2::",), ("0x2::",), ("",), (None,)], "t string")
    rewritten = marked.select(strings.rewrite_addresses(F.col("t"), [("2", "s\x01\x02\x04")]).alias("r"))
    assert [r["r"] for r in rewritten.collect()] == ["\x01@s\x01\x02\x04\x02\x040x3::\x02\x03 s\x01\x02\x04::", "s\x01\x02\x04::", "", None]
    assert "split(t" not in rewritten._jdf.queryExecution().optimizedPlan().toString()
