"""Operators on literal frames, and every query against its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from traceloom.functions import ids, scoring
from traceloom.operators import dataflow, graph, joins, ledger, sequence, source_rules
from traceloom.plans import registry

SOURCE = """
module a::m {
    const USED: u64 = 1; // const COMMENTED
    const UNUSED: u64 = 2;
    struct Kept { x: u64 }
    struct Lost { x: u64 }
    public fun run(k: Kept): u64 { helper(USED); if (k.x == true) { return (1 / 2) * 3 }; 1 / 2 * 3 }
    fun helper(x: u64): u64 { loop { x = x + 1; } }
    fun alone() { while (true) { break; }; let s = "fun text() loop"; alone() }
}
"""


def test_source_rules(spark):
    found = source_rules.all_findings(spark.createDataFrame([("m", SOURCE), ("n", None)], "module string, text string")).collect()
    assert sorted((r["rule"], r["name"]) for r in found) == [
        ("bool_judgement", "true"), ("infinite_loop", "loop"), ("precision_loss", "*"),
        ("unused_const", "UNUSED"), ("unused_private_function", "alone"), ("unused_struct", "Lost"),
    ]


def test_complexity(spark):
    text = "if (a && b) { assert!(x) } while #while transfer::x match_ dynamic_field"
    row = spark.createDataFrame([(text,)], "t string").select(scoring.complexity(F.col("t"), F.lit(2), F.lit(True)).alias("c")).first()
    assert row["c"] == 1 + 1 + 1 + 1 + 1 + 1 + 1 + 2 + 2


def test_ids(spark):
    row = spark.createDataFrame([("abc", "x")], "a string, b string").select(
        ids.stable_id("edge", "a", "b").alias("id"), ids.logical_id("f", F.lit("a b"), "b").alias("l"), ids.estimate_tokens(F.lit("éé1")).alias("t"),
        ids.git_blob_sha1(F.lit("hello\n")).alias("g"), ids.hex_address(F.lit("0x00Ab")).alias("h"), ids.first_integer(F.lit("x12y3")).alias("n"), ids.csv_escape(F.lit('a"b')).alias("c"),
    ).first()
    assert tuple(row) == ("edge:563bc0e8e57fe5b62336fed0", "f:a_b::x", 2, "ce013625030ba8dba906f756967f9e9ca394464a", "0xab", 12, '"a""b"')


CHAIN = [("entry", "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "a")]


def test_graph(spark):
    edges = spark.createDataFrame(CHAIN + CHAIN[:1], "src string, dst string")
    seed = spark.createDataFrame([("entry",)], "node string")
    assert {(r["node"], r["depth"]) for r in graph.reach(edges, seed, 3).collect()} == {("a", 1), ("b", 2), ("c", 3)}
    assert {r["node"] for r in graph.closure(edges, seed).collect()} == set("abcde")
    paths = {r["caller"]: r["path"] for r in graph.reverse_paths(edges, spark.createDataFrame([("c",)], "node string"), 5).collect()}
    assert paths["entry"] == ["entry", "a", "b", "c"] and "c" not in paths
    assert [r["dst"] for r in graph.neighbours(edges.where("src = 'entry'"), 2).collect()] == ["a", "a"]


def test_two_tier_resolution(spark):
    rows = spark.createDataFrame([(1, "s", "f"), (2, None, "g"), (3, None, "f"), (4, "x", "g")], "id int, scope string, name string")
    targets = spark.createDataFrame([("s", "f", "t1"), ("u", "f", "t2"), ("u", "g", "t3")], "scope string, name string, tid string")
    assert {r["id"]: r["target"] for r in joins.resolve_two_tier(rows, targets, "scope", "name", "tid", "target").collect()} == {1: "t1", 2: "t3", 3: None, 4: None}


def test_rollbacks_take_what_is_left(spark):
    rows = spark.createDataFrame([("t", 1, None), ("t", 2, None), ("t", 3, 5), ("t", 4, None), ("t", 5, 1), ("t", 6, None)], "k string, pos int, n int")
    assert [r["pos"] for r in sequence.replay_rollbacks(rows, "k", "pos", "n").collect()] == [6]


def test_head_tail(spark):
    head, tail, omitted = sequence.head_tail(F.col("t"), 5)
    rows = spark.createDataFrame([("abcdefgh",), ("abc",), ("",)], "t string").select(head.cast("string"), tail.cast("string"), omitted).collect()
    assert [tuple(r) for r in rows] == [("ab", "fgh", 3), ("ab", "c", 0), ("", "", 0)]


def test_confirmation_gate(spark):
    findings = spark.createDataFrame([("f", ["e1", "e2"]), ("g", ["e1"])], "finding string, evidence array<string>")
    evidence = spark.createDataFrame([("e1", "replay", True), ("e2", "static", False)], "evidence string, method string, has_trace boolean")
    verdicts = spark.createDataFrame([("other", True, ["e1", "e2", "e3"])], "candidate string, positive boolean, evidence array<string>")
    assert [r["finding"] for r in ledger.confirmed(findings, evidence, verdicts).collect()] == ["f"]


def test_stack_edges_and_packs(spark):
    code = spark.createDataFrame([("f", 0, 0, 1), ("f", 1, 0, 1), ("f", 2, 2, 1), ("f", 3, 2, 0)], "fn string, pos int, pops int, pushes int")
    assert {(r["src"], r["dst"]) for r in dataflow.stack_edges(code).collect()} == {(1, 2), (0, 2), (2, 3)}
    packs = spark.createDataFrame([(1, "signature", "x" * 40), (1, "docs", "x" * 40), (1, "callers", "x" * 400), (2, "docs", None)], "id int, section string, text string")
    rows = {r["id"]: r for r in dataflow.trim_packs(packs, 50).collect()}
    assert rows[1]["reasons"] == ["callers"] and rows[1]["tokens"] == 20 and rows[2]["reasons"] == []


def plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    if hasattr(value, "isoformat"):
        return value.isoformat()[:19]
    return str(value)


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, sf, name):
    found = registry.QUERIES[name](spark, sf)
    columns = sorted(found.columns)
    expected = duck.sql(registry.ORACLES[name])
    assert columns == sorted(expected.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = duck.sql(f"SELECT {quoted} FROM ({registry.ORACLES[name]})").fetchall()
    assert sorted(tuple(map(plain, r)) for r in found.select(*columns).collect()) == sorted(tuple(map(plain, r)) for r in want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_products_of_divisions(spark):
    """Nested brackets, both sides, and operands that end at an operator or a bracket."""
    risky = ["(a / b) * c", "((a / b) + 1) * c", "a * (b - (c / d))", "f(x[a / b]) * 2", "sqrt(x) * y", "y * m::sqrt((x))", "{ a / 2 } * b", "g(1, (a / b) * 2)"]
    sound = ["a / b * c", "a * b / c", "(a * b) / c", "a / 2 + b * c", "f(a / 2, b * c)", "(a / b) + b * c", "sqrt * y", "(a / b); x * y", "* a", "a *"]
    rows = [(k, f"fun f() {{ {text} }}") for k, text in enumerate(risky + sound)] + [(100, "*"), (101, ") / ( * x"), (102, None)]
    found = source_rules.precision_loss(source_rules.tokens(spark.createDataFrame(rows, "module int, text string")))
    assert sorted(r["module"] for r in found.collect()) == list(range(len(risky)))


def test_bracket_pairs(spark):
    words = source_rules.tokens(spark.createDataFrame([(1, "f(a[1], (b)) { c } )"), (2, "((")], "module int, text string"))
    pairs = source_rules.bracket_pairs(source_rules.bracketed(words, F.col("token").isin("a", "b")))
    assert sorted((r["module"], r["token"], r["pos"], r["end"], r["inside"]) for r in pairs.collect()) == [(1, "(", 1, 10, 2), (1, "(", 7, 9, 1), (1, "[", 3, 5, 0), (1, "{", 11, 13, 0)]


def test_source_tasks(spark, monkeypatch):
    """Texts are dealt out once, by their length, and no token moves after."""
    sources = spark.createDataFrame([(k, SOURCE) for k in range(40)], "module int, text string")
    monkeypatch.setattr(source_rules, "TASK_CHARS", 5 * len(SOURCE))
    found = source_rules.all_findings(sources)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
    assert found.rdd.getNumPartitions() == 8 and found.count() == 6 * 40


def test_source_names(spark):
    """Calls within and outside of bodies, repeated names, names without bodies, and braces of their own."""
    texts = [
        "fun f() { f() }", "fun f() { } fun g() { f() }", "f() fun f() { f() }", "fun f() { } fun f() { }", "fun f(); fun g() { g() }", "fun f() { { f() } } f<T>",
        "public fun f() { }", "public(friend) fun f() { }", "entry fun f() { }", "fun f() {", "const A const A", "const A struct B struct A", "struct {", "struct { }", "fun fun f { }",
    ]
    found = source_rules.all_findings(spark.createDataFrame(list(enumerate(texts)), "module int, text string")).where("rule LIKE 'unused%'")
    assert sorted((r["module"], r["rule"][7:], r["name"]) for r in found.collect()) == [
        (0, "private_function", "f"), (1, "private_function", "g"), (3, "private_function", "f"), (3, "private_function", "f"), (4, "private_function", "g"),
        (11, "struct", "B"), (12, "struct", "{"), (13, "struct", "{"), (14, "private_function", "f"),
    ]


def test_matches_and_addresses(spark):
    from traceloom.functions import strings

    row = spark.createDataFrame([("İabc aBc", "0x002::coin @0X2 a2::x 02::y 0x2_ dead::b @0x02f 0x2::z x0x2::q 0x0::n")], "t string, s string").select(
        strings.match_ranges(F.col("t"), "ABC").alias("r"), strings.rewrite_addresses(F.col("s"), [("2", "std"), ("2", "zzz"), ("0", "nil"), ("A2", "up")]).alias("a")
    ).first()
    assert [tuple(r) for r in row["r"]] == [(1, 4), (5, 8)]
    assert row["a"] == "std::coin @std up::x std::y 0x2_ dead::b @0x02f std::z x0x2::q nil::n"


def test_wrapper_evidence_gives_each_link(spark, tmp_path):
    """Which types hold a token of a type, each pair once, though it shares several tokens."""
    from traceloom.plans import facts

    names = [("red bolt",), ("bolt red",), ("red gear",), ("red bolt",), ("nut",), (None,), ("gear  pin",), ("cog  cog",)]
    spark.createDataFrame(names, "p_name string").write.parquet(f"{tmp_path}/part.parquet")
    own = {n: set(n.split(" ")) for (n,) in names if n}
    found = [tuple(r) for r in facts.wrapper_evidence(spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted((a, b) for a in own for b in own if a != b and own[a] & own[b])


def test_partitions_grow_with_the_stored_table(spark, tmp_path, monkeypatch):
    """Sorted edges and operations are dealt out by the number of stored rows, not by a fixed number of partitions."""
    from traceloom.plans import program, registry

    monkeypatch.setattr(registry, "TASK_ROWS", 20)
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_extendedprice double, l_returnflag string, l_shipdate date"
    spark.createDataFrame([(k // 4, k, k, k % 4, 1.0, "R", None) for k in range(400)], kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("neighbors_topk", "cfg_successors"):
        assert getattr(program, name)(spark, str(tmp_path)).rdd.getNumPartitions() >= 20
    assert program.neighbors_topk(spark, str(tmp_path)).count() == 600
