"""Relations by text, edges by wide keys, types in summaries, scans, point updates and forwarding, against plain loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from traceloom.operators import graph, history, joins, ledger, summary_types
from traceloom.sources import files, tables
from traceloom.streaming import stateful


def test_package_relationships_against_all_pairs(spark):
    rng = random.Random(5)
    pieces = ["a", "b", "ab", "f", "fa", "_1", "::", "::", "(", " ", "ä", "\n"]
    rows = [
        (rng.choice(["a", "b", "ab", "b_1", None]), rng.choice(["f", "fa", "a", None]), rng.choice(["public(package)", "public", None]), rng.choice([None, "", "".join(rng.choices(pieces, k=18))]))
        for _ in range(2000)
    ]
    rows += [("a", "f", "public(package)", "x" * 5000 + "a::f"), ("b", "fa", "public", "a::b::fab ab::f(")]
    targets = {(m, f) for m, f, v, _ in rows if v == "public(package)" and m and f}
    expected = {(m, f, tm, tf) for m, f, _, body in rows if body is not None for tm, tf in targets if f"{tm}::{tf}" in body or (m == tm and f"{tf}(" in body)}
    df = spark.createDataFrame(rows, "module string, name string, visibility string, body string")
    got = [tuple(r) for r in joins.package_relationships(df).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and len(expected) > 100
    assert joins.package_relationships(df.limit(0)).count() == 0


def test_keyed_edges_with_null_parts(spark):
    rows = spark.createDataFrame([(1, None, 3, "c"), (1, None, 2, "b"), (1, "x", 1, None), (None, None, 9, "n")], "a int, b string, at int, what string")
    got = {(r["a"], r["b"]): tuple(r)[2:] for r in graph.keyed_edges(rows, ["a", "b"], ["what"], ["at"], "at").collect()}
    assert got == {(1, None): ("b", 2, 2, 3), (1, "x"): (None, 1, 1, 1), (None, None): ("n", 1, 9, 9)}


def named(owner, value, context, known):
    """(source, target, relationship, index, argument name, mutable, reference) of all that a value names, depth first."""
    edge = lambda target: [(owner, target, *context)]
    if isinstance(value, str):
        return edge(f"builtin:type:{value}" if value in summary_types.BUILTIN else f"external:type:summaryType:_::summary::{value}")
    if isinstance(value, list):
        return [e for v in value for e in named(owner, v, context, known)]
    if not isinstance(value, dict):
        return []
    data = value.get("Datatype")
    if isinstance(data, dict):
        if not isinstance(data.get("module"), dict) or not isinstance(data.get("name"), str):
            return []
        key = (data["module"].get("address"), data["module"].get("name", "unknown"), data["name"])
        target, labels = known.get(key, ("external:type:datatype:" + "::".join((key[0] or "_", *key[1:])), []))
        found = edge(target)
        for at, argument in enumerate(data.get("type_arguments", [])):
            if "argument" in argument:
                found += named(target, argument["argument"], ("genericArgument", at, labels[at] if at < len(labels) else None, False, False), known)
        return found
    if "vector" in value:
        return edge("builtin:type:vector") + named("builtin:type:vector", value["vector"], ("genericArgument", None, "T", False, False), known)
    if isinstance(value.get("Reference"), list):
        pair = value["Reference"]
        return named(owner, pair[1], (*context[:3], pair[0] is True, True), known) if len(pair) > 1 else []
    return [e for v in value.values() for e in named(owner, v, context, known)]


def test_summary_edges_against_recursion(spark):
    rng = random.Random(8)

    def value(depth):
        pick = rng.randrange(9 if depth else 3)
        inner = lambda: value(depth - 1)
        if pick < 3:
            return ["u8", "Own", rng.choice([3, True, None])][pick]
        data = {"module": {"address": rng.choice(["0x1", "0x2"]), "name": "m"}, "name": rng.choice("AB"), "type_arguments": [{"argument": inner()}, {"phantom": True}, {"argument": inner()}]}
        return [{"Datatype": data}, {"vector": inner()}, {"Reference": [rng.random() < 0.5, inner()]}, {"Reference": []}, {"Other": inner(), "More": [inner()]}, {"Datatype": {"name": "x"}}][pick - 3]

    known = {("0x1", "m", "A"): ("own:A", ["K", "V"])}
    places = {f"s{k}": value(3) for k in range(600)} | {"plain": "address"}
    rows = [(source, json.dumps(v)) for source, v in places.items()] + [("broken", "{not json"), ("nothing", None)]
    given = {"relationship": F.lit("field"), "is_mutable": F.lit(False), "is_reference": F.lit(False)}
    df = spark.createDataFrame(rows, "source string, value string")
    df = df.select("source", *(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in summary_types.CONTEXT.items()), "value")
    types = spark.createDataFrame([(*key, id, labels) for key, (id, labels) in known.items()], "address string, module string, name string, id string, parameters array<string>")
    columns = ("source", "target", "relationship", "type_argument_index", "type_argument_name", "is_mutable", "is_reference")
    got = [tuple(r) for r in summary_types.summary_edges(df, types).select(*columns).collect()]
    expected = [e for source, v in places.items() for e in named(source, v, ("field", None, None, False, False), known)]
    assert sorted(got, key=str) == sorted(expected, key=str) and len(expected) > 300


def test_usages(spark, tmp_path):
    summary = {
        "id": {"address": "0x1", "name": "m"}, "structs": {"S": {"fields": {"fields": {"x": {"type_": "u8"}, "y": {}}}}},
        "enums": {"E": {"variants": {"V": {"fields": {"fields": {"z": {"type_": {"vector": "u8"}}}}}}}},
        "functions": {"f": {"parameters": [{"name": "p", "type_": "bool"}, {"type_": "Own"}, {}], "return_": ["u64"]}, "g": {}},
    }
    (tmp_path / "a.json").write_text(json.dumps(summary))
    (tmp_path / "b.json").write_text(json.dumps({"id": {"address": "0x1", "name": "bare"}}))
    rows = summary_types.usages(files.summaries(spark, str(tmp_path))[0]).collect()
    assert {(r["source"], r["relationship"], r["field_name"], r["variant_name"], r["parameter_name"], r["function_name"], r["value"]) for r in rows} == {
        ("type:0x1::m::S", "field", "x", None, None, None, '"u8"'), ("type:0x1::m::E", "variantField", "z", "V", None, None, '{"vector":"u8"}'),
        ("function:0x1::m::f", "parameter", None, None, "p", "f", '"bool"'), ("function:0x1::m::f", "parameter", None, None, None, "f", '"Own"'), ("function:0x1::m::f", "return", None, None, None, "f", '"u64"'),
    }


def test_bytecode_files_and_artifacts(spark, tmp_path):
    root = tmp_path / "pkg"
    kept = ["build/p/bytecode_modules/a.mv", "build/p/bytecode_modules/in/b.mv", "bytecode_modules/c.mv"]
    for name in [*kept, "build/p/bytecode_modules/dependencies/d.mv", "build/p/sources/e.mv", "f.mv", "build/p/bytecode_modules/g.txt", "x/build/p/bytecode_modules/h.mv"]:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(name.encode())
    for roots in ([str(root)], [str(root) + "/", str(root / "bytecode_modules"), str(root)]):
        rows = files.bytecode_files(spark, roots).collect()
        assert [bytes(r["content"]).decode() for r in rows] == kept and [r["path"] for r in rows] == sorted(r["path"] for r in rows)
    assert bytes(files.read_artifact(spark, str(root), "build/p/bytecode_modules/g.txt").first()["content"]) == b"build/p/bytecode_modules/g.txt"
    (root / "big").write_bytes(b"x" * (tables.MOST_BYTES + 1))
    assert files.read_artifact(spark, str(root), "big").count() == 0
    for bad in ("", "/etc/passwd", "../x", "a/../b", "a//b", "*", "a/./b"):
        with pytest.raises(ValueError, match="within"):
            files.read_artifact(spark, str(root), bad)


def test_update_by_key(spark):
    cards = spark.createDataFrame([(1, "a", 1, "k"), (2, "b", 2, "k"), (None, "c", 3, "k")], "id int, status string, n int, other string")
    changes = spark.createDataFrame([(1, "x", 5, 1), (1, None, 6, 2), (9, "z", 0, 1), (None, "q", 0, 1)], "id int, status string, n int, at int")
    got = tables.update_by_key(cards, changes, "id", ["status", "n"], "at")
    assert got.columns == cards.columns and {tuple(r) for r in got.collect()} == {(1, None, 6, "k"), (2, "b", 2, "k"), (None, "c", 3, "k")}


def test_forward_goes_on_where_it_stopped(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for part in range(3):
        spark.createDataFrame([(part, "x")], "id int, what string").coalesce(1).write.mode("append").parquet(str(source))
        stream = stateful.forward(spark.readStream.schema("id int, what string").parquet(str(source)), folder, every=None)
        assert stream.awaitTermination(120)
    sent = spark.read.parquet(f"{folder}/sent")
    assert {(r["batch"], r["id"]) for r in sent.collect()} == {(0, 0), (1, 1), (2, 2)}
    running = stateful.forward(spark.readStream.schema("id int, what string").parquet(str(source)), folder)
    assert running.isActive
    running.stop()
    assert not running.isActive and spark.read.parquet(f"{folder}/sent").count() == 3


def test_token_totals(spark):
    rows = [
        ("a", 1, "r", 5, 50, None), ("a", 2, "u", 1, 10, None), ("a", 3, "m", 2, 20, 40), ("a", 4, "r", 7, 70, None), ("a", 5, "u", 3, 30, None), ("a", 6, "t", None, 1, None),
        ("never", 1, "u", 9, 90, None), ("huge", 1, "m", 1, 1, history.MOST), ("huge", 2, "u", 4, 4, None),
    ]
    df = spark.createDataFrame(rows, "k string, at int, role string, tokens bigint, size bigint, usage bigint")
    role = F.col("role")
    got = {r[0]: tuple(r)[1:] for r in history.token_totals(df, "k", "at", role.isin("m", "r"), role == "u", role == "r", "tokens", "size", "usage").collect()}
    assert got["a"] == (40, 181, 3, 31, 12, 55, 43)
    assert got["never"] == (0, 90, 0, 0, 0, 0, 0) and got["huge"][5:] == (history.MOST, history.MOST)
    assert {r["k"]: r["after_model"] for r in history.usage_after(df.where("k <> 'huge'"), "k", "at", role.isin("m", "r"), "tokens").collect()} == {"a": 3, "never": 0}


def test_merged_gaps(spark):
    rows = spark.createDataFrame([(1, 1, "net", "a", None), (1, 2, "disk", "b", "p"), (1, 3, "net", "c", "q"), (2, 1, "x", None, None)], "k int, at int, capability string, reason string, provider string")
    got = {r["k"]: json.loads(r["gaps"]) for r in ledger.merged_gaps(rows, "k", "at", ["reason", "provider"]).collect()}
    assert got == {1: [{"capability": "net", "reason": "c", "provider": "q"}, {"capability": "disk", "reason": "b", "provider": "p"}], 2: [{"capability": "x"}]}


def _replay_by_hand(items, claims, finishes, evidence):
    """One event after the other; claims come ahead of finishes of the same time."""
    stored = {(e[0], e[1]): e for e in evidence}
    state = {(i[0], i[1]): {"place": i[2], "stage": i[3], "status": "pending", "by": None, "at": None, "evidence": list(i[6] or [])} for i in items}
    fixed, outcomes, runs = {(i[0], i[1]): (i[4] or [], i[5] or []) for i in items}, {}, {}
    events = sorted([(c[3], 0, c[1], c) for c in claims] + [(f[6], 1, f[0], f) for f in finishes], key=lambda e: e[:3])
    for time, kind, _, event in events:
        if kind == 0:
            run, worker, stage, _ = event
            waiting = sorted((s["place"], key) for key, s in state.items() if key[0] == run and s["status"] == "pending" and (stage is None or s["stage"] == stage))
            if waiting:
                own = state[waiting[0][1]]
                own |= {"status": "claimed", "by": worker, "at": time}
                runs[run] = own["stage"]
            continue
        request, run, item, worker, status, cited, _ = event
        own, outcome = state.get((run, item)), status
        if status not in ledger.FINISHED:
            outcome = "invalid_status"
        elif any((run, c) not in stored for c in cited):
            outcome = "evidence_not_found"
        elif own is None:
            outcome = "item_not_found"
        elif own["by"] is None or own["by"] != worker:
            outcome = "claimed_by_other"
        elif status == "completed" and fixed[run, item][0]:
            outcome = "unavailable_capabilities"
        elif status == "completed" and fixed[run, item][1]:
            known = [stored[run, c] for c in {*own["evidence"], *cited} if (run, c) in stored]
            if not any(e[2] == item and e[3] in fixed[run, item][1] and not e[4] for e in known):
                outcome = "missing_evidence"
        outcomes[request] = outcome
        if outcome in ledger.FINISHED:
            own |= {"status": outcome, "at": time, "evidence": own["evidence"] + cited}
            waiting = sorted((s["place"], s["stage"]) for key, s in state.items() if key[0] == run and s["status"] == "pending")
            runs[run] = waiting[0][1] if waiting else runs[run]
    return outcomes, state, runs


@pytest.mark.parametrize("seed", [1, 2])
def test_replayed_work(spark, seed):
    rng = random.Random(seed)
    runs = ["any", "staged", "quiet"]
    items = [(run, f"i{k}", k, rng.choice("abc"), rng.choice([None, [], [], ["shell"]]), rng.choice([None, ["replay"], ["replay", "trace"]]), rng.choice([None, [f"{run}{k % 9}"]])) for run in runs for k in range(25)]
    times = iter(rng.sample(range(1000), 400))
    claims = [(run, rng.choice("vw"), None if run == "any" else rng.choice("abcz"), next(times)) for run in runs[:2] for _ in range(24)]
    finishes = [(f"f{k}", rng.choice(runs), f"i{rng.randrange(26)}", rng.choice("vw"), rng.choice(["completed"] * 4 + ["failed", "blocked", "pending"]), [], next(times)) for k in range(250)]
    finishes = [(*f[:5], [f"{f[1]}{rng.randrange(31)}" for _ in range(rng.randrange(3))], f[6]) for f in finishes]
    evidence = [(run, f"{run}{k}", f"i{rng.randrange(25)}" if k % 3 else f"i{k}", rng.choice(["replay", "trace", "review"]), rng.random() < 0.3) for run in runs for k in range(30)]
    outcomes, state, stages = _replay_by_hand(items, claims, finishes, evidence)
    lists = "unavailable array<string>, methods array<string>, evidence array<string>"
    frames = [
        spark.createDataFrame(items, f"run string, item string, place int, stage string, {lists}"), spark.createDataFrame(claims, "run string, worker string, stage string, time int"),
        spark.createDataFrame(finishes, "request string, run string, item string, worker string, status string, cited array<string>, time int"),
        spark.createDataFrame(evidence, "run string, evidence string, item string, method string, submitted_by_model boolean"),
    ]
    told, left = ledger.replayed_work(*frames)
    assert {r["request"]: r["outcome"] for r in told.collect()} == outcomes
    assert {"completed", "missing_evidence", "claimed_by_other", "failed"} <= set(outcomes.values())
    rows = {(r["run"], r["item"]): r for r in left.collect()}
    assert len(rows) == len(items)
    for key, own in state.items():
        row = rows[key]
        assert (row["status"], row["claimed_by"], row["updated_at"], row["n_evidence"]) == (own["status"], own["by"], own["at"], len(set(own["evidence"])))
    assert {r["run"]: r["current_stage"] for r in ledger.run_states(left).collect() if r["current_stage"]} == stages


def test_claims_of_both_kinds_are_refused(spark):
    items = spark.createDataFrame([("r", "i", 1, "a")], "run string, item string, place int, stage string")
    claims = spark.createDataFrame([("r", "w", None, 1), ("r", "w", "a", 2)], "run string, worker string, stage string, time int")
    with pytest.raises(Exception, match="with and without stages in run r"):
        ledger.claimed_items(items, claims).collect()
    assert ledger.claimed_items(items, claims.limit(0)).first()["claimed_by"] is None


def test_items_without_a_queue_and_few_shuffles(spark):
    """Items without a stage or a run stay, unclaimed; requests go once to their items, once to what they cite, and back to their items."""
    lists = "unavailable array<string>, methods array<string>, evidence array<string>"
    items = spark.createDataFrame([("r", "i", 1, "a", None, [], ["e", "x"]), ("r", "j", 2, None, None, [], None), (None, "k", 3, "a", None, None, [])], f"run string, item string, place int, stage string, {lists}")
    claims = spark.createDataFrame([("r", "w", "a", 1), ("r", "w", "a", 2)], "run string, worker string, stage string, time int")
    finishes = spark.createDataFrame([("q", "r", "i", "w", "failed", ["e"], 5), ("p", "r", "i", "w", "blocked", None, 4), ("o", "r", "j", "w", "failed", [], 6)], "request string, run string, item string, worker string, status string, cited array<string>, time int")
    evidence = spark.createDataFrame([("r", "e", "i", "m", False)], "run string, evidence string, item string, method string, submitted_by_model boolean")
    told, left = ledger.replayed_work(items, claims, finishes, evidence, 3)
    assert {r["request"]: r["outcome"] for r in told.collect()} == {"q": "failed", "p": "blocked", "o": "claimed_by_other"}
    rows = {r["item"]: (r["status"], r["claimed_by"], r["attempts"], r["updated_at"], r["n_evidence"]) for r in left.collect()}
    assert rows == {"i": ("failed", "w", 1, 5, 2), "j": ("pending", None, 0, None, 0), "k": ("pending", None, 0, None, 0)}
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and told.rdd.getNumPartitions() == 3


def test_finish_outcomes(spark):
    items = [("r", "free", None, None, None, None), ("r", "plain", "w", None, None, None), ("r", "gap", "w", ["shell"], None, None), ("r", "proof", "w", [], ["replay"], ["held"]), ("r", "own", "w", [], ["replay"], ["mine"])]
    evidence = [("r", "held", "proof", "replay", False), ("r", "mine", "own", "replay", True), ("r", "else", "proof", "replay", False), ("q", "far", "own", "replay", False)]
    requests = [
        (1, "plain", "pending", []), (2, "plain", "completed", ["far"]), (3, "none", "failed", []), (4, "free", "failed", []), (5, "gap", "completed", []), (6, "gap", "blocked", None),
        (7, "proof", "completed", ["mine"]), (8, "own", "completed", ["else"]), (9, "plain", "completed", None), (10, "plain", None, None), (11, "own", "failed", ["mine"]),
    ]
    df = spark.createDataFrame([(n, "r", item, "w", status, cited) for n, item, status, cited in requests], "request int, run string, item string, worker string, status string, cited array<string>")
    items = spark.createDataFrame(items, "run string, item string, claimed_by string, unavailable array<string>, methods array<string>, evidence array<string>")
    evidence = spark.createDataFrame(evidence, "run string, evidence string, item string, method string, submitted_by_model boolean")
    got = {r["request"]: r["outcome"] for r in ledger.finish_outcomes(df, items, evidence).collect()}
    assert got == {
        1: "invalid_status", 2: "evidence_not_found", 3: "item_not_found", 4: "claimed_by_other", 5: "unavailable_capabilities", 6: "blocked",
        7: "completed", 8: "missing_evidence", 9: "completed", 10: "invalid_status", 11: "failed",
    }
