"""Predicates, times and reports, against literal expectations and plain loops."""

import datetime
import json
import random

from pyspark.sql import functions as F

from traceloom.functions import predicates, strings, times
from traceloom.operators import reports


def test_each_guard_and_privilege_signal(spark):
    rows = [(f"f(x: {word.upper()}2): u64", "") for word in predicates.GUARD_PARAMETERS] + [("f(x: u8)", f"{{ {word.upper()} }}") for word in predicates.GUARD_BODY]
    found = spark.createDataFrame(rows, "s string, b string").select(predicates.is_guarded(F.col("s"), F.col("b")).alias("g")).collect()
    assert len(found) == 12 and all(r.g for r in found)
    rows = [("admin_f(x: u8): Cap", "x"), ("f(x: u8): AdminCap", None), (None, None), ("f", "checks"), ("f(x: checKed)", "checK_"), ("f(a: (u8, B<(C)>), d: Cap): E", "")]
    df = spark.createDataFrame(rows, "s string, b string")
    assert [r.g for r in df.select(predicates.is_guarded(F.col("s"), F.col("b")).alias("g")).collect()] == [False] * 5 + [True]
    rows = [(w.title(), "") for w in predicates.PRIVILEGED_NAMES] + [("x", f"a{w}b".upper()) for w in predicates.PRIVILEGED_BODY] + [("x", "coin:"), (None, None), ("reads", "")]
    got = [r.p for r in spark.createDataFrame(rows, "n string, b string").select(predicates.is_privileged(F.col("n"), F.col("b")).alias("p")).collect()]
    assert got == [True] * 25 + [False] * 3


def test_tests_abilities_and_reach(spark):
    rows = [("a/tests/m", []), ("a/mytests/m", []), ("a/m", ["doc", "Test_Only"]), ("a/m", ["EXPECTED_failure(x)"]), (None, None), ("a/m", [None])]
    got = spark.createDataFrame(rows, "p string, a array<string>").select(predicates.is_test(F.col("p"), F.col("a")).alias("t"), predicates.has_ability(F.col("a"), "doc").alias("h")).collect()
    assert [r.t for r in got] == [True, False, True, True, False, False] and [r.h for r in got] == [False, False, True, False, False, False]
    rows = [("public", False, False), ("public(package)", None, None), ("private", True, False), (None, None, True), ("public(friend)", False, None), (None, None, None)]
    got = spark.createDataFrame(rows, "v string, e boolean, c boolean").select(predicates.is_reachable(F.col("v"), F.col("e"), F.col("c")).alias("r")).collect()
    assert [r.r for r in got] == [True] * 4 + [False] * 2


def test_nesting_of_long_texts(spark):
    def parameters(text):
        at = text.find("(")
        depth = 0
        for i in range(max(at, 0), len(text) if at >= 0 else 0):
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            if depth == 0:
                return text[at + 1 : i]
        return None

    rng = random.Random(4)
    texts = ["".join(rng.choices("(),a<ä😀", k=12)) for _ in range(300)] + ["", "(" * 500 + ")" * 500, "f(" + "x, " * 30000 + "y)z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", strings.function_parameters(F.col("t")).alias("p")).collect()}
    assert got == {i: parameters(t) for i, t in enumerate(texts)}


def test_rfc3339(spark):
    good = {"2024-02-29T23:59:59Z": 0, "2024-02-29t23:59:59.5z": 500_000, "2024-03-01 05:29:59.1234567+05:30": 123_456, "2024-02-29T11:59:59.000001-12:00": 1}
    bad = ["2024-02-30T00:00:00Z", "2024-02-29T24:00:00Z", "2024-02-29T23:59:59", "2024-02-29", "24-02-29T23:59:59Z", "2024-02-29T23:59Z", "x2024-02-29T23:59:59Z", "2024-02-29T23:59:59Z\n", "2024-02-29T23:59:60Z", "", None]
    base = 1_709_251_199_000_000
    for zone in ("UTC", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            at = times.parse_rfc3339(F.col("t"))
            got = spark.createDataFrame([(t,) for t in [*good, *bad]], "t string").select(F.unix_micros(at).alias("us"), times.format_rfc3339(at).alias("text")).collect()
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert [r.us for r in got] == [base + us for us in good.values()] + [None] * len(bad)
        assert [r.text for r in got][:4] == [f"2024-02-29T23:59:59.{ms}Z" for ms in ("000", "500", "123", "000")]


def test_ages_and_file_times(spark):
    now = times.parse_rfc3339(F.lit("2024-03-08T00:00:00Z"))
    rows = [("2024-03-01T00-00-00-a.md", True), ("2024-03-01T00-00-01.md", False), ("2024-02-01T00-00-00.txt", False), ("2024-02-31T00-00-00.md", False), ("notes.md", False), (None, False)]
    got = spark.createDataFrame(rows, "n string, e boolean").select(times.is_expired(F.col("n"), now, 7).alias("got"), "e").collect()
    assert [r.got for r in got] == [r.e for r in got]
    updated = [("2024-03-07T23:59:00Z", True), ("2024-03-07T23:59:00.000001Z", False), ("2024-03-08T00:00:01Z", False), (None, False)]
    got = spark.createDataFrame(updated, "u string, e boolean").select(times.is_stale(times.parse_rfc3339(F.col("u")), now, 60).alias("got"), "e").collect()
    assert [r.got for r in got] == [r.e for r in got]


def test_merged_objects(spark):
    rows = [
        ('{"b":1,"a":{"x":[1,null]}}', '{"b":"q\\"é","c":null}', {"a": {"x": [1, None]}, "b": 'q"é', "c": None}), ("{}", '{"k":2.5}', {"k": 2.5}), ('{"k":1}', "[1]", {"k": 1}), ('{"k":1}', None, {"k": 1}),
        ("[1]", '{"k":1}', [1]),
    ]
    got = spark.createDataFrame([(a, b) for a, b, _ in rows], "a string, b string").select(reports.merge_objects(F.col("a"), F.col("b")).alias("m")).collect()
    assert [json.loads(r.m) for r in got] == [m for _, _, m in rows]
    assert got[0].m.index('"a"') < got[0].m.index('"b"') < got[0].m.index('"c"')
    rows = [(None, {"h": {"r": 1}}), ('{"h":3,"z":4}', {"h": {"r": 1}, "z": 4}), ("[1]", {"h": {"r": 1}, "previousMetadata": [1]}), ("null", {"h": {"r": 1}, "previousMetadata": None}), ("no json", {"h": {"r": 1}, "previousMetadata": "no json"})]
    got = spark.createDataFrame([(a,) for a, _ in rows], "a string").select(reports.with_entry(F.col("a"), "h", F.lit('{"r":1}')).alias("m")).collect()
    assert [json.loads(r.m) for r in got] == [m for _, m in rows]


def test_merged_metadata(spark):
    rng = random.Random(9)
    rows, expected = [], {}
    for bundle in range(40):
        merged = None
        for at in range(rng.randint(1, 6)):
            text = rng.choice(["[1]", None, "3", *(json.dumps({rng.choice("abc"): rng.randint(0, 9), rng.choice("cd"): [at]}) for _ in range(4))])
            rows.append((bundle, at, text))
            value = json.loads(text) if text else None
            if at == 0:
                merged = value if isinstance(value, dict) else None
            elif merged is not None and isinstance(value, dict):
                merged.update(value)
        expected |= {(bundle, k): v for k, v in (merged or {}).items()}
    df = spark.createDataFrame(rows, "bundle int, at int, m string")
    got = reports.merged_metadata(df, "bundle", ["at"], "m").collect()
    assert len(got) == len(expected) and {(r.bundle, r.key): json.loads(r.value) for r in got} == expected
    assert reports.merged_metadata(df.limit(0), "bundle", ["at"], "m").count() == 0


def test_index_health(spark):
    schema = (
        "id int, summary_artifact_count long, function_count long, operation_count long, operation_exact_span_count long, operation_source_span_count long, call_operation_count long, call_edge_with_operation_count long, "
        "dangling_operation_edge_count long, dangling_semantic_tag_target_count long, prohibited_tag_count long, full_mode boolean, known boolean, clean boolean, codes array<string>, metadata string"
    )
    rows = [
        (1, 0, 5, 0, 0, 0, 0, 0, 0, 0, 0, True, False, False, None, None), (2, 1, 5, 4, 0, 3, 2, 1, 1, 2, 3, True, True, False, ["call_edge_parity_mismatch"], '{"x":1}'),
        (3, 1, 5, 4, 4, 4, 2, 2, 0, 0, 0, False, True, True, [], "[]"), (4, 1, 5, 0, 0, 0, 0, 0, 0, 0, 0, True, False, True, [], None),
    ]
    got = {r.id: r for r in reports.index_health(spark.createDataFrame(rows, schema)).collect()}
    assert [(got[i].readiness, got[i].freshness) for i in (1, 2, 3, 4)] == [("missing_summary_artifacts", "first_index"), ("compiler_backed", "changed"), ("summary_pointer", "fresh"), ("summary_pointer", "fresh")]
    codes = {i: [d.code for d in got[i].diagnostics] for i in got}
    assert codes[1] == ["missing_summary_artifacts", "body_operations_unavailable"] and codes[3] == [] and codes[4] == ["body_operations_unavailable"]
    assert codes[2] == ["exact_operation_spans_unavailable", "dangling_operation_edges", "dangling_semantic_tag_targets", "non_neutral_semantic_tags"]
    assert json.loads(got[2].metadata) == {"x": 1, "index_health": {"readiness": "compiler_backed", "freshness": "changed"}} and json.loads(got[3].metadata)["previousMetadata"] == []
    assert json.loads(got[2].diagnostics[0].metadata) == {"operation_count": 4, "operation_source_span_count": 3}


def test_bound_capabilities(spark):
    desired = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (4, "z")], "stage int, capability string")
    bindings = spark.createDataFrame([(1, 2, "a", True, "late", None), (1, 1, "a", False, "p", "broken"), (1, 1, "b", True, "q", None), (2, 1, "a", False, "p", None), (3, 1, "a", True, "p", None)], "stage int, at int, capability string, available boolean, provider string, diagnostic string")
    bound = reports.bound_capabilities(desired, bindings, ["stage"], "at")
    assert {tuple(r) for r in bound.collect()} == {(1, "a", "unavailable", None, "broken"), (1, "b", "available", "q", None), (1, "c", "unbound", None, None), (2, "a", "unavailable", None, "capability provider is unavailable"), (4, "z", "unbound", None, None)}
    actions = reports.stage_actions(spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "stage int"), bound, ["stage"])
    assert {r.stage: r.action for r in actions.collect()} == {1: "UseAvailableCapabilitiesWithGaps", 2: "RecordUnavailableAndContinue", 3: "ModelOnly", 4: "UseAvailableCapabilities"}


def test_scan_counts(spark):
    rows = [
        ("p", "unit", "f", "a", "1", False), ("p", "unit", "f", "a", "1", False), ("p", "unit", "f", "a", "2", False), ("p", "unit", "f", "a", "3", True), ("p", "unit", "f", "b", "3", True), ("p", "unit", "f", "b", "4", True),
        ("p", "spec", "f", "a", None, False), ("p", "spec", "f", None, None, True), ("q", "other", "f", "a", "1", False),
    ]
    got = {r.p: r.asDict() for r in reports.scan_counts(spark.createDataFrame(rows, "p string, kind string, file string, name string, detail string, fallback boolean"), "p", ["unit", "spec"]).collect()}
    assert got["p"] == {"p": "p", "unit_count": 3, "has_unit": True, "unit_added": 1, "spec_count": 2, "has_spec": True, "spec_added": 1}
    assert got["q"] == {"p": "q", "unit_count": 0, "has_unit": False, "unit_added": 0, "spec_count": 0, "has_spec": False, "spec_added": 0}


def test_job_progress(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [("a", "running", t), ("a", "pending", t), ("b", "completed", t), ("b", "failed", None), ("c", "pending", t), ("d", "running", t + datetime.timedelta(seconds=1))]
    got = {r.job: r for r in reports.job_progress(spark.createDataFrame(rows, "job string, status string, updated_at timestamp"), "job", times.parse_rfc3339(F.lit("2024-01-01T00:30:00Z")), 1800).collect()}
    assert {j: (r.done, r.cancellable, r.n_stale) for j, r in got.items()} == {"a": (False, False, 1), "b": (True, True, 0), "c": (False, True, 0), "d": (False, False, 0)}
    assert (got["b"].n_items, got["b"].n_failed) == (2, 1)
