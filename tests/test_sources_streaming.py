"""Readers, writers and streaming operators on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from traceloom.plans import rows_only
from traceloom.sources import files, tables
from traceloom.streaming import stateful


def test_csv_round_trip(spark, tmp_path):
    rows = [("1", 'say "hi", you', "x\ny"), ("2", None, "é"), (None, None, None)]
    tables.write_csv(spark.createDataFrame(rows, "id string, a string, b string").coalesce(1), str(tmp_path / "out"))
    back = {r["id"]: (r["a"], r["b"]) for r in tables.read_csv(spark, str(tmp_path / "out")).collect()}
    assert back == {"1": ('say "hi", you', "x\ny"), "2": (None, "é")}


def test_csv_byte_order_mark_and_empty_rows(spark, tmp_path):
    (tmp_path / "in.csv").write_bytes("﻿id,b\n1,x\n,\n2,y\n".encode())
    rows = tables.read_csv(spark, str(tmp_path / "in.csv"))
    assert rows.columns == ["id", "b"] and rows.count() == 2


def test_job_items_and_template(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "id string, n int")
    items = tables.job_items(rows, ["n"], "id").orderBy("row_index").collect()
    assert [r["item_id"] for r in items] == ["a", "a-2", "b"] and json.loads(items[1]["row_json"]) == {"id": "a", "n": 2}
    filled = rows.select(tables.fill_template("{{x}} {id}:{n} {z}", ["id", "n"]).alias("t")).first()["t"]
    assert filled == "{x} a:1 {z}"


def test_replace_packages_keeps_others(spark, tmp_path):
    path = str(tmp_path / "facts")
    tables.replace_packages(spark.createDataFrame([("p", 1), ("q", 2)], "package_id string, v int"), path)
    tables.replace_packages(spark.createDataFrame([("p", 3)], "package_id string, v int"), path)
    assert {(r["package_id"], r["v"]) for r in spark.read.parquet(path).collect()} == {("p", 3), ("q", 2)}


def test_upsert_and_first_wins(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], "id int, v string, t int")
    new = spark.createDataFrame([(2, "c", 5), (3, "d", 1)], "id int, v string, t int")
    assert {r["id"]: r["v"] for r in tables.upsert(old, new, ["id"], "t").collect()} == {1: "a", 2: "c", 3: "d"}
    assert tables.first_wins(old.union(new), ["id"], ["v"]).where("id = 2").first()["v"] == "b"


def test_summaries_and_malformed_files(spark, tmp_path):
    good = {"id": {"address": "0x1", "name": "m"}, "immediate_dependencies": [{"address": "0x2", "name": "n"}, {"address": "0x1", "name": "o"}], "functions": {"f": {"entry": True, "native": True, "doc": "d"}, "g": {}}}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text("{broken")
    modules, warnings = files.summaries(spark, str(tmp_path))
    found = {r["name"]: r for r in files.functions_of(modules).collect()}
    assert found["f"]["is_entry"] and found["f"]["is_native"] and found["f"]["docs"] == "d" and found["g"]["visibility"] == "Private"
    assert [tuple(r) for r in files.dependency_counts(modules).collect()] == [("0x1", "0x2", 1)]
    assert [r["severity"] for r in warnings.collect()] == ["Warning"]


def test_manifests_sources_and_directory_hash(spark, tmp_path):
    for name in ("p", "p/build/q"):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "Move.toml").write_text(f'[package]\nname = "{name[-1]}"\n')
    (tmp_path / "p" / "m.move").write_text("module a::m {}")
    assert [r["name"] for r in files.manifests(spark, str(tmp_path)).collect()] == ["p"]
    assert files.source_files(spark, str(tmp_path)).first()["text"] == "module a::m {}"
    before = files.directory_hash(spark, str(tmp_path)).first()["hash"]
    (tmp_path / "p" / "m.move").write_text("module a::n {}")
    assert before != files.directory_hash(spark, str(tmp_path)).first()["hash"]


def test_rollouts(spark, tmp_path):
    lines = [
        {"timestamp": "2024-01-01T00:00:00Z", "type": "session_meta", "payload": {"id": "t", "cwd": "/w", "model_provider": "m"}},
        {"timestamp": "2024-01-01T00:00:05Z", "type": "event", "payload": {"id": "e"}},
    ]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)))
    row = tables.rollouts(spark, str(tmp_path)).first()
    assert (row["cwd"], row["provider"], row["records"]) == ("/w", "m", 2)


def test_report_and_documents(spark, tmp_path):
    rows = spark.createDataFrame([("low", "b", None), ("high", "a", "t")], "severity string, title string, target string")
    assert [r["value"] for r in tables.report_lines(rows).collect()] == ["- **high** a (t)", "- **low** b (-)"]
    docs = spark.createDataFrame([(1, "x"), (2, "y" * (tables.MOST_BYTES + 1))], "id int, body string")
    assert [r["id"] for r in tables.write_documents(docs, str(tmp_path / "d"), "body").collect()] == [2]
    with pytest.raises(Exception, match="(?i)exist"):
        tables.write_documents(docs, str(tmp_path / "d"), "body")


def run_stream(spark, tmp_path, rows, schema, make, name):
    """Each list of rows is one micro-batch; returns what the stream has put out."""
    source = tmp_path / name
    source.mkdir()
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source / f"{i:03}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    query = make(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"{name}-c")).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_hysteresis(spark, tmp_path):
    samples = [[("k", 0, 1, 0), ("k", 10, 9, 10)], [("k", 300, 1, 10), ("k", 400, 1, 10), ("k", 560, 1, 10)], [("k", 600, 9, 10), ("k", 610, 70, 10)]]
    rows = run_stream(spark, tmp_path, samples, "k string, at bigint, lines bigint, age bigint", lambda s: stateful.hysteresis(s, "k"), "modes")
    modes = [r["mode"] for r in sorted(rows, key=lambda r: r["at"])]
    assert modes == ["smooth", "catch_up", "catch_up", "catch_up", "smooth", "smooth", "catch_up"]


def test_debounced_equals_batch(spark, tmp_path):
    stamp = lambda s: f"2024-01-01 00:00:{s:02}"
    raw = [[("a", stamp(0)), ("a", stamp(1))], [("a", stamp(9)), ("b", stamp(1))], [("z", "2024-01-01 01:00:00")], [("z", "2024-01-01 02:00:00")]]
    schema = "k string, ts string"
    make = lambda s: stateful.debounced(s.withColumn("ts", F.to_timestamp("ts")), "k", "ts", "2 seconds")
    found = {(r["k"], r["n"]) for r in run_stream(spark, tmp_path, raw, schema, make, "bursts")}
    assert {("a", 2), ("a", 1), ("b", 1)} <= found


def test_idle_streams(spark, tmp_path):
    raw = [[("a", "2024-01-01 00:00:00", "x"), ("b", "2024-01-01 00:00:00", "x")], [("b", "2024-01-01 00:00:01", "done")], [("c", "2024-01-01 01:00:00", "x")], [("c", "2024-01-01 01:00:01", "x")]]
    make = lambda s: stateful.idle(s.withColumn("ts", F.to_timestamp("ts")), "k", "ts", 1000, "done")
    found = {(r["k"], r["n"], r["outcome"]) for r in run_stream(spark, tmp_path, raw, "k string, ts string, event string", make, "idle")}
    assert {("a", 1, "idle"), ("b", 2, "completed")} <= found


def ended_by_hand(rows, timeout, done):
    """Streams of (key, time, event) rows; those that may still go on are left out."""
    out, end = [], max(at for _, at, _ in rows)
    for key in {k for k, _, _ in rows}:
        n = last = 0
        for at, finished in sorted((at, event == done) for k, at, event in rows if k == key):
            if n and at - last > timeout:
                out.append((key, n, "idle"))
                n = 0
            n, last = n + 1, at
            if finished:
                out.append((key, n, "completed"))
                n = 0
        if n and end - last > timeout:
            out.append((key, n, "idle"))
    return sorted(out)


@pytest.mark.parametrize("folder", [False, True])
def test_idle_query_on_one_batch(spark, sf, tmp_path, folder):
    events = spark.read.parquet(f"{sf}/events.parquet")
    path = sf
    if folder:
        path = str(tmp_path)
        events.repartition(3).write.parquet(f"{path}/events.parquet")
    rows = [tuple(r) for r in events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")), "event_type").collect()]
    found = sorted(map(tuple, rows_only.stream_idle_timeout(spark, path).collect()))
    assert found and found == ended_by_hand(rows, 6 * 3_600_000_000, "signup")


def test_high_water_mark(spark):
    assert stateful.high_water_mark(spark.createDataFrame([(3,), (7,)], "v int"), "v", 9) == 9
    assert stateful.high_water_mark(spark.createDataFrame([(30,)], "v int"), "v", 9) == 30
    assert stateful.high_water_mark(spark.createDataFrame([], "v int"), "v", 9) == 9
