"""Commits over many tables, digests of ordered rows, and retractions in a stream."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from traceloom.operators import sequence
from traceloom.sources import snapshots
from traceloom.streaming import retraction


def test_a_failed_commit_changes_nothing(spark, tmp_path):
    root = f"{tmp_path}/store"
    make = lambda rows: spark.createDataFrame(rows, "package_id string, name string, n int")
    first = {"modules": make([("0x1", "a", 1), ("2", "b", 2)]), "types": make([("0x1", "t", 1)])}
    assert snapshots.commit(spark, root, first) == 1
    bound = snapshots.read(spark, root, "modules")
    # The writer is killed between its tables.
    broken = make([("0x1", "x", 9)]).withColumn("n", F.raise_error(F.lit("killed")).cast("int"))
    with pytest.raises(Exception, match="killed"):
        snapshots.commit(spark, root, {"modules": make([("0x1", "new", 3)]), "types": broken})
    rows = lambda name, k=None: sorted(tuple(r) for r in snapshots.read(spark, root, name, k).select("package_id", "name", "n").collect())
    assert snapshots.latest(spark, root) == 1 and rows("modules") == [("0x1", "a", 1), ("2", "b", 2)] and rows("types") == [("0x1", "t", 1)]
    # A package loses its old rows in all tables, others keep theirs, and what was read before stays.
    assert snapshots.commit(spark, root, {"modules": make([("0x1", "new", 3)])}) == 2
    assert rows("modules") == [("0x1", "new", 3), ("2", "b", 2)] and rows("types") == [] and rows("types", 1) == [("0x1", "t", 1)]
    assert sorted(r["name"] for r in bound.collect()) == ["a", "b"]
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, root, {"modules": make([("3", "late", 1)])}, base=1)
    assert rows("modules") == [("0x1", "new", 3), ("2", "b", 2)]


def test_documents_are_put_once(spark, tmp_path):
    snapshots.put_document(spark, f"{tmp_path}/docs/a.json", {"é": 1})
    with pytest.raises(FileExistsError):
        snapshots.put_document(spark, f"{tmp_path}/docs/a.json", {"b": 2})
    with pytest.raises(ValueError):
        snapshots.put_document(spark, f"{tmp_path}/docs/b.json", "x" * snapshots.MOST_BYTES)
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/docs").collect()] == ['{"é": 1}'] and len([p for p in (tmp_path / "docs").iterdir() if p.suffix == ".json"]) == 1


def test_digests_tell_order_and_rows(spark):
    rows = [("g", k // 3, k % 3, None if k == 4 else f"s{k}") for k in range(40)] + [("h", 1, 1, "")]
    digest = lambda rows, parts: {r["k"]: (r["n"], r["digest"]) for r in sequence.sequence_digests(spark.createDataFrame(rows, "k string, a int, b int, c string").repartition(parts), ["k"], ["a", "b", "c"]).collect()}
    want = digest(rows, 1)
    assert digest(rows[::-1], 5) == want and want["g"][0] == 40
    assert digest(rows[:-1] + [("h", 1, 1, None)], 2)["h"] != want["h"] and digest(rows[1:], 2)["g"] != want["g"]
    swapped = sequence.sequence_digests(spark.createDataFrame(rows, "k string, b int, a int, c string"), ["k"], ["b", "a", "c"])
    assert {r["k"]: r["digest"] for r in swapped.collect()}["g"] == want["g"][1]
    other = sequence.sequence_digests(spark.createDataFrame(rows, "k string, b int, a int, c string"), ["k"], ["a", "b", "c"])
    assert {r["k"]: r["digest"] for r in other.collect()}["g"] != want["g"][1]


def test_spans_of_edges(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 1), ("a", 3), ("b", 2), (None, 5), (None, 4)], "e string, s int")
    found = {(r["e"], r["place"]): (r["s"], r["n_times"]) for r in sequence.spans_of_edges(rows, ["e"], ["s"]).collect()}
    assert found == {("a", 0): (1, 1), ("a", 1): (3, 2), ("b", 0): (2, 1), (None, 0): (4, 1), (None, 1): (5, 1)}


@pytest.mark.parametrize("seed", [1, 2])
def test_rollbacks_in_any_cut_into_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), at, rng.choice([None, None, None, 1, 2, 5])) for at in range(60)]
    schema = "k string, at bigint, n int"
    cuts = sorted(rng.sample(range(1, 60), 4))
    for a, b in zip([0, *cuts], [*cuts, 60]):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    retraction.keep_changes(retraction.rollback_changes(stream, "k", "at", "n"), f"{tmp_path}/out").awaitTermination()
    got = sorted(tuple(r) for r in retraction.standing(spark, f"{tmp_path}/out", "k", "at").collect())
    batch = sequence.replay_rollbacks(spark.createDataFrame(rows, schema), "k", "at", "n")
    assert got == sorted((r["k"], r["at"]) for r in batch.collect()) and spark.read.parquet(f"{tmp_path}/out/changes").where("NOT stands").count() > 0


def test_thread_filters_reach_the_source(spark, tmp_path):
    from traceloom.sources import threads

    rows = [(k, 0, "user", "x\ny", s) for k, s in enumerate(["cli", "vscode", "exec", "subagent:review", "subagent:other", "mcp", "cli"])]
    spark.createDataFrame(rows, threads.SCHEMA).write.partitionBy("source").json(f"{tmp_path}/logs")

    def found(kinds):
        rows = threads.thread_logs(spark, f"{tmp_path}/logs", kinds)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        return sorted(r["thread"] for r in rows.collect()), rows.rdd.getNumPartitions(), " Filter " in f" {plan}"

    everything = found(["subAgent"])[1]
    assert found([]) == found(None) and found(None)[0] == [0, 1, 6]
    assert found(["vscode"])[:2] == ([1], 1) and threads.thread_logs(spark, f"{tmp_path}/logs", ["vscode"]).first()["text"] == "x\ny"
    # Taken by the source: no filter is left, and fewer files are read. Otherwise Spark filters what all files hold.
    for kinds, ids, pushed in [(["cli", "vscode"], [0, 1, 6], True), (["cli", "subAgent"], [0, 3, 4, 6], False), (["exec", "appServer"], [2, 5], False), (["subAgentOther"], [4], False)]:
        got, parts, filtered = found(kinds)
        assert got == ids and filtered != pushed and (parts < everything) == pushed


def test_batches_of_many_files_come_in_order(spark, tmp_path, monkeypatch):
    """Four batches, each written by several tasks: no batch is one file, and none begins before the one ahead of it has ended."""
    from traceloom.plans import rows_only

    rows = [(k, datetime.datetime(2026, 1, 1), k % 3, ("click", "click", "error")[k // 3 % 3], 1.0, "") for k in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(rows_only, "scratch_dir", lambda _: str(tmp_path))
    with_files = {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "4k"}
    before = {k: spark.conf.get(k) for k in with_files}
    for k, v in with_files.items():
        spark.conf.set(k, v)
    try:
        got = sorted(tuple(r) for r in rows_only.stream_rollbacks(spark, str(tmp_path)).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    stands = {u: [] for u in range(3)}
    for k, _, u, kind, _, _ in rows:
        if kind == "error":
            del stands[u][-1:]
        else:
            stands[u].append(k)
    assert got == sorted((u, k) for u, own in stands.items() for k in own)
    assert len(list(tmp_path.glob("stream-*/events/*.parquet"))) > 4 and len(list(tmp_path.glob("stream-*/changes/batch=*"))) == 4
