"""Many tables that change together: snapshots of package tables, put in place by one rename.

Rows of a commit go to folders of their own (``data/<table>/commit_version=<version>/package_id=...``), where nobody looks yet. A manifest
says for each package which version holds it, in all tables at once. A snapshot file names the manifest; it appears by a
rename that fails if another writer was first, and that is the commit. Readers are bound to a snapshot: what they read stays
as it is while others write, and a writer that dies leaves folders that no manifest names."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from traceloom.sources.tables import MOST_BYTES

PACKAGE = "package_id"


class Conflict(Exception):
    """Another writer has committed since the snapshot that a writer began from."""


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """A file of a given content appears at a path whole or not at all, and never over another."""
    temporary, files = _files(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}.tmp")
    out = files.create(temporary, False)
    try:
        out.write(bytearray(content))
        if hasattr(out, "hsync"):
            out.hsync()
    finally:
        out.close()
    jvm = spark._jvm
    never_over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), spark._jsc.hadoopConfiguration()).rename(temporary, jvm.org.apache.hadoop.fs.Path(path), never_over)
    except Exception as failed:
        files.delete(temporary, False)
        if "FileAlreadyExists" in str(failed):
            raise FileExistsError(path) from None
        raise


def put_document(spark: SparkSession, path: str, document: object) -> None:
    """A JSON document of at most MOST_BYTES, by ``put``."""
    content = json.dumps(document, ensure_ascii=False).encode()
    if len(content) > MOST_BYTES:
        raise ValueError(f"a document of {len(content)} bytes; the most is {MOST_BYTES}")
    put(spark, path, content)


def latest(spark: SparkSession, root: str) -> int:
    """The number of the last snapshot; 0 without any."""
    where, files = _files(spark, f"{root}/snapshots")
    if not files.exists(where):
        return 0
    return max((int(f.getPath().getName()) for f in files.listStatus(where) if f.getPath().getName().isdigit()), default=0)


def _snapshot(spark: SparkSession, root: str, number: int) -> dict:
    if not number:
        return {"version": None, "schemas": {}}
    rows = spark.read.text(f"{root}/snapshots/{number:020d}", wholetext=True).collect()
    return json.loads(rows[0]["value"])


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], removed: DataFrame | None = None, base: int | None = None) -> int:
    """Replace packages in all tables at once; returns the new snapshot's number.

    ``tables`` hold all rows of their packages; a package that any of them names, or ``removed`` (package_id), loses its old rows
    in every table. The commit builds on snapshot ``base``, the last one unless given, and raises ``Conflict`` if there is
    a later one by the time it is ready."""
    number = latest(spark, root) if base is None else base
    before, version = _snapshot(spark, root, number), uuid.uuid4().hex
    schemas, changed = dict(before["schemas"]), removed.select(F.col(PACKAGE).cast("string")) if removed is not None else None
    for name, rows in tables.items():
        rows = rows.withColumn(PACKAGE, F.col(PACKAGE).cast("string"))
        folder = f"{root}/data/{name}/commit_version={version}"
        rows.repartition(PACKAGE).write.partitionBy(PACKAGE).parquet(folder)
        schema = StructType([f for f in rows.schema.fields if f.name != PACKAGE])
        schemas[name] = json.loads(schema.json())
        own = rows.select(PACKAGE).distinct()
        changed = own if changed is None else changed.unionByName(own)
    changed = changed.distinct()
    held = changed.withColumn("commit_version", F.lit(version))
    if before["version"]:
        kept = spark.read.parquet(f"{root}/manifests/{before['version']}").join(changed, PACKAGE, "left_anti")
        held = held.unionByName(kept)
    held.write.parquet(f"{root}/manifests/{version}")
    try:
        put(spark, f"{root}/snapshots/{number + 1:020d}", json.dumps({"version": version, "schemas": schemas}).encode())
    except FileExistsError:
        raise Conflict(f"snapshot {number + 1} is there already") from None
    return number + 1


def read(spark: SparkSession, root: str, table: str, snapshot: int | None = None) -> DataFrame:
    """A table as of a snapshot, the last one unless given; its manifest tells which folders are read."""
    found = _snapshot(spark, root, latest(spark, root) if snapshot is None else snapshot)
    schema = StructType.fromJson(found["schemas"][table]).add(PACKAGE, "string").add("commit_version", "string")
    manifest = spark.read.schema(f"{PACKAGE} string, commit_version string").parquet(f"{root}/manifests/{found['version']}")
    rows = spark.read.schema(schema).option("basePath", f"{root}/data/{table}").parquet(f"{root}/data/{table}")
    return rows.join(manifest, [PACKAGE, "commit_version"], "left_semi").drop("commit_version")
