"""Scans of program packages and their summaries."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from traceloom.functions.ids import stable_id
from traceloom.sources.tables import MOST_BYTES

#: Folders that hold no packages of their own.
SKIPPED = ("build", "node_modules", "target", ".git", "dependencies")

#: A module summary; keys that newer files name otherwise are read by both names.
SUMMARY = (
    "id struct<address:string,name:string>, immediate_dependencies array<struct<address:string,name:string>>, "
    "functions map<string,string>, structs map<string,string>, enums map<string,string>, docs string, _malformed string"
)


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """(path, name): package manifests below a folder, in order, without those in skipped folders."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "Move.toml").load(root)
    parts = F.split("path", "/")
    found = found.where(~F.arrays_overlap(parts, F.array(*(F.lit(s) for s in SKIPPED))))
    return found.select("path", F.regexp_extract(F.decode("content", "UTF-8"), r'(?m)^name\s*=\s*"([^"]*)"', 1).alias("name")).orderBy("path")


def source_files(spark: SparkSession, root: str, glob: str = "*.move") -> DataFrame:
    """(path, text): whole source files."""
    found = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def summaries(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Module summaries, and a warning for each file that can't be read; the others are read all the same."""
    read = spark.read.schema(SUMMARY).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_malformed").option("multiLine", True)
    rows = read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root).withColumn("path", F.col("_metadata.file_path"))
    broken = F.col("_malformed").isNotNull() | F.col("id.name").isNull()
    warnings = rows.where(broken).select(
        stable_id("diagnostic", "path").alias("id"), F.lit("Warning").alias("severity"), F.lit("summary").alias("source"), F.concat(F.lit("malformed summary: "), "path").alias("message")
    )
    return rows.where(~broken).drop("_malformed"), warnings


def functions_of(modules: DataFrame) -> DataFrame:
    """One row per function of the summaries, with aliases of keys resolved and defaults filled in."""
    rows = modules.select(F.col("id.address").alias("address"), F.col("id.name").alias("module"), F.explode("functions").alias("name", "body"))
    get = lambda *keys: F.coalesce(*(F.get_json_object("body", f"$.{key}") for key in keys))
    flag = lambda *keys: F.coalesce(get(*keys) == "true", F.lit(False))
    return rows.select(
        "address", "module", "name", stable_id("function", "address", "module", "name").alias("id"), F.coalesce(get("visibility"), F.lit("Private")).alias("visibility"),
        flag("entry").alias("is_entry"), flag("is_native", "native").alias("is_native"), get("docs", "doc").alias("docs"),
    )


def dependency_counts(modules: DataFrame) -> DataFrame:
    """(src, dst, n): module dependencies between packages; those within one package don't count."""
    edges = modules.select(F.col("id.address").alias("src"), F.explode("immediate_dependencies").alias("d")).select("src", F.col("d.address").alias("dst"))
    return edges.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def directory_hash(spark: SparkSession, root: str) -> DataFrame:
    """One row: the hash over all files' relative paths and hashes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").rsplit("/", 1)[-1] + "/"
    relative = F.substring_index("path", base, -1)
    line = F.concat(relative, F.lit("\x00"), F.sha2("content", 256), F.lit("\n"))
    return files.select(line.alias("line")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), ""), 256).alias("hash"))


def bytecode_files(spark: SparkSession, roots: Sequence[str], glob: str = "*.mv") -> DataFrame:
    """(path, length, content): compiled modules of packages, each once and in order of path.

    A root that is itself named ``bytecode_modules`` counts whole, of others ``bytecode_modules`` and
    ``build/*/bytecode_modules``; nothing below a folder named ``dependencies``. A file that several roots reach comes with the
    first of them, which its path alone decides: contents are not compared or shuffled for it."""
    found, earlier = None, F.lit(False)
    for root in dict.fromkeys(r.rstrip("/") for r in roots):
        base = re.sub(r"^\w+:/*(?=/)", "", root) + "/"
        whole = base.endswith("/bytecode_modules/")
        own = F.locate(base, F.col("path")) > 0
        below = F.substr("path", F.locate(base, F.col("path")) + len(base))
        own = own & (F.lit(whole) | below.rlike("^(build/[^/]+/)?bytecode_modules/"))
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
        rows = rows.where(own & ~earlier & ~F.array_contains(F.split("path", "/"), "dependencies")).select("path", "length", "content")
        found, earlier = rows if found is None else found.unionByName(rows), earlier | own
    return found.orderBy("path")


def read_artifact(spark: SparkSession, root: str, reference: str) -> DataFrame:
    """(path, length, content): one stored document of up to MOST_BYTES; no row where it is missing from its folder or larger.

    The reference is a relative path of plain names. Anything that could lead out of the root is refused before reading."""
    parts = reference.split("/")
    if not reference or any(part in ("", ".", "..") or re.search(r"[\\*?\[\]{}:]", part) for part in parts):
        raise ValueError(f"not a path within the store: {reference!r}")
    folder = "/".join([root.rstrip("/"), *parts[:-1]])
    rows = spark.read.format("binaryFile").option("pathGlobFilter", parts[-1]).load(folder)
    return rows.where(F.col("length") <= MOST_BYTES).select("path", "length", "content")
