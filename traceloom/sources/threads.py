"""Thread logs by source kind: a data source that takes the filters its folders can answer and leaves the others to Spark."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

# Kinds that a request may name and the sources that they mean; a source's name may have more after a colon.
INTERACTIVE = {"cli": "cli", "vscode": "vscode"}
OTHERS = {"exec": "exec", "appServer": "mcp", "subAgentReview": "subagent:review", "subAgentCompact": "subagent:compact", "unknown": "unknown"}
PREFIXES = {"subAgent": "subagent:", "subAgentThreadSpawn": "subagent:thread_spawn", "subAgentOther": "subagent:other"}
SCHEMA = "thread long, turn long, role string, text string, source string"


def source_filter(kinds: Sequence[str] | None, source: str = "source") -> Column:
    """Which sources a request means: those of interactive sessions if it names none. Interactive kinds alone give a filter on
    equal values, which a source can take; a request with another kind is filtered row by row."""
    if not kinds:
        return F.col(source).isin(*INTERACTIVE.values())
    if all(kind in INTERACTIVE for kind in kinds):
        return F.col(source).isin(*(INTERACTIVE[kind] for kind in kinds))
    exact = [(INTERACTIVE | OTHERS)[kind] for kind in kinds if kind not in PREFIXES]
    found = F.lower(source).isin(*exact)
    for kind in kinds:
        if kind in PREFIXES:
            found = found | F.startswith(F.lower(source), F.lit(PREFIXES[kind]))
    return found


class LogFile(InputPartition):
    def __init__(self, path: str, source: str):
        self.path, self.source = path, source


class ThreadReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.wanted = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality of the source, and a list of sources, choose folders, and none is null; what else there is goes back."""
        for given in filters:
            values = given.value if isinstance(given, In) else (given.value,) if isinstance(given, EqualTo) else None
            if values is not None and given.attribute == ("source",):
                self.wanted = set(values) if self.wanted is None else self.wanted & set(values)
            elif not (isinstance(given, IsNotNull) and given.attribute == ("source",)):
                yield given

    def partitions(self) -> Sequence[InputPartition]:
        from urllib.parse import unquote

        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.path)
        found = []
        for entry in files.get_file_info(fs.FileSelector(root, recursive=True)):
            folder = entry.path.rsplit("/", 2)[-2]
            if entry.is_file and entry.base_name.endswith(".json") and folder.startswith("source="):
                source = unquote(folder.removeprefix("source="))
                if self.wanted is None or source in self.wanted:
                    found.append(LogFile(entry.path, source))
        return found

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(self.path)
        if partition is None or not isinstance(partition, LogFile):
            return
        with files.open_input_stream(partition.path) as stream:
            rest = b""
            while block := stream.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                yield from (_row(line, partition.source) for line in lines if line)
            if rest:
                yield _row(rest, partition.source)


def _row(line: bytes, source: str) -> tuple:
    given = json.loads(line)
    return given.get("thread"), given.get("turn"), given.get("role"), given.get("text"), source


class ThreadLogs(DataSource):
    """``spark.read.format("thread_logs").option("path", uri)``: JSON lines below ``source=<name>`` folders."""

    @classmethod
    def name(cls) -> str:
        return "thread_logs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ThreadReader(self.options["path"])


def thread_logs(spark: SparkSession, path: str, kinds: Sequence[str] | None) -> DataFrame:
    """Logs below a URI or an absolute path whose sources a request means.

    Spark keeps one plan of reading for a loaded frame, so each request loads its own; filters reach Python sources only where
    Spark is told so."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ThreadLogs)
    uri = path if "://" in path else f"file://{path.removeprefix('file:')}"
    return spark.read.format("thread_logs").option("path", uri).load().where(source_filter(kinds))
