"""Recorded answers of providers as a data source, ``format("recorded_answers")``.

A folder holds a folder for each provider, and in it files of JSON lines (query, answered_at, body) whose names grow
with time. A batch read has a task for each file; filters on ``provider`` (equal, or one of a list) choose
folders before any file is opened. A stream reads the files that were added, in the order of their
names, and its offset is the last name it has read, by provider.

Register with ``register(spark)``; filters reach the source where
``spark.sql.python.filterPushdown.enabled`` is true. Defined results: lines that aren't JSON objects keep their text as
body, with null query; missing fields are null; empty files and folders give no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "provider string, query string, answered_at bigint, body string"


class _File(InputPartition):
    def __init__(self, provider: str, path: str):
        self.provider, self.path = provider, path


def _listing(folder: str) -> dict[str, list[str]]:
    """Names of files by provider, in order."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    out: dict[str, list[str]] = {}
    for found in system.get_file_info(fs.FileSelector(path, recursive=True)):
        provider, _, name = found.path[len(path) :].strip("/").partition("/")
        if found.type == fs.FileType.File and name and "/" not in name and not name.startswith((".", "_")):
            out.setdefault(provider, []).append(name)
    return {p: sorted(names) for p, names in sorted(out.items())}


def _rows(folder: str, part: _File) -> Iterator[tuple]:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{path}/{part.provider}/{part.path}") as f:
        rest = b""
        while chunk := f.read(1 << 20):
            *lines, rest = (rest + chunk).split(b"\n")
            yield from (_row(part.provider, line) for line in lines if line.strip())
        if rest.strip():
            yield _row(part.provider, rest)


def _row(provider: str, line: bytes) -> tuple:
    text = line.decode("utf-8", "replace")
    try:
        got = json.loads(text)
    except ValueError:
        got = None
    if not isinstance(got, dict):
        return provider, None, None, text
    at, body, asked = got.get("answered_at"), got.get("body"), got.get("query")
    body = body if body is None or isinstance(body, str) else json.dumps(body)
    return provider, asked if isinstance(asked, str) else None, at if isinstance(at, int) and not isinstance(at, bool) else None, body


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.providers = folder, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) and f.attribute == ("provider",) else set(f.value) if isinstance(f, In) and f.attribute == ("provider",) else None
            if wanted is None:
                yield f
            else:
                self.providers = wanted if self.providers is None else self.providers & wanted

    def partitions(self) -> list[InputPartition]:
        found = [_File(p, name) for p, names in _listing(self.folder).items() if self.providers is None or p in self.providers for name in names]
        return found or [_File("", "")]

    def read(self, partition: _File) -> Iterator[tuple]:
        return _rows(self.folder, partition) if partition.path else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {p: names[-1] for p, names in _listing(self.folder).items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_File(p, name) for p, names in _listing(self.folder).items() for name in names if start.get(p, "") < name <= end.get(p, "")]

    def read(self, partition: _File) -> Iterator[tuple]:
        return _rows(self.folder, partition)


class RecordedAnswers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_answers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordedAnswers)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
