"""A Python data source for fetched bodies: files in a folder, read as a table or as a stream.

A body is a file; what stands in its path as `key=value` says what it is of. A body that can't be read is a row too, with the
reason. The stream's offset is the last file by time of writing and path, so a query that starts again goes on behind the last body
that it took. Folders are read through Arrow's file systems, so any of these will do that executors see, too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "keys map<string, string>, path string, written timestamp, body string, error string"
#: Most bytes of a body; fixed value. Bytes and files that one task reads.
LARGEST, TASK_BYTES, TASK_FILES = 2_000_000, 32_000_000, 500


@dataclass
class Files(InputPartition):
    """Some files, as (path, size)."""

    names: list[tuple[str, int]]


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")


def listed(folder: str) -> list[tuple[int, str, int]]:
    """(time of writing in nanoseconds, path, size) of every body, oldest first. Hidden files are left out."""
    files, root = _opened(folder)
    found = [x for x in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if x.is_file and not x.base_name.startswith(("_", "."))]
    return sorted((x.mtime_ns or 0, x.path, x.size or 0) for x in found)


def dealt(found: list[tuple[int, str, int]]) -> list[Files]:
    out: list[Files] = []
    room = count = 0
    for _, path, size in found:
        if not out or room + size > TASK_BYTES or count == TASK_FILES:
            out.append(Files([]))
            room = count = 0
        out[-1].names.append((path, size))
        room, count = room + size, count + 1
    return out


def bodies(folder: str, names: list[tuple[str, int]]) -> Iterator[tuple]:
    files, _ = _opened(folder)
    for path, size in names:
        keys = {k: unquote(v) for k, _, v in (part.partition("=") for part in path.split("/")) if v}
        written = body = error = None
        try:
            written = files.get_file_info(path).mtime
            if size > LARGEST:
                error = "too large"
            else:
                with files.open_input_stream(path) as stream:
                    body = stream.read().decode("utf-8").removesuffix("\n")
                error = None if body else "empty"
        except UnicodeDecodeError:
            error = "not UTF-8"
        except OSError as problem:
            error = type(problem).__name__
        yield keys, path, written, body if error is None else None, error


class BodyReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Files]:
        return dealt(listed(self.folder)) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return bodies(self.folder, partition.names)


class BodyStream(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"at": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = listed(self.folder)
        return {"at": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        inside = lambda x: (start["at"], start["path"]) < x[:2] <= (end["at"], end["path"])
        return dealt([x for x in listed(self.folder) if inside(x)]) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return bodies(self.folder, partition.names)

    def commit(self, end: dict) -> None:
        """Nothing to free: bodies stay."""


class Bodies(DataSource):
    """format("bodies").option("path", folder)."""

    @classmethod
    def name(cls) -> str:
        return "bodies"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> BodyReader:
        return BodyReader(self.options["path"])

    def streamReader(self, schema: object) -> BodyStream:
        return BodyStream(self.options["path"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(Bodies)
    return spark.read.format("bodies").option("path", folder).load()


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(Bodies)
    return spark.readStream.format("bodies").option("path", folder).load()


def write(rows: DataFrame, folder: str, *keys: str) -> None:
    """Write the `body` of each row as a file of its own, under its keys."""
    rows.select(*keys, "body").write.mode("append").option("maxRecordsPerFile", 1).partitionBy(*keys).text(folder)
