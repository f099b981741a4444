"""`spark.read.format("lead_listings")`: listings of one's own adapters as JSON lines, in batches and streams, read and written.

Files are split by byte ranges, so that a large one is many tasks and none holds more than a block and a line of it.  Filters are
tested before rows are made.  A stream takes files in the order of their change times, of which the last is
its offset.  A writer's files get their names when the job commits, so that readers see all of them or none, but for the moment
of naming them.  The path may be of any file system that Arrow opens.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import datasource as D

#: Bytes of a split, and of a read.
SPLIT_BYTES, BLOCK_BYTES = 32_000_000, 1_000_000
#: A stream leaves files alone that changed so many seconds ago or less, as others may still come with the same time.
SETTLED = 1.0


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Split(D.InputPartition):
    """The lines that begin in the bytes [start, end) of a file."""

    path: str
    start: int
    end: int


def _files(path: str) -> list:
    from pyarrow import fs

    system, folder = _open(path)
    return [f for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.type == fs.FileType.File and f.base_name.endswith(".jsonl") and f.base_name[0] not in "._"]


def _splits(files: Iterable, size: int) -> list[Split]:
    return [Split(f.path, at, min(f.size, at + size)) for f in files for at in range(0, f.size, size)]


def lines(path: str, split: Split, block: int = BLOCK_BYTES) -> Iterator[bytes]:
    """The lines of a split; one that begins in it is read to its end, also beyond."""
    with _open(path)[0].open_input_file(split.path) as f:
        at = max(0, split.start - 1)
        f.seek(at)
        skipping, held = split.start > 0, b""
        while True:
            data = f.read(block)
            parts = (held + data).split(b"\n")
            held = parts.pop() if data else b""
            for part in parts:
                if skipping:  # the rest of a line that began before, or nothing if a line begins here
                    skipping = False
                elif at >= split.end:
                    return
                else:
                    yield part
                at += len(part) + 1
            if not data or (at >= split.end and not skipping):
                return


_COMPARE: dict[type, Callable] = {
    D.EqualTo: lambda v, x: v is not None and v == x, D.EqualNullSafe: lambda v, x: v == x,
    D.GreaterThan: lambda v, x: v is not None and v > x, D.GreaterThanOrEqual: lambda v, x: v is not None and v >= x,
    D.LessThan: lambda v, x: v is not None and v < x, D.LessThanOrEqual: lambda v, x: v is not None and v <= x,
    D.In: lambda v, x: v is not None and v in x, D.IsNull: lambda v, _: v is None, D.IsNotNull: lambda v, _: v is not None,
    D.StringStartsWith: lambda v, x: v is not None and v.startswith(x), D.StringEndsWith: lambda v, x: v is not None and v.endswith(x), D.StringContains: lambda v, x: v is not None and x in v,
}


def _test(f: D.Filter) -> Callable[[dict], bool] | None:
    """The filter as a function of a row, None if it is of another kind."""
    if type(f) not in _COMPARE or len(f.attribute) != 1:
        return None
    compare, column, value = _COMPARE[type(f)], f.attribute[0], getattr(f, "value", None)
    return lambda row: compare(row.get(column), value)


class _Rows:
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.source, self.columns = options["path"], options.get("source", "unknown"), columns
        self.size = int(options.get("split_bytes", SPLIT_BYTES))
        self.filters: list[D.Filter] = []

    def read(self, partition: Split | None) -> Iterator[tuple]:
        if partition is None:  # Spark reads once where there are no partitions
            return
        tests = [_test(f) for f in self.filters]
        for line in lines(self.path, partition):
            if line.strip():
                row = json.loads(line) | {"source_adapter": self.source}
                if all(t(row) for t in tests):
                    yield tuple(row.get(c) for c in self.columns)


class Reader(_Rows, D.DataSourceReader):
    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            if _test(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self) -> list[Split]:
        if not all(_test(f)({"source_adapter": self.source}) for f in self.filters if f.attribute == ("source_adapter",)):
            return []
        return _splits(sorted(_files(self.path), key=lambda f: f.path), self.size)


class StreamReader(_Rows, D.DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"changed": 0}

    def latestOffset(self) -> dict:
        settled = time.time_ns() - int(SETTLED * 1e9)
        return {"changed": max([f.mtime_ns for f in _files(self.path) if f.mtime_ns <= settled], default=0)}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return _splits(sorted((f for f in _files(self.path) if start["changed"] < f.mtime_ns <= end["changed"]), key=lambda f: (f.mtime_ns, f.path)), self.size)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(D.WriterCommitMessage):
    passing: str
    rows: int


class Writer(D.DataSourceWriter):
    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.path, self.columns, self.overwrite = options["path"], columns, overwrite

    def write(self, iterator: Iterator) -> Written:
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        passing, n = f"{folder}/_{uuid.uuid4().hex}.jsonl", 0
        with system.open_output_stream(passing) as out:
            for row in iterator:
                out.write(json.dumps({c: v for c, v in zip(self.columns, row, strict=True) if v is not None and c != "source_adapter"}, ensure_ascii=False).encode() + b"\n")
                n += 1
        return Written(passing, n)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _open(self.path)
        old = [f.path for f in _files(self.path)] if self.overwrite else []
        for m in messages:
            if m is not None and m.rows:
                system.move(m.passing, f"{folder}/part-{m.passing.rsplit('/_', 1)[1]}")
            elif m is not None:
                system.delete_file(m.passing)
        for f in old:
            system.delete_file(f)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _open(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.passing)


class RawRecordSource(D.DataSource):
    """JSON-lines files of payload records in the folder `path`; `source` names their adapter, split_bytes the size of a split.

    Fields that a line lacks are null; writing leaves null fields and source_adapter out.
    """

    @classmethod
    def name(cls) -> str:
        return "lead_listings"

    def schema(self) -> str:
        return "source_adapter string, name string, address string, phone string, website string, category string, latitude double, longitude double, rating double, reviews_count int"

    def reader(self, schema) -> Reader:
        return Reader(self.options, [f.name for f in schema])

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options, [f.name for f in schema])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, [f.name for f in schema], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let it take filters, without which Spark refuses a reader that can."""
    spark.dataSource.register(RawRecordSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
