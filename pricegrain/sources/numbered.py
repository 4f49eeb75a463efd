"""A data source for answers that arrive one after another: numbered folders of JSON lines, read as a table or as a stream with offsets."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: A folder of one answer below the path: answer-000012, complete when Spark's _SUCCESS lies in it.
NAME = "answer-{:06d}"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"[a-z0-9]+:", path) else f"file://{path}")


def _answers(path: str) -> dict[int, list[str]]:
    """Number of each complete answer to its files."""
    from pyarrow import fs

    where, root = _open(path)
    found: dict[int, list[str]] = {}
    for info in where.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        hit = re.search(r"/answer-(\d+)/([^/]+)$", info.path)
        if hit and info.type == fs.FileType.File:
            found.setdefault(int(hit[1]), []).append(info.path)
    return {n: sorted(f for f in files if f.endswith(".json")) for n, files in found.items() if any(f.endswith("/_SUCCESS") for f in files)}


def _rows(path: str, file: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Lines that are no JSON object are left out; a field that does not fit its type is an error."""
    where, _ = _open(path)
    with where.open_input_stream(file) as stream:
        lines: list[dict] = []
        for line in _lines(stream):
            lines.append(line)
            if len(lines) == 10_000:
                yield pa.RecordBatch.from_pylist(lines, schema)
                lines = []
        if lines:
            yield pa.RecordBatch.from_pylist(lines, schema)


def _lines(stream) -> Iterator[dict]:
    rest = b""
    while block := stream.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from _objects(whole)
    yield from _objects([rest])


def _objects(lines: list[bytes]) -> Iterator[dict]:
    for line in lines:
        try:
            found = json.loads(line)
        except ValueError:
            continue
        if isinstance(found, dict):
            yield found


class _Reading:
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.ack = schema, options["path"], options.get("ack")

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from _rows(self.path, partition.path, to_arrow_schema(self.schema))

    def files(self, start: int, end: int | None) -> list[_File]:
        return [_File(f) for n, files in sorted(_answers(self.path).items()) if start <= n and (end is None or n < end) for f in files]


class _Table(_Reading, DataSourceReader):
    def partitions(self) -> list[_File]:
        return self.files(0, None) or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from super().read(partition)


class _Stream(_Reading, DataSourceStreamReader):
    """The offset is the number of the next answer to read. Answers count as there when all before them are, so one that is
    late is waited for, not skipped."""

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        there, n = _answers(self.path), 0
        while n in there:
            n += 1
        return {"next": n}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        return self.files(start["next"], end["next"])

    def commit(self, end: dict) -> None:
        """With the option ack: tell the sender, in that file, which answers it need not keep."""
        if self.ack:
            where, file = _open(self.ack)
            with where.open_output_stream(file) as out:
                out.write(json.dumps(end).encode())


class NumberedAnswers(DataSource):
    """Format 'numbered_answers'; options path and ack; the schema is given by the reader's user."""

    @classmethod
    def name(cls) -> str:
        return "numbered_answers"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Table(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NumberedAnswers)
