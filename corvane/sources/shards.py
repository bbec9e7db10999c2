"""Shards of a candidate pool as a Spark data source: one file, one partition; checks happen where lines are read.

    spark.dataSource.register(ShardSource)
    rows.repartition(8, "problem_id").write.format("pool_shards").option("path", p).option("shards", 8).mode("append").save()
    spark.read.format("pool_shards").schema(s).option("path", p).load()

A shard is a text file <stem>_shardKKKKKofNNNNN.jsonl. Its first line is a manifest: shard, of, num_rows, identity
and complete; each further line is a row. A set is whole when there is one file for every shard of one N. Anything
else is an error that names the file, and the line if there is one.
"""

from __future__ import annotations

import datetime
import decimal
import json
import re
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, DataType, DateType, DecimalType, StructType, TimestampNTZType, TimestampType, _infer_type

NAME = re.compile(r"(.+)_shard(\d{5})of(\d{5})\.jsonl$")


class ShardError(ValueError):
    """A shard, or a set of them, that isn't what its manifest or name says."""


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _value(v, kind: DataType):
    """A JSON value as Spark's type has it in Python."""
    if v is None:
        return None
    if isinstance(kind, DecimalType):
        return decimal.Decimal(str(v))
    if isinstance(kind, DateType):
        return datetime.date.fromisoformat(v)
    if isinstance(kind, TimestampType | TimestampNTZType):
        return datetime.datetime.fromisoformat(v)
    if isinstance(kind, StructType):
        return tuple(_value(v.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return [_value(x, kind.elementType) for x in v]
    same = _infer_type(v).typeName()
    wanted = kind.typeName()
    if same != wanted and not (same == "long" and wanted in ("integer", "short", "byte", "double", "float")) and not (same == "double" and wanted == "float"):
        raise TypeError(f"{same} in place of {wanted}")
    return float(v) if wanted in ("double", "float") else v


class ShardReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.schema = options["path"].rstrip("/"), schema
        self.missing, self.identity = options.get("missing", "error"), options.get("identity")
        if self.missing not in ("error", "skip"):
            raise ShardError("missing is error or skip")

    def partitions(self) -> list[InputPartition]:
        """One per shard. With missing=skip a set may lack shards, and unfinished ones are left out; else both are errors."""
        fs, root = _opened(self.path)
        found = [(m, f.path) for f in fs.get_file_info(pafs.FileSelector(root)) if (m := NAME.match(f.base_name))]
        if not found:
            raise ShardError(f"no shards under {self.path}")
        if len(sets := {(m[1], m[3]) for m, _ in found}) > 1:
            raise ShardError(f"shards of different sets under {self.path}: {sorted(sets)}")
        n = int(found[0][0][3])
        have = {int(m[2]) for m, _ in found}
        if over := sorted(k for k in have if k >= n):
            raise ShardError(f"shards {over} of {n} under {self.path}")
        if self.missing == "error" and len(have) < n:
            raise ShardError(f"shards {sorted(set(range(n)) - have)} of {n} are missing under {self.path}")
        return [InputPartition(path) for _, path in sorted(found, key=lambda x: int(x[0][2]))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path = partition.value
        fs, _ = _opened(self.path)
        name = NAME.search(path)
        with fs.open_input_stream(path) as raw:
            lines = _lines(raw)
            try:
                said = json.loads(next(lines, b""))
                shard, of, size, identity, complete = (said[k] for k in ("shard", "of", "num_rows", "identity", "complete"))
            except (ValueError, KeyError, TypeError) as e:
                raise ShardError(f"{path}:1: no manifest") from e
            if (shard, of) != (int(name[2]), int(name[3])):
                raise ShardError(f"{path}:1: the manifest is of shard {shard} of {of}")
            if self.identity is not None and identity != self.identity:
                raise ShardError(f"{path}:1: identity {identity}, not {self.identity}")
            if not complete:
                if self.missing == "skip":
                    return
                raise ShardError(f"{path}:1: the shard isn't complete")
            n = 0
            for k, line in enumerate(lines, 2):
                try:
                    row = json.loads(line)
                    made = tuple(_value(row[f.name] if not f.nullable else row.get(f.name), f.dataType) for f in self.schema.fields)
                except (ValueError, KeyError, TypeError, AttributeError, decimal.InvalidOperation) as e:
                    raise ShardError(f"{path}:{k}: {type(e).__name__}: {e}") from e
                n += 1
                yield made
            if n != size:
                raise ShardError(f"{path}:{n + 1}: {n} rows, the manifest says {size}")


def _lines(raw) -> Iterator[bytes]:
    """The lines of a stream, whatever their length, read a megabyte at a time."""
    rest = b""
    while block := raw.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest


class _Written(WriterCommitMessage):
    def __init__(self, beside: str, target: str) -> None:
        self.beside, self.target = beside, target


class ShardWriter(DataSourceWriter):
    """A task's rows become the shard of its partition's number; files get their names when all tasks are done."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.n, self.stem, self.identity = int(options["shards"]), options.get("stem", "pool"), options.get("identity", "")
        self.names = schema.names

    def write(self, iterator) -> WriterCommitMessage:
        task = TaskContext.get()
        shard = task.partitionId()
        if shard >= self.n:
            raise ShardError(f"partition {shard} of a set of {self.n} shards")
        fs, root = _opened(self.path)
        fs.create_dir(root, recursive=True)
        target = f"{root}/{self.stem}_shard{shard:05d}of{self.n:05d}.jsonl"
        body, beside = f"{root}/_{shard}-{task.taskAttemptId()}.rows", f"{root}/_{shard}-{task.taskAttemptId()}.shard"
        n = 0
        # The manifest tells the number of rows, so rows go to a file of their own first.
        with fs.open_output_stream(body) as out:
            for row in iterator:
                out.write(json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False).encode() + b"\n")
                n += 1
        with fs.open_output_stream(beside) as out, fs.open_input_stream(body) as rows:
            out.write(json.dumps({"shard": shard, "of": self.n, "num_rows": n, "identity": self.identity, "complete": True}).encode() + b"\n")
            while block := rows.read(1 << 20):
                out.write(block)
        fs.delete_file(body)
        return _Written(beside, target)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _opened(self.path)
        made = {m.target for m in messages if m}
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if NAME.match(f.base_name)]
        if old and not self.overwrite:
            self.abort(messages)
            raise ShardError(f"there are shards under {self.path}")
        for m in messages:
            fs.move(m.beside, m.target)
        for path in set(old) - made:
            fs.delete_file(path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _ = _opened(self.path)
        for m in messages:
            if m and fs.get_file_info(m.beside).type != pafs.FileType.NotFound:
                fs.delete_file(m.beside)


class ShardSource(DataSource):
    """Options: path; when read: identity (another one is an error), missing (error, or skip); when written: shards, stem, identity."""

    @classmethod
    def name(cls) -> str:
        return "pool_shards"

    def schema(self) -> StructType:
        raise ShardError("name the rows' schema: spark.read.format('pool_shards').schema(...)")

    def reader(self, schema: StructType) -> DataSourceReader:
        return ShardReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ShardWriter(dict(self.options), schema, overwrite)
