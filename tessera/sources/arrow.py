"""A data source of Arrow IPC files: a partition for each record batch, which is read and handed on as Arrow.

    read(spark, ["/data/a.arrow"], "id long, x double")

Only the columns of the schema are read from a file. A stream has no footer and so no places of its batches: it is one
partition, read batch by batch. Paths are local ones or those of stores that pyarrow knows by their scheme."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Batches that a partition takes where a file has very many.
MOST = 4096


class _Batches(InputPartition):
    """Batches first to last of a file; of a stream, all (last is -1)."""

    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pa.memory_map(path)
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _is_file(source) -> bool:
    magic = source.read(6)
    source.seek(0)
    return magic == b"ARROW1"


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], schema: pa.Schema):
        self.paths, self.schema = paths, schema

    def partitions(self):
        out = []
        for path in self.paths:
            with _open(path) as source:
                n = pa.ipc.open_file(source).num_record_batches if _is_file(source) else -1
            step = max(1, -(-n // MOST))
            out += [_Batches(path, -1, -1)] if n < 0 else [_Batches(path, i, min(n, i + step)) for i in range(0, n, step)]
        return out

    def read(self, partition):
        names = self.schema.names
        with _open(partition.path) as source:
            if partition.last < 0:
                batches = iter(pa.ipc.open_stream(source))
            else:
                with pa.ipc.open_file(source) as whole:
                    at = [whole.schema.get_field_index(n) for n in names if n in whole.schema.names]
                reader = pa.ipc.open_file(source, options=pa.ipc.IpcReadOptions(included_fields=sorted(at)))
                batches = (reader.get_batch(i) for i in range(partition.first, partition.last))
            for b in batches:
                columns = [b.column(n).cast(self.schema.field(n).type) if n in b.schema.names else pa.nulls(len(b), self.schema.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


class ArrowFiles(DataSource):
    """format("arrowfiles"), with a schema and the option `paths`, a JSON list."""

    @classmethod
    def name(cls):
        return "arrowfiles"

    def reader(self, schema: StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        return _Reader(json.loads(self.options["paths"]), to_arrow_schema(schema))


def read(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The rows of Arrow files; columns that a file lacks are null; no files, no rows."""
    if not paths:
        return spark.createDataFrame([], schema)
    spark.dataSource.register(ArrowFiles)
    return spark.read.format("arrowfiles").schema(schema).option("paths", json.dumps(paths)).load()
