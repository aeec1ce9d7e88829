"""Stores of named arrays, a compressed file for each key, as a Spark data source.

    spark.dataSource.register(ArrayStore)
    spark.read.format("arrays").schema("key string, en_f0 array<double>").load("/shared/contours")
    df.write.format("arrays").mode("append").save("/shared/contours")

The schema says what is read: only the named arrays of a file are opened. A folder of files is dealt to partitions of a few
files each. What a task writes has a temporary name until the whole job commits; a job that fails leaves nothing behind, and
no file is ever half written. The folder must be one that the driver and all executors see as a plain path.

Layouts: `keyed`, one row a file with its `key`; `rows`, where every array of a file has one entry a row (two-dimensional ones
give a row an array).
"""

from __future__ import annotations

import os
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

SUFFIX, FILES = ".npz", 16
#: Rows of a batch of the layout `rows`.
BATCH = 1_000


def _folder(options: dict[str, str]) -> str:
    url = urlparse(options["path"])
    if url.scheme not in ("", "file"):
        raise ValueError("an array store is a folder that all executors see as a plain path")
    return url.path


def file_of(folder: str, key: str) -> str:
    return os.path.join(folder, quote(key, safe="") + SUFFIX)


def key_of(path: str) -> str:
    return unquote(os.path.basename(path)[: -len(SUFFIX)])


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class ArrayReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.folder = schema, _folder(options)
        self.rows, self.each = options.get("layout", "keyed") == "rows", int(options.get("files", FILES))

    def partitions(self) -> list[Files]:
        found = sorted(os.path.join(self.folder, f) for f in os.listdir(self.folder) if f.endswith(SUFFIX))
        return [Files(found[i : i + self.each]) for i in range(0, len(found), self.each)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        for path in partition.paths:
            with zipfile.ZipFile(path) as store:
                there = set(store.namelist())
                arrays: dict[str, np.ndarray | None] = {}
                for name in self.schema.names:
                    if not (name == "key" and not self.rows):
                        arrays[name] = _array(store, name) if f"{name}.npy" in there else None
            if not self.rows:
                values = [[key_of(path) if f.name == "key" else _value(arrays[f.name])] for f in self.schema.fields]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)
                continue
            n = {len(a) for a in arrays.values() if a is not None}
            if len(n) > 1:
                raise ValueError(f"arrays of {path} differ in length")
            for low in range(0, max(n, default=0), BATCH):
                cut = [None if arrays[f.name] is None else arrays[f.name][low : low + BATCH] for f in self.schema.fields]
                size = max(len(c) for c in cut if c is not None)
                yield pa.RecordBatch.from_arrays([pa.array([None] * size if c is None else c.tolist(), f.type) for c, f in zip(cut, schema, strict=True)], schema=schema)


def _array(store: zipfile.ZipFile, name: str) -> np.ndarray:
    with store.open(f"{name}.npy") as f:
        return np.lib.format.read_array(f, allow_pickle=False)


def _value(a: np.ndarray | None):
    return None if a is None else a.tolist()


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class ArrayWriter(DataSourceArrowWriter):
    """One file a row; nulls are left out of it."""

    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool):
        if "key" not in schema.names:
            raise ValueError("rows of an array store have a key")
        self.schema, self.folder, self.overwrite = schema, _folder(options), overwrite
        self.staging = os.path.join(self.folder, f"_staging-{uuid.uuid4().hex}")
        os.makedirs(self.staging, exist_ok=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        out = []
        for batch in iterator:
            for row in batch.to_pylist():
                if row["key"] is None:
                    raise ValueError("a row lacks its key")
                arrays = {}
                for field in self.schema.fields:
                    v = row[field.name]
                    if field.name != "key" and v is not None:
                        arrays[field.name] = np.array(v, _kind(field.dataType))
                held = os.path.join(self.staging, uuid.uuid4().hex)
                with open(held, "wb") as f:
                    np.savez_compressed(f, **arrays)
                out.append((held, file_of(self.folder, row["key"])))
        return Written(out)

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        if len({final for _, final in files}) < len(files):
            self.abort(messages)
            raise ValueError("a key stands in several rows")
        for held, final in files:
            os.replace(held, final)
        if self.overwrite:
            kept = {final for _, final in files}
            for name in os.listdir(self.folder):
                if name.endswith(SUFFIX) and os.path.join(self.folder, name) not in kept:
                    os.remove(os.path.join(self.folder, name))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        if os.path.isdir(self.staging):
            for name in os.listdir(self.staging):
                os.remove(os.path.join(self.staging, name))
            os.rmdir(self.staging)


def _kind(t) -> str | None:
    base = t.elementType if isinstance(t, ArrayType) else t
    return {"double": "f8", "float": "f4", "long": "i8", "integer": "i4", "short": "i2", "boolean": "?", "string": None}.get(base.typeName(), "f8")


class ArrayStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        raise ValueError("say by .schema(...) which arrays to read, and their types")

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(schema, self.options, overwrite)
