"""One artifact file an item as a Spark data source: JSON lines, NPZ embeddings and raw zips.

Writing is all or nothing: tasks write drafts into a folder of the job, hash the bytes while they write them, and report what they wrote; the
driver moves the drafts to their places once every task has reported, and deletes the folder otherwise. Attempts that no report
names, of speculative or lost tasks, go with the folder.

Reading lists names on the driver: a filter on the item key leaves only the files of these keys, before any byte is read, and the files
are bundled by their sizes into partitions.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from lectern.errors import InvalidParams
from lectern.sources import artifacts

SUFFIXES = {"chunks": artifacts.CHUNKS, "blocks": artifacts.BLOCKS, "npz": artifacts.EMBEDDINGS, "zip": artifacts.RAW}
LINES = "item_key string, path string, line long, value string"
SCHEMAS = {"chunks": LINES, "blocks": LINES, "npz": "item_key string, " + artifacts.EMBEDDING_ROWS, "zip": "item_key string, " + artifacts.MEMBERS}
#: Bytes and files of a partition when reading.
BUNDLE_BYTES, BUNDLE_FILES = 64 << 20, 1000
WRITTEN = "_written"
DRAFTS = "_drafts_"


@dataclass
class Report(WriterCommitMessage):
    """What a task wrote: item key, name of the draft, bytes, sha256."""

    files: list[tuple[str, str, int, str]] = field(default_factory=list)


class _Draft:
    """A file that is hashed while it is written."""

    def __init__(self, store: pafs.FileSystem, folder: str, key: str):
        self.key, self.name, self.n, self.hash = key, uuid.uuid4().hex, 0, hashlib.sha256()
        self.stream = store.open_output_stream(f"{folder}/{self.name}")

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.hash.update(data)
        self.n += len(data)

    def close(self) -> tuple[str, str, int, str]:
        self.stream.close()
        return self.key, self.name, self.n, self.hash.hexdigest()


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Slices of rows with one item key (the first column)."""
    keys = batch.column(0).to_pylist()
    at = 0
    while at < len(keys):
        end = at + 1
        while end < len(keys) and keys[end] == keys[at]:
            end += 1
        yield keys[at], batch.slice(at, end - at)
        at = end


class ItemWriter(DataSourceArrowWriter):
    def __init__(self, path: str, kind: str):
        self.path, self.kind, self.drafts = path.rstrip("/"), kind, f"{DRAFTS}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Report:
        store, folder = artifacts.file_system(f"{self.path}/{self.drafts}")
        store.create_dir(folder, recursive=True)
        report = Report()
        for key, make in (self._zips if self.kind == "zip" else self._npz if self.kind == "npz" else self._lines)(iterator):
            if make is None:
                report.files.append(draft.close())
                continue
            if key is not None:
                draft = _Draft(store, folder, key)
            draft.write(make)
        return report

    # Each yields (key, bytes) for the first bytes of a file, (None, bytes) for more of it, and (None, None) at its end.

    def _lines(self, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str | None, bytes | None]]:
        now = None
        for batch in batches:
            for key, own in _runs(batch):
                if now is not None and key != now:
                    yield None, None
                data = "".join(f"{x}\n" for x in own.column(1).to_pylist()).encode()
                yield (key if key != now else None), data
                now = key
        if now is not None:
            yield None, None

    def _npz(self, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str | None, bytes | None]]:
        now, vectors, meta, models = None, [], [], set()

        def whole() -> bytes:
            if len(models) != 1 or None in models:
                raise InvalidParams(f"{now}: vectors need one model")
            return artifacts.npz_bytes(np.concatenate(vectors), meta, model=next(iter(models)))

        for batch in batches:
            for key, own in _runs(batch):
                if now is not None and key != now:
                    yield now, whole()
                    yield None, None
                    vectors, meta, models = [], [], set()
                now = key
                flat = own.column(3)
                vectors.append(flat.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(own.num_rows, -1))
                meta += [{"chunk_id": c, "text_sha256": s} for c, s in zip(own.column(1).to_pylist(), own.column(2).to_pylist())]
                models.update(own.column(4).to_pylist())
        if now is not None:
            yield now, whole()
            yield None, None

    def _zips(self, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str | None, bytes | None]]:
        for batch in batches:
            for row in range(batch.num_rows):
                key, provider, payload, files = (c[row].as_py() for c in batch.columns)
                yield key, artifacts.raw_zip({"id": provider}, json.loads(payload), dict(files or []), {"item_key": key})
                yield None, None

    def commit(self, messages: list[Report | None]) -> None:
        store, folder = artifacts.file_system(self.path)
        rows = []
        for key, name, n, digest in (f for m in messages if m for f in m.files):
            leaf = artifacts.file_key(key) + SUFFIXES[self.kind]
            store.move(f"{folder}/{self.drafts}/{name}", f"{folder}/{leaf}")
            rows.append({"item_key": key, "path": f"{self.path}/{leaf}", "n_bytes": n, "sha256": digest})
        self._clear()
        store.create_dir(f"{folder}/{WRITTEN}", recursive=True)
        with store.open_output_stream(f"{folder}/{WRITTEN}/{self.drafts.removeprefix(DRAFTS)}.jsonl") as out:
            out.write("".join(json.dumps(r) + "\n" for r in rows).encode())

    def abort(self, messages: list[Report | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, folder = artifacts.file_system(f"{self.path}/{self.drafts}")
        if store.get_file_info(folder).type == pafs.FileType.Directory:
            store.delete_dir(folder)


@dataclass
class Bundle(InputPartition):
    """Files of a partition: item key and path."""

    files: list[tuple[str, str]]

    def __init__(self, files: list[tuple[str, str]]):
        super().__init__(files)
        self.files = files


class ItemReader(DataSourceReader):
    def __init__(self, path: str, kind: str):
        self.path, self.kind = path.rstrip("/"), kind
        self.keys: set[str] | None = None

    def pushFilters(self, filters: Sequence[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Equality and lists of item keys are taken; Spark applies the others."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("item_key",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.keys = wanted if self.keys is None else self.keys & wanted
            else:
                yield f

    def partitions(self) -> list[Bundle]:
        store, folder = artifacts.file_system(self.path)
        suffix = SUFFIXES[self.kind]
        # a key that a name can't hold has another name: its file is known by the key asked for
        named = None if self.keys is None else {artifacts.file_key(k): k for k in self.keys}
        out, size = [[]], 0
        for info in sorted(store.get_file_info(pafs.FileSelector(folder)), key=lambda i: i.base_name):
            if info.type != pafs.FileType.File or not info.base_name.endswith(suffix) or info.base_name.startswith((".", "_")):
                continue
            name = info.base_name.removesuffix(suffix)
            if named is not None and name not in named:
                continue
            if out[-1] and (size + info.size > BUNDLE_BYTES or len(out[-1]) >= BUNDLE_FILES):
                out.append([])
                size = 0
            out[-1].append((name if named is None else named[name], info.path))
            size += info.size
        return [Bundle(files) for files in out]

    def read(self, partition: Bundle) -> Iterator[pa.RecordBatch]:
        store, _ = artifacts.file_system(self.path)
        for key, path in partition.files:
            with store.open_input_file(path) as f:
                data = f.read()
            yield from {"npz": _vectors, "zip": _members}.get(self.kind, _lines_of)(key, path, data)


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def _lines_of(key: str, path: str, data: bytes) -> Iterator[pa.RecordBatch]:
    lines = [x for x in enumerate(data.decode().split("\n"), 1) if x[1].strip()]
    for at in range(0, len(lines), 10_000):
        yield _batch([(key, path, n, x) for n, x in lines[at : at + 10_000]], [pa.string(), pa.string(), pa.int64(), pa.string()], ["item_key", "path", "line", "value"])


def _vectors(key: str, path: str, data: bytes) -> Iterator[pa.RecordBatch]:
    batch = artifacts.npz_rows(path, io.BytesIO(data))
    yield pa.RecordBatch.from_arrays([pa.array([key] * batch.num_rows, pa.string()), *batch.columns], names=["item_key", *batch.schema.names])


def _members(key: str, path: str, data: bytes) -> Iterator[pa.RecordBatch]:
    batch = artifacts.zip_rows(path, io.BytesIO(data))
    yield pa.RecordBatch.from_arrays([pa.array([key] * batch.num_rows, pa.string()), *batch.columns], names=["item_key", *batch.schema.names])


class ItemFiles(DataSource):
    """Options: path, and kind: chunks, blocks, npz or zip."""

    @classmethod
    def name(cls) -> str:
        return "lectern_items"

    def _kind(self) -> str:
        kind = self.options.get("kind", "")
        if kind not in SUFFIXES or not self.options.get("path"):
            raise InvalidParams(f"item files need a path and a kind of: {', '.join(SUFFIXES)}")
        return kind

    def schema(self) -> str:
        return SCHEMAS[self._kind()]

    def reader(self, schema: StructType) -> ItemReader:
        return ItemReader(self.options["path"], self._kind())

    def writer(self, schema: StructType, overwrite: bool) -> ItemWriter:
        return ItemWriter(self.options["path"], self._kind())


def _ready(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(ItemFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read_items(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of all item files of a kind below path; a filter on item_key opens the files of these items only."""
    return _ready(spark).read.format("lectern_items").option("kind", kind).load(path)


def read_item_rows(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """item_key and the fields of schema, of chunks or blocks; a line that isn't JSON fails the read."""
    lines = read_items(spark, path, kind)
    row = F.from_json("value", schema, {"mode": "FAILFAST"})
    return lines.select("item_key", row.alias("row")).select("item_key", "row.*")


def write_items(rows: DataFrame, path: str, kind: str) -> DataFrame:
    """Write a file for each item of rows, all or none; item_key, path, n_bytes and sha256 of all files written below path so far.

    chunks and blocks: item_key, ordinal and other columns, which become JSON with sorted names. npz: item_key, ordinal, chunk_id, text_sha256,
    vector, model. zip: item_key, provider, payload, files, a row a file. An item's rows meet in one task, in order.
    """
    spark = _ready(rows.sparkSession)
    if kind == "zip":
        files = F.col("files") if "files" in rows.columns else F.lit(None).cast("map<string, binary>")
        own = rows.select("item_key", "provider", "payload", files.alias("files"))
    else:
        if kind == "npz":
            own = rows.select("item_key", "chunk_id", "text_sha256", "vector", "model", "ordinal")
        else:
            own = rows.select("item_key", F.to_json(F.struct(*[c for c in sorted(rows.columns)])).alias("line"), "ordinal")
        own = own.repartition("item_key").sortWithinPartitions("item_key", "ordinal").drop("ordinal")
    own.write.format("lectern_items").option("kind", kind).mode("append").save(path)
    return spark.read.schema("item_key string, path string, n_bytes long, sha256 string").json(f"{path.rstrip('/')}/{WRITTEN}")
