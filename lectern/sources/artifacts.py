"""Artifact files: JSONL of blocks and chunks, zip of raw provider payloads, NPZ of embeddings.

Spark lists and reads the files (`binaryFile`, `json`); members are parsed in Arrow batches. NPZ files are read without pickle.
Zip and NPZ files are written by the tasks that hold their items: a file is made under a name of its own attempt and then
moved to its place, so a repeated task leaves the same files.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.errors import InvalidParams
from lectern.functions.text import safe_key
from lectern.schemas import BLOCK, CHUNK

CHUNKS, BLOCKS, EMBEDDINGS, RAW = ".chunks.jsonl", ".blocks.jsonl", ".embeddings.npz", ".raw.zip"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are skipped; a line that isn't JSON fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_with_errors(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows as struct `row`, with `line` (the text) where it can't be parsed."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.withColumn("row", F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    return parsed.select("row", F.when(F.col("row._bad").isNotNull(), F.col("value")).alias("line"))


def read_jsonl_located(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """path, line (counted over lines that aren't blank, from 1), row, error: for a line that can't be parsed row is null and error is its text.

    Files are read whole, as their lines must be numbered: artifacts hold one item each.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    each = files.select("path", F.posexplode(lines).alias("line", "text"))
    parsed = each.withColumn("row", F.from_json("text", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    bad = F.col("row._bad").isNotNull()
    row = F.struct(*[F.col(f"row.`{f.name}`") for f in T.StructType.fromDDL(schema)])
    return parsed.select("path", (F.col("line") + 1).alias("line"), F.when(~bad, row).alias("row"), F.when(bad, F.col("text")).alias("error"))


def require_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows; the first line that can't be parsed is an error that names file and line."""
    found = read_jsonl_located(spark, path, schema)
    bad = found.where("error IS NOT NULL").orderBy("path", "line").first()
    if bad:
        raise InvalidParams(f"{bad['path']}, line {bad['line']}: {bad['error']}")
    return found.select("row.*")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, CHUNK)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, BLOCK)


def write_jsonl(df: DataFrame, path: str, by_item: bool = False) -> DataFrame:
    """JSON lines with sorted keys; by_item partitions by the file-safe item key, each item in one file. Returns path and sha256 of the files."""
    df = df.select(*sorted(df.columns))
    if by_item:
        own = df.withColumn("item", safe_key(F.col("item_key")))
        own.repartition("item").write.partitionBy("item").mode("overwrite").json(path)
    else:
        df.write.mode("overwrite").json(path)
    return file_digests(df.sparkSession, path, by_item)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path inside it, for a local path or any URI that Arrow opens."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def put_file(folder: str, name: str, data: bytes) -> str:
    """Write a file whole or not at all: under a name of its own, then moved to its place."""
    store, path = file_system(folder.rstrip("/"))
    store.create_dir(path, recursive=True)
    draft = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(data)
    store.move(draft, f"{path}/{name}")
    return f"{folder.rstrip('/')}/{name}"


WRITTEN = "item_key string, path string, n_bytes long"


def _written(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["item_key", "path", "n_bytes"])


def file_key(item_key: str) -> str:
    return item_key.replace("/", "_").replace("\\", "_")


def write_npz(rows: DataFrame, folder: str) -> DataFrame:
    """An NPZ file for each item of rows (item_key, ordinal, chunk_id, text_sha256, vector, model): item_key, path, n_bytes.

    An item's vectors meet in one task, sorted, and a task holds one item at a time.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(own: list[dict]) -> tuple:
            models = {r["model"] for r in own}
            if len(models) > 1 or None in models:
                raise InvalidParams(f"{own[0]['item_key']}: vectors need one model")
            meta = [{"chunk_id": r["chunk_id"], "text_sha256": r["text_sha256"]} for r in own]
            data = npz_bytes(np.array([r["vector"] for r in own], np.float32), meta, model=models.pop())
            key = own[0]["item_key"]
            return key, put_file(folder, file_key(key) + EMBEDDINGS, data), len(data)

        own: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if own and own[0]["item_key"] != row["item_key"]:
                    out.append(done(own))
                    own = []
                own.append(row)
            yield _written(out)
        if own:
            yield _written([done(own)])

    wanted = rows.select("item_key", "ordinal", "chunk_id", "text_sha256", "vector", "model")
    return wanted.repartition("item_key").sortWithinPartitions("item_key", "ordinal").mapInArrow(run, WRITTEN)


def write_raw_zips(rows: DataFrame, folder: str) -> DataFrame:
    """A zip for each row (item_key, provider, payload as JSON, files as a map of names to bytes): item_key, path, n_bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                key, provider, payload, files = (c[row].as_py() for c in batch.columns)
                data = raw_zip({"id": provider}, json.loads(payload), dict(files or []), {"item_key": key})
                out.append((key, put_file(folder, file_key(key) + RAW, data), len(data)))
            yield _written(out)

    files = F.col("files") if "files" in rows.columns else F.lit(None).cast("map<string, binary>")
    return rows.select("item_key", "provider", "payload", files.alias("files")).mapInArrow(run, WRITTEN)


def file_digests(spark: SparkSession, path: str, nested: bool = False) -> DataFrame:
    """path, sha256 of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(nested).lower()).load(path).select("path", F.sha2("content", 256).alias("sha256"))


def item_keys(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """item_key of artifact files, ascending, from names only: contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return files.select(F.substring("name", 1, F.length("name") - len(suffix)).alias("item_key")).orderBy("item_key")


def discover(attachments: DataFrame, suffix: str) -> DataFrame:
    """The first attachment of each parent whose title ends in suffix: parent_key, key."""
    own = attachments.where(F.endswith("title", F.lit(suffix)))
    return own.groupBy("parent_key").agg(F.min("key").alias("key"))


def _safe_member(name: str) -> str:
    if name.startswith(("/", "\\")) or ".." in name.replace("\\", "/").split("/") or ":" in name:
        raise InvalidParams(f"unsafe member name: {name}")
    return name


def raw_zip(provider: dict, payload, files: dict[str, bytes] | None = None, manifest: dict | None = None) -> bytes:
    """A zip with manifest.json, provider.json, provider_raw.json and files, members in name order and without times."""
    members = {"manifest.json": json.dumps(manifest or {}, sort_keys=True).encode(), "provider.json": json.dumps(provider, sort_keys=True).encode(), "provider_raw.json": json.dumps(payload, sort_keys=True, ensure_ascii=False).encode()}
    members |= {f"files/{_safe_member(n)}": b for n, b in (files or {}).items()}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(members):
            z.writestr(zipfile.ZipInfo(name), members[name])
    return out.getvalue()


MEMBERS = "path string, member string, kind string, text string, data binary"


def zip_rows(path: str, file) -> pa.RecordBatch:
    """One row a member of a zip: kind json or text (in `text`) or binary (in `data`)."""
    rows = []
    with zipfile.ZipFile(file) as z:
        for name in sorted(z.namelist()):
            data = z.read(_safe_member(name))
            try:
                text = data.decode()
                rows.append((path, name, "json" if name.endswith(".json") else "text", text, None))
            except UnicodeDecodeError:
                rows.append((path, name, "binary", None, data))
    kinds = [pa.string()] * 4 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=["path", "member", "kind", "text", "data"])


def read_raw_zips(spark: SparkSession, path: str) -> DataFrame:
    """One row a member of each zip below path."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield zip_rows(where, io.BytesIO(content.as_buffer()))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInArrow(run, MEMBERS)


def npz_bytes(vectors: np.ndarray, metadata: list[dict] | dict | None = None, chunk_ids: list[str] | None = None, model: str | None = None) -> bytes:
    """Embeddings as NPZ: chunk-aligned metadata with a model, or chunk ids with metadata. Only plain arrays."""
    if metadata is None or (chunk_ids is None and model is None):
        raise InvalidParams("vectors need metadata, and chunk ids or a model")
    arrays = {"vectors": np.asarray(vectors, np.float32), "metadata_json": np.array(json.dumps(metadata, ensure_ascii=False))}
    if chunk_ids is not None:
        arrays["chunk_ids"] = np.array(chunk_ids, dtype=np.str_)
    if model is not None:
        arrays["model"] = np.array(model)
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


EMBEDDING_ROWS = "path string, ordinal int, chunk_id string, text_sha256 string, vector array<float>, model string, dim int"


def npz_rows(path: str, file) -> pa.RecordBatch:
    """One row a vector of an NPZ file, for both layouts."""
    with np.load(file, allow_pickle=False) as z:
        vectors, meta = z["vectors"], json.loads(str(z["metadata_json"]))
        n = len(vectors)
        per = meta if isinstance(meta, list) else [{}] * n
        ids = z["chunk_ids"].tolist() if "chunk_ids" in z else [m.get("chunk_id") for m in per]
        model = str(z["model"]) if "model" in z else (meta.get("model") if isinstance(meta, dict) else None)
    if len(per) != n or len(ids) != n:
        raise InvalidParams(f"{path}: {n} vectors, {len(per)} rows of metadata")
    cols = [[path] * n, range(n), ids, [m.get("text_sha256") for m in per], list(vectors), [model] * n, [vectors.shape[1]] * n]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.float32()), pa.string(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["path", "ordinal", "chunk_id", "text_sha256", "vector", "model", "dim"])


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """One row a vector of each NPZ file below path."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield npz_rows(where, io.BytesIO(content.as_buffer()))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInArrow(run, EMBEDDING_ROWS)


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """path, is_pdf by the first bytes."""
    from lectern.operators.filters import pdf_magic

    return spark.read.format("binaryFile").load(path).select("path", pdf_magic(F.col("content")).alias("is_pdf"))


def provider_markdown(payload: Column) -> Column:
    """Markdown or text of a provider's response: pages' markdown joined by empty lines, else the first filled of the usual names."""
    pages = F.from_json(payload, "struct<pages: array<struct<markdown: string>>>")["pages"]
    joined = F.nullif(F.array_join(F.filter(F.transform(pages, lambda p: p["markdown"]), lambda m: m.isNotNull()), "\n\n"), F.lit(""))
    names = ("$.markdown", "$.md_results", "$.result", "$.text", "$.content", "$.choices[0].message.content", "$.output.choices[0].message.content[0].text")
    return F.coalesce(joined, *[F.nullif(F.get_json_object(payload, n), F.lit("")) for n in names])


def import_items(spark: SparkSession, path: str) -> DataFrame:
    """Items from a JSON (lines or array), CSV or Parquet file by its ending: every column that isn't part of the model becomes a field."""
    from lectern.operators.exports import push_payload

    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        rows = spark.read.option("header", "true").csv(path)
    elif kind in ("json", "jsonl"):
        rows = spark.read.option("multiLine", str(kind == "json").lower()).json(path)
    elif kind == "parquet":
        rows = spark.read.parquet(path)
    else:
        raise InvalidParams(f"unknown kind of file: {kind}")
    if "item_type" not in rows.columns:
        rows = rows.withColumn("item_type", F.lit(None).cast("string"))
    return push_payload(rows)
