"""What the operators of this subpackage share: the shared folder, written stages, and row keys."""

from __future__ import annotations

import contextlib
import contextvars
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset, a folder in the SQL warehouse serves a local session, whose executors are in the driver's process;
    on a cluster it is an error, since a folder of the driver's machine isn't shared.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_lectern"
    return found.rstrip("/")


class Workspace:
    """A fresh folder in the shared folder for the tables that one run of an operator writes.

    put() writes a frame and reads it back, which cuts lineage: a lost executor costs a reread, not a recomputation.
    Tables that no later frame reads are dropped by the operator; what its lazy result still reads is deleted when the
    session ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}_{uuid.uuid4().hex}"
        self.names: list[str] = []
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)
        if (own := _MADE.get()) is not None:
            own.append(self.path)

    def put(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        at = f"{self.path}/{name}"
        self.names.append(name)
        df.write.mode("overwrite").option("compression", compression).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        """Delete tables that no frame still to be run reads."""
        for name in names:
            _delete(self.spark, f"{self.path}/{name}")
            self.names.remove(name)

    def drop_others(self, *names: str) -> None:
        """Delete all tables but these."""
        self.drop(*[x for x in dict.fromkeys(self.names) if x not in names])


#: Folders of the workspaces made inside the innermost `released` of this context (each thread has its own).
_MADE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """On leaving, delete the folders of the workspaces that this thread made inside: what was read from them must have been written elsewhere.

    Workspaces of other threads, and those made before, stay.
    """
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
    for path in made:
        _delete(spark, path)


def crc32_of_id(doc_id) -> int:
    """Unsigned crc32 of the id written as decimal text; the folds are remainders of it. A null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(int(doc_id)).encode())


def id_fold(doc_id: Column, n: int) -> Column:
    """crc32_of_id(doc_id) % n as a column."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def least_hashes(rows: DataFrame, group: str, most: int, bits: int = 11) -> DataFrame:
    """id and group: of rows (id, group), all different, the `most` ids of each group with the least hash.

    Ids are counted by the leading bits of their hash (partial counts); buckets behind the one in which a group's count reaches
    `most` go unranked, so that a group never meets in one task: one task sees 2 ** bits counts, then `most` ids and a bucket more.
    """
    rows = rows.select("id", group).withColumn("h", F.xxhash64("id")).withColumn("b", F.shiftright("h", 64 - bits))
    counts = rows.groupBy(group, "b").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = counts.withColumn("before", before).where(F.col("before") < most).select(group, "b")
    rank = F.row_number().over(Window.partitionBy(group).orderBy("h", "id"))
    return rows.join(near, [group, "b"], "left_semi").withColumn("rank", rank).where(F.col("rank") <= most).select("id", group)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices_of(batch: pa.RecordBatch, text_at: int | pa.Array, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts (a column, or an array as long) hold about most_bytes at most; a longer text is a slice of its own."""
    text = batch.column(text_at) if isinstance(text_at, int) else text_at
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def coded_words(texts: Iterable[bytes | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, pa.Array]:
    """The words of each text (split at bytes 0x20 and 0x09-0x0D), offsets of the texts, a number for each word, and the different words."""
    split = [t.split() if t else [] for t in texts]
    at = np.zeros(len(split) + 1, np.int64)
    np.cumsum([len(x) for x in split], out=at[1:])
    coded = pa.array(list(chain.from_iterable(split)), pa.large_binary()).dictionary_encode()
    return split, at, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
