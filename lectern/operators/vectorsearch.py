"""The best vectors for each of many queries, as one job of block pairs.

Both sides are packed into rows that hold a matrix as bytes. Each block of vectors meets each block of queries in a join by cell: blocks of
vectors are dealt to `rows` cells and, if the queries are many, copied to `columns` cells, blocks of queries the other way round. A
task multiplies matrices, keeps the best k of each query it has met, and hands them on once a cell; they are ranked after one more
shuffle. The driver sees counts only. A query set whose size is known to be small is broadcast instead, so that the vectors
stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.errors import InvalidParams
from lectern.stages import Stages

#: Queries of a block, and bytes of a block of vectors.
QUERY_BLOCK, BLOCK_BYTES = 1 << 12, 1 << 20
#: Queries that meet in one cell: their best k stay in a task's memory.
CELL_QUERIES = 1 << 16
#: Bytes of queries that every executor may hold.
BROADCAST_BYTES = 8 << 20
#: Bytes of scores that a task holds at a time.
SCORE_BYTES = 8 << 20
#: Scores closer than this count as equal; products of other blocks round differently.
DIGITS = 12


def _packed(rows: DataFrame, names: list[str], block: int | None) -> DataFrame:
    """Blocks of rows (names and vector): number (unique), n, matrix (bytes of n rows), and a list of each name's values."""
    width = 4 if rows.schema["vector"].dataType.elementType == T.FloatType() else 8
    kind = pa.float32() if width == 4 else pa.float64()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, dim = TaskContext.get().partitionId() << 33, None
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(len(names))
            sizes = pc.list_value_length(column)
            dim = sizes[0].as_py() if dim is None else dim
            if column.null_count or pc.min(sizes).as_py() != dim or pc.max(sizes).as_py() != dim:
                raise InvalidParams("vectors of another dimension")
            most = block or max(1, BLOCK_BYTES // (width * max(dim, 1)))
            for at in range(0, batch.num_rows, most):
                own = batch.slice(at, most)
                flat = own.column(len(names)).flatten().cast(kind).to_numpy(zero_copy_only=False)
                lists = [pa.array([c.to_pylist()], pa.list_(c.type)) for c in own.columns[: len(names)]]
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([own.num_rows]), pa.array([flat.tobytes()], pa.binary()), *lists], names=["number", "n", "matrix", *names])
                number += 1

    kinds = [T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in names]
    schema = T.StructType([T.StructField("number", T.LongType()), T.StructField("n", T.LongType()), T.StructField("matrix", T.BinaryType()), *kinds])
    return rows.select(*names, "vector").mapInArrow(run, schema)


def _units(matrix: bytes, n: int, width: int) -> np.ndarray:
    """Rows of unit length in double precision; a zero row stays zero."""
    rows = np.frombuffer(matrix, f"<f{width}").astype(np.float64).reshape(n, -1)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1)


class _Best:
    """The best k of the vectors met so far, for each query of a block."""

    def __init__(self, number: int, units: np.ndarray, ids: pa.Array, k: int):
        self.number, self.units, self.ids, self.k = number, units, ids, k
        self.least = np.full(len(units), -np.inf)
        self.held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object), np.zeros(0, object)]

    def meet(self, units: np.ndarray, chunk: np.ndarray, item: np.ndarray) -> None:
        if units.shape[1] != self.units.shape[1]:
            raise InvalidParams("vectors of another dimension")
        slack, border, found = 10.0**-DIGITS, self.least, []
        most = max(1, SCORE_BYTES // (8 * max(1, len(self.units))))
        for at in range(0, max(1, len(units)), most):
            scores = units[at : at + most] @ self.units.T
            if len(scores) > self.k and np.isneginf(border).any():
                border = np.maximum(border, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k])
            row, query = np.nonzero(scores >= border - 2 * slack)
            found.append((query, np.round(scores[row, query], DIGITS), row + at))
        query, score, row = [np.concatenate(x) for x in zip(*found)]
        if not len(row):
            return
        both = zip(self.held, (query, score, chunk[row], item[row]))
        query, score, chunk, item = [np.concatenate(x) for x in both]
        order = np.lexsort((chunk, -score, query))
        starts = np.flatnonzero(np.diff(query[order], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        own = order[rank < self.k]
        self.held = [c[own] for c in (query, score, chunk, item)]
        full = np.flatnonzero(np.bincount(self.held[0], minlength=len(self.least)) == self.k)
        lowest = np.full(len(self.least), np.inf)
        np.minimum.at(lowest, self.held[0], self.held[1])
        self.least[full] = lowest[full]

    def rows(self, kind: pa.DataType) -> pa.RecordBatch:
        query, score, chunk, item = self.held
        arrays = [pa.array(np.full(len(query), self.number)), pa.array(query), self.ids.take(pa.array(query)).cast(kind), pa.array(chunk, pa.string()), pa.array(item, pa.string()), pa.array(score)]
        return pa.RecordBatch.from_arrays(arrays, names=["block", "place", "query_id", "chunk_id", "item_key", "score"])


def _met(k: int, v_width: int, q_width: int):
    """Rows (cell, block of vectors, block of queries) to the best k of each query; once a cell, or when a cell ends."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, best, last = None, {}, (None, None)
        kind = None
        for batch in batches:
            names = batch.schema.names
            kind = batch.schema.field("query_id").type.value_type
            cols = {c: batch.column(j) for j, c in enumerate(names)}
            for j in range(batch.num_rows):
                if cols["cell"][j].as_py() != cell:
                    for b in best.values():
                        yield b.rows(kind)
                    cell, best = cols["cell"][j].as_py(), {}
                number = cols["q_number"][j].as_py()
                if number not in best:
                    best[number] = _Best(number, _units(cols["q_matrix"][j].as_buffer(), cols["q_n"][j].as_py(), q_width), cols["query_id"][j].values, k)
                if last[0] != cols["number"][j].as_py():
                    last = (cols["number"][j].as_py(), (_units(cols["matrix"][j].as_buffer(), cols["n"][j].as_py(), v_width), *(np.array(cols[c][j].as_py(), object) for c in ("chunk_id", "item_key"))))
                best[number].meet(*last[1])
        for b in best.values():
            yield b.rows(kind)

    return run


def vector_hits_of(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = QUERY_BLOCK, broadcast_bytes: int = BROADCAST_BYTES, cell_queries: int = CELL_QUERIES) -> DataFrame:
    """The best k of all vectors for each row of queries (query_id, vector): query_id, chunk_id, item_key, score.

    Ties go to the smaller chunk id, a zero vector scores 0; a vector of another dimension is an error. Query sets of up to broadcast_bytes are
    broadcast; others, of any size, meet the vectors in cells of about cell_queries queries.
    """
    spark = vectors.sparkSession
    space = Stages(spark, "vector_search")
    width = lambda df: 4 if df.schema["vector"].dataType.elementType == T.FloatType() else 8
    kind = queries.schema["query_id"].dataType
    wanted = queries.select("query_id", "vector")
    asked = space.put(_packed(wanted.repartition(max(1, -(-wanted.count() // block))), ["query_id"], block), "queries")
    n_blocks, n_queries, size = asked.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.length("matrix")), F.lit(0))).first()
    asked = asked.select(F.col("number").alias("q_number"), F.col("n").alias("q_n"), F.col("matrix").alias("q_matrix"), "query_id")
    packed = _packed(vectors, ["chunk_id", "item_key"], None)
    if size <= broadcast_bytes:
        # one cell: a task's own vectors
        pairs = packed.withColumn("cell", F.lit(0)).join(F.broadcast(asked.withColumn("q_cell", F.lit(0))), F.col("cell") == F.col("q_cell")).drop("q_cell")
    else:
        rows = int(spark.conf.get("spark.sql.shuffle.partitions"))
        columns = max(1, min(n_blocks, -(-n_queries // cell_queries)))
        number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        left = packed.withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))).withColumn("cell", number("number", rows) * columns + F.col("column")).drop("column")
        right = asked.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("cell", F.col("row") * columns + number("q_number", columns)).drop("row")
        # a merge join hands on a cell after another, and adaptive execution can split a large one
        pairs = left.hint("merge").join(right, "cell")
    order = ["cell", "number", "n", "matrix", "chunk_id", "item_key", "q_number", "q_n", "q_matrix", "query_id"]
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("place", T.LongType()), T.StructField("query_id", kind), T.StructField("chunk_id", T.StringType()), T.StructField("item_key", T.StringType()), T.StructField("score", T.DoubleType())])
    best = pairs.select(*order).mapInArrow(_met(k, width(vectors), width(queries)), schema)
    rank = F.row_number().over(Window.partitionBy("block", "place").orderBy(F.desc("score"), "chunk_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "chunk_id", "item_key", "score")
