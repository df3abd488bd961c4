"""Embedding as an Arrow function over a protocol; the embedder shipped here hashes words and needs no network."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lectern.errors import InvalidParams


class Embedder(Protocol):
    dim: int
    model: str

    def embed_documents(self, texts: list[str]) -> np.ndarray: ...

    def embed_queries(self, texts: list[str]) -> np.ndarray: ...

    def embed_query(self, text: str) -> np.ndarray: ...


class HashingEmbedder:
    """Signed word weights in hashed cells, unit length. A document's word weighs 1 + ln(times), a query's word 1, however often it stands there."""

    def __init__(self, dim: int = 256, dtype: str = "float32"):
        self.dim, self.model, self.dtype = dim, f"hashing-{dim}", np.dtype(dtype)

    def _embed(self, texts: list[str], weigh) -> np.ndarray:
        """Each different word of the texts is hashed once; weigh takes the times that words stand in a text."""
        split = [(t or "").lower().split() for t in texts]
        coded = pa.array(list(chain.from_iterable(split)), pa.large_string()).dictionary_encode()
        words = coded.dictionary.to_pylist()
        out = np.zeros((len(texts), self.dim))
        if not words:
            return out.astype(self.dtype)
        hashes = np.array([int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") for w in words], np.int64)
        text = np.repeat(np.arange(len(texts)), [len(x) for x in split])
        pairs, times = np.unique(text * np.int64(len(words)) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        text, own = pairs // len(words), hashes[pairs % len(words)]
        np.add.at(out, (text, own % self.dim), np.where(own >> 31, 1.0, -1.0) * weigh(times))
        sizes = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(sizes > 0, sizes, 1)).astype(self.dtype)

    def embed_documents(self, texts: list[str]) -> np.ndarray:
        return self._embed(texts, lambda n: 1 + np.log(n))

    def embed_queries(self, texts: list[str]) -> np.ndarray:
        return self._embed(texts, np.ones_like)

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed_queries([text])[0]


EMBEDDERS = {"hashing": HashingEmbedder}


def create_embedder(provider: str, **options) -> Embedder:
    if provider not in EMBEDDERS:
        raise InvalidParams(f"unknown embedding provider: {provider}; known: {', '.join(sorted(EMBEDDERS))}")
    return EMBEDDERS[provider](**options)


#: Bytes of texts that are embedded together.
SLICE_BYTES = 1 << 20


def by_bytes(batch: pa.RecordBatch, text_at: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts hold about `most` bytes; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def with_vectors(chunks: DataFrame, provider: str = "hashing", text_col: str = "text", out_col: str = "vector", role: str = "document", **options) -> DataFrame:
    """chunks with vectors of their texts, as documents or as queries, and the model's name. The embedder is made once a task.

    Vectors are of floats, or of doubles if the embedder's dtype says so.
    """
    dtype = np.dtype(getattr(create_embedder(provider, **options), "dtype", np.float32))
    kind = T.DoubleType() if dtype == np.float64 else T.FloatType()
    dtype = np.float64 if dtype == np.float64 else np.float32
    if role not in ("document", "query"):
        raise InvalidParams(f"unknown role: {role}")
    at, names = chunks.columns.index(text_col), [*chunks.columns, out_col, "model"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = create_embedder(provider, **options)
        for batch in batches:
            for own in by_bytes(batch, at):
                texts = own.column(at).to_pylist()
                vectors = np.asarray(embedder.embed_documents(texts) if role == "document" else embedder.embed_queries(texts), dtype)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(own.num_rows + 1) * embedder.dim, pa.int32()), pa.array(vectors.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*own.columns, lists, pa.array([embedder.model] * own.num_rows)], names=names)

    schema = T.StructType([*chunks.schema.fields, T.StructField(out_col, T.ArrayType(kind)), T.StructField("model", T.StringType())])
    return chunks.mapInArrow(run, schema)
