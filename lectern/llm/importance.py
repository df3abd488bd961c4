"""Importance resampling towards a target distribution, over hashed runs of words.

Features of a text are all runs of 1 to max_run consecutive words, joined by one space, repeats counted; a feature's bucket is
its crc32 modulo `buckets`. Counts of all documents and of all target texts give each bucket a gain, the logarithm of how much
commoner it is in the target; an array of gains scores every document, and noise from a hash of its id turns taking the best
scores into a weighted draw without replacement.

How it runs: each task counts its own buckets and hands on one row a bucket, so the shuffle doesn't grow with the texts; the
driver sees `buckets` numbers. A checksum of a run comes from those of its words by the linearity of crc32 (the checksum
of the words before, moved on by the length of the last one, by tables). Scores are whole numbers and are written once, five
numbers a document. The draw counts documents by score, exactly; suffix sums over this histogram give every score's rank offset.
The histogram can have as many rows as there are documents, so the sums are formed along the score's digits of 8 bits: no
window sees more than 2 ** 8 rows of one prefix (2 ** 13 leading ones), and prefixes behind the last rank aren't followed. Only documents of
surviving scores are numbered, by id within their score.

Defined results: a null or empty text has no features, weight 0 and no rank; a null id counts as the empty text in the hash
and comes last among equal scores; repeated rows count and are drawn as rows of their own; without target texts, or without documents,
counts are 0 and the gains follow from the formula; columns other than id and text don't matter.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import Workspace, coded_words, slices_of

#: Texts of about so many bytes are worked on together.
SLICE_BYTES = 4 << 20
#: Bits of a digit of the score, and digits below the leading one: scores are below 2 ** 52 in size.
DIGIT, DIGITS = 8, 5


@dataclass(frozen=True)
class DrawRules:
    """Runs of up to max_run words, crc32 modulo buckets; of documents with min_words, percent in a hundred (rounded down) are drawn."""

    max_run: int = 3
    buckets: int = 10_000
    min_words: int = 20
    percent: int = 5
    seed: int = 42


#: Bytes 0-9, a-z and from 0x80 make words, A-Z lower-cased; every other byte becomes a blank.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


class Checksums:
    """crc32 of joined strings from the crc32 of their parts: crc(a + b) = moved(crc(a), len(b)) ^ crc(b)."""

    #: Longer words are added byte by byte.
    LONGEST = 255

    def __init__(self):
        step = np.array([self._zero_byte(c) for c in range(256)], np.uint32)
        tables = np.zeros((self.LONGEST + 1, 4, 256), np.uint32)
        for k in range(4):
            tables[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for size in range(1, self.LONGEST + 1):
            before = tables[size - 1]
            tables[size] = (before >> np.uint32(8)) ^ step[(before & np.uint32(255)).astype(np.int64)]
        self.tables = tables.reshape(-1)

    @staticmethod
    def _zero_byte(c: int) -> int:
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        return c

    def moved(self, crc: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        base = np.asarray(size, np.int64) * 1024
        out = self.tables[base + (crc & np.uint32(255))]
        for k in range(1, 4):
            out = out ^ self.tables[base + k * 256 + ((crc >> np.uint32(8 * k)) & np.uint32(255))]
        return out


def run_buckets(texts: Iterable[bytes | None], rules: DrawRules, sums: Checksums) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Offsets of the texts' words, and for each run length the first words of its runs and their buckets."""
    _, at, codes, words = coded_words(t and t.translate(_WORD_BYTES) for t in texts)
    words = words.to_pylist()
    own = np.array([zlib.crc32(w) for w in words], np.uint32)
    size = np.array([len(w) for w in words], np.int64)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    blank, out = np.uint32(zlib.crc32(b" ")), []
    first, crc = np.arange(len(codes)), own[codes]
    for n in range(1, rules.max_run + 1):
        if n > 1:
            inside = first + n - 1 < len(codes)
            first, crc = first[inside], crc[inside]
            inside = doc[first] == doc[first + n - 1]
            first, crc = first[inside], crc[inside]
            last = codes[first + n - 1]
            before = sums.moved(crc, 1) ^ blank
            crc = sums.moved(before, np.minimum(size[last], sums.LONGEST)) ^ own[last]
            for k in np.flatnonzero(size[last] > sums.LONGEST).tolist():
                crc[k] = zlib.crc32(words[last[k]], int(before[k]))
        out.append((first, (crc % np.uint32(rules.buckets)).astype(np.int64)))
    return at, out


def bucket_counts(texts: DataFrame, rules: DrawRules, text_col: str = "text") -> np.ndarray:
    """How many features of all the texts fall in each bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = Checksums(), np.zeros(rules.buckets, np.int64)
        for batch in batches:
            for own in slices_of(batch, 0, SLICE_BYTES):
                for _, bucket in run_buckets(own.column(0).cast(pa.binary()).to_pylist(), rules, sums)[1]:
                    counts += np.bincount(bucket, minlength=rules.buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["bucket", "n"])

    found = texts.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(rules.buckets, np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return counts


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain in thousandths: the floor of the logarithm of the target's smoothed share over the documents'."""
    cells, s_all, t_all = len(own), int(own.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1) * (s_all + cells)) / ((s + 1) * (t_all + cells)))) for s, t in zip(own.tolist(), target.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, rules: DrawRules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight (the sum of the gains of its features) for every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Checksums()
        for batch in batches:
            for own in slices_of(batch, 1, SLICE_BYTES):
                at, runs = run_buckets(own.column(1).cast(pa.binary()).to_pylist(), rules, sums)
                value, count = np.zeros(at[-1] + 1, np.int64), np.zeros(at[-1] + 1, np.int64)
                for first, bucket in runs:
                    value[first] += gain[bucket]
                    count[first] += 1
                total, n = (np.concatenate([[0], np.cumsum(x)]) for x in (value, count))
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(np.diff(at)), pa.array(np.diff(n[at])), pa.array(np.diff(total[at]))], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noisy(weighted: DataFrame, seed: int) -> DataFrame:
    """With score: weight plus Gumbel noise in thousandths, from the first 8 hex digits of sha256 of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    share = (F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return weighted.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("long"))


def rank_offsets(space: Workspace, scores: DataFrame, most: int) -> DataFrame:
    """score, offset: the scores of which fewer than `most` rows have a greater one, and how many have. scores: column score.

    Suffix sums along the digits of the score: the rows before a score are those before its prefix, and of its prefix those of greater digits.
    """
    counts = space.put(scores.groupBy("score").agg(F.count("*").alias("n")), "histogram")
    found = None
    for level in range(DIGITS, -1, -1):
        low = level * DIGIT
        group = counts.groupBy(F.shiftright("score", low + DIGIT).alias("prefix"), F.shiftright("score", low).alias("digits")).agg(F.sum("n").alias("n"))
        if found is not None:
            group = group.join(found, "prefix")
        span = (Window.partitionBy("prefix") if found is not None else Window.partitionBy()).orderBy(F.desc("digits")).rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("n").over(span), F.lit(0))
        before = before + F.col("offset") if found is not None else before
        found = group.select(F.col("digits").alias("prefix"), before.alias("offset")).where(F.col("offset") < most)
        found = space.put(found, f"offsets_{level}")
    return found.withColumnRenamed("prefix", "score")


def importance_draw(spark: SparkSession, docs: DataFrame, target: DataFrame, rules: DrawRules = DrawRules(), id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """Every row's doc_id, n_words, n_features, weight, score, and rank (from 1) where it is drawn."""
    space = Workspace(spark, "importance")
    gain = gains(bucket_counts(docs, rules, text_col), bucket_counts(target, rules, target_text_col))
    scored = space.put(noisy(weights(docs, gain, rules, id_col, text_col), rules.seed), "scores")
    able = scored.where(F.col("n_words") >= rules.min_words)
    most = rules.percent * able.count() // 100
    offsets = rank_offsets(space, able.select("score"), most)
    cutoff = offsets.agg(F.min("score")).first()[0]
    if cutoff is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    best = able.where(F.col("score") >= cutoff).join(offsets, "score").withColumn("rank", F.col("offset") + place)
    best = best.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    others = scored.where((F.col("n_words") < rules.min_words) | (F.col("score") < cutoff)).withColumn("rank", F.lit(None).cast("long"))
    return best.select(*others.columns).unionByName(others)


def drawn_documents(docs: DataFrame, drawn: DataFrame, id_col: str = "doc_id", rank_col: str = "rank") -> DataFrame:
    """The documents that importance_draw drew, with their rank. Ids must be unique here."""
    ranks = drawn.where("rank IS NOT NULL").select(F.col("doc_id").alias(id_col), F.col("rank").alias(rank_col))
    return docs.drop(rank_col).join(ranks, id_col)
