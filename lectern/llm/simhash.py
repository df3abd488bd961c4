"""SimHash near-duplicate groups with pivot distance tables.

Fingerprints: 64 bits over XXH64 values of word shingles. Two link when at most `most` (3) bits differ; a document's group
is the component of that relation, found exactly:

1. Equal fingerprints fall together by an aggregation with partial sums, so exact copies cost one row a map task.
2. Candidate pairs share a bucket. The bits are cut into five blocks; three differing bits leave two blocks whole, so ten
   masks (pairs of blocks) put every linked pair into a common bucket. A bucket with more than `most_in_bucket` different
   fingerprints is dealt again: its free bits are cut into four parts, of which one is whole for every linked pair. This
   repeats for crowded buckets only, until no bucket is crowded (a bucket with nine free bits can't be), so no group grows
   without bound and no pair is lost.
3. Inside a bucket each fingerprint has a row of a table of its Hamming distances to many reference fingerprints (pivots).
   The bucket is ordered by the first coordinate, and only pairs that lie within `most` there are made at all; by the
   triangle inequality a pair whose rows differ by more than `most` in any other coordinate is discarded; survivors are
   verified by counting differing bits. A bucket hands on a spanning forest of its links, never all pairs. `pair_figures`
   counts the pairs of each kind.
4. Components by alternating stars (components.py).

`groups` is that relation. `one_of_each` uses a wider one, `WORDS`, which finds near copies in which a few words in a hundred differ. Its
fingerprints are over a text's different words (letters and digits, lower case); texts with equal ones are one class, and classes link when
these differ in at most 7 bits and their smallest fingerprints over shingles in at most `SHINGLE_BITS`. A text of fewer
than `FEW_WORDS` different words has the fingerprint over shingles for both. Nine blocks, of which two are whole for every linked
pair, make 36 masks there; all else is the same, and the second fingerprints are compared for the survivors of the tables.

Defined results: null and empty texts have fingerprint 0 and link like any other; very long texts count whole; repeated rows
are rows of their own in the same group; a null id keeps its row and never names a group unless all ids of a group are
null (then component_id is null); an empty table gives an empty result; extra columns are not read by `groups`.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import Workspace, coded_words, slices_of
from lectern.llm.components import components

#: Fingerprints of a bucket that one task solves. Near copies of one text lie within few bits of each other and share most buckets however
#: they are dealt, the more so in the wider relation, so its buckets are larger.
MOST_IN_BUCKET, MOST_IN_WORD_BUCKET = 512, 8192


@dataclass(frozen=True)
class Relation:
    """Fingerprints link at `most` or fewer differing bits; so many of the blocks are whole for every linked pair: len(blocks) - most at least."""

    most: int = 3
    blocks: tuple[int, ...] = (13, 13, 13, 13, 12)
    whole: int = 2
    #: Most differing bits of a second fingerprint, if there is one.
    most_second: int = 64

    def first_masks(self) -> list[int]:
        """Masks of each choice of `whole` blocks."""
        at, blocks = 64, []
        for width in self.blocks:
            at -= width
            blocks.append(((1 << width) - 1) << at)
        return [sum(own) for own in itertools.combinations(blocks, self.whole)]

    def finer_masks(self, mask: int) -> list[int]:
        """The mask with each of most + 1 parts of its free bits added: a linked pair agrees on one of them at least."""
        free, parts = [1 << k for k in range(64) if not mask >> k & 1], self.most + 1
        cut = [len(free) * k // parts for k in range(parts + 1)]
        return [mask | sum(free[a:b]) for a, b in zip(cut, cut[1:])]


SHINGLES = Relation()
#: Two unrelated texts differ in 32 of 64 bits over shingles, give or take 4.
SHINGLE_BITS = 16
FEW_WORDS = 16
#: Texts of about so many bytes are worked on together, and so many words' bits are summed at once.
SLICE_BYTES, BITS_AT_ONCE = 2 << 20, 1 << 15
WORDS = Relation(most=7, blocks=(7,) * 8 + (8,), whole=2, most_second=SHINGLE_BITS)
N_PIVOTS = 64
#: For each byte value its eight bits, the high one first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """Reference fingerprints, made by a rule."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(f"pivot {k}".encode()) for k in range(n)], np.uint64)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of a text: a bit is 1 if set in over half of the shingles' hashes."""
    from xxhash import xxh64_digest

    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return int.from_bytes(xxh64_digest(joined, seed), "big")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = [0, *(ends[: n - shingle] + 1).tolist()]
    hashes = b"".join([xxh64_digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())])
    lanes = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(lanes)).tobytes(), "big")


#: Letters and digits of ASCII make words, A-Z lower-cased, and so does every byte from 0x80.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def word_fingerprints(texts: Iterable[bytes | None], few: np.ndarray, seed: int = 42) -> np.ndarray:
    """Signed fingerprints over the different words of each text; those of `few` where a text has fewer than FEW_WORDS."""
    from xxhash import xxh64_digest

    _, at, codes, words = coded_words(t and t.translate(_WORD_BYTES) for t in texts)
    n, out = len(at) - 1, few.copy()
    if not len(codes):
        return out
    bits = np.unpackbits(np.frombuffer(b"".join([xxh64_digest(w, seed) for w in words.to_pylist()]), np.uint8).reshape(-1, 8), axis=1)
    doc = np.repeat(np.arange(n), np.diff(at))
    different = np.unique(doc * np.int64(len(words)) + codes)
    doc, word = different // len(words), different % len(words)
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    sizes = np.diff(np.append(starts, len(doc)))
    sums = np.zeros((len(starts), 64), np.int64)
    # a block of rows at a time bounds the table of bits
    for a in range(0, len(doc), BITS_AT_ONCE):
        own = doc[a : a + BITS_AT_ONCE]
        cut = np.flatnonzero(np.diff(own, prepend=-1))
        np.add.at(sums, np.searchsorted(doc[starts], own[cut]), np.add.reduceat(bits[word[a : a + BITS_AT_ONCE]].astype(np.int32), cut, axis=0))
    found = np.packbits(2 * sums > sizes[:, None], axis=1).view(">u8")[:, 0].astype(np.uint64).view(np.int64)
    many = sizes >= FEW_WORDS
    out[doc[starts][many]] = found[many]
    return out


def _both_fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for own in slices_of(batch, 1, SLICE_BYTES):
            second = np.array([fingerprint(t.as_py()) for t in own.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array(word_fingerprints(own.column(1).cast(pa.binary()).to_pylist(), second)), pa.array(second)], names=["key", "fp", "second"])


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["key", "fp"])


def fingerprints(docs: DataFrame, key_col: str, text_col: str = "text", words: bool = False) -> DataFrame:
    """key, fp (the fingerprint as a signed 64-bit number); with words fp is that over words, and second the one over shingles."""
    rows = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    if words:
        return rows.mapInArrow(_both_fingerprints, f"key {kind}, fp long, second long")
    return rows.mapInArrow(_fingerprints, f"key {kind}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _dealt(rows: DataFrame, masks: list[list[int]]) -> DataFrame:
    """rows (m, fp, ...), m an index into masks, once for each mask in masks[m]: m, v, fp, ... with m counted over all masks."""
    flat = [x for group in masks for x in group]
    first = np.cumsum([0, *map(len, masks)]).tolist()
    table = F.array(*[F.array(*[F.struct(F.lit(first[k] + j).alias("m"), F.lit(_signed(x)).alias("mask")) for j, x in enumerate(group)]) for k, group in enumerate(masks)])
    assert len(flat) == first[-1]
    own = [c for c in rows.columns if c not in ("m", "v")]
    each = rows.select(*own, F.explode(F.get(table, F.col("m"))).alias("x"))
    return each.select(F.col("x.m").alias("m"), F.col("x.mask").bitwiseAND(F.col("fp")).alias("v"), *own)


def spanning_links(group: np.ndarray, fp: np.ndarray, relation: Relation = SHINGLES, second: np.ndarray | None = None, figures: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Index pairs of linked fingerprints that span each group's components. group: ascending numbers, fp and second: uint64.

    figures, if given, gets added: pairs in groups, made, left by the tables, linked.
    """
    own, most = pivots(), relation.most
    first = np.bitwise_count(fp ^ own[0]).astype(np.int16)
    order = np.lexsort((first, group))
    sorted_fp, group, first = fp[order], group[order], first[order]
    table = np.bitwise_count(sorted_fp[:, None] ^ own[1:]).astype(np.int8)
    root = np.arange(len(fp))
    links: list[tuple[int, int]] = []

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    if figures is not None:
        size = np.bincount(group)
        figures[0] += int((size * (size - 1) // 2).sum())
    at, step = np.arange(len(fp)), 0
    while True:
        step += 1
        at = at[at + step < len(fp)]
        # places beyond the border of the first coordinate stay beyond it for every larger step
        at = at[(group[at] == group[at + step]) & (first[at + step] - first[at] <= most)]
        if not len(at):
            return links
        near = at[root[at] != root[at + step]] if figures is None else at
        left = near[(np.abs(table[near] - table[near + step]) <= most).all(axis=1)]
        near = left[np.bitwise_count(sorted_fp[left] ^ sorted_fp[left + step]) <= most]
        if second is not None:
            near = near[np.bitwise_count(second[order[near]] ^ second[order[near + step]]) <= relation.most_second]
        if figures is not None:
            figures[1:] += (len(at), len(left), len(near))
        for i in near.tolist():
            a, b = find(i), find(i + step)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((int(order[i]), int(order[i + step])))
        if len(near):
            while not np.array_equal(flat := root[root], root):
                root[:] = flat


def _solved(m: np.ndarray, v: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    group, keep = _shared(m, v)
    fp = fp[keep]
    links = np.array(spanning_links(group, fp.view(np.uint64)), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(fp[links[:, 0]]), pa.array(fp[links[:, 1]])], names=["a", "b"])


def _solved_words(m: np.ndarray, v: np.ndarray, fp: np.ndarray, second: np.ndarray) -> pa.RecordBatch:
    group, keep = _shared(m, v)
    fp = fp[keep]
    links = np.array(spanning_links(group, fp.view(np.uint64), WORDS, second[keep].view(np.uint64)), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(fp[links[:, 0]]), pa.array(fp[links[:, 1]])], names=["a", "b"])


FIGURES = ["in_buckets", "made", "left_by_tables", "linked"]


def _counted(m: np.ndarray, v: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    group, keep = _shared(m, v)
    figures = np.zeros(len(FIGURES), np.int64)
    spanning_links(group, fp[keep].view(np.uint64), figures=figures)
    return pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in figures], names=FIGURES)


def _shared(m: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the buckets of two or more, and which rows stand in them."""
    group = np.cumsum(np.concatenate([[0], (m[1:] != m[:-1]) | (v[1:] != v[:-1])]))
    keep = np.bincount(group)[group] > 1
    return group[keep] - (group[keep][0] if keep.any() else 0), keep


def _by_bucket(solve):
    """solve(m, v, ...) for whole buckets. Rows come sorted by bucket (m, v); the last bucket of a batch waits for the next."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            cols = cols if left is None else [np.concatenate(x) for x in zip(left, cols)]
            if not len(cols[0]):
                continue
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            whole = int(np.argmax(same))
            left = [c[whole:] for c in cols]
            if whole:
                yield solve(*[c[:whole] for c in cols])
        if left is not None and len(left[0]):
            yield solve(*left)

    return run


def links(space: Workspace, distinct: DataFrame, most_in_bucket: int = MOST_IN_BUCKET) -> DataFrame:
    """a, b: links between different fingerprints that span the components. distinct: column fp, each value once."""
    return _of_buckets(space, distinct.select("fp"), SHINGLES, most_in_bucket, _solved, "a long, b long")


def word_links(space: Workspace, distinct: DataFrame, most_in_bucket: int = MOST_IN_WORD_BUCKET) -> DataFrame:
    """a, b: links that span the components of `WORDS`. distinct: columns fp and second, each fp once."""
    return _of_buckets(space, distinct.select("fp", "second"), WORDS, most_in_bucket, _solved_words, "a long, b long")


def pair_figures(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_in_bucket: int = MOST_IN_BUCKET) -> DataFrame:
    """One row: pairs of different fingerprints that share a bucket, are made, are left by the tables, and link. A pair counts once a bucket."""
    space = Workspace(spark, "simhash_figures")
    distinct = space.put(fingerprints(docs, id_col, text_col).select("fp").distinct(), "distinct")
    found = _of_buckets(space, distinct, SHINGLES, most_in_bucket, _counted, ", ".join(f"{x} long" for x in FIGURES))
    return found.agg(*[F.sum(x).alias(x) for x in FIGURES])


def _of_buckets(space: Workspace, distinct: DataFrame, relation: Relation, most_in_bucket: int, solve, schema: str) -> DataFrame:
    masks = relation.first_masks()
    rows = _dealt(distinct.withColumn("m", F.lit(0)), [masks])
    found = None
    for level in range(12):
        crowded = space.put(rows.groupBy("m", "v").count().where(F.col("count") > most_in_bucket).select("m", "v"), f"crowded_{level}")
        split = not crowded.isEmpty()
        ready = rows.join(crowded, ["m", "v"], "left_anti") if split else rows
        dealt = ready.repartition("m", "v").sortWithinPartitions("m", "v").select("m", "v", *distinct.columns)
        own = space.put(dealt.mapInArrow(_by_bucket(solve), schema), f"links_{level}")
        found = own if found is None else found.unionByName(own)
        if not split:
            return found
        finer = [relation.finer_masks(x) for x in masks]
        rows = space.put(_dealt(rows.join(crowded, ["m", "v"], "left_semi").select("m", *distinct.columns), finer), f"dealt_{level + 1}")
        masks = [x for group in finer for x in group]
    raise RuntimeError("buckets stay crowded")


def keyed_groups(spark: SparkSession, docs: DataFrame, key_col: str, id_col: str = "doc_id", text_col: str = "text", words: bool = False) -> DataFrame:
    """key, doc_id, fp, component_id and first (true for one row of each group: the smallest id, then the smallest key).

    key_col must name a column that is never null and differs in each row. With words the relation is `WORDS`, else `SHINGLES`.
    """
    space = Workspace(spark, "simhash")
    rows = docs.select(F.struct(F.col(key_col).alias("key"), F.col(id_col).cast("long").alias("doc_id")).alias("k"), F.col(text_col).alias("text"))
    marked = space.put(fingerprints(rows, "k", words=words).select("key.key", "key.doc_id", "fp", *["second"] * words), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("key").alias("key"))
    distinct = space.put(marked.groupBy("fp").agg(F.min(order).alias("first"), *[F.min("second").alias("second")] * words), "distinct")
    roots = components(space, word_links(space, distinct) if words else links(space, distinct))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = space.put(rooted, "rooted")
    heads = space.put(rooted.groupBy("root").agg(F.min("first").alias("head")), "heads")
    named = space.put(rooted.join(heads, "root").select("fp", F.col("head.id").alias("component_id"), F.col("head.key").alias("head_key")), "named")
    space.drop_others("fingerprints", "named")
    return marked.join(named, "fp").select("key", "doc_id", "fp", "component_id", (F.col("key") == F.col("head_key")).alias("first"))


def groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable)."""
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = keyed_groups(spark, keyed, "key")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are first in their group by `WORDS`, with all columns."""
    space = Workspace(spark, "simhash_docs")
    staged = space.put(docs.select(F.monotonically_increasing_id().alias("__sh_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__sh_row")), "docs")
    slim = staged.select("__sh_key", F.col(f"__sh_row.`{id_col}`").alias("id"), F.col(f"__sh_row.`{text_col}`").alias("text"))
    first = keyed_groups(spark, slim, "__sh_key", "id", "text", words=True).where("first").select(F.col("key").alias("__sh_key"))
    return staged.join(first, "__sh_key", "left_semi").select("__sh_row.*")
