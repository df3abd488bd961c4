"""Exact repeated-passage removal with a sparse suffix array that deep-shallow sorting orders.

A byte is removed when it is covered by a string of `n` bytes (200) that also starts anywhere else. Strings are judged on the
input, in UTF-8 bytes, and never cross documents.

Sampling that loses nothing. Among the grams of GRAM bytes inside a window of n bytes, the one with the least hash (leftmost
among equals) is the window's anchor. It depends on the window's bytes only, so equal windows have equal anchors at equal
offsets. The windows of one anchor follow one another, so an anchor stands for a segment: all its windows' bytes. About one
byte in 70 is an anchor.

1. Anchors: (hash of gram, hash of segment, place), narrow rows written once.
2. Grams that occur once are dropped (an aggregation with partial sums, then a join). Equal segments are counted (again with
   partial sums, so copies and common passages cost a row a map task); one that occurs twice is repeated as a whole.
3. Where one gram has different segments, one representative of each is cut from its text and the group's suffixes from the
   anchor rightwards, and reversed prefixes leftwards, are sorted by deep-shallow sorting. Neighbouring common prefixes
   tell for each window offset which suffixes agree far enough on both sides: those windows are repeated.
4. A gram with more than `most_in_group` different segments is not gathered in one task: its segments are dealt again by
   the bytes that a narrow band of offsets has in common, and where these agree, window by window, with partial counts.
5. Covered ranges are gathered per document, merged and cut out.

Texts are staged zstd-compressed once and shuffled twice in that form. Hashes: a gram's 64 bits and a segment's 64 bits,
of different functions, must both agree (128 bits); step 3 compares bytes.

Defined results: null and empty texts have no bytes and lose none; texts below n bytes lose none; very long texts are cut
into overlapping pieces for step 1 only; repeated rows lose everything if they have n bytes; an empty table gives an
empty result; extra columns are kept by `without_repeats` (a removal inside a character drops the rest of that character).
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import Workspace, slices_of
from lectern.llm.deepshallow import deep_shallow_order, neighbour_lcps

N = 200
GRAM = 64
PIECE = 1 << 18
#: Packed texts are opened in slices of about so many bytes.
PACKED_BYTES = 1 << 20
#: Plain texts are cut in slices of about so many bytes.
TEXT_BYTES = 4 << 20
MOST_IN_GROUP = 512
BANDS = 8
MASK64 = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte; powers of an odd base and of its inverse modulo 2^64."""
    import xxhash

    of_byte = np.array([xxhash.xxh64_intdigest(bytes([b]), 9) for b in range(256)], np.uint64)
    up = np.full(PIECE + N, BASE, np.uint64)
    down = np.full(PIECE + N, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return of_byte, np.multiply.accumulate(up), np.multiply.accumulate(down)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the gram at each place, by differences of a running sum."""
    of_byte, up, down = _tables()
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(of_byte[data] * down[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * up[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchor_runs(data: np.ndarray, valid: np.ndarray, n: int = N, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For windows starting at valid places (ascending): each anchor's place, hash, first and last window start."""
    h = gram_hashes(data, gram)
    low = np.uint64(PIECE - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, least = 1, key
    want = n - gram + 1
    while width * 2 <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < want:
        least = np.minimum(least[: len(key) - want + 1], least[want - width : want - width + len(key) - want + 1])
    at = (least[valid] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    return at[first], h[at[first]], valid[first], valid[last]


def _pieces(texts: list[bytes], n: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (index, offset, bytes) of up to PIECE bytes; long texts are cut so that each window is in one piece only."""
    own, size = [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(len(t) - n + 1, 0), PIECE - n + 1):
            part = t[at : at + PIECE]
            if size + len(part) > PIECE and own:
                yield own
                own, size = [], 0
            own.append((k, at, part))
            size += len(part)
    if own:
        yield own


def find_anchors(texts: list[bytes], n: int = N, gram: int = GRAM) -> tuple[list[np.ndarray], list[int]]:
    """Arrays (hash, index of text, place, greatest offset, least offset) and the segments' hashes, for each anchor.

    A window starts `offset` bytes before its anchor. The segment's hash covers its bytes and its greatest offset.
    """
    from xxhash import xxh3_64_intdigest

    cols: list[list[np.ndarray]] = [[] for _ in range(5)]
    segments: list[int] = []
    for own in _pieces(texts, n):
        joined = b"".join(p for _, _, p in own)
        sizes = np.array([len(p) for _, _, p in own])
        starts = np.cumsum(sizes) - sizes
        valid = np.concatenate([np.arange(s, s + m - n + 1) for s, m in zip(starts.tolist(), sizes.tolist())])
        at, h, lo, hi = anchor_runs(np.frombuffer(joined, np.uint8), valid, n, gram)
        which = np.searchsorted(starts, at, side="right") - 1
        most = at - lo
        segments += [xxh3_64_intdigest(joined[a : b + n], m) for a, b, m in zip(lo.tolist(), hi.tolist(), most.tolist())]
        index = np.array([k for k, _, _ in own])[which]
        place = at - starts[which] + np.array([o for _, o, _ in own])[which]
        for c, x in zip(cols, (h, index, place, most, at - hi)):
            c.append(x)
    return [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols], segments


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        blobs = [pack((t.as_py() or "").encode()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["dk", "z"])


def _unpack(column: pa.Array) -> list[bytes]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(z.as_buffer()) for z in column]


ANCHOR = "h long, s long, dk long, a long, most int, least int"


def _anchors(n: int, gram: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in slices_of(batch, 1, PACKED_BYTES):
                (h, index, place, most, least), segments = find_anchors(_unpack(own.column(1)), n, gram)
                dk = own.column(0).to_numpy()[index.astype(np.int64)]
                cols = [h.astype(np.uint64).view(np.int64), np.array(segments, np.uint64).view(np.int64), dk, place.astype(np.int64), most.astype(np.int32), least.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h", "s", "dk", "a", "most", "least"])

    return run


def _cut_segments(n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            for own in slices_of(batch, 0, PACKED_BYTES):
                out = []
                for t, parts in zip(_unpack(own.column(0)), own.column(1).to_pylist()):
                    out += [(p["h"], p["s"], p["c"], p["most"], p["least"], t[p["a"] - p["most"] : p["a"] - p["least"] + n]) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], names=["h", "s", "c", "most", "least", "seg"])

    return run


def repeated_offsets(segs: list[bytes], most: list[int], least: list[int], n: int = N, gram: int = GRAM) -> list[list[int]]:
    """For each segment the offsets (ascending) whose windows occur in another segment of the group too."""
    right = [s[m:] for s, m in zip(segs, most)]
    left = [s[:m][::-1] for s, m in zip(segs, most)]
    k = len(segs)
    low, high = min(least), max(most)
    offsets = np.arange(low, high + 1)
    classes = []
    for strings, need in ((right, n - offsets), (left, offsets)):
        # all suffixes share their gram, so the shallow sort starts behind it
        order = deep_shallow_order(strings, start=gram if strings is right and len(set(s[:gram] for s in strings)) == 1 else 0)
        apart = np.array(neighbour_lcps(strings, order))[:, None] < need[None, :]
        own = np.empty((k, len(offsets)), np.int64)
        own[order] = np.cumsum(apart, axis=0)
        classes.append(own)
    both = (classes[0] * (k + 1) + classes[1]) * len(offsets) + np.arange(len(offsets))
    inside = (offsets >= np.array(least)[:, None]) & (offsets <= np.array(most)[:, None])
    _, back, count = np.unique(both[inside], return_inverse=True, return_counts=True)
    twice = np.zeros(both.shape, bool)
    twice[inside] = count[back] > 1
    return [offsets[row].tolist() for row in twice]


def ranges_of(offsets: list[int], n: int = N) -> list[int]:
    """Covered bytes relative to the anchor, as start, end, start, end..., for ascending offsets."""
    out: list[int] = []
    for o in reversed(offsets):
        if out and -o <= out[-1]:
            out[-1] = n - o
        else:
            out += [-o, n - o]
    return out


def _sort_groups(n: int, gram: int):
    """Rows (h, s, c, most, least, seg) sorted by h; a group never exceeds most_in_group rows."""

    def solve(rows: list[tuple]) -> list[tuple]:
        if len(rows) < 2:
            return []
        found = repeated_offsets([r[5] for r in rows], [r[3] for r in rows], [r[4] for r in rows], n, gram)
        return [(r[0], r[1], ranges_of(o, n)) for r, o in zip(rows, found) if o and r[2] == 1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[0][0] != row[0]:
                    out += solve(group)
                    group = []
                group.append(row)
            yield _ranges_batch(out)
        yield _ranges_batch(solve(group))

    return run


RANGES = "h long, s long, ranges array<int>"


def _ranges_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=["h", "s", "ranges"])


def _crowded_ranges(space: Workspace, segs: DataFrame, n: int, gram: int) -> DataFrame:
    """h, s, ranges for grams with too many segments.

    Offsets are cut into bands. Segments that share the bytes common to all windows of a band go on; those that agree on
    the band's whole bytes are repeated there and stand as one row from then on; only what is left is dealt window by
    window. All counts have partial sums.
    """
    width = -(-(n - gram + 1) // BANDS)
    two = lambda x: F.struct(F.xxhash64(x).alias("x"), F.xxhash64(F.lit(7), x).alias("y"))
    low, high = F.col("j") * width, F.least((F.col("j") + 1) * width - 1, F.lit(n - gram))
    bands = segs.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))).where((high >= F.col("least")) & (low <= F.col("most")))
    core = F.expr(f"substring(seg, most - j * {width} + 1, {n} - (least(j * {width} + {width - 1}, {n - gram}) - j * {width}))")
    bands = bands.withColumns({"x": F.greatest(low, F.col("least")), "y": F.least(high, F.col("most"))})
    whole = F.expr(f"substring(seg, most - y + 1, {n} + y - x)")
    bands = space.put(bands.select("h", "s", "c", "most", "seg", "j", "x", "y", two(core).alias("core"), two(whole).alias("whole")), "bands")
    shared = bands.groupBy("h", "j", "core").count().where("count > 1").drop("count")
    left = bands.join(space.put(shared, "shared"), ["h", "j", "core"], "left_semi")
    same = space.put(left.groupBy("h", "x", "y", "whole").agg(F.count("*").alias("same"), F.min("s").alias("one")), "same")
    left = space.put(left.join(same, ["h", "x", "y", "whole"]), "left")
    alike = left.where("same > 1 AND c = 1").select("h", "s", (-F.col("y")).alias("from"), (n - F.col("x")).alias("to"))
    windows = left.where("s = one").select("h", "s", "c", "same", F.explode(F.sequence("x", "y")).alias("o"), "seg", "most")
    windows = space.put(windows.select("h", "s", "c", "same", "o", two(F.expr(f"substring(seg, most - o + 1, {n})")).alias("w")), "windows")
    twice = space.put(windows.groupBy("h", "o", "w").count().where("count > 1").drop("count"), "twice")
    single = windows.where("c = 1 AND same = 1").join(twice, ["h", "o", "w"], "left_semi").select("h", "s", (-F.col("o")).alias("from"), (n - F.col("o")).alias("to"))
    found = alike.unionByName(single)
    # one entry a band and one a window at most; ranges that touch become one
    touching = lambda out, x: F.when(
        (F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["to"] >= x["from"]),
        F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.try_element_at(out, F.lit(-1))["from"].alias("from"), F.greatest(F.try_element_at(out, F.lit(-1))["to"], x["to"]).alias("to")))),
    ).otherwise(F.concat(out, F.array(x)))
    listed = found.groupBy("h", "s").agg(F.sort_array(F.collect_list(F.struct(F.col("from").cast("int").alias("from"), F.col("to").cast("int").alias("to")))).alias("x"))
    one = F.aggregate("x", F.array().cast("array<struct<from: int, to: int>>"), touching)
    return listed.select("h", "s", F.flatten(F.transform(one, lambda x: F.array(x["from"], x["to"]))).alias("ranges"))


def repeat_spans(space: Workspace, staged: DataFrame, n: int = N, gram: int = GRAM, most_in_group: int = MOST_IN_GROUP, by_route: bool = False) -> DataFrame:
    """dk, ranges: covered bytes of each document that has any, as start, end, ..., not merged. staged: dk, z (packed text).

    What is gathered for a document is a row of 40 bytes for each of its anchors, and one range or a few: an anchor comes with
    about 70 bytes of text, so both stay below the document's own size, which one row holds anyhow. by_route gives a row
    for each route as well: whole (equal segments, counted), sorted (deep-shallow sorting), crowded (bands and windows).
    """
    if not 0 < gram <= n - 1:
        raise ValueError("gram must be below n")
    occ = space.put(staged.select("dk", "z").mapInArrow(_anchors(n, gram), ANCHOR), "anchors", "lz4")
    grams = occ.groupBy("h").agg(F.count("*").alias("c"), F.min("s").alias("s0"), F.max("s").alias("s1")).where("c > 1")
    grams = space.put(grams.select("h", (F.col("s0") < F.col("s1")).alias("mixed")), "grams")
    # the joins of what grows with the documents are shuffles at every size, which adaptive execution splits where one gram is hot
    found = space.put(occ.join(grams.hint("merge"), "h"), "found", "lz4")
    space.drop("anchors")
    kinds = found.groupBy("h", "s").agg(F.count("*").alias("c"), F.min(F.struct("dk", "a", "most", "least")).alias("ref"), F.first("mixed").alias("mixed"))
    kinds = space.put(kinds, "kinds", "lz4")
    wanted = kinds.where("mixed").groupBy("ref.dk").agg(F.collect_list(F.struct("h", "s", "c", F.col("ref.a").alias("a"), F.col("ref.most").alias("most"), F.col("ref.least").alias("least"))).alias("parts"))
    segs = space.put(staged.join(wanted, "dk").select("z", "parts").mapInArrow(_cut_segments(n), "h long, s long, c long, most int, least int, seg binary"), "segments")
    crowded = space.put(segs.groupBy("h").count().where(F.col("count") > most_in_group).select("h"), "crowded")
    split = not crowded.isEmpty()
    ready = segs.join(crowded, "h", "left_anti") if split else segs
    ranges = ready.select("h", "s", "c", "most", "least", "seg").repartition("h").sortWithinPartitions("h").mapInArrow(_sort_groups(n, gram), RANGES)
    route = lambda df, name: df.withColumn("route", F.lit(name)) if by_route else df
    ranges = route(ranges, "sorted")
    if split:
        ranges = ranges.unionByName(route(_crowded_ranges(space, segs.join(crowded, "h", "left_semi"), n, gram), "crowded"))
    whole = kinds.where("c > 1").select("h", "s", F.array(-F.col("ref.most"), n - F.col("ref.least")).cast("array<int>").alias("ranges"))
    ranges = space.put(ranges.unionByName(route(whole, "whole")), "ranges")
    space.drop("segments")
    own = ["dk", "route"] if by_route else ["dk"]
    spans = found.join(ranges.hint("merge"), ["h", "s"]).select(*own, F.transform("ranges", lambda x: F.col("a") + x).alias("ranges"))
    spans = space.put(spans.groupBy(*own).agg(F.flatten(F.collect_list("ranges")).alias("ranges")), "spans")
    space.drop_others("docs", "staged", "spans")
    return spans


def merged(ranges: list[int] | np.ndarray | None) -> list[tuple[int, int]]:
    """Maximal runs covered by start, end, start, end, ..."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(ranges[::2], ranges[1::2])) if ranges is not None else []:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_out(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in spans)]
    return b"".join(text[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(text)]))


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for own in slices_of(batch, 1, PACKED_BYTES):
            out = []
            for t, r in zip(_unpack(own.column(1)), own.column(2)):
                spans = merged(r.values.to_numpy().tolist() if r.is_valid else None)
                out.append((len(t), sum(b - a for a, b in spans), len(spans), hashlib.sha256(cut_out(t, spans)).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([own.column(0), *(pa.array([r[j] for r in out], t) for j, t in enumerate(kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _stage(space: Workspace, docs: DataFrame, key: str, text_col: str) -> DataFrame:
    return space.put(docs.select(F.col(key).alias("dk"), F.col(text_col).alias("text")).mapInArrow(_pack, "dk long, z binary"), "staged", "none")


def repeat_digests(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, gram: int = GRAM, most_in_group: int = MOST_IN_GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    space = Workspace(spark, "repeats")
    keyed = docs.select(F.struct(F.monotonically_increasing_id().alias("dk"), F.col(id_col).cast("long").alias("doc_id")).alias("k"), F.col(text_col).alias("text"))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pack(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["k", "z"])

    kept = space.put(keyed.mapInArrow(pack, "k struct<dk: long, doc_id: long>, z binary").select("k.dk", "k.doc_id", "z"), "staged", "none")
    spans = repeat_spans(space, kept.select("dk", "z"), n, gram, most_in_group)
    joined = kept.join(spans.hint("merge"), "dk", "left").select("doc_id", "z", "ranges")
    return joined.mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def route_figures(spark: SparkSession, docs: DataFrame, text_col: str = "text", n: int = N, gram: int = GRAM, most_in_group: int = MOST_IN_GROUP) -> DataFrame:
    """route, n_bytes: bytes that each route covers; a byte that several cover counts for each."""
    space = Workspace(spark, "repeats_figures")
    staged = _stage(space, docs.select(F.monotonically_increasing_id().alias("__sd_key"), F.col(text_col).alias("__sd_text")), "__sd_key", "__sd_text")
    spans = repeat_spans(space, staged, n, gram, most_in_group, by_route=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [sum(b - a for a, b in merged(r.values.to_numpy().tolist())) for r in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["route", "n"])

    return spans.select("route", "ranges").mapInArrow(run, "route string, n long").groupBy("route").agg(F.sum("n").alias("n_bytes"))


def without_repeats(spark: SparkSession, docs: DataFrame, text_col: str = "text", n: int = N, gram: int = GRAM, most_in_group: int = MOST_IN_GROUP) -> DataFrame:
    """docs with repeated passages cut out of the text column; every row stays, a null text stays null."""
    space = Workspace(spark, "repeats_docs")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = space.put(docs.select(F.monotonically_increasing_id().alias("__sd_key"), row.alias("__sd_row")), "docs")
    text = F.col(f"__sd_row.`{text_col}`")
    staged = _stage(space, rows.select("__sd_key", text.alias("__sd_text")), "__sd_key", "__sd_text")
    spans = repeat_spans(space, staged, n, gram, most_in_group).withColumnRenamed("dk", "__sd_key")

    joined = rows.join(spans.hint("merge"), "__sd_key", "left").select("ranges", "__sd_row")
    at = docs.columns.index(text_col)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in slices_of(batch, batch.column(1).field(at), TEXT_BYTES):
                cols, out = own.column(1).flatten(), []
                for t, r in zip(cols[at], own.column(0)):
                    t = t.as_py()
                    if t is not None and r.is_valid:
                        t = cut_out(t.encode(), merged(r.values.to_numpy().tolist())).decode("utf-8", "ignore")
                    out.append(t)
                cols[at] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=docs_names)

    docs_names = list(docs.columns)
    schema = docs.select(*[F.col(f"`{c}`") for c in docs.columns]).schema
    return joined.mapInArrow(cut, schema)
