"""Sorted-string-table shards of token ids.

A shard is one file:

    data blocks   entries (shared key bytes, own key bytes, value bytes as varints; key suffix; value), prefix-compressed
                  against the key before, restarted in each block; the block is zstd-compressed and ends with a crc32
    Bloom filters k bits a key, one filter for each run of blocks with about FILTER_KEYS keys
    index block   for each data block its first key, last key, offset, length and number of filter (sparse: one entry a block)
    filter index  offset and bits of each filter
    footer        fixed size: places of the index and the filter index, counts, id width, checksum, magic

Keys are document ids as 8 big-endian bytes with the sign bit turned, so byte order is number order; a null id is the empty
key and sorts first. A lookup takes the shards whose key range in the manifest holds the key, then reads footer, index,
one filter and one block.

Layout of the job: rows are dealt by range of (id, hash of the text), so that shards hold consecutive ids and a hot id is
split too, then sorted inside the task and streamed into the file; memory holds one data block, the keys of one filter and
the sparse index. A task writes under a name of its own attempt and its manifest row names the file, so lost or repeated
attempts leave only files nobody reads.

Ids are the library's with the tokenizer as loaded and add_special_tokens=False: added tokens in a text become their ids.

Defined results: null and empty texts give just the end id; repeated ids give one entry each, ordered by hash of the text;
an empty table gives no shards and an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import bisect
import functools
import io
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import Workspace, slices_of

MAGIC = b"LSST0002"
FOOTER = struct.Struct("<QQQQQQII8s")
FILTER = struct.Struct("<QQ")
BLOCK_BYTES = 256 * 1024
#: Texts are encoded in slices of about so many bytes.
SLICE_BYTES = 4 << 20
BLOOM_BITS_PER_KEY = 10
BLOOM_HASHES = 7
#: A filter is closed at the end of the block in which it has so many keys.
FILTER_KEYS = 1 << 16
MANIFEST = "part int, path string, n_docs long, n_ids long, n_bytes long, first_key binary, last_key binary"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path inside it, for a local path or any URI that Arrow opens."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Takes (key, value) pairs in ascending key order."""

    def __init__(self, out, id_bytes: int, block_bytes: int = BLOCK_BYTES):
        import zstandard

        self.out, self.id_bytes, self.block_bytes = out, id_bytes, block_bytes
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.at = self.n = self.n_ids = 0
        self.block, self.size, self.first, self.last = [], 0, b"", b""
        self.least = b""
        self.index: list[bytes] = []
        #: Keys of the open filter; place and bits of the closed ones.
        self.keys: list[bytes] = []
        self.filters: list[bytes] = []

    def add(self, key: bytes, value: bytes) -> None:
        if self.n and key < self.last:
            raise ValueError("keys must come in ascending order")
        if not self.n:
            self.least = key
        if self.block:
            shared = len(os.path.commonprefix((self.last, key)))
        else:
            shared, self.first = 0, key
        self.block += (_varint(shared), _varint(len(key) - shared), _varint(len(value)), key[shared:], value)
        self.size += len(value) + len(key) + 6
        self.last = key
        self.n += 1
        self.n_ids += len(value) // self.id_bytes
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        if self.size >= self.block_bytes:
            self._flush()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _flush(self) -> None:
        if self.block:
            data = self.pack(b"".join(self.block))
            place = self.at
            self._write(data + struct.pack("<I", zlib.crc32(data)))
            number = _varint(len(self.filters))
            self.index.append(_varint(len(self.first)) + self.first + _varint(len(self.last)) + self.last + _varint(place) + _varint(len(data)) + number)
            self.block, self.size = [], 0
            if len(self.keys) >= FILTER_KEYS:
                self._close_filter()

    def _close_filter(self) -> None:
        bits = max(64, BLOOM_BITS_PER_KEY * len(self.keys))
        bloom = np.zeros((bits + 7) // 8, np.uint8)
        for key in self.keys:
            for p in _bloom_places(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.filters.append(FILTER.pack(self.at, bits))
        self._write(bloom.tobytes())
        self.keys = []

    def close(self) -> None:
        self._flush()
        if self.keys:
            self._close_filter()
        index, index_at = b"".join(self.index), self.at
        self._write(index)
        filters_at = self.at
        self._write(b"".join(self.filters))
        self._write(FOOTER.pack(index_at, len(index), filters_at, len(self.filters), self.n, self.n_ids, self.id_bytes, zlib.crc32(index), MAGIC))


class ShardReader:
    """Reads one shard from a seekable file."""

    def __init__(self, file):
        import zstandard

        self.file, self.unpack = file, zstandard.ZstdDecompressor().decompress
        self.file.seek(0, io.SEEK_END)
        end = self.file.tell()
        index_at, index_len, filters_at, n_filters, self.n_docs, self.n_ids, self.id_bytes, crc, magic = FOOTER.unpack(self._at(end - FOOTER.size, FOOTER.size))
        index = self._at(index_at, index_len)
        if magic != MAGIC or zlib.crc32(index) != crc:
            raise ValueError("not a whole shard")
        self.filters = list(FILTER.iter_unpack(self._at(filters_at, n_filters * FILTER.size)))
        self.blooms: dict[int, bytes] = {}
        self.firsts, self.lasts, self.places, self.filter_of, at = [], [], [], [], 0
        while at < len(index):
            n, at = _read_varint(index, at)
            self.firsts.append(index[at : at + n])
            n, at = _read_varint(index, at + n)
            self.lasts.append(index[at : at + n])
            place, at = _read_varint(index, at + n)
            n, at = _read_varint(index, at)
            self.places.append((place, n))
            n, at = _read_varint(index, at)
            self.filter_of.append(n)

    def _at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        return self.file.read(n)

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        place, n = self.places[k]
        data = self._at(place, n + 4)
        if struct.unpack("<I", data[n:])[0] != zlib.crc32(data[:n]):
            raise ValueError(f"block {k} is damaged")
        data, at, key = self.unpack(data[:n]), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own + size
            yield key, data[at - size : at]

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.places)):
            yield from self.block(k)

    def may_hold(self, key: bytes, number: int) -> bool:
        """What the filter of that number says about the key."""
        place, bits = self.filters[number]
        if number not in self.blooms:
            self.blooms[number] = self._at(place, (bits + 7) // 8)
        bloom = self.blooms[number]
        return all(bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, bits))

    def get(self, key: bytes) -> list[bytes]:
        """All values of a key: binary search in the index, then, where the filter lets it pass, the blocks that can hold it."""
        found: list[bytes] = []
        k = bisect.bisect_left(self.lasts, key)
        while k < len(self.places) and self.firsts[k] <= key:
            if self.may_hold(key, self.filter_of[k]):
                found += [v for x, v in self.block(k) if x == key]
            k += 1
        return found


class WordEncoder:
    """Ids of whole texts with the tokenizers library, a word at a time where that gives the library's ids.

    With a plain byte-level pre-tokenizer (checked on loading) no pre-token runs over a space followed by a visible character, so
    a text's ids are those of its parts cut before such spaces. Each new part is encoded by the library once, with others in
    one text, and then looked up. Texts in which an added token stands, and all texts under any other pre-tokenizer, normaliser or model, are
    encoded whole by the library. One text of each slice is encoded whole as well; should it differ, that is an error, and
    by_word=False has the library encode every text whole.

    The words are kept in two generations, so that frequent ones outlive the many that come once. A generation ends when
    its words and ids take MOST_BYTES.
    """

    MOST_BYTES = 48 << 20
    #: What an entry of a table takes besides its characters and ids.
    ENTRY_BYTES = 200
    #: New words that the library encodes as one text.
    WORDS_AT_ONCE = 1024

    def __init__(self, path: str, id_bytes: int = 2, by_word: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.kind = {2: "<u2", 4: "<u4"}[id_bytes]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.young_bytes = 0
        made = json.loads(self.tok.to_str())
        before = made.get("pre_tokenizer") or {}
        added = made.get("added_tokens") or []
        self.by_word = (
            by_word
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and made.get("normalizer") is None
            and made["model"].get("type") == "BPE"
            and not made["model"].get("dropout")
        )
        self.added = [t["content"] for t in added]
        feed = self.tok.encode("\n", add_special_tokens=False).ids
        #: The id of a line feed, if it is a single one.
        self.feed = feed[0] if len(feed) == 1 else None

    def _encode(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tok.encode_batch_fast(parts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of different words, each with a space before it.

        Words without white space go to the library by the thousand, parted by a line feed: the pre-tokenizer cuts before and behind one, its
        own piece stands for nothing else, and its places part the ids. Should there be more or fewer of them, each word goes by itself.
        """
        out = [b""] * len(words)
        plain = [k for k, w in enumerate(words) if w.split() == [w]] if self.feed is not None else []
        groups = [plain[k : k + self.WORDS_AT_ONCE] for k in range(0, len(plain), self.WORDS_AT_ONCE)]
        width, single = np.dtype(self.kind).itemsize, set(range(len(words))).difference(plain)
        for group, found in zip(groups, self.tok.encode_batch_fast([" " + "\n ".join([words[k] for k in group]) for group in groups], add_special_tokens=False)):
            ids = np.array(found.ids, self.kind)
            cuts = np.flatnonzero(ids == self.feed)
            if len(cuts) != len(group) - 1:
                single.update(group)
                continue
            data, starts, ends = ids.tobytes(), [0, *((cuts + 1) * width).tolist()], [*(cuts * width).tolist(), len(ids) * width]
            for k, a, b in zip(group, starts, ends):
                out[k] = data[a:b]
        rest = sorted(single)
        for k, ids in zip(rest, self._encode([" " + words[k] for k in rest])):
            out[k] = ids
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian numbers."""
        whole = [t or "" for t in texts]
        if not self.by_word:
            return self._encode(whole)
        marked = [k for k, t in enumerate(whole) if any(a in t for a in self.added)]
        plain = [k for k, t in enumerate(whole) if t] if not marked else sorted({k for k, t in enumerate(whole) if t} - set(marked))
        out = [b""] * len(whole)
        for own, by in ((marked, self._encode), (plain, self._by_words)):
            for k, ids in zip(own, by([whole[k] for k in own])):
                out[k] = ids
        if plain and self._encode([whole[plain[0]]])[0] != out[plain[0]]:
            raise ValueError("this tokenizer's ids of a text aren't those of its words: encode with by_word=False")
        return out

    def _look_up(self, words: list[str]) -> list[bytes]:
        """Ids of words, each with a space before it."""
        if self.young_bytes > self.MOST_BYTES:
            self.young, self.old, self.young_bytes = {}, self.young, 0
        young, old, grown = self.young, self.old, 0
        found, new = list(map(young.get, words)), []
        for k in [k for k, f in enumerate(found) if f is None]:
            w = words[k]
            if (f := old.get(w)) is None:
                new.append(k)
                continue
            found[k] = young[w] = f
            grown += len(w) + len(f) + self.ENTRY_BYTES
        for k, f in zip(new, self._encode_words([words[k] for k in new])):
            found[k] = young[words[k]] = f
            grown += len(words[k]) + len(f) + self.ENTRY_BYTES
        self.young_bytes += grown
        return found

    def _glued(self, text: str) -> list[str]:
        """The first part, then the others without their space; parts that are empty or begin with white space stay with the part before."""
        first, *rest = text.split(" ")
        out = [first]
        for p in rest:
            if not p or p[0].isspace():
                out[-1] += " " + p
            else:
                out.append(p)
        return out

    def _by_words(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without added tokens."""
        if not texts:
            return []
        cut = pc.split_pattern(pa.array(texts, pa.string()), " ")
        at = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        words, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
        firsts = [words[k] for k in index[at[:-1]].tolist()]
        odd = np.asarray(pc.or_(pc.equal(pc.binary_length(coded.dictionary), 0), pc.utf8_is_space(pc.utf8_slice_codeunits(coded.dictionary, 0, 1))))
        for k in np.flatnonzero(odd).tolist():
            words[k] = "-"
        own = self._look_up(words) + self._encode(firsts)
        index[at[:-1]] = np.arange(len(words), len(own))
        width = np.dtype(self.kind).itemsize
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // width
        starts, ids = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(own), self.kind)
        each = sizes[index]
        ends = np.cumsum(each)
        data = ids[np.repeat(starts[index] - (ends - each), each) + np.arange(int(ends[-1]))].tobytes()
        borders = (np.concatenate([[0], ends])[at] * width).tolist()
        out = [data[a:b] for a, b in zip(borders, borders[1:])]
        if odd.any():
            # the place of a first part no longer points into words, so only parts after it count
            bad = np.append(odd, np.zeros(len(firsts), bool))[index]
            for k in np.flatnonzero(np.add.reduceat(bad, at[:-1])).tolist():
                first, *rest = self._glued(texts[k])
                out[k] = self._encode([first])[0] + b"".join(self._look_up(rest))
        return out


@functools.lru_cache(maxsize=2)
def encoder_for(path: str, id_bytes: int, by_word: bool) -> WordEncoder:
    """One encoder a worker process: its words serve later tasks too."""
    return WordEncoder(path, id_bytes, by_word)


def _writer(out_dir: str, tokenizer: str, end_id: int, id_bytes: int, by_word: bool):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, writer, stream = encoder_for(tokenizer, id_bytes, by_word), None, None
        part = TaskContext.get().partitionId()
        where = f"{out_dir}/shard-{part:06d}-{uuid.uuid4().hex}.sst"
        end = end_id.to_bytes(id_bytes, "little")
        for batch in batches:
            for own in slices_of(batch, 1, SLICE_BYTES):
                if writer is None:
                    store, path = filesystem(where)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    stream = store.open_output_stream(path)
                    writer = ShardWriter(stream, id_bytes)
                for doc_id, ids in zip(own.column(0).to_pylist(), encoder.encode(own.column(1).to_pylist())):
                    writer.add(key_of(doc_id), ids + end)
        if writer:
            writer.close()
            stream.close()
            row = {"part": part, "path": where, "n_docs": writer.n, "n_ids": writer.n_ids, "n_bytes": writer.at, "first_key": writer.least, "last_key": writer.last}
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema(list(zip(row, kinds))))

    return write


def write_shards(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", id_bytes: int = 2, by_word: bool = True) -> DataFrame:
    """Write docs as shards in ascending id order into the shared folder; the manifest, one row a shard.

    id_bytes is 2 for vocabularies of up to 65,536 ids, else 4; by_word=False has the library encode every text whole.
    """
    space = Workspace(spark, "sst")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("id", "h").sortWithinPartitions("id", "h")
    return space.put(rows.select("id", "text").mapInArrow(_writer(f"{space.path}/shards", tokenizer, end_id, id_bytes, by_word), MANIFEST), "manifest")


def _read_digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for row in batch.to_pylist():
            store, path = filesystem(row["path"])
            with store.open_input_file(path) as file:
                shard, start, out = ShardReader(file), row["before"], []
                kind = {2: "<u2", 4: "<u4"}[shard.id_bytes]
                for key, value in shard:
                    ids = np.frombuffer(value, kind)
                    out.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(out) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)


def read_digests(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document, from the shards: doc_id, start (ids of all documents before it), n_tokens and ids_crc32.

    The running sum is over the manifest, one row a shard.
    """
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("path", before.alias("before")).repartition(max(1, manifest.count()))
    return shards.mapInArrow(_read_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, doc_ids: list[int | None]) -> dict:
    """Ids of a few documents: {doc_id: list of id arrays}. Only shards whose key range holds one of them are opened."""
    keys = {d: key_of(d) for d in doc_ids}
    holds = functools.reduce(lambda a, b: a | b, [(F.col("first_key") <= F.lit(k)) & (F.lit(k) <= F.col("last_key")) for k in keys.values()], F.lit(False))
    found: dict = {d: [] for d in doc_ids}
    for row in manifest.where(holds).orderBy("part").collect():
        store, path = filesystem(row["path"])
        with store.open_input_file(path) as file:
            shard = ShardReader(file)
            for d, k in keys.items():
                if row["first_key"] <= k <= row["last_key"]:
                    found[d] += [np.frombuffer(v, {2: "<u2", 4: "<u4"}[shard.id_bytes]) for v in shard.get(k)]
    return found
