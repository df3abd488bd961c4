"""Media columns in Ogg: texts stored as 8-bit samples in an Ogg stream, read back page by page.

The writer interleaves two logical streams page by page: samples (a header packet, then packets of 576 samples) and notes (a
header packet, then a cue after each page of samples, which names the position reached). The reader verifies each page's
checksum, rebuilds packets from lacing values over page borders, separates the logical streams by serial number and derives
the time of every packet: a page's granule position is that of the last packet that ends on it, the packets before it
end earlier by the lengths of those behind them, and on a last page that is cut short time runs forward up to its position.

The media column is written to a table in the shared folder and probed from there; both jobs are one projection each, with
no shuffle, and hold a few documents of an Arrow batch at a time.

Defined results: a null text counts as empty and is stored as 576 fill bytes; very long texts use more pages; repeated rows
give equal values; an empty table gives an empty result; other columns are not read. Damaged media raise OggError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import Workspace, slices_of

PACKET = 576
RATE = 8000
FILL = b"\xff"
SAMPLES, NOTES = 0x53414D50, 0x4E4F5445
HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
#: Each byte with its bits reversed. Ogg's checksum runs from the high bit, zlib's from the low one.
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    pass


def page_crc(page: bytes) -> int:
    """Ogg's checksum (polynomial 0x04C11DB7, start 0, high bit first) through zlib's reflected one on bit-reversed bytes."""
    low_first = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(low_first.to_bytes(4, "little").translate(REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def pages_of(packets: list[bytes], granules: list[int], serial: int) -> list[bytes]:
    """A logical stream's pages: the first packet alone on the first page, the others filled up to 255 lacing values a page.

    A page's granule position is that of the last packet that ends on it, -1 where none ends.
    """
    out = [_page(FIRST | (LAST if len(packets) == 1 else 0), granules[0], serial, 0, bytes([255] * (len(packets[0]) // 255) + [len(packets[0]) % 255]), packets[0])]
    sizes = np.array([len(p) for p in packets[1:]], np.int64)
    if not len(sizes):
        return out
    body = b"".join(packets[1:])
    counts = sizes // 255 + 1
    lacing = np.full(int(counts.sum()), 255, np.uint8)
    ends = np.cumsum(counts) - 1
    lacing[ends] = sizes % 255
    at = 0
    for k in range(0, len(lacing), 255):
        own = lacing[k : k + 255]
        n = int(own.sum())
        done = int(np.searchsorted(ends, k + len(own)))
        flags = (CONTINUED if k and lacing[k - 1] == 255 else 0) | (LAST if k + 255 >= len(lacing) else 0)
        began = int(np.searchsorted(ends, k))
        out.append(_page(flags, granules[done] if done > began else -1, serial, len(out), own.tobytes(), body[at : at + n]))
        at += n
    return out


def mux(payload: bytes, packet_bytes: int = PACKET, rate: int = RATE) -> bytes:
    """The payload as one physical stream. Equal payloads give equal bytes."""
    cut = [payload[k : k + packet_bytes] for k in range(0, len(payload), packet_bytes)]
    head = b"\x01pcm8" + struct.pack("<BII", 1, rate, packet_bytes)
    first, *samples = pages_of([head, *cut], [0, *(min((k + 1) * packet_bytes, len(payload)) for k in range(len(cut)))], SAMPLES)
    note_head = b"\x01note"
    out, reached = [first, _page(FIRST, 0, NOTES, 0, bytes([len(note_head)]), note_head)], 0
    for k, page in enumerate(samples, 1):
        ends_at = HEAD.unpack_from(page)[3]
        reached = ends_at if ends_at >= 0 else reached
        cue = b"CUE=%d;SAMPLES=%d;OF=%d" % (k, reached, len(payload))
        out += [page, _page(LAST if k == len(samples) else 0, reached, NOTES, k, bytes([len(cue)]), cue)]
    return b"".join(out)


class Stream:
    """A logical stream: its packets, and for each the granule position at which it ends (times); position is that of the last."""

    def __init__(self, serial: int):
        self.serial, self.packets, self.times, self.part = serial, [], [], []
        self.pages, self.ended, self.position, self.frame = 0, False, 0, 0

    def lengths(self, packets: list[bytes]) -> np.ndarray:
        """How long each packet plays, in granules. Header packets and notes take no time."""
        if not self.frame and not self.packets and packets[0].startswith(b"\x01pcm8") and len(packets[0]) >= 14:
            self.frame = packets[0][5] or 1
            return np.array([0, *(len(p) // self.frame for p in packets[1:])], np.int64)
        return np.array([len(p) // self.frame if self.frame else 0 for p in packets], np.int64)

    def add(self, packets: list[bytes], granule: int, last: bool) -> None:
        """Packets that end on one page, in order."""
        own = self.lengths(packets)
        forward = self.position + np.cumsum(own)
        cut_short = last and granule < int(forward[-1])
        # the last packet ends at the page's position; each one before, earlier by what follows it
        times = np.minimum(forward, granule) if cut_short else granule - (int(own.sum()) - np.cumsum(own))
        self.packets += packets
        self.times += times.tolist()
        self.position = granule


def demux(media: bytes) -> dict[int, Stream]:
    """The logical streams with their packets and the time of each packet."""
    streams: dict[int, Stream] = {}
    at, n = 0, len(media)
    while at < n:
        if n - at < HEAD.size:
            raise OggError(f"a page is cut short at {at}")
        magic, version, flags, granule, serial, number, crc, segments = HEAD.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at {at}")
        start = at + HEAD.size + segments
        lacing = np.frombuffer(media, np.uint8, segments, at + HEAD.size) if start <= n else np.zeros(0, np.uint8)
        end = start + int(lacing.sum())
        if start > n or end > n:
            raise OggError(f"a page is cut short at {at}")
        if page_crc(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != crc:
            raise OggError(f"checksum of the page at {at}")
        if flags & FIRST:
            if serial in streams:
                raise OggError(f"stream {serial} begins twice")
            streams[serial] = Stream(serial)
        s = streams.get(serial)
        if s is None or s.ended or number != s.pages:
            raise OggError(f"page {number} of stream {serial} is out of place")
        if bool(flags & CONTINUED) != bool(s.part):
            raise OggError(f"page {number} of stream {serial} doesn't continue the packet before")
        s.pages += 1
        stops = np.flatnonzero(lacing < 255)
        borders = np.cumsum(lacing, dtype=np.int64)[stops] + start if len(stops) else stops
        done = []
        for stop in borders.tolist():
            done.append(b"".join([*s.part, media[start:stop]]) if s.part else media[start:stop])
            s.part, start = [], stop
        if bool(done) != (granule >= 0):
            raise OggError(f"page {number} of stream {serial} has a granule position that doesn't fit its packets")
        if done:
            s.add(done, granule, bool(flags & LAST))
        if start < end or (segments and lacing[-1] == 255):
            s.part.append(media[start:end])
        if flags & LAST:
            if s.part:
                raise OggError(f"stream {serial} ends inside a packet")
            s.ended = True
        at = end
    if any(not s.ended for s in streams.values()):
        raise OggError("a stream has no last page")
    return streams


def payload_of_text(text: str | None, unit: int = PACKET) -> bytes:
    data = (text or "").encode()
    return data + FILL * (unit - len(data) % unit if len(data) % unit or not data else 0)


def probe(media: bytes) -> dict:
    """What the stored bytes hold: the payload with its digests, and features of its samples."""
    streams = demux(media)
    s = streams[SAMPLES]
    channels, rate, unit = struct.unpack("<BII", s.packets[0][5:14])
    payload = b"".join(s.packets[1:])
    if s.times[1:] != (np.cumsum([len(p) for p in s.packets[1:]]) // channels).tolist():
        raise OggError("the granule positions don't match the samples")
    notes = streams[NOTES]
    if any(int(p.split(b"SAMPLES=")[1].split(b";")[0]) != t for p, t in zip(notes.packets[1:], notes.times[1:])):
        raise OggError("a cue isn't at its time")
    x = np.frombuffer(payload, np.uint8)
    high = x > 127
    middle = s.times[(len(s.times) - 1) // 2]
    feature = (
        f"packets={len(s.packets) - 1};pages={s.pages};cues={len(notes.packets) - 1};ms={s.times[-1] * 1000 // rate};middle_ms={middle * 1000 // rate}"
        f";sum={int(x.sum(dtype=np.int64))};high={int(high.sum())};turns={int((high[1:] != high[:-1]).sum())};peak={int(x.max())}"
    )
    return {
        "n_bytes": len(payload.rstrip(FILL)),
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-32:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": feature,
    }


def _encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for own in slices_of(batch, 1, 4 << 20):
            media = pa.array([mux(payload_of_text(t)) for t in own.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([own.column(0), media], names=["id", "media"])


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, media: each text as an Ogg stream."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_encode, "id long, media binary")


PROBED = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for own in slices_of(batch, 1, 4 << 20):
            out = defaultdict(list)
            for media in own.column(1):
                for k, v in probe(media.as_buffer().to_pybytes()).items():
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([own.column(0), *map(pa.array, out.values())], names=["id", *out])


def probe_media(media: DataFrame) -> DataFrame:
    """id and the probe's columns for rows of (id, media)."""
    return media.select("id", "media").mapInArrow(_probe, PROBED)


def store_and_probe(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the media table to the shared folder, then probe what is stored."""
    stored = Workspace(spark, "ogg").put(encode_texts(docs, id_col, text_col), "media")
    return probe_media(stored).withColumnRenamed("id", "doc_id")
