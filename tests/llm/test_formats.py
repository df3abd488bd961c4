"""Token shards, Ogg media and pieces, without Spark where none is needed."""

import hashlib
import io
import json
import random
import struct
import zlib

import numpy as np
import pytest

from lectern.llm import ogg, pieces, registry, sst

ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \n b", "\n\n  x\t y", "é ü ß — “q” don't I'll", "日本 語 テスト", "a  b  c", "x" * 5000,
    "12 345 6,7.8 $9", "😀 🤖x", "▁ a▁b", "\x00 q\x00", "<|endoftext|> <s> </s>", " 　 x", "tab\tsep \t z", "a\x1c b \x1cc", "\r\n a\r\n", "  lead", "trail  ", "a   b    c     d",
]


def texts(n=60):
    r = random.Random(5)
    alphabet = ["the", "Of", " ", "  ", "\n", "\t", "é", "ing", "12", ".", ",", "'s", "日", " ", "a", "!", "###"]
    return ODD + ["".join(r.choice(alphabet) + (" " if r.random() < 0.4 else "") for _ in range(r.randint(0, 80))) for _ in range(n)]


def test_word_encoder_equals_library():
    from tokenizers import Tokenizer

    path = registry.tokenizer_path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    own = [*texts(), "a <|endoftext|> b", "a  <|endoftext|>", "<|endoftext|><|endoftext|>", "x<|endoftext|>y z", "<|endoftext", "word " * 3000 + "<|endoftext|>"]
    want = [e.ids for e in plain.encode_batch(own, add_special_tokens=False)]
    assert want[own.index("a <|endoftext|> b")] == [64, 220, 50256, 275]
    encoder = sst.WordEncoder(path)
    assert encoder.by_word
    got = [np.frombuffer(b, "<u2").tolist() for b in encoder.encode(own)]
    assert got == want and encoder.by_word
    assert encoder.encode([None]) == [b""] and encoder.encode([]) == []
    # a table of words that is always full, and one text at a time, change nothing
    small = sst.WordEncoder(path)
    small.MOST_BYTES = 0
    assert [np.frombuffer(small.encode([t])[0], "<u2").tolist() for t in own] == want


def test_word_encoder_leaves_other_tokenizers_to_the_library(tmp_path):
    """A tokenizer whose words depend on what surrounds them is never cut into words."""
    from tokenizers import Tokenizer

    made = json.loads(Tokenizer.from_file(registry.tokenizer_path("byte_bpe_50k.json")).to_str())
    made["pre_tokenizer"]["use_regex"] = False
    (tmp_path / "t.json").write_text(json.dumps(made))
    encoder = sst.WordEncoder(str(tmp_path / "t.json"))
    plain = Tokenizer.from_file(str(tmp_path / "t.json"))
    own = texts(20)
    assert not encoder.by_word
    assert [np.frombuffer(b, "<u2").tolist() for b in encoder.encode(own)] == [e.ids for e in plain.encode_batch(own, add_special_tokens=False)]


def test_agenda_equals_library():
    path = registry.tokenizer_path("piece_bpe_32k.model")
    agenda = pieces.Agenda(path)
    assert agenda.by_word
    want = agenda.library.encode(texts(), num_threads=1)
    assert [ids for _, ids in agenda.encode_batch(texts())] == want
    assert [agenda.merge(agenda.escape(t)) for t in texts()] == want
    assert [j for j, _ in agenda.encode_batch(["", None])] == ["", ""]
    # tables of words that are always full change nothing
    agenda.MOST_BYTES = 0
    assert [agenda.encode_batch([t])[0][1] for t in texts()] == want and not agenda.differing and agenda.by_word


@pytest.mark.parametrize("unit", [1, 254, 255, 256, 576, 70000])
def test_ogg_round_trip(unit):
    r = random.Random(unit)
    for n in (1, 254, 255, 576, 70001, 200_000):
        payload = r.randbytes(n)
        media = ogg.mux(payload, unit) if n // unit < 5000 else None
        if media:
            streams = ogg.demux(media)
            assert b"".join(streams[ogg.SAMPLES].packets[1:]) == payload
            assert [len(p) for p in streams[ogg.SAMPLES].packets[1:]] == [min(unit, n - k) for k in range(0, n, unit)]
            ends = [min(k + unit, n) for k in range(0, n, unit)]
            assert streams[ogg.SAMPLES].times == [0, *ends]
            notes = streams[ogg.NOTES]
            assert [int(p.split(b"SAMPLES=")[1].split(b";")[0]) for p in notes.packets[1:]] == notes.times[1:] and notes.times[-1] == n
            assert len(notes.packets) == streams[ogg.SAMPLES].pages


def plain_pages(media):
    """(flags, granule, serial, number, lacing, body) of each page, read byte by byte."""
    at = 0
    while at < len(media):
        assert media[at : at + 4] == b"OggS" and media[at + 4] == 0
        flags = media[at + 5]
        granule = int.from_bytes(media[at + 6 : at + 14], "little", signed=True)
        serial, number = struct.unpack("<II", media[at + 14 : at + 22])
        n = media[at + 26]
        lacing = list(media[at + 27 : at + 27 + n])
        start = at + 27 + n
        yield flags, granule, serial, number, lacing, media[start : start + sum(lacing)]
        at = start + sum(lacing)


def test_streams_are_interleaved():
    serials = [p[2] for p in plain_pages(ogg.mux(b"x" * 576 * 300))]
    assert len(serials) == 10 and serials == [ogg.SAMPLES, ogg.NOTES] * 5


def test_last_page_cut_short():
    """A last page may name an earlier position than its packets reach: the rest of the last packet isn't played."""
    head = b"\x01pcm8" + struct.pack("<BII", 1, 8000, 100)
    pages = ogg.pages_of([head, *[b"x" * 100] * 200], [0, *range(100, 20_100, 100)], 7)
    flags, _, serial, number, lacing, body = list(plain_pages(pages[-1]))[0]
    pages[-1] = ogg._page(flags, 19_930, serial, number, bytes(lacing), body)
    assert ogg.demux(b"".join(pages))[7].times == [0, *range(100, 20_000, 100), 19_930]


def test_probe_equals_brute_force():
    r = random.Random(4)
    for text in ["", "abc", "é" * 700, "".join(r.choice("aé日 \n") for _ in range(90_000))]:
        data = ogg.payload_of_text(text)
        media = ogg.mux(data)
        parts, sizes, pages, cues = [], [], 0, 0
        for _, _, serial, number, lacing, body in plain_pages(media):
            if serial == ogg.SAMPLES:
                pages += 1
                if number:
                    parts.append(body)
                    sizes += lacing
            elif number:
                cues += 1
        payload, packets, size = b"".join(parts), [], 0
        for x in sizes:
            size += x
            if x < 255:
                packets.append(size)
                size = 0
        assert payload == data
        ends = [sum(packets[: k + 1]) for k in range(len(packets))]
        bits = [b > 127 for b in payload]
        want = {
            "packets": len(packets), "pages": pages, "cues": cues, "ms": ends[-1] * 1000 // 8000, "middle_ms": ([0, *ends])[len(packets) // 2] * 1000 // 8000,
            "sum": sum(payload), "high": sum(bits), "turns": sum(a != b for a, b in zip(bits, bits[1:])), "peak": max(payload),
        }
        got = ogg.probe(media)
        assert got["feature"] == ";".join(f"{k}={v}" for k, v in want.items())
        assert got["media_bytes"] == len(media) and got["media_sha256"] == hashlib.sha256(media).hexdigest()


def test_ogg_crc_is_the_plain_one():
    def plain(data):
        crc = 0
        for b in data:
            crc ^= b << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
        return crc

    for data in (b"", b"a", bytes(range(256)) * 3):
        assert ogg.page_crc(data) == plain(data)


def test_ogg_damage_is_found():
    media = bytearray(ogg.mux(b"x" * 1000))
    for at in (5, 30, len(media) - 1):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(ogg.OggError):
            ogg.demux(bytes(bad))
    with pytest.raises(ogg.OggError):
        ogg.demux(bytes(media[:-3]))


def test_probe_values():
    for text in ["", None, "abc", "é" * 400, "x" * 576]:
        data = ogg.payload_of_text(text)
        got = ogg.probe(ogg.mux(data))
        raw = (text or "").encode()
        assert got["n_bytes"] == len(raw) and got["payload_bytes"] % 576 == 0 and got["payload_bytes"] > 0
        assert got["payload_sha256"] == hashlib.sha256(raw + b"\xff" * (got["payload_bytes"] - len(raw))).hexdigest()
        assert got["tail_crc32"] == zlib.crc32(data[-32:])


def test_shard_lookup_and_order():
    r = random.Random(1)
    keys = sorted([sst.key_of(k) for k in [None, -5, 0, 7, 7, 1 << 40, *range(100, 3000, 3)]])
    values = [r.randbytes(2 * r.randint(0, 300)) for _ in keys]
    file = io.BytesIO()
    writer = sst.ShardWriter(file, 2, block_bytes=2000)
    for k, v in zip(keys, values):
        writer.add(k, v)
    writer.close()
    shard = sst.ShardReader(file)
    assert list(shard) == list(zip(keys, values)) and len(shard.places) > 50
    for d in (None, -5, 0, 7, 100, 103, 2998, 1 << 40):
        assert shard.get(sst.key_of(d)) == [v for k, v in zip(keys, values) if k == sst.key_of(d)]
    absent = [sst.key_of(k) for k in range(101, 3000, 3)]
    assert all(not shard.get(k) for k in absent) and sum(shard.may_hold(k, 0) for k in absent) < 40 and len(shard.filters) == 1
    with pytest.raises(ValueError):
        writer.add(b"", b"")


def test_shard_with_many_filters(monkeypatch):
    monkeypatch.setattr(sst, "FILTER_KEYS", 40)
    keys = [sst.key_of(k) for k in range(0, 2000, 2)]
    file = io.BytesIO()
    writer = sst.ShardWriter(file, 2, block_bytes=300)
    for k in keys:
        writer.add(k, k)
    assert len(writer.keys) < 100
    writer.close()
    shard = sst.ShardReader(file)
    assert len(shard.filters) > 15 and all(shard.get(k) == [k] for k in keys) and not any(shard.get(sst.key_of(k)) for k in range(-5, 2005, 2))
