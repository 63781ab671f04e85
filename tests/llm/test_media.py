"""MPEG audio: round trips, damaged streams, checksums, other layers and versions."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from sparkloom.llm import media
from sparkloom.llm.queries import QUERIES


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 500, 513, 10_000, 300_001])
def test_round_trip(size):
    rng = random.Random(size)
    data = bytes(rng.choice((0xFF, 0xFB, 0x90, 0, rng.randrange(256))) for _ in range(size))
    payload = data + bytes(max(64, -(-size // 64) * 64) - size)
    stream = media.encode(payload)
    audio = media.decode(stream)
    assert audio.payload == payload and not audio.bad_checksums and not audio.skipped
    assert audio.table["frames"] == len(audio.offsets) and audio.samples == 1152 * len(audio.offsets)
    assert audio.seconds == audio.samples / 44100 and all(media.header(stream, a) for a in audio.offsets)


def test_resynchronises_after_damage():
    stream = media.encode(bytes(range(256)) * 60)
    clean = media.decode(stream)
    third = clean.offsets[2]
    broken = bytearray(stream)
    broken[third : third + 4] = b"\0\0\0\0"
    audio = media.decode(bytes(broken))
    assert audio.offsets == clean.offsets[:2] + clean.offsets[3:] and audio.skipped == clean.offsets[3] - third
    junk = media.decode(b"\xff\xfbjunk" + stream[media.read_tag(stream, media.Audio()) :] + b"TAG" + b"title".ljust(125, b"\0"))
    assert len(junk.offsets) == len(clean.offsets) and junk.tags["ID3v1:title"] == "title" and junk.skipped == 6
    broken = bytearray(stream)
    broken[third + 7] ^= 1
    audio = media.decode(bytes(broken))
    assert (audio.bad_checksums, audio.offsets) == (1, clean.offsets[:2] + clean.offsets[3:]) and audio.samples == clean.samples - 1152
    room = 1006
    assert audio.payload == clean.payload[: 2 * room] + bytes(room) + clean.payload[3 * room :]


def test_payload_that_looks_like_a_trailing_tag():
    for size in (1006, 4 * 1006):
        payload = bytearray(b"x" * size)
        payload[-128:-125] = b"TAG"
        stream = media.encode(bytes(payload))
        assert stream[-128:-125] == b"TAG" and media.decode(stream).payload == bytes(payload) and not media.decode(stream).skipped
        tagged = media.decode(stream + b"TAG" + b"a title".ljust(125, b"\0"))
        assert tagged.payload == bytes(payload) and tagged.tags["ID3v1:title"] == "a title"


def seven(n):
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


@pytest.mark.parametrize(
    ("head", "body", "foot"),
    [
        (b"ID3\x02\0\0", b"TT2" + (6).to_bytes(3, "big") + b"\0Title", b""),
        (b"ID3\x03\0\0", b"TT2X"[:0] + b"TIT2" + (6).to_bytes(4, "big") + b"\0\0" + b"\0Title", b""),
        (b"ID3\x03\0\x40", (6).to_bytes(4, "big") + bytes(6) + b"TIT2" + (6).to_bytes(4, "big") + b"\0\0" + b"\0Title", b""),
        (b"ID3\x04\0\x50", seven(6) + b"\x01\0" + b"TIT2" + seven(11) + b"\0\0" + b"\x02" + "Title".encode("utf-16-be"), b"3DI\x04\0\x50" + bytes(4)),
        (b"ID3\x03\0\x80", b"TIT2" + (13).to_bytes(4, "big") + b"\0\0" + (b"\x01" + "Title".encode("utf-16"))[:3].replace(b"\xff", b"\xff\x00") + "Title".encode("utf-16-le"), b""),
        (b"ID3\x04\0\0", b"TIT2" + seven(6) + b"\0\0" + b"\x03Title", b""),
    ],
)
def test_tags_of_all_versions(head, body, foot):
    tag = head + seven(len(body)) + body + foot
    stream = media.encode(b"y" * 64)
    frames = stream[media.read_tag(stream, media.Audio()) :]
    audio = media.decode(tag + frames)
    assert audio.tags.get("TIT2", audio.tags.get("TT2")) == "Title" and len(audio.offsets) == 1 and audio.skipped == 0


def test_seek_tables_are_read_and_compared():
    stream = media.encode(bytes(200_000))
    audio = media.decode(stream)
    assert len(audio.points) == 100 and audio.wrong_points() == 0
    at = stream.index(b"Xing") + 16
    twisted = bytearray(stream)
    twisted[at : at + 100] = bytes(reversed(stream[at : at + 100]))
    assert media.decode(bytes(twisted)).wrong_points() > 50
    # a VBRI table: entries of ten frames each, sizes in two bytes
    frames = stream[audio.offsets[0] :]
    size = media.header(stream, audio.offsets[0]).size
    first = bytearray(stream[audio.offsets[0] - size : audio.offsets[0]])
    first[36:] = bytes(len(first) - 36)
    entries = len(audio.offsets) // 10
    first[36:62] = b"VBRI" + bytes(6) + len(frames).to_bytes(4, "big") + len(audio.offsets).to_bytes(4, "big") + entries.to_bytes(2, "big") + b"\0\x01\0\x02\0\x0a"
    first[62 : 62 + 2 * entries] = (10 * size).to_bytes(2, "big") * entries
    other = media.decode(bytes(first) + frames)
    assert (other.table["frames"], len(other.points), other.wrong_points()) == (len(audio.offsets), entries, 0)


@pytest.mark.parametrize("data", [b"", b"ID3", b"\xff" * 1000, b"\xff\xfb\x90\x00", bytes(5000)])
def test_no_audio(data):
    audio = media.decode(data)
    assert (audio.offsets, audio.payload, audio.seconds) == ([], b"", 0.0)


def test_headers_of_other_kinds():
    assert (media.header(b"\xff\xfb\x90\x00", 0).size, media.header(b"\xff\xfb\x92\x00", 0).size) == (417, 418)
    assert media.header(b"\xff\xff\x10\x00", 0).samples == 384
    assert media.header(b"\xff\xf3\x40\xc0", 0).samples == 576 and media.header(b"\xff\xf3\x40\xc0", 0).side == 9
    assert media.header(b"\xff\xfb\xf0\x00", 0) is media.header(b"\xff\xfb\x00\x00", 0) is media.header(b"\xff\xeb\x90\x00", 0) is None


def test_checksum_by_long_division():
    def slow(data):
        crc = 0xFFFF
        for byte in data:
            for k in range(7, -1, -1):
                crc = (crc << 1) ^ (0x8005 if (crc >> 15 ^ byte >> k) & 1 else 0)
                crc &= 0xFFFF
        return crc

    for data in (b"", b"a", bytes(range(256))):
        assert media.crc16(data) == slow(data)


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op6_mpeg_audio_columns"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        stream = media.encode(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.offsets == media.decode(stream).offsets and r.seconds == len(r.offsets) * 1152 / 44100 and f"frames={len(r.offsets)} " in r.feature and "bad=0" in r.feature
        assert (r.media_bytes, r.media_sha256) == (len(stream), hashlib.sha256(stream).hexdigest())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, None, 1), (None, "", 2), (2, "x" * 500_000, 3)], "doc_id long, text string, n_bytes int")
    rows = media.read(media.store(docs)).collect()
    assert sorted((r.n_bytes, r.payload_bytes) for r in rows) == [(0, 64)] * 3 + [(500_000, 500_032)]
    assert media.read(media.store(docs.limit(0))).count() == 0
