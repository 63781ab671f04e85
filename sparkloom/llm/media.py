"""MPEG audio columns: write, resynchronise, read.

A payload is stored in the main-data area of silent Layer III frames (44.1 kHz,
stereo, 16-bit checksum): header, checksum, side information without granule
data, then payload bytes, which a decoder skips as ancillary data. The stream
starts with an ID3v2 tag that states the payload's length, then a frame with a
Xing table (frames, bytes, 100 seek points).

Reading trusts nothing but the format: tags are parsed and skipped (ID3v2.2 to
2.4 with extended header, footer and unsynchronisation, ID3v1 where the frames
end at it), the first frame is found by a header that two further headers confirm
(payload bytes may look like a sync word), lost sync is regained the same way, and
the exact duration is frames times samples per frame over the sample rate. A
frame's start is its seek offset; the seek points of a Xing or VBRI table are read
and compared with the frames. Checksums of Layer III are verified (what Layers I
and II protect depends on their bit allocation, theirs aren't).

Payloads over SMALL_BYTES are stored in 320 kbit/s frames, others in 40 kbit/s
frames, which hold less but waste less; both read alike.

Defined results: a null or empty text stores 64 zero bytes; very long texts are
stored whole; a frame whose checksum is wrong is counted and skipped, it has no
offset and no duration, and zeros stand for its part of the payload, so nothing
after it moves; bytes without any frame give no frames, no payload and duration 0;
equal texts (ties, repeated rows) give equal bytes, row by row; an empty table gives
an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import texts

#: Fixed values of the MPEG audio format: bit rates in kbit/s by (version 1?, layer) and index, sample rates by version and index.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}
#: Bit rate index of the frames written: small for short payloads (40 kbit/s), 320 kbit/s for the rest.
SMALL, LARGE = 2, 14
SMALL_BYTES = 512
BLOCK = 64
_POLY = 0x8005


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ _POLY if crc & 0x8000 else crc << 1) & 0xFFFF
        out.append(crc)
    return out


_CRC = _crc_table()


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    """The checksum of protected frames."""
    for byte in data:
        crc = (crc << 8 & 0xFFFF) ^ _CRC[crc >> 8 ^ byte]
    return crc


@dataclass(frozen=True)
class Header:
    """A frame header that passed all checks of form."""

    version: int
    layer: int
    protected: bool
    bitrate: int
    rate: int
    padding: int
    mono: bool
    samples: int
    size: int

    @property
    def side(self) -> int:
        """Bytes of side information in Layer III."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)

    @property
    def body(self) -> int:
        """Offset of main data in the frame."""
        return 4 + 2 * self.protected + self.side


def header(data: bytes, at: int) -> Header | None:
    """The header at a place, None if there is none of a size that can be known."""
    if at < 0 or at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b, c, d = data[at + 1], data[at + 2], data[at + 3]
    version, layer = b >> 3 & 3, 4 - (b >> 1 & 3)
    if version == 1 or layer == 4 or c >> 4 in (0, 15) or c >> 2 & 3 == 3 or d & 3 == 2:
        return None
    bitrate, rate, padding = BITRATES[version == 3, layer][c >> 4] * 1000, RATES[version][c >> 2 & 3], c >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    size = (12 * bitrate // rate + padding) * 4 if layer == 1 else samples // 8 * bitrate // rate + padding
    return Header(version, layer, not b & 1, bitrate, rate, padding, d >> 6 == 3, samples, size)


def _synchsafe(n: int) -> bytes:
    return bytes((n >> s & 127) for s in (21, 14, 7, 0))


def _frame(index: int, first: bytes = b"") -> tuple[bytes, int]:
    """What stands before main data in a frame of a bit rate index, and the room for main data."""
    head = bytes((0xFF, 0xFA, index << 4, 0x00))
    kind = header(head, 0)
    side = bytes(kind.side)
    return head + crc16(head[2:4] + side).to_bytes(2, "big") + side + first, kind.size - kind.body - len(first)


_FRAMES = {k: _frame(k) for k in (SMALL, LARGE)}


def payload_of(text: str) -> tuple[int, bytes]:
    """(bytes of the text, the text in UTF-8 with zeros up to a positive multiple of BLOCK)."""
    data = text.encode("utf-8", "surrogatepass")
    return len(data), data + bytes(max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def encode(payload: bytes) -> bytes:
    """The MPEG audio stream that holds a payload."""
    index = LARGE if len(payload) > SMALL_BYTES else SMALL
    prefix, room = _FRAMES[index]
    body = [prefix + payload[a : a + room] for a in range(0, len(payload), room)]
    size = len(prefix) + room
    if body:
        body[-1] = body[-1].ljust(size, b"\0")
    count = len(body)
    note = b"\0payload\0" + str(len(payload)).encode()
    frame = b"TXXX" + _synchsafe(len(note)) + b"\0\0" + note
    tag = b"ID3\x04\0\0" + _synchsafe(len(frame)) + frame
    seek = bytes(min(255, 256 * (count * k // 100) // max(1, count)) for k in range(100))
    xing = b"Xing" + (7).to_bytes(4, "big") + count.to_bytes(4, "big") + (size * count).to_bytes(4, "big") + seek
    lead, space = _FRAMES[LARGE]
    return tag + lead + xing + bytes(space - len(xing)) + b"".join(body)


@dataclass
class Audio:
    """What a stream holds."""

    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, int] = field(default_factory=dict)
    #: Byte offsets that the table's seek points name, each with the number of the frame that it should lie in.
    points: list[tuple[int, int]] = field(default_factory=list)
    #: Where frames begin: all of them, and those that are sound.
    starts: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    version: str = ""
    layer: int = 0
    protected: int = 0
    bad_checksums: int = 0
    skipped: int = 0
    payload: bytes = b""

    @property
    def seconds(self) -> float:
        return self.samples / self.rate if self.rate else 0.0

    def wrong_points(self) -> int:
        """Seek points more than a frame, or the table's own step, away from the frame they stand for."""
        if not self.starts:
            return len(self.points)
        largest = max((b - a for a, b in zip(self.starts, self.starts[1:])), default=0)
        room = max(largest, self.table.get("step", 0)) + self.table.get("step", 0)
        return sum(abs(at - self.starts[min(n, len(self.starts) - 1)]) > room for n, at in self.points)

    def feature(self) -> str:
        """The facts of a stream in one line."""
        last = self.offsets[-1] if self.offsets else -1
        return (
            f"mpeg{self.version}-layer{self.layer} rate={self.rate} frames={len(self.offsets)} samples={self.samples} seconds={self.seconds:.6f} "
            f"first={self.offsets[0] if self.offsets else -1} last={last} checked={self.protected} bad={self.bad_checksums} skipped={self.skipped} "
            f"points={len(self.points)} wrong={self.wrong_points()}"
        )


def _seven(raw: bytes) -> int:
    """A number of seven bits a byte."""
    n = 0
    for byte in raw:
        n = n << 7 | byte & 127
    return n


#: Character sets of text frames, by their first byte.
_CHARSETS = ("latin-1", "utf-16", "utf-16-be", "utf-8")


def _text_frame(name: str, body: bytes, audio: Audio) -> None:
    if not body:
        return
    charset = _CHARSETS[body[0]] if body[0] < 4 else "latin-1"
    parts = body[1:].decode(charset, "replace").split("\0")
    if name in ("TXXX", "TXX"):
        audio.tags[f"TXXX:{parts[0]}"] = parts[1].lstrip("\ufeff") if len(parts) > 1 else ""
    else:
        audio.tags[name] = parts[0]


def read_tag(data: bytes, audio: Audio) -> int:
    """Parse an ID3v2 tag at the start; where it ends."""
    if data[:3] != b"ID3" or len(data) < 10 or not 2 <= data[3] <= 4:
        return 0
    version, flags, size = data[3], data[5], _seven(data[6:10])
    stop = 10 + size + 10 * (version == 4 and bool(flags & 0x10))  # a footer repeats the header
    tag = data[10 : 10 + size]
    if flags & 0x80 and version < 4:  # unsynchronised as a whole
        tag = tag.replace(b"\xff\x00", b"\xff")
    at = 0
    if flags & 0x40 and version > 2:  # an extended header; version 3 counts itself not
        at = _seven(tag[:4]) if version == 4 else 4 + int.from_bytes(tag[:4], "big")
    wide, head = (3, 6) if version == 2 else (4, 10)
    while at + head <= len(tag) and tag[at : at + wide].strip(b"\0"):
        raw = tag[at + wide : at + 2 * wide]
        n = _seven(raw) if version == 4 else int.from_bytes(raw, "big")
        body, more = tag[at + head : at + head + n], tag[at + 9] if version == 4 else 0
        if more & 0x01:  # the length before unsynchronisation
            body = body[4:]
        if more & 0x02:
            body = body.replace(b"\xff\x00", b"\xff")
        name = tag[at : at + wide].decode("latin-1")
        if name.startswith("T") and not more & 0x0C:  # neither compressed nor encrypted
            _text_frame(name, body, audio)
        at += head + n
    return stop


def _alike(a: Header, b: Header | None) -> bool:
    return b is not None and (a.version, a.layer, a.rate) == (b.version, b.layer, b.rate)


def resync(data: bytes, at: int, end: int, confirm: int = 2) -> int:
    """The next place from `at` whose header is confirmed by those that should follow it (or by the end, or a trailing tag); -1 if none."""
    at = data.find(b"\xff", at, end)
    while at >= 0:
        first = own = header(data, at)
        place = at
        for _ in range(confirm):
            if own is None:
                break
            place += own.size
            if place == end or _trailer(data, place):
                break
            own = header(data, place) if place < end else None
            if not _alike(first, own):
                own = None
        if own is not None and place <= end:
            return at
        at = data.find(b"\xff", at + 1, end)
    return -1


def _trailer(data: bytes, at: int) -> bool:
    """Whether an ID3v1 tag, always the last 128 bytes, begins here."""
    return at == len(data) - 128 and data[at : at + 3] == b"TAG"


def read_table(data: bytes, at: int, kind: Header, audio: Audio) -> bool:
    """Parse a Xing, Info or VBRI table of a first frame with its seek points; whether there is one."""
    for place in (at + kind.body, at + kind.body - 2 * kind.protected):
        if data[place : place + 4] in (b"Xing", b"Info"):
            flags, p = int.from_bytes(data[place + 4 : place + 8], "big"), place + 8
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    audio.table[name] = int.from_bytes(data[p : p + 4], "big")
                    p += 4
            if flags & 4 and flags & 3 == 3:  # point k is where k percent of the time begin, in 256ths of the bytes
                frames, total = audio.table["frames"], audio.table["bytes"]
                audio.points = [(frames * k // 100, at + kind.size + point * total // 256) for k, point in enumerate(data[p : p + 100])]
                audio.table["step"] = total // 256 + 1
            return True
    if data[at + 36 : at + 40] == b"VBRI":
        number = lambda p, n: int.from_bytes(data[at + p : at + p + n], "big")
        audio.table |= {"bytes": number(46, 4), "frames": number(50, 4)}
        entries, scale, width, each, place = number(54, 2), number(56, 2), number(58, 2), number(60, 2), at + kind.size
        for k in range(entries):  # entry k is the size of the next `each` frames
            audio.points.append((k * each, place))
            place += number(62 + k * width, width) * scale
        audio.table["step"] = scale
        return True
    return False


def decode(data: bytes) -> Audio:
    """Read a stream."""
    audio = Audio()
    at = read_tag(data, audio)
    end = len(data)
    found = resync(data, at, end)
    audio.skipped += (found if found >= 0 else max(at, end)) - at
    at, kinds, bodies, first = found, {}, [], True
    while 0 <= at < end:
        if _trailer(data, at):
            audio.tags["ID3v1:title"] = data[at + 3 : at + 33].decode("latin-1").strip("\0 ")
            break
        key = data[at : at + 4]
        kind = kinds.get(key)
        if kind is None:
            kind = kinds[key] = header(data, at)
        if kind is None or at + kind.size > end:
            found = resync(data, at + 1, end)
            audio.skipped += (found if found >= 0 else end) - at
            at = found
            continue
        sound = True
        if kind.protected and kind.layer == 3:
            audio.protected += 1
            given, side = data[at + 4 : at + 6], data[at + 6 : at + kind.body]
            sound = _checked(key[2:4] + side) == int.from_bytes(given, "big")
            audio.bad_checksums += not sound
        audio.version, audio.layer, audio.rate = VERSIONS[kind.version], kind.layer, kind.rate
        if not (first and read_table(data, at, kind, audio)):
            audio.starts.append(at)
            if sound:
                audio.offsets.append(at)
                audio.samples += kind.samples
                bodies.append(data[at + kind.body : at + kind.size])
            else:
                bodies.append(bytes(kind.size - kind.body))  # a gap, so that nothing after it moves
        first = False
        at += kind.size
    stored = b"".join(bodies)
    length = audio.tags.get("TXXX:payload", "")
    audio.payload = stored[: int(length)] if length.isdecimal() else stored
    return audio


_known_checksums: dict[bytes, int] = {}


def _checked(data: bytes) -> int:
    """crc16 with a small memory: the side information of silent frames is always the same."""
    if data not in _known_checksums:
        if len(_known_checksums) > 1000:
            _known_checksums.clear()
        _known_checksums[data] = crc16(data)
    return _known_checksums[data]


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(n, encode(p)) for n, p in map(payload_of, texts(batch))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([n for n, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary())], ["doc_id", "n_bytes", "media"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


_FACTS = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "seconds double, offsets array<long>"
)


def read(media: DataFrame) -> DataFrame:
    """Digests and facts of stored streams, all from the stored bytes; `seconds` is the exact duration, `offsets` where each sound frame begins."""

    def facts(data: bytes) -> tuple:
        audio = decode(data)
        p = audio.payload
        return len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(data), hashlib.sha256(data).hexdigest(), audio.feature(), audio.seconds, audio.offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64())]
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds", "offsets"]
        for batch in batches:
            rows = [facts(v.as_py() or b"") for v in batch.column(2)]
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["doc_id", "n_bytes", *names])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, _FACTS)
