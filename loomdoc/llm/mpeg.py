"""Media columns: MPEG audio.

read_stream() parses tags (ID3v2, ID3v1), finds frame headers again after junk, reads variable-bitrate tables (Xing,
Info, VBRI), verifies Layer III checksums and gives exact durations and the byte offset of every frame.
write_stream() stores any payload without loss in valid MPEG-1 Layer III frames: silent granules, whose unused bytes
(ancillary data) carry the payload; a tag names its length, a Xing table the frames.

Cases. Null or empty text: a payload of 64 zero bytes. Junk, truncated frames and bad checksums: skipped or counted,
never an error. Equal payloads give equal streams. Repeated rows and extra columns: each row stands for itself.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column

from loomdoc.llm.common import per_text

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by bitrate index (1-14), Hz by sampling index.
V1L1 = (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448)
V1L2 = (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384)
V1L3 = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
V2L1 = (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256)
V2L23 = (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

BLOCK = 64
SIDE = 17  # side information of a mono MPEG-1 Layer III frame
FRAME_BITRATES = range(14, 0, -1)


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    length: int
    samples: int
    side: int  # bytes of Layer III side information


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    vbr: str | None = None
    vbr_frames: int | None = None
    vbr_bytes: int | None = None
    seek_table: list[int] = field(default_factory=list)
    checked: int = 0
    bad_checksums: int = 0
    skipped: int = 0  # bytes of junk between frames
    payload: bytes = b""

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    @property
    def duration(self) -> Fraction:
        return sum((Fraction(h.samples, h.rate) for h in self.headers), Fraction(0))


_headers: dict[bytes, Header | None] = {}
_sums: dict[bytes, int] = {}


def header(raw: bytes) -> Header | None:
    """The header in four bytes, or None if they are not one. Free-format streams are not taken."""
    if raw in _headers:
        return _headers[raw]
    found = None
    if len(raw) == 4 and raw[0] == 0xFF and raw[1] & 0xE0 == 0xE0:
        version, layer, rate, index = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3), raw[2] >> 2 & 3, raw[2] >> 4
        if version != 1 and layer != 4 and rate != 3 and 0 < index < 15 and raw[3] & 3 != 2:
            table = ((V1L1, V1L2, V1L3) if version == 3 else (V2L1, V2L23, V2L23))[layer - 1]
            kbps, hz, pad, mono = table[index - 1], RATES[version][rate], raw[2] >> 1 & 1, raw[3] >> 6 == 3
            samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
            length = (12 * kbps * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + pad
            side = (17 if mono else 32) if version == 3 else (9 if mono else 17)
            found = Header(version, layer, not raw[1] & 1, kbps, hz, mono, length, samples, side)
    if len(_headers) < 10_000:
        _headers[raw] = found
    return found


def crc16(data: bytes) -> int:
    """The checksum of MPEG audio: polynomial 8005, from FFFF."""
    if data in _sums:
        return _sums[data]
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    if len(_sums) < 10_000:
        _sums[data] = crc
    return crc


def synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def unsynchsafe(raw: bytes) -> int:
    n = 0
    for byte in raw:
        n = n << 7 | byte & 0x7F
    return n


def _text(raw: bytes) -> str:
    codec = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0] if raw else 0, "latin-1")
    return raw[1:].decode(codec, "replace").rstrip("\0")


def _id3v2(data: bytes, tags: dict[str, str]) -> int:
    """Reads a tag at the start; gives its length."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    size, major = unsynchsafe(data[6:10]), data[3]
    end, at = min(len(data), 10 + size), 10
    while major in (3, 4) and at + 10 <= end and data[at] != 0:
        n = unsynchsafe(data[at + 4 : at + 8]) if major == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        name, body = data[at : at + 4].decode("latin-1"), data[at + 10 : min(end, at + 10 + n)]
        if name == "TXXX":
            key, _, value = _text(body).partition("\0")
            tags[f"TXXX:{key}"] = value
        elif name[0] == "T":
            tags[name] = _text(body)
        at += 10 + n
    return 10 + size + 10 * (data[5] >> 4 & 1)


def _vbr(data: bytes, at: int, h: Header, out: Stream) -> bool:
    """Reads a table of variable bitrate from the first frame; such a frame holds no sound."""
    if h.layer != 3:
        return False
    for place in (at + 4 + h.side, at + 6 + h.side):
        if data[place : place + 4] in (b"Xing", b"Info"):
            out.vbr = data[place : place + 4].decode()
            flags, p = int.from_bytes(data[place + 4 : place + 8], "big"), place + 8
            if flags & 1:
                out.vbr_frames, p = int.from_bytes(data[p : p + 4], "big"), p + 4
            if flags & 2:
                out.vbr_bytes, p = int.from_bytes(data[p : p + 4], "big"), p + 4
            if flags & 4:
                out.seek_table = list(data[p : p + 100])
            return True
    place = at + 4 + 32
    if data[place : place + 4] == b"VBRI" and place + 26 <= at + h.length:
        out.vbr = "VBRI"
        out.vbr_bytes, out.vbr_frames, n, scale, width = struct.unpack(">IIHHH", data[place + 10 : place + 24])
        p = place + 26
        whole = 0 < width <= 4 and p + n * width <= at + h.length
        out.seek_table = [int.from_bytes(data[p + i * width : p + (i + 1) * width], "big") * scale for i in range(n)] if whole else []
        return True
    return False


def _frames_to_end(data: bytes, at: int) -> bool:
    """Whether frames without a gap fill data from at to its end."""
    while at + 4 <= len(data) and (h := header(data[at : at + 4])):
        at += h.length
    return at == len(data)


def read_stream(data: bytes) -> Stream:
    out = Stream()
    at = _id3v2(data, out.tags)
    end = len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG" and not _frames_to_end(data, at):  # else the bytes are a frame's own
        end -= 128
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            out.tags[f"id3v1:{name}"] = data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip()
    parts, first, synced = [], True, True
    while at + 4 <= end:
        h = header(data[at : at + 4])
        after = at + h.length if h else 0
        # Out of step, a header counts only if another one, or the end, follows where it says.
        if h is None or after > end or not synced and after + 4 <= end and header(data[after : after + 4]) is None:
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out.skipped += nxt - at
            at, synced = nxt, False
            continue
        synced = True
        if first and _vbr(data, at, h, out):
            first, at = False, after
            continue
        first = False
        body = at + 4
        if h.layer == 3:
            if h.protected:
                out.checked += 1
                if crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) != data[at + 4] << 8 | data[at + 5]:
                    out.bad_checksums += 1
                body += 2
            body += h.side
        out.offsets.append(at)
        out.headers.append(h)
        parts.append(data[body:after])
        at = after
    out.skipped += max(0, end - at)
    joined = b"".join(parts)
    n = out.tags.get("TXXX:payload_bytes", "")
    out.payload = joined[: int(n)] if n.isascii() and n.isdigit() and len(n) < 20 else joined
    return out


def _frame_start(index: int) -> tuple[bytes, int]:
    head = bytes((0xFF, 0xFA, index << 4, 0xC4))
    side = bytes(SIDE)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side, header(head).length - 6 - SIDE


STARTS = {i: _frame_start(i) for i in FRAME_BITRATES}


def padded(raw: bytes) -> bytes:
    """raw with zero bytes up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


def write_stream(payload: bytes) -> bytes:
    start, room = STARTS[14]
    frames, sizes, at, n = [], [], 0, len(payload)
    while n - at >= room:
        frames += (start, payload[at : at + room])
        sizes.append(room + 6 + SIDE)
        at += room
    if at < n or not frames:
        index = next(i for i in range(1, 15) if STARTS[i][1] >= n - at)
        start, room = STARTS[index]
        frames += (start, payload[at:], bytes(room - (n - at)))
        sizes.append(room + 6 + SIDE)
    body = b"\x03payload_bytes\0" + str(n).encode()
    tag = b"TXXX" + synchsafe(len(body)) + b"\0\0" + body
    tag = b"ID3\x04\0\0" + synchsafe(len(tag)) + tag
    total = sum(sizes)
    count = len(sizes)
    head = bytes((0xFF, 0xFB, 3 << 4, 0xC4))
    length = header(head).length
    ends, at, big = [], length, 1044
    for i in range(100):  # where, in 256ths of the bytes, each hundredth of the frames begins
        ends.append(min(255, (length + min(i * count // 100 * big, total)) * 256 // (length + total)))
    xing = head + bytes(SIDE) + b"Xing" + struct.pack(">III", 7, count, length + total) + bytes(ends)
    return b"".join((tag, xing + bytes(length - len(xing)), *frames))


def describe(s: Stream) -> str:
    """A short text of exact features; the frame offsets come as a checksum of their table."""
    seek = zlib.crc32(struct.pack(f"<{len(s.offsets)}Q", *s.offsets))
    d = s.duration
    kbps = sorted({h.kbps for h in s.headers})
    return f"frames={len(s.headers)};samples={s.samples};seconds={d.numerator}/{d.denominator};kbps={','.join(map(str, kbps))};vbr={s.vbr}:{s.vbr_frames};crc={s.checked - s.bad_checksums}/{s.checked};skipped={s.skipped};seek_crc32={seek:08x}"


def media_struct(text: Column) -> Column:
    """A struct column: each whole text stored as MPEG audio, with duration, frame offsets and table of contents."""

    def run(text: str):
        media = write_stream(padded(text.encode()))
        s = read_stream(media)
        return media, s.samples, s.headers[0].rate, s.offsets, s.seek_table, s.checked - s.bad_checksums, describe(s)

    return per_text(text, lambda: run, "media binary, samples long, rate int, frame_offsets array<long>, seek_table array<int>, checksums_good long, feature string")


def digest_struct(text: Column) -> Column:
    """A struct column: the digests of each text's stored form and of the payload read back from it, its exact duration
    (samples at a rate) and the byte offset of every frame."""

    def run(text: str):
        raw = text.encode()
        media = write_stream(padded(raw))
        s = read_stream(media)
        back = s.payload
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), describe(s), s.samples, s.headers[0].rate, s.offsets

    return per_text(text, lambda: run, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, samples long, rate int, frame_offsets array<long>")
