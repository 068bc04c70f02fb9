"""Media columns as MPEG audio: writing payloads into a stream, and reading any such stream back.

A payload becomes MPEG-1 Layer III frames (mono, 32 kHz) that decode to silence; its bytes are their
ancillary data, after the side information. Each frame has its checksum, an ID3v2 tag holds the
payload's length, and a first frame carries the table for variable bit rates (frame and byte
counts and 100 seek points): the last frame takes the lowest bit rate that fits.

The reader takes streams in general: MPEG 1, 2 and 2.5, layers I to III, with ID3 tags of all versions before or after.
It finds the first header that another header or the end follows, resynchronises after damage, measures frames of free
format by the next header, verifies the checksums that headers announce (header, side information, bit allocation and
scale factor selection, by layer), reads the tables of variable bit rates (Xing, Info and VBRI), and reports exact durations
(samples over rate) and each frame's offset.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import prepare, utf8

UNIT = 64
#: Bytes of streams or payloads that a worker sends on together.
SENT = 8 << 20
# Fixed values of the MPEG audio format: kbit/s by (MPEG 1?, layer), Hz by version.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_CRC_TABLE = []
for _i in range(256):
    _c = _i << 8
    for _ in range(8):
        _c = (_c << 1) ^ (0x8005 if _c & 0x8000 else 0)
    _CRC_TABLE.append(_c & 0xFFFF)


def crc16(data: bytes) -> int:
    """The checksum of MPEG audio frames: polynomial 0x8005, start 0xFFFF."""
    c = 0xFFFF
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ _CRC_TABLE[(c >> 8) ^ b]
    return c


def crc16_bits(data: bytes, bits: int) -> int:
    """``crc16`` of the first so many bits."""
    c = crc16(data[: bits // 8])
    for k in range(bits // 8 * 8, bits):
        top = (c >> 15) ^ (data[k // 8] >> (7 - k % 8) & 1)
        c = (c << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return c


@dataclass(frozen=True)
class Header:
    """A frame header; ``length`` is 0 in free format, where only the next header tells it."""

    version: int
    layer: int
    guarded: bool
    bitrate: int
    rate: int
    length: int
    samples: int
    side: int
    padding: int
    mode: int
    extension: int


def header(b: bytes) -> Header | None:
    """The frame header in four bytes; None if they are none."""
    if len(b) < 4 or b[0] != 0xFF or b[1] & 0xE0 != 0xE0:
        return None
    version, layer = b[1] >> 3 & 3, 4 - (b[1] >> 1 & 3)
    index, at = b[2] >> 4, b[2] >> 2 & 3
    if version == 1 or layer == 4 or index == 15 or at == 3:
        return None
    first, rate, mode = version == 3, RATES[version][at], b[3] >> 6
    bitrate, padding = BITRATES[first, layer][index], b[2] >> 1 & 1
    if layer == 1:
        samples, side, length = 384, 0, (12000 * bitrate // rate + padding) * 4
        padding *= 4
    else:
        samples = 1152 if first or layer == 2 else 576
        side = 0 if layer == 2 else (17 if mode == 3 else 32) if first else (9 if mode == 3 else 17)
        length = samples * 125 * bitrate // rate + padding
    return Header(version, layer, not b[1] & 1, bitrate, rate, length if bitrate else 0, samples, side, padding, mode, b[3] >> 4 & 3)


# Fixed values of layer II: bits of the allocation of each subband, as (subbands, bits) in order, by table.
ALLOCATION = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "low": ((4, 4), (7, 3), (19, 2)),
}


def _guarded_bits(h: Header, body: bytes) -> int:
    """Bits after the checksum that it covers."""
    if h.layer == 3:
        return 8 * h.side
    bound = 4 * (h.extension + 1) if h.mode == 1 else 32
    channels = 1 if h.mode == 3 else 2
    if h.layer == 1:
        return 4 * (min(bound, 32) * channels + max(0, 32 - bound))
    each = h.bitrate // channels
    if h.version != 3:
        name = "low"
    elif h.bitrate and each < 56:
        name = "d" if h.rate == 32000 else "c"
    else:
        name = "a" if h.rate == 48000 or h.bitrate and each <= 80 else "b"
    widths = [w for n, w in ALLOCATION[name] for _ in range(n)]
    number = int.from_bytes(body, "big")
    at = used = 0
    for k, w in enumerate(widths):
        for c in range(channels if k < bound else 1):
            at += w
            if at > 8 * len(body):
                return 8 * len(body)
            if number >> (8 * len(body) - at) & ((1 << w) - 1):
                used += 2 * (1 if k < bound or c else channels)
    return min(at + used, 8 * len(body))


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _text_frame(name: str, value: str) -> bytes:
    body = b"\x00" + name.encode("latin-1") + b"\x00" + value.encode("latin-1")
    return b"TXXX" + len(body).to_bytes(4, "big") + b"\x00\x00" + body


_SIDE = 17
_OVERHEAD = 4 + 2 + _SIDE


def _frame(index: int) -> tuple[bytes, int]:
    """What stands before the ancillary data of our frame with that bit rate index, and the frame's length."""
    head = bytes([0xFF, 0xFA, index << 4 | 2 << 2, 0xC0])
    side = bytes(_SIDE)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side, header(head).length


_FRAMES = {i: _frame(i) for i in range(1, 15)}


def write(payload: bytes) -> bytes:
    """The stream that carries the payload."""
    start, full = _FRAMES[14]
    room = full - _OVERHEAD
    whole, rest = divmod(len(payload), room)
    frames = np.zeros((whole, full), np.uint8)
    frames[:, :_OVERHEAD] = np.frombuffer(start, np.uint8)
    frames[:, _OVERHEAD:] = np.frombuffer(payload, np.uint8, whole * room).reshape(whole, room)
    last = b""
    if rest:
        begin, length = next(_FRAMES[i] for i in _FRAMES if _FRAMES[i][1] - _OVERHEAD >= rest)
        last = begin + payload[whole * room :] + bytes(length - _OVERHEAD - rest)
    n = whole + bool(rest)
    begin, length = _FRAMES[9]
    size = length + frames.size + len(last)
    toc = bytes(min(255, (length + min(n * i // 100, whole) * full) * 256 // size) for i in range(100))
    table = b"Xing" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + size.to_bytes(4, "big") + toc
    tag = _text_frame("payload_bytes", str(len(payload)))
    tag = b"ID3\x03\x00\x00" + _syncsafe(len(tag)) + tag
    return b"".join([tag, begin, table, bytes(length - len(begin) - len(table)), frames.tobytes(), last])


@dataclass
class Stream:
    """What a stream holds. ``offsets``: where each audio frame begins, for seeking; ``seek``: the points of the stream's own table, in bytes or 256ths."""

    tags: dict[str, str] = field(default_factory=dict)
    frames: int = 0
    offsets: list[int] = field(default_factory=list)
    duration: Fraction = Fraction(0)
    bad_checksums: int = 0
    skipped_bytes: int = 0
    bitrates: dict[int, int] = field(default_factory=dict)
    table: dict[str, int] = field(default_factory=dict)
    seek: list[int] = field(default_factory=list)
    ancillary: bytes = b""


_ENCODINGS = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}


def _syncsafe_of(b: bytes) -> int:
    return sum((x & 127) << s for x, s in zip(b, (21, 14, 7, 0), strict=False))


def _strings(body: bytes) -> list[str]:
    """The strings of a text frame, which zeros part."""
    kind = _ENCODINGS.get(body[0]) if body else None
    if kind is None:
        return []
    raw, bom = body[1:], body[1:3]
    if kind == "utf-16" and bom not in (b"\xff\xfe", b"\xfe\xff"):
        kind = "utf-16-be"
    text = raw.decode("utf-16-be" if kind == "utf-16" and bom == b"\xfe\xff" else "utf-16-le" if kind == "utf-16" else kind, "replace")
    return [t.lstrip("\ufeff") for t in text.rstrip("\x00").split("\x00")]


def _tags(data: bytes, at: int, to: dict[str, str]) -> int:
    """Read an ID3v2 tag at ``at`` into ``to``; where the stream goes on."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10:
        return at
    version, flags, size = data[at + 3], data[at + 5], _syncsafe_of(data[at + 6 : at + 10])
    end = min(len(data), at + 10 + size)
    body = data[at + 10 : end]
    end = min(len(data), end + 10 * (version == 4 and flags >> 4 & 1))
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    p = 0
    if flags & 0x40 and version == 3:
        p = 4 + int.from_bytes(body[:4], "big")
    elif flags & 0x40 and version == 4:
        p = max(6, _syncsafe_of(body[:4]))
    name_size, head = (3, 6) if version == 2 else (4, 10)
    while p + head <= len(body) and body[p : p + name_size].isalnum():
        name = body[p : p + name_size].decode("ascii")
        raw = body[p + name_size : p + 2 * name_size]
        long = _syncsafe_of(raw) if version == 4 else int.from_bytes(raw, "big")
        content = body[p + head : p + head + long]
        if version == 4 and (flags & 0x80 or body[p + 9] & 2):
            content = content.replace(b"\xff\x00", b"\xff")
        if version == 4 and body[p + 9] & 1:
            content = content[4:]
        if name.startswith("T") and (strings := _strings(content)):
            if name in ("TXXX", "TXX"):
                to[strings[0]] = "\x00".join(strings[1:])
            else:
                to[name] = "\x00".join(strings)
        p += head + long
    return end


def _free_length(data: bytes, at: int, end: int, h: Header) -> int:
    """The length of a frame of free format: up to the next header that agrees but in padding; 0 if there is none."""
    nxt = data.find(data[at : at + 2], at + 4 + h.side, min(end, at + 8192))
    while nxt >= 0:
        if nxt + 4 <= end and data[nxt + 2] & 0xFD == data[at + 2] & 0xFD and data[nxt + 3] >> 6 == h.mode:
            return nxt - at
        nxt = data.find(data[at : at + 2], nxt + 1, min(end, at + 8192))
    return 0


def _vbr_table(data: bytes, at: int, h: Header, out: Stream) -> bool:
    """Read the table of variable bit rates in the frame at ``at``, if it is one."""
    content = at + 4 + 2 * h.guarded + h.side
    if data[content : content + 4] in (b"Xing", b"Info"):
        flags, p = int.from_bytes(data[content + 4 : content + 8], "big"), content + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out.table[name] = int.from_bytes(data[p : p + 4], "big")
                p += 4
        if flags & 4:
            out.seek = list(data[p : p + 100])
        return True
    content = at + 36
    if data[content : content + 4] == b"VBRI":
        word = lambda k, n: int.from_bytes(data[content + k : content + k + n], "big")
        out.table |= {"bytes": word(10, 4), "frames": word(14, 4)}
        entries, scale, wide = word(18, 2), word(20, 2), word(22, 2)
        if wide in (1, 2, 4) and content + 26 + entries * wide <= at + h.length:
            out.seek = np.cumsum([word(26 + k * wide, wide) * scale for k in range(entries)], dtype=np.int64).tolist()
        return True
    return False


def read(data: bytes) -> Stream:
    """Parse a stream; damage is skipped and counted, nothing raises."""
    out, parts = Stream(), []
    at = _tags(data, 0, out.tags)
    end = len(data) - 128 if len(data) >= 128 and data[-128:-125] == b"TAG" else len(data)
    if end < len(data):
        out.tags["ID3v1.title"] = data[-125:-95].rstrip(b"\x00 ").decode("latin-1")
    headers: dict[bytes, Header | None] = {}
    sums: dict[bytes, int] = {}
    durations: dict[int, int] = {}
    synced, first, free = False, True, 0
    while at < end:
        if data[at : at + 3] == b"ID3" and (after := _tags(data, at, out.tags)) > at:
            at = after
            continue
        word = data[at : at + 4]
        h = headers[word] if word in headers else headers.setdefault(word, header(word))
        length = h.length if h else 0
        if h and not length:  # free format: all frames have one length, but for padding
            length = free + h.padding if free and at + free + h.padding <= end else _free_length(data, at, end, h)
            if length and not free:
                free = length - h.padding
        if h is None or length < 4 + 2 * h.guarded + h.side or at + length > end or not synced and at + length < end and header(data[at + length : at + length + 4]) is None and data[at + length : at + length + 3] != b"ID3":
            synced = False
            nxt = data.find(b"\xff", at + 1, end)
            tag = data.find(b"ID3", at + 1, nxt if nxt >= 0 else end)
            nxt = tag if tag >= 0 else end if nxt < 0 else nxt
            out.skipped_bytes += nxt - at
            at = nxt
            continue
        synced = True
        body = at + 4 + 2 * h.guarded
        if h.guarded:
            covered = data[body : min(at + length, body + (h.side if h.layer == 3 else 64))]
            known = data[at + 2 : at + 4] + covered
            if known not in sums:
                if len(sums) > 10_000:
                    sums.clear()
                sums[known] = crc16_bits(known, 16 + _guarded_bits(h, covered))
            out.bad_checksums += sums[known] != int.from_bytes(data[at + 4 : at + 6], "big")
        if not (first and h.layer == 3 and _vbr_table(data, at, h, out)):
            out.offsets.append(at)
            out.bitrates[h.bitrate] = out.bitrates.get(h.bitrate, 0) + 1
            durations[h.rate] = durations.get(h.rate, 0) + h.samples
            parts.append(data[body + h.side : at + length])
        first = False
        at += length
    out.frames = len(out.offsets)
    out.duration = sum((Fraction(n, rate) for rate, n in durations.items()), Fraction(0))
    out.ancillary = b"".join(parts)
    size = out.tags.get("payload_bytes", "")
    if size.isascii() and size.isdigit() and len(size) < 19:
        out.ancillary = out.ancillary[: int(size)]
    return out


def pad(data: bytes) -> bytes:
    return data + bytes(UNIT - len(data) if not data else -len(data) % UNIT)


def feature(s: Stream) -> str:
    """Frames, exact seconds, mean bit rate, damage, agreement with the table, and a digest of the seek offsets."""
    offsets = hashlib.sha256(np.array(s.offsets, "<u8").tobytes()).hexdigest()[:16]
    rate = sum(k * v for k, v in s.bitrates.items()) // max(s.frames, 1)
    agrees = int(s.table.get("frames") == s.frames)
    return f"frames={s.frames};seconds={s.duration};kbps={rate};bad_crc={s.bad_checksums};skipped={s.skipped_bytes};table={agrees};seek={offsets}"


def _store(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        data, off, _ = utf8(batch.column("text"))
        n_bytes, media, size = [], [], 0
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            n_bytes.append(b - a)
            media.append(write(pad(data[a:b].tobytes())))
            size += len(media[-1])
            if size > SENT or len(n_bytes) == batch.num_rows:
                done = batch.column("doc_id").slice(0, len(n_bytes))
                yield pa.record_batch([done, pa.array(n_bytes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])
                batch, n_bytes, media, size = batch.slice(len(n_bytes)), [], [], 0


def store(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)``: the bytes of each text, and the text as an MPEG audio stream; null texts count as empty.

    Texts of any length are stored whole; repeated rows are stored each, and alike.
    """
    prepare(spark)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


_DESCRIBED = "payload binary, frames long, frame_offsets array<long>, duration_numerator long, duration_denominator long, tags map<string,string>, table_frames long, table_bytes long, bad_checksums long, skipped_bytes long, feature string"


def _describe(keep: list[str]):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [
            pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(),
        ]
        names = [x.split(" ")[0] for x in _DESCRIBED.split(", ")]
        for batch in batches:
            held, size, done = [], 0, 0
            for n, media in enumerate(batch.column("media")):
                s = read(media.as_py() or b"")
                held.append((s.ancillary, s.frames, s.offsets, s.duration.numerator, s.duration.denominator, list(s.tags.items()), s.table.get("frames"), s.table.get("bytes"), s.bad_checksums, s.skipped_bytes, feature(s)))
                size += 2 * len(s.ancillary)
                if size > SENT or n + 1 == batch.num_rows:
                    cols = [pa.array(list(c), k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)]
                    yield pa.record_batch([*(batch.column(c).slice(done, len(held)) for c in keep), *cols], names=[*keep, *names])
                    held, size, done = [], 0, n + 1

    return run


def describe(spark: SparkSession, media: DataFrame) -> DataFrame:
    """``media`` with what each stream in its column ``media`` holds.

    ``payload`` is the frames' content after the side information; ``frame_offsets`` says where each audio frame
    begins, for seeking; the duration is exact, as a fraction of seconds. Null streams count as empty.
    Columns with names of the result are replaced.
    """
    prepare(spark)
    fields = T._parse_datatype_string(_DESCRIBED).fields
    keep = [f for f in media.schema.fields if f.name not in {x.name for x in fields}]
    return media.select(*(f.name for f in keep)).mapInArrow(_describe([f.name for f in keep]), T.StructType([*keep, *fields]))


def media_columns(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Each text stored as a stream, read back and described in digests; one row per row of ``docs``.

    Null texts count as empty, and an empty text has a payload of 64 zero bytes. Equal texts have equal values.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read_back = describe(spark, store(spark, docs))
    return read_back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -UNIT, UNIT)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "duration_numerator",
        "duration_denominator",
        "frame_offsets",
    )
