import hashlib
import os
import zlib
from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st

from millrace.llm import media as M
from tests.llm.util import corpus, documents


@given(st.binary(max_size=6000))
def test_round_trip(data):
    payload = M.pad(data)
    s = M.read(M.write(payload))
    assert s.ancillary == payload and not s.bad_checksums and not s.skipped_bytes and s.table["frames"] == s.frames


@pytest.mark.parametrize("payload", [b"\xff\xfb\x90\x64" * 5000, b"\xff" * 9000, b"ID3" * 700, b"Xing" * 500, b"TAG" + bytes(2000)])
def test_payloads_that_look_like_frames(payload):
    assert M.read(M.write(M.pad(payload))).ancillary == M.pad(payload)


def test_damage():
    whole = M.write(M.pad(os.urandom(9000)))
    good = M.read(whole)
    junk = whole[:4000] + b"\x00junk" * 50 + whole[4000:]
    s = M.read(junk)
    assert s.skipped_bytes > 0 and good.frames - 1 <= s.frames <= good.frames + 1
    at = good.offsets[2] + 7
    broken = whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :]
    assert M.read(broken).bad_checksums == 1
    assert M.read(b"").frames == 0 and M.read(b"no audio at all" * 20).frames == 0
    title = whole + b"TAG" + b"Song".ljust(125, b"\x00")
    assert M.read(title).tags["ID3v1.title"] == "Song" and M.read(title).frames == good.frames
    assert M.read(whole[:-10]).frames == good.frames - 1


def test_headers():
    h = M.header(bytes([0xFF, 0xFB, 0x90, 0x64]))
    assert (h.bitrate, h.rate, h.length, h.samples, h.side, h.guarded) == (128, 44100, 417, 1152, 32, False)
    assert M.header(b"\xff\xfb\xf0\x64") is None and M.header(b"\xff\xeb\x90\x64") is None
    assert M.header(bytes([0xFF, 0xF3, 0x90, 0xC4])).samples == 576


def bits_crc(bits):
    """The checksum bit by bit."""
    c = 0xFFFF
    for b in bits:
        c = (c << 1) ^ (0x18005 if (c >> 15) ^ b else 0)
        c &= 0xFFFF
    return c.to_bytes(2, "big")


def bits_of(data):
    return [x >> k & 1 for x in data for k in range(7, -1, -1)]


def hand_made(head, length, guarded=b"", fill=b"\x00"):
    return (head + guarded + fill * length)[:length]


#: MPEG 1 layer III, 128 kbit/s, 44.1 kHz, stereo, without checksum: 417 bytes, 1152 samples.
PLAIN = hand_made(b"\xff\xfb\x90\x04", 417, fill=b"\x55")


def test_streams_made_by_hand():
    s = M.read(PLAIN * 10)
    assert (s.frames, s.offsets[:3], s.duration, s.bad_checksums, s.skipped_bytes) == (10, [0, 417, 834], Fraction(11520, 44100), 0, 0)
    # a later frame padded by one byte, junk between, and a cut last frame
    padded = hand_made(b"\xff\xfb\x92\x04", 418)
    s = M.read(PLAIN * 3 + padded + b"junk" * 9 + PLAIN * 2 + PLAIN[:100])
    assert s.offsets == [0, 417, 834, 1251, 1705, 2122] and s.skipped_bytes == 36 + 100
    # layer I, 384 samples, 32 kbit/s at 32 kHz: 48 bytes; layer II, 32 kbit/s at 48 kHz mono: 96 bytes
    s = M.read(hand_made(b"\xff\xff\x18\x04", 48) * 4)
    assert (s.frames, s.duration) == (4, Fraction(4 * 384, 32000))
    s = M.read(hand_made(b"\xff\xfd\x14\xc0", 96) * 5)
    assert (s.frames, s.duration, s.offsets[1]) == (5, Fraction(5 * 1152, 48000), 96)
    # MPEG 2 layer III: 576 samples, 64 kbit/s at 22.05 kHz: 208 bytes
    s = M.read(hand_made(b"\xff\xf3\x80\xc4", 208) * 3)
    assert (s.frames, s.duration) == (3, Fraction(3 * 576, 22050))
    # two rates in one stream add up exactly
    assert M.read(PLAIN * 2 + hand_made(b"\xff\xf3\x80\xc4", 208) * 2).duration == Fraction(2304, 44100) + Fraction(1152, 22050)


def test_free_format():
    frame = hand_made(b"\xff\xfb\x00\x04", 300, fill=b"\x11")
    longer = hand_made(b"\xff\xfb\x02\x04", 301, fill=b"\x11")
    s = M.read(frame * 3 + longer + frame)
    assert s.offsets == [0, 300, 600, 900, 1201] and s.bitrates == {0: 5} and s.duration == Fraction(5 * 1152, 44100)
    assert M.read(frame).frames == 0


@pytest.mark.parametrize("mode", [0x00, 0x40, 0x50, 0xC0])
def test_checksums_of_layers_one_and_two(mode):
    # layer I: 4 bits of allocation for each subband and channel, shared above the bound of joint stereo
    bound = {0x40: 4, 0x50: 8}.get(mode, 32)
    n = 32 * 4 if mode == 0xC0 else 4 * (2 * bound + 32 - bound)
    head = bytes([0xFF, 0xFE, 0x68, mode])
    body = bytes(range(7, 7 + 60))
    crc = bits_crc(bits_of(head[2:] + body)[: 16 + n])
    frame = hand_made(head, 288, crc + body)
    assert M.read(frame * 4).bad_checksums == 0
    assert M.read(frame + frame[:6] + bytes([frame[6] ^ 1]) + frame[7:] + frame).bad_checksums == 1
    # layer II, 64 kbit/s at 48 kHz in mono, or 128 in stereo (27 subbands): allocations, then 2 bits for each that is not 0
    index = 0x40 if mode == 0xC0 else 0x80
    head = bytes([0xFF, 0xFC, index | 0x04, mode])
    widths = [4] * 11 + [3] * 12 + [2] * 4
    stream, at, scfsi = bits_of(body), 0, 0
    for k, w in enumerate(widths):
        channels = 1 if mode == 0xC0 else 2
        for _ in range(1 if k >= bound else channels):
            scfsi += 2 * (channels if k >= bound else 1) * any(stream[at : at + w])
            at += w
    frame = hand_made(head, 192 if mode == 0xC0 else 384, bits_crc(bits_of(head[2:]) + stream[: at + scfsi]) + body)
    assert M.read(frame * 3).bad_checksums == 0 and M.read(frame * 3).frames == 3
    flipped = frame[:7] + bytes([frame[7] ^ 16]) + frame[8:]
    assert M.read(frame + flipped + frame).bad_checksums == 1


def test_tables_of_variable_bit_rates():
    vbri = b"VBRI" + b"\x00\x01" + b"\x00\x00" + b"\x00\x4b" + (417 * 9).to_bytes(4, "big") + (8).to_bytes(4, "big") + (4).to_bytes(2, "big") + (2).to_bytes(2, "big") + (2).to_bytes(2, "big") + (2).to_bytes(2, "big")
    vbri += b"".join(x.to_bytes(2, "big") for x in (417, 400, 417, 434))
    first = (PLAIN[:4] + bytes(32) + vbri + bytes(417))[:417]
    s = M.read(first + PLAIN * 8)
    assert (s.frames, s.table, s.seek) == (8, {"bytes": 417 * 9, "frames": 8}, [834, 1634, 2468, 3336])
    xing = (PLAIN[:4] + bytes(32) + b"Xing" + (5).to_bytes(4, "big") + (3).to_bytes(4, "big") + bytes(range(100)) + bytes(417))[:417]
    s = M.read(xing + PLAIN * 3)
    assert (s.table, s.seek, s.offsets[0]) == ({"frames": 3}, list(range(100)), 417)


def tag(version, flags, body):
    n = len(body)
    return b"ID3" + bytes([version, 0, flags]) + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + body


def test_tags_of_all_versions():
    two = b"TT2" + (6).to_bytes(3, "big") + b"\x00Title" + b"TXX" + (8).to_bytes(3, "big") + b"\x00key\x00val"
    assert M.read(tag(2, 0, two) + PLAIN * 3).tags == {"TT2": "Title", "key": "val"}
    utf16 = b"\x01" + "Käse".encode("utf-16")
    three = b"TIT2" + len(utf16).to_bytes(4, "big") + b"\x00\x00" + utf16
    assert M.read(tag(3, 0, three) + PLAIN * 3).tags == {"TIT2": "Käse"}
    assert M.read(tag(3, 0x40, (6).to_bytes(4, "big") + bytes(6) + three) + PLAIN * 3).tags == {"TIT2": "Käse"}
    assert M.read(tag(3, 0x80, three.replace(b"\xff", b"\xff\x00")) + PLAIN * 3).tags == {"TIT2": "Käse"}
    big = b"\x02" + "Zoë\x00more".encode("utf-16-be")
    four = b"TPE1" + bytes([0, 0, 0, len(big)]) + b"\x00\x00" + big
    s = M.read(tag(4, 0x50, bytes([0, 0, 0, 6, 1, 0]) + four) + b"3DI" + bytes(7) + PLAIN * 3)
    assert s.tags == {"TPE1": "Zoë\x00more"} and s.frames == 3 and s.skipped_bytes == 0
    # a tag between frames, and one at the end
    s = M.read(PLAIN * 2 + tag(3, 0, three) + PLAIN * 2 + tag(2, 0, two))
    assert (s.frames, s.skipped_bytes, s.tags) == (4, 0, {"TIT2": "Käse", "TT2": "Title", "key": "val"})


@given(st.binary(max_size=300), st.sampled_from([b"", b"ID3\x02\x00\xff", b"ID3\x03\x00\xc0", b"ID3\x04\x00\xff\x00\x00\x01", b"\xff\xfc\x84\x50", b"\xff\xfb\x00\x04", b"\xff\xfe\x68\x40"]), st.binary(max_size=300))
def test_nothing_raises(a, b, c):
    M.read(a + b + c + b + a)


def test_odd_payload_sizes():
    body = b"\x03payload_bytes\x00" + "²4".encode()
    odd = tag(3, 0, b"TXXX" + len(body).to_bytes(4, "big") + b"\x00\x00" + body)
    assert M.read(odd + PLAIN * 3).frames == 3


def test_described_columns(spark):
    rows = [(1, PLAIN * 4, "x"), (2, None, "y"), (2, b"", "z"), (None, b"no audio", "w"), (1, PLAIN * 4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, media binary, frames string")
    out = sorted(((r.doc_id, r.frames, r.frame_offsets, r.duration_numerator, r.duration_denominator) for r in M.describe(spark, df).collect()), key=str)
    d = Fraction(4 * 1152, 44100)
    assert out == sorted([(1, 4, [0, 417, 834, 1251], d.numerator, d.denominator)] * 2 + [(2, 0, [], 0, 1)] * 2 + [(None, 0, [], 0, 1)], key=str)
    assert M.describe(spark, df.limit(0)).count() == 0


def test_very_long_and_repeated_texts(spark, monkeypatch):
    rows = [(1, "long " * 1_000_000), (2, "a"), (2, "a"), (2, "b"), (3, "x" * 3_000_000)]
    out = M.media_columns(spark, documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_bytes) for r in out) == [(1, 5_000_000), (2, 1), (2, 1), (2, 1), (3, 3_000_000)]
    for r in out:
        if r.doc_id != 2:
            p = M.pad(dict(rows)[r.doc_id].encode())
            assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and len(r.frame_offsets) == -(-len(p) // (1440 - 23))


def test_columns(spark):
    rows = corpus(5, 30)
    out = {r.doc_id: r for r in M.media_columns(spark, documents(spark, rows)).collect()}
    assert len(out) == len(rows)
    for i, t in rows:
        b = (t or "").encode()
        p = M.pad(b)
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        m = M.write(p)
        assert (r.media_bytes, r.media_sha256) == (len(m), hashlib.sha256(m).hexdigest())
    assert len(M.pad(b"")) == 64 and len(M.pad(b"x" * 64)) == 64
    stored = M.store(spark, documents(spark, rows[:3])).collect()
    assert all(M.read(bytes(r.media)).ancillary == M.pad((dict(rows)[r.doc_id] or "").encode()) for r in stored)
    assert M.media_columns(spark, documents(spark, [])).count() == 0
