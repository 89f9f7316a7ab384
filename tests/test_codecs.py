import os
import random
import struct
import zlib

import numpy as np
import pytest
from memtide.functions import ecc, lzari, modes, text, times
from memtide.sources import containers, icons, layout
from memtide.sources.image import Image, build

NOW = 1_700_000_000


def entry(name, data):
    return layout.Dirent(modes.NEW_FILE, len(data), NOW, 0, 0, NOW, name), data


@pytest.mark.parametrize(
    "mb,clusters,fat,offset,end,image",
    [(8, 8192, 32, 41, 8135, 8650752), (16, 16384, 64, 73, 16295, 17301504), (32, 32768, 128, 137, 32615, 34603008), (64, 65536, 256, 265, 65255, 69206016)],
)
def test_geometry(mb, clusters, fat, offset, end, image):
    g = layout.geometry_of_mb(mb)
    assert (g.clusters, g.fat_clusters, g.alloc_offset, g.alloc_end, g.limit) == (clusters, fat, offset, end, end)
    if mb == 8:
        raw = build(g, [], NOW)
        assert len(raw) == image
        i = Image(raw)
        assert i.has_ecc and int((i.fat & layout.ALLOCATED == 0).sum()) * 1024 == 8329216
        assert layout.unpack_superblock(raw) == g


def test_geometry_errors():
    with pytest.raises(ValueError):
        layout.geometry_of_mb(7)
    with pytest.raises(layout.CardError):
        layout.Geometry.of(page_size=500)
    with pytest.raises(layout.CardError):
        layout.Geometry.of(pages_per_block=0)
    with pytest.raises(layout.CardError):
        layout.Geometry.of(pages=32)


def test_ecc_vectors():
    zero = np.zeros((1, 128), np.uint8)
    one = zero.copy()
    one[0, 42] = 8
    count = np.arange(128, dtype=np.uint8)[None]
    assert ecc.calculate(zero).tolist() == [[0x77, 0x7F, 0x7F]]
    assert ecc.calculate(one).tolist() == [[0x43, 0x2A, 0x55]]
    assert ecc.calculate(count).tolist() == [[0x77, 0x7F, 0x7F]]


def test_ecc_corrects_each_single_bit_and_no_two():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, (1, 128), dtype=np.uint8)
    code = ecc.calculate(data)
    for bit in range(1024):
        bad = data.copy()
        bad[0, bit // 8] ^= 1 << bit % 8
        fixed, state = ecc.correct(bad, code)
        assert state[0] == ecc.DATA_FIXED and (fixed == data).all()
    bad = data.copy()
    bad[0, 3] ^= 1
    bad[0, 90] ^= 4
    assert ecc.correct(bad, code)[1][0] == ecc.FAILED
    wrong = code.copy()
    wrong[0, 1] ^= 2
    assert ecc.correct(data, wrong)[1][0] == ecc.CODE_WRONG


@pytest.mark.parametrize("data", [b"", b"a", bytes(i % 256 for i in range(200)), b"A " * 512, os.urandom(3000), b"\0" * 9000, b"abcabcabd" * 700])
def test_lzari_round_trip(data):
    packed = lzari.encode(data)
    assert lzari.decode(packed, len(data)) == data
    if data[:2] == b"A ":
        assert len(packed) < len(data) // 10


def test_lzari_rejects_match_past_size():
    packed = lzari.encode(b"abcdefgh" * 50)
    with pytest.raises(ValueError):
        lzari.decode(packed, 9)


def test_shift_jis():
    assert text.decode_sjis(b"AB\x83\x41\xb1\0C") == "ABアｱ"
    assert text.decode_sjis(b"\x88\x9f\xff\x81") == "���"
    assert text.title_text(b"\x82\x60\x81\x40\x81\x7c\x81\x63\x81\x69") == "A -...("
    assert text.readable("“´”") == '" ́"'


def test_times():
    raw = struct.pack("<BBBBBBH", 0, 6, 47, 0, 4, 6, 2025)
    t = times.unpack_tod(raw)
    assert times.pack_tod(t) == raw
    assert times.unpack_tod(struct.pack("<BBBBBBH", 0, 0, 0, 25, 0, 0, 2000)) == times.unpack_tod(struct.pack("<BBBBBBH", 0, 0, 0, 1, 1, 1, 2000))


def icon_sys(one=b"\x82\x60", two=b"\x82\x61 "):
    raw = bytearray(964)
    raw[:4] = b"PS2D"
    struct.pack_into("<H", raw, 6, len(one))
    raw[192 : 192 + len(one + two)] = one + two
    raw[260:267] = b"ico.icn"
    return bytes(raw)


def test_containers():
    s = containers.from_files("BASLUS-1", {"icon.sys": icon_sys(), "b": b"x" * 1500, "a": b""}, NOW)
    assert [e.name for e, _ in s.files] == ["a", "b", "icon.sys"]
    assert s.title == "A B" and containers.long_name(s) == "BASLUS-1 AB"
    psu = containers.dump(s, "psu")
    assert len(psu) == 512 * 6 + 2048 + 1024 and containers.sniff(psu) == "psu"
    raw = containers.dump(s, "max")
    head = raw[:12] + bytes(4) + raw[16:92]
    assert struct.unpack_from("<I", raw, 12)[0] == zlib.crc32(head + raw[92:])
    assert raw[48:51] == b"A B"
    for kind, packed in (("psu", psu), ("max", raw)):
        t = containers.load(packed, NOW)
        assert (t.directory.name, [(e.name, d) for e, d in t.files]) == ("BASLUS-1", [(e.name, d) for e, d in s.files]), kind
    assert [x.directory.name for x in containers.from_zip(containers.to_zip([s]), NOW)] == ["BASLUS-1"]
    for bad in (psu[:600], psu[:-1500], b"Ps2PowerSave" + bytes(10), b"CFU\0" + bytes(40)):
        with pytest.raises(containers.FormatError):
            containers.load(bad, NOW)
    with pytest.raises(containers.Unsupported):
        containers.dump(s, "sps")


def test_sps():
    def header(name, length, mode):
        m = (mode & 255) << 8 | mode >> 8
        return struct.pack("<H64sI8xH2x", 98, name, length, m) + times.pack_tod(NOW) * 2

    long = lambda b: struct.pack("<I", len(b)) + b
    raw = containers.SPS_MAGIC + bytes(4) + long(b"d") + long(b"t") + long(b"") + bytes(4) + header(b"SAVE", 3, modes.RWX | modes.DIR) + header(b"f", 3, modes.RWX | modes.FILE) + b"abc" + bytes(4)
    s = containers.load(raw, NOW)
    assert s.directory.name == "SAVE" and [(e.name, d) for e, d in s.files] == [("f", b"abc")] and s.files[0][0].created == NOW


def icon(shapes=1, vertices=3, kind=0, tail=b"", magic=0x010000):
    body = b"".join(struct.pack("<4h", 4096, -4096, 2048, 0) * shapes + struct.pack("<4h2h4B", 0, 0, 4096, 0, 1024, 2048, 1, 2, 3, 4) for _ in range(vertices))
    return struct.pack("<5I", magic, shapes, kind, 0, vertices) + body + struct.pack("<IIfII", 1, 10, 1.5, 2, 1) + struct.pack("<4I", 0, 2, 0, 0) + bytes(8) + tail


def test_icons():
    got = icons.parse_icon(icon(2))
    assert got["positions"] == [[1.0, -1.0, 0.5] * 3] * 2 and got["normals"][:3] == [0, 0, 1] and got["uvs"][:2] == [0.25, 0.5]
    assert got["vertex_colors"] == bytes([1, 2, 3, 4] * 3) and got["texture"] is None and got["frame_count"] == 1
    pixel = struct.pack("<H", 31 | 3 << 5 | 1 << 10)
    plain = icons.parse_icon(icon(kind=4, tail=pixel * 128 * 128))["texture"]
    packed = struct.pack("<H", 128 * 128 - 2) + pixel + struct.pack("<H", 0x10000 - 2) + pixel * 2
    run = icons.parse_icon(icon(kind=12, tail=struct.pack("<I", len(packed)) + packed))["texture"]
    assert plain == run and len(plain) == 49152 and plain[:3] == bytes([248, 24, 8])
    assert icons.parse_icon(b"x" * 10) is None and icons.parse_icon(icon(magic=1)) is None and icons.parse_icon(icon()[:60]) is None


def test_image_faults():
    raw = bytearray(build(layout.geometry_of_mb(8), [(layout.Dirent(modes.NEW_DIR, 0, NOW, 0, 0, NOW, "D"), [entry("f", bytes(3000))])], NOW))
    flipped = bytearray(raw)
    page = (41 + 1) * 2 * 528
    flipped[page + 100] ^= 16
    i = Image(bytes(flipped))
    assert i.states[84] == ecc.DATA_FIXED and [e.name for *_, e in i.walk()] == [e.name for *_, e in Image(bytes(raw)).walk()]
    flipped[page + 101] ^= 1
    assert Image(bytes(flipped)).states[84] == ecc.FAILED
    with pytest.raises(layout.EccError):
        Image(bytes(flipped)).cluster(1)
    with pytest.raises(layout.Corrupt):
        Image(b"nothing")
    plain = build(layout.geometry_of_mb(8), [], NOW, with_ecc=False)
    assert len(plain) == 8388608 and not Image(plain).has_ecc
    with pytest.raises(layout.NoSpace):
        build(layout.geometry_of_mb(8), [entry("big", bytes(8330240))], NOW)


def test_allocation_takes_least_value_first():
    rnd = random.Random(5)
    files = [entry(f"f{i}", rnd.randbytes(rnd.randint(0, 5000))) for i in range(40)]
    i = Image(build(layout.geometry_of_mb(8), files, NOW))
    got = {e.name: i.read(e.cluster, e.length) for *_, s, e in i.walk() if s >= 2}
    assert got == {e.name: d for e, d in files}


def test_times_of_any_year():
    import datetime as dt

    from memtide.functions import times

    for y, mo, d, h in ((1970, 1, 1, 9), (2000, 2, 29, 0), (1999, 12, 31, 23), (2100, 3, 1, 5), (1, 1, 1, 9), (9999, 12, 31, 1)):
        unix = int((dt.datetime(y, mo, d, h) - dt.datetime(1970, 1, 1)).total_seconds()) - 9 * 3600
        raw = bytes([0, 0, 0, h, d, mo]) + y.to_bytes(2, "little")
        assert times.unpack_tod(raw) == unix and times.pack_tod(unix) == raw
    for raw in (b"\xff" * 8, bytes(8), bytes([0, 61, 75, 30, 40, 14, 255, 255])):
        again = times.pack_tod(times.unpack_tod(raw))
        assert len(again) == 8 and times.pack_tod(times.unpack_tod(again)) == again
