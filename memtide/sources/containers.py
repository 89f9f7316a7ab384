"""Save containers: one save (a directory and its files) in psu, max or sps form, and zips."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from dataclasses import dataclass, field, replace

from ..functions import lzari, modes, text
from ..functions.rounding import round_up
from .icons import IconSys
from .layout import CLUSTER, DIRENT, Dirent

MAX_MAGIC, SPS_MAGIC = b"Ps2PowerSave", b"\x0d\0\0\0SharkPortSave"


class FormatError(ValueError):
    kind = "format"


class Unsupported(FormatError):
    kind = "unsupported"


@dataclass
class Save:
    directory: Dirent
    files: list[tuple[Dirent, bytes]] = field(default_factory=list)

    @property
    def icon_sys(self) -> IconSys | None:
        raw = next((d for e, d in self.files if e.name.lower() == "icon.sys"), None)
        return IconSys.unpack(raw) if raw is not None else None

    @property
    def title(self) -> str:
        i = self.icon_sys
        return (i and " ".join(i.titles).strip()) or self.directory.name


def sniff(head: bytes) -> str | None:
    if len(head) < 16:
        return None
    for magic, kind in ((b"CFU\0", "cbs"), (MAX_MAGIC, "max"), (b"nPort", "npo"), (SPS_MAGIC, "sps")):
        if head.startswith(magic):
            return kind
    return "psu"


class _Reader:
    def __init__(self, raw: bytes, what: str) -> None:
        self.raw, self.at, self.what = raw, 0, what

    def take(self, n: int) -> bytes:
        out = self.raw[self.at : self.at + n]
        if len(out) != n:
            raise FormatError(f"{self.what} file truncated at {self.at}")
        self.at += n
        return out

    def u32(self) -> int:
        return struct.unpack("<I", self.take(4))[0]


def _name(raw: bytes) -> str:
    return raw.partition(b"\0")[0].decode("latin-1")


def load_psu(raw: bytes) -> Save:
    r = _Reader(raw, "psu")
    top, *dots = (Dirent.unpack(r.take(DIRENT)) for _ in range(3))
    folder = lambda e: e.mode & modes.KIND == modes.EXISTS | modes.DIR
    if not all(map(folder, (top, *dots))) or top.length < 2:
        raise FormatError("psu: invalid directory")
    files = []
    for _ in range(top.length - 2):
        e = Dirent.unpack(r.take(DIRENT))
        if e.mode & modes.KIND != modes.EXISTS | modes.FILE:
            raise FormatError("psu: a subdirectory is not supported")
        files.append((e, r.take(e.length)))
        r.at += round_up(e.length, CLUSTER) - e.length
    return Save(replace(top, length=len(files)), files)


def save_psu(s: Save) -> bytes:
    d = s.directory
    dot = Dirent(modes.NEW_DIR, 0, d.created, 0, 0, d.created, ".")
    out = [replace(d, length=len(s.files) + 2).pack(), dot.pack(), replace(dot, name="..").pack()]
    for e, data in s.files:
        out += [replace(e, length=len(data)).pack(), data, bytes(round_up(len(data), CLUSTER) - len(data))]
    return b"".join(out)


def load_max(raw: bytes, now: int) -> Save:
    """Times and modes are not kept by this container: ``now`` and plain ones stand for them; its checksum is not looked at."""
    r = _Reader(raw, "max")
    head = r.take(92)
    if head[:12] != MAX_MAGIC:
        raise FormatError("not a max save")
    packed, count, size = struct.unpack_from("<3I", head, 80)
    body = raw[92:] if packed == size else r.take(packed - 4)
    try:
        data = lzari.decode(body, size)
    except ValueError as e:
        raise FormatError(f"max: {e}") from e
    r, files = _Reader(data, "max"), []
    for _ in range(count):
        n = r.u32()
        name = _name(r.take(32))
        files.append((Dirent(modes.NEW_FILE, n, now, 0, 0, now, name), r.take(n)))
        r.at = round_up(r.at + 8, 16) - 8
    return Save(Dirent(modes.NEW_DIR, len(files), now, 0, 0, now, _name(head[16:48])), files)


def save_max(s: Save) -> bytes:
    body = bytearray()
    for e, data in s.files:
        body += struct.pack("<I32s", len(data), e.name.encode("latin-1", "replace")) + data
        body += bytes(round_up(len(body) + 8, 16) - 8 - len(body))
    packed = lzari.encode(bytes(body))
    one, two = s.icon_sys.titles if s.icon_sys else ("", "")
    title = one + (" " if one and one[-1] != " " else "") + two.rstrip()
    head = struct.pack("<12sI32s32s3I", MAX_MAGIC, 0, s.directory.name.encode("latin-1", "replace"), title.encode("latin-1", "replace"), len(packed) + 4, len(s.files), len(body))
    return head[:12] + struct.pack("<I", zlib.crc32(packed, zlib.crc32(head))) + head[16:] + packed


def load_sps(raw: bytes) -> Save:
    r = _Reader(raw, "sps")
    if r.take(17) != SPS_MAGIC:
        raise FormatError("not a sps save")
    r.take(4)
    for _ in range(3):
        r.take(r.u32())
    r.take(4)

    def entry(kind: int) -> Dirent:
        h = r.take(98)
        size, name, length, mode = struct.unpack_from("<H64sI8xH", h, 0)
        if size < 98 and kind == modes.FILE:
            raise FormatError("sps: header too short")
        r.take(max(0, size - 98))
        mode = (mode & 255) << 8 | mode >> 8 | modes.EXISTS
        if mode & modes.KIND != modes.EXISTS | kind:
            raise FormatError("sps: entry of the wrong kind")
        d = Dirent.unpack(bytes(8) + h[82:90] + bytes(8) + h[90:98] + bytes(480))
        return Dirent(mode, length, d.created, 0, 0, d.modified, _name(name))

    top = entry(modes.DIR)
    if top.length < 2:
        raise FormatError("sps: bad directory")
    files = []
    for _ in range(top.length - 2):
        e = entry(modes.FILE)
        files.append((e, r.take(e.length)))
    return Save(replace(top, length=len(files)), files)


def load(raw: bytes, now: int) -> Save:
    kind = sniff(raw[:32])
    if kind == "psu":
        return load_psu(raw)
    if kind == "max":
        return load_max(raw, now)
    if kind == "sps":
        return load_sps(raw)
    raise Unsupported(f"{kind or 'unknown'} saves can't be read")


def dump(s: Save, kind: str) -> bytes:
    if kind == "psu":
        return save_psu(s)
    if kind == "max":
        return save_max(s)
    raise Unsupported(f"{kind} saves can't be written")


def from_files(directory: str, files: dict[str, bytes], now: int) -> Save:
    """A save of host files, by name."""
    made = [(Dirent(modes.NEW_FILE, len(b), now, 0, 0, now, n), b) for n, b in sorted(files.items())]
    return Save(Dirent(modes.NEW_DIR, len(made), now, 0, 0, now, directory), made)


def to_zip(saves: list[Save]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for s in saves:
            for e, data in s.files:
                z.writestr(zipfile.ZipInfo(f"{s.directory.name}/{e.name}", (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def from_zip(raw: bytes, now: int) -> list[Save]:
    """One save for each top folder; what lies deeper or at the top is left out."""
    groups: dict[str, dict[str, bytes]] = {}
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for i in z.infolist():
                parts = i.filename.split("/")
                if not i.is_dir() and len(parts) >= 2 and parts[-1]:
                    groups.setdefault(parts[0], {})[parts[-1]] = z.read(i)
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError) as e:
        raise FormatError(f"zip: {e}") from e
    return [from_files(d, f, now) for d, f in groups.items()]


def long_name(s: Save) -> str:
    import re

    i = s.icon_sys
    t = re.sub(r"\s+", " ", re.sub(text.ILLEGAL, "_", "".join(i.titles))).strip() if i else ""
    return f"{s.directory.name} {t}" if t else s.directory.name
