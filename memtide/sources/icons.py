"""icon.sys records and icon models."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from ..functions.text import title_text

ICON_SYS_SIZE, TEXTURE_BYTES, FIXED_POINT = 964, 128 * 128 * 2, 4096.0


@dataclass(frozen=True)
class IconSys:
    split: int
    title: bytes
    transparency: int
    colors: tuple[int, ...]
    lights: tuple[float, ...]  # three directions, three colours, ambient: four numbers each
    normal: str
    copy: str
    delete: str

    @staticmethod
    def unpack(raw: bytes) -> IconSys | None:
        if len(raw) < ICON_SYS_SIZE or raw[:4] != b"PS2D":
            return None
        name = lambda at: raw[at : at + 64].partition(b"\0")[0].decode("latin-1")
        return IconSys(*struct.unpack_from("<H", raw, 6), raw[192:260], *struct.unpack_from("<I", raw, 12), struct.unpack_from("<16I", raw, 16), struct.unpack_from("<28f", raw, 80), name(260), name(324), name(388))

    @property
    def titles(self) -> tuple[str, str]:
        t = self.title.partition(b"\0")[0]
        return title_text(t[: self.split]), title_text(t[self.split :])


def run_lengths(raw: bytes, at: int) -> bytes | None:
    """Expand 16-bit run lengths: a code with its top bit set counts literals down from 0x8000, another repeats one pixel."""
    if at + 4 > len(raw):
        return None
    (size,) = struct.unpack_from("<I", raw, at)
    body, out, i = raw[at + 4 :], bytearray(), 0
    while i < size and i + 2 <= len(body):
        code = body[i] | body[i + 1] << 8
        i += 2
        if code >= 0x8000:
            n = 2 * (0x10000 - code)
            out += body[i : i + n]
            i += n
        elif code:
            if i + 2 > len(body):
                break
            out += body[i : i + 2] * code
            i += 2
    return bytes(out)


def rgb(raw: bytes) -> bytes:
    """Three bytes a pixel of 5-bit colours, red lowest."""
    p = np.frombuffer(raw[: len(raw) // 2 * 2], "<u2")
    return np.stack([(p >> s & 31) << 3 for s in (0, 5, 10)], axis=1).astype(np.uint8).tobytes()


def parse_icon(raw: bytes) -> dict | None:
    """The model as plain values, or None where the rules of the format don't hold."""
    if len(raw) < 20:
        return None
    magic, shapes, kind, _, vertices = struct.unpack_from("<5I", raw, 0)
    stride = 8 * shapes + 16
    at = 20 + vertices * stride
    if magic != 0x010000 or not shapes or not vertices or at + 20 > len(raw):
        return None
    rows = np.frombuffer(raw, np.uint8, vertices * stride, 20).reshape(vertices, stride)
    fixed = lambda a, z: np.ascontiguousarray(rows[:, a:z]).view("<i2") / FIXED_POINT
    one, length, speed, offset, frames = struct.unpack_from("<IIfII", raw, at)
    if one != 1:
        return None
    at += 20
    for _ in range(frames):
        if at < 0 or at + 16 > len(raw):
            return None
        at += 16 + (struct.unpack_from("<I", raw, at + 4)[0] - 1) * 8
    texture = None
    if kind & 4 and at < len(raw):
        pixels = run_lengths(raw, at) if kind & 8 else raw[at : at + TEXTURE_BYTES]
        texture = rgb(pixels) if pixels is not None else None
    n = 8 * shapes
    return {
        "vertex_count": vertices,
        "animation_shapes": shapes,
        "positions": [fixed(8 * s, 8 * s + 6).ravel().tolist() for s in range(shapes)],
        "normals": fixed(n, n + 6).ravel().tolist(),
        "uvs": fixed(n + 8, n + 12).ravel().tolist(),
        "vertex_colors": rows[:, n + 12 :].tobytes(),
        "texture": texture,
        "frame_length": length,
        "anim_speed": speed,
        "play_offset": offset,
        "frame_count": frames,
    }
