"""Fixed layout of card images, and the arithmetic of their geometry."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field, replace

from ..functions.rounding import div_round_up, round_down
from ..functions.times import pack_tod, unpack_tod

# Fixed values of the format.
MAGIC = b"Sony PS2 Memory Card Format "
VERSION = b"1.2.0.0\0\0\0\0\0"
ALLOCATED, CHAIN_END, FREE = 0x80000000, 0xFFFFFFFF, 0x7FFFFFFF
CLUSTER, PAGE, PAGES, PAGES_PER_BLOCK = 1024, 512, 16384, 16
INDIRECT_OFFSET, MAX_INDIRECT, DIRENT = 0x2000, 32, 512
SIZES_MB = (8, 16, 32, 64)
#: No card is larger; what a superblock says beyond that is damage.
MAX_BYTES = max(SIZES_MB) << 20


class CardError(Exception):
    kind = "error"


class Corrupt(CardError):
    kind = "corrupt"


class EccError(Corrupt):
    kind = "ecc"


class PathNotFound(CardError):
    kind = "path_not_found"


class IoError(CardError):
    kind = "io"


class NoSpace(IoError):
    kind = "no_space"


@dataclass(frozen=True)
class Geometry:
    page_size: int
    pages_per_cluster: int
    pages_per_block: int
    clusters: int
    alloc_offset: int
    alloc_end: int
    root: int
    good1: int
    good2: int
    indirect: tuple[int, ...]
    bad: tuple[int, ...] = (0xFFFFFFFF,) * 32
    fat_clusters: int = field(default=0, compare=False)

    @property
    def cluster_size(self) -> int:
        return self.page_size * self.pages_per_cluster

    @property
    def entries(self) -> int:
        return self.cluster_size // 4

    @property
    def possible(self) -> bool:
        """Whether a card can be so: sizes of the format, everything inside the card."""
        return (
            DIRENT <= self.page_size <= CLUSTER
            and self.page_size & (self.page_size - 1) == 0
            and self.page_size * self.pages_per_cluster == CLUSTER
            and self.pages_per_block > 0
            and 0 < self.clusters * CLUSTER <= MAX_BYTES
            and 0 < self.alloc_end <= self.clusters - min(self.alloc_offset, self.clusters)
            and self.root < self.alloc_end
        )

    @property
    def limit(self) -> int:
        """Clusters that may be allocated: up to the blocks kept for the superblock's spare copy."""
        return min(self.good1, self.good2) * self.pages_per_block // self.pages_per_cluster - self.alloc_offset

    @staticmethod
    def of(pages: int = PAGES, page_size: int = PAGE, pages_per_block: int = PAGES_PER_BLOCK) -> Geometry:
        """The layout that a freshly formatted card gets."""
        if pages_per_block < 1:
            raise CardError(f"invalid pages per erase block ({pages_per_block})")
        per = CLUSTER // page_size if page_size else 0
        if page_size < DIRENT or per < 1 or per * page_size != CLUSTER:
            raise CardError(f"invalid page size ({page_size})")
        pages = round_down(pages, pages_per_block)
        blocks, clusters, entries = pages // pages_per_block, pages // per, CLUSTER // 4
        first = div_round_up(INDIRECT_OFFSET, CLUSTER)
        fat = div_round_up(clusters - first - 2, entries)
        indirect = div_round_up(fat, entries)
        if indirect > MAX_INDIRECT:
            indirect, fat = MAX_INDIRECT, MAX_INDIRECT * entries
        offset = first + indirect + fat
        end = (blocks - 2) * (pages_per_block // per) - offset
        if end < 1:
            raise CardError("memory card image too small to be formatted")
        return Geometry(page_size, per, pages_per_block, clusters, offset, end, 0, blocks - 1, blocks - 2, tuple(range(first, first + indirect)) + (0,) * (MAX_INDIRECT - indirect), fat_clusters=fat)


def geometry_of_mb(mb: int) -> Geometry:
    if mb not in SIZES_MB:
        raise ValueError(f"card size must be one of {SIZES_MB}")
    return Geometry.of(pages=PAGES * mb // 8)


def unpack_superblock(raw: bytes) -> Geometry | None:
    """None if the bytes are no superblock."""
    if len(raw) < 340 or raw[:28] != MAGIC:
        return None
    size, per, block = struct.unpack_from("<3H", raw, 40)
    n, offset, end, root, g1, g2 = struct.unpack_from("<6I", raw, 48)
    return Geometry(size, per, block, n, offset, end, root, g1, g2, struct.unpack_from("<32I", raw, 80), struct.unpack_from("<32I", raw, 208))


def pack_superblock(g: Geometry) -> bytes:
    out = bytearray(340)
    out[:28], out[28:40] = MAGIC, VERSION
    struct.pack_into("<4H", out, 40, g.page_size, g.pages_per_cluster, g.pages_per_block, 0xFF00)
    struct.pack_into("<6I", out, 48, g.clusters, g.alloc_offset, g.alloc_end, g.root, g.good1, g.good2)
    struct.pack_into("<32I", out, 80, *g.indirect)
    struct.pack_into("<32I", out, 208, *g.bad)
    out[336:338] = b"\x02\x2b"
    return bytes(out)


@dataclass(frozen=True)
class Dirent:
    mode: int
    length: int
    created: int  # Unix seconds
    cluster: int
    parent: int
    modified: int
    name: str
    attr: int = 0
    unused: int = 0

    @staticmethod
    def unpack(raw: bytes) -> Dirent:
        mode, unused, length = struct.unpack_from("<HHI", raw, 0)
        cluster, parent = struct.unpack_from("<II", raw, 16)
        (attr,) = struct.unpack_from("<I", raw, 32)
        name = raw[64:512].partition(b"\0")[0].decode("latin-1")
        return Dirent(mode, length, unpack_tod(raw[8:16]), cluster, parent, unpack_tod(raw[24:32]), name, attr, unused)

    def changed(self, **fields) -> Dirent:
        """The same entry with other values in some fields."""
        return replace(self, **fields)

    def pack(self) -> bytes:
        out = bytearray(DIRENT)
        struct.pack_into("<HHI", out, 0, self.mode, self.unused, self.length)
        out[8:16] = pack_tod(self.created)
        struct.pack_into("<II", out, 16, self.cluster, self.parent)
        out[24:32] = pack_tod(self.modified)
        struct.pack_into("<I", out, 32, self.attr)
        name = self.name.encode("latin-1", "replace")[:448]
        out[64 : 64 + len(name)] = name
        return bytes(out)
