"""Card images and save files as Spark tables: many cards at once, a lazy table for each kind of row."""

from __future__ import annotations

import itertools
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import modes
from ..operators import listing, space
from . import containers, icons, layout
from .image import Image, build
from .layout import ALLOCATED, CHAIN_END, CardError

_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
SUPERBLOCK = "card_id string, page_size int, pages_per_cluster int, pages_per_block int, clusters long, alloc_offset long, alloc_end long, cluster_size int, alloc_limit long, has_ecc boolean, error string"
PAGES = "card_id string, page long, state int"
FAT = "card_id string, cluster long, raw long, allocated boolean, next long"
DIRENTS = "card_id string, dir_path string, dir_cluster long, slot int, mode int, length long, created long, modified long, cluster long, parent long, attr long, name string, own_parent long, own_slot long"
FILES = "card_id string, path string, parent string, name string, slot int, mode int, length long, created long, modified long, data binary"
CHAINS = "card_id string, path string, visit int, pos int, cluster long"
FINDINGS = "card_id string, kind string, path string, detail string"
SAVES = "card_id string, slot int, name string, mode int, title1 string, title2 string, size long, modified long, normal_icon string"
ENDINGS = "card_id string, path string, visit int, is_dir boolean, length long, ending string"


def kernel(images: DataFrame, schema: str, rows, *more) -> DataFrame:
    """``rows(card_id, content, *more)`` of every image, a batch of output for each card; a card that can't be read gives none,
    and one that breaks off what came before."""
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]
    types = pa.schema([(c.strip().split(" ")[0], _TYPES[c.strip().split(" ")[1]]) for c in schema.split(", ")])

    def run(batches):
        for b in batches:
            for card, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                out = []
                try:
                    out.extend(rows(card, raw.as_py() or b"", *more))
                except CardError:  # told by errors()
                    pass
                got = list(zip(*out, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(got, types.types, strict=True)], schema=types)

    return images.select("card_id", "content").mapInArrow(run, schema)


def _superblock(card, raw, ignore_ecc=False):
    try:
        i = Image(raw, ignore_ecc)
        i.root()
        g = i.g
        yield card, g.page_size, g.pages_per_cluster, g.pages_per_block, g.clusters, g.alloc_offset, g.alloc_end, g.cluster_size, g.limit, i.has_ecc, None
    except CardError as e:
        yield card, *[None] * 9, f"{e.kind}: {e}"


def _read(raw, ignore_ecc) -> Image:
    i = Image(raw, ignore_ecc)
    i.root()
    return i


def _pages(card, raw, ignore_ecc=False):
    yield from ((card, p, int(s)) for p, s in enumerate(_read(raw, ignore_ecc).states))


def _fat(card, raw, ignore_ecc=False):
    for c, v in enumerate(_read(raw, ignore_ecc).fat.tolist()):
        yield card, c, v, bool(v & ALLOCATED), None if v == CHAIN_END or not v & ALLOCATED else v & ~ALLOCATED


def _dirents(card, raw, ignore_ecc=False):
    i = _read(raw, ignore_ecc)
    place = {i.g.root: (0, 0)}
    for path, first, slot, e in i.walk([]):
        if slot >= 2 and e.mode & modes.EXISTS and e.mode & modes.DIR:
            place.setdefault(e.cluster, (first, slot))
        yield card, path, first, slot, e.mode, e.length, e.created, e.modified, e.cluster, e.parent, e.attr, e.name, *place.get(first, (0, 0))


def _content(i, e, offset=0, size=None):
    """A file's bytes, or None for a directory and for what can't be read."""
    try:
        return None if e.mode & modes.DIR else i.read_range(e.cluster, e.length, offset, size)
    except CardError:
        return None


def _files(card, raw, ignore_ecc=False):
    i = _read(raw, ignore_ecc)
    for path, _, slot, e in i.walk([]):
        if slot >= 2 and e.mode & modes.EXISTS:
            yield card, path + e.name, path.rstrip("/"), e.name, slot, e.mode, e.length, e.created, e.modified, _content(i, e)


def _part(card, raw, ignore_ecc, wanted, offset, size):
    i = _read(raw, ignore_ecc)
    for path, _, slot, e in i.walk([]):
        if slot >= 2 and e.mode & modes.EXISTS and path + e.name == wanted and not e.mode & modes.DIR:
            yield card, wanted, e.length, _content(i, e, offset, size)
            return


def _visits(i, unread):
    yield "/", True, i.g.root, i.root().length * layout.DIRENT
    for path, _, slot, e in i.walk(unread):
        if slot >= 2 and e.mode & modes.EXISTS:
            folder = bool(e.mode & modes.DIR)
            yield path + e.name, folder, e.cluster, e.length * (layout.DIRENT if folder else 1)


def _chains(card, raw, ignore_ecc=False):
    i = _read(raw, ignore_ecc)
    for visit, (path, _, first, _) in enumerate(_visits(i, [])):
        yield from ((card, path, visit, pos, c) for pos, c in enumerate(i.chain(first)))


def _ending(i, first, chain) -> str:
    last = int(i.fat[chain[-1]]) if chain else first
    return "end" if last == CHAIN_END else "unallocated" if not last & ALLOCATED else "loop or out of range"


def _endings(card, raw, ignore_ecc=False):
    i = _read(raw, ignore_ecc)
    for visit, (path, folder, first, length) in enumerate(_visits(i, [])):
        yield card, path, visit, folder, length, _ending(i, first, list(i.chain(first)))


def _errors(card, raw, ignore_ecc=False):
    try:
        i = _read(raw, ignore_ecc)
    except CardError as e:
        yield card, None, f"{e.kind}: {e}"
        return
    unread: list = []
    for path, _, slot, e in i.walk(unread):
        if slot >= 2 and e.mode & modes.EXISTS and not e.mode & modes.DIR:
            try:
                i.read(e.cluster, e.length)
            except CardError as x:
                yield card, path + e.name, f"{x.kind}: {x}"
    yield from ((card, p.rstrip("/") or "/", x) for p, x in unread)


def _findings(card, raw, ignore_ecc=False):
    """All that ``check.findings`` tells, from one decoding of the card; it is local to the card, so nothing is shuffled."""
    try:
        i = _read(raw, ignore_ecc)
    except CardError as e:
        yield card, "unreadable", None, f"{e.kind}: {e}"
        return
    unread: list = []
    seen: set[int] = set()
    for path, _, first, length in _visits(i, unread):
        chain = list(i.chain(first))
        yield from ((card, "cross-linked", path, str(c)) for c in chain if c in seen)
        seen.update(chain)
        want = -(-length // layout.CLUSTER)
        if len(chain) != want:
            yield card, "bad chain", path, f"{len(chain)}/{want}"
        if (ending := _ending(i, first, chain)) != "end":
            yield card, "bad chain", path, ending
    for c in np.flatnonzero(i.fat & ALLOCATED).tolist():
        if c not in seen:
            yield card, "lost", None, str(c)
    place = {i.g.root: (0, 0)}
    for path, first, slot, e in i.walk([]):
        if slot >= 2 and e.mode & modes.EXISTS and e.mode & modes.DIR:
            place.setdefault(e.cluster, (first, slot))
        if slot == 0 and e.name != ".":
            yield card, "bad directory", path, 'missing "." entry'
        if slot == 0 and (e.cluster, e.parent) != place.get(first, (0, 0)):
            yield card, "bad directory", path, 'bad "." entry'
        if slot == 1 and e.name != "..":
            yield card, "bad directory", path, 'missing ".." entry'
    yield from ((card, "unreadable", p, x) for p, x in unread)


def _saves(card, raw, ignore_ecc=False):
    i = _read(raw, ignore_ecc)
    unit, top, sizes, titles = layout.CLUSTER, {}, {}, {}
    for path, _, slot, e in i.walk([]):
        if slot < 2 or not e.mode & modes.EXISTS:
            continue
        folder = bool(e.mode & modes.DIR)
        save = (path + e.name).split("/")[1]
        if path == "/" and folder:
            top[e.name] = (slot, e)
        sizes[save] = sizes.get(save, 0) + -(-e.length * (layout.DIRENT if folder else 1) // unit) * unit
        if e.name == "icon.sys" and path.count("/") == 2 and not folder:
            titles[save] = icons.IconSys.unpack(_content(i, e) or b"")
    for name, (slot, e) in top.items():
        s = titles.get(name)
        yield card, slot, name, e.mode, *(s.titles if s else ("Corrupt", "")), sizes[name], e.modified, s.normal if s else None


class Cards:
    """Lazy tables over images (card_id, content); each decodes only what it needs."""

    def __init__(self, images: DataFrame, ignore_ecc: bool = False) -> None:
        """``ignore_ecc``: take images for such without codes, as their bytes lie."""
        self.images, self.ignore_ecc = images, ignore_ecc

    def _table(self, schema: str, rows, *more) -> DataFrame:
        return kernel(self.images, schema, rows, self.ignore_ecc, *more)

    def superblocks(self) -> DataFrame:
        return self._table(SUPERBLOCK, _superblock)

    def errors(self) -> DataFrame:
        """(card_id, path, error) of cards, directories and files that can't be read."""
        return self._table("card_id string, path string, error string", _errors)

    def pages(self) -> DataFrame:
        return self._table(PAGES, _pages)

    def fat(self) -> DataFrame:
        return self._table(FAT, _fat)

    def dirents(self) -> DataFrame:
        return self._table(DIRENTS, _dirents)

    def entries(self) -> DataFrame:
        return self._table(FILES, _files)

    def chains(self) -> DataFrame:
        return self._table(CHAINS, _chains)

    def endings(self) -> DataFrame:
        return self._table(ENDINGS, _endings)

    def file(self, path: str, offset: int = 0, size: int | None = None, cwd: str = "/") -> DataFrame:
        """(card_id, path, length, data) of a file on each card that has it: all its bytes, or ``size`` from ``offset`` on."""
        return self._table("card_id string, path string, length long, data binary", _part, listing.absolute(path, cwd), offset, size)

    def mode(self, path: str, cwd: str = "/") -> DataFrame:
        """(card_id, mode) of an entry on each card that has it."""
        at = listing.absolute(path, cwd)
        if at == "/":
            return self.dirents().where("dir_path = '/' AND slot = 0").select("card_id", "mode")
        folder, _, name = at.rpartition("/")
        return self.dirents().where((F.col("dir_path") == f"{folder}/") & (F.col("name") == name) & (F.col("slot") >= 2) & modes.exists(F.col("mode"))).select("card_id", "mode")

    def free_space(self) -> DataFrame:
        return space.free_space(self.fat(), self.superblocks().where("error IS NULL"))

    def allocatable(self) -> DataFrame:
        """(card_id, bytes) that files may ever take: up to the blocks kept for the superblock's spare copy."""
        return space.allocatable(self.superblocks().where("error IS NULL"))

    def ls(self, path: str = "/", zone: str = "UTC", cwd: str = "/") -> DataFrame:
        return listing.ls(self.dirents().where(F.col("dir_path") == (listing.absolute(path, cwd).rstrip("/") + "/")), zone)

    def glob(self, pattern: str, cwd: str = "/") -> DataFrame:
        """(card_id, path) of what matches in the pattern's directory; a card without any gives the pattern itself."""
        return listing.glob_paths(self.dirents(), self.images.select("card_id"), pattern, cwd)

    def sizes(self) -> DataFrame:
        e = self.entries().select("card_id", "path", modes.is_dir(F.col("mode")).alias("is_dir"), "length")
        root = self.dirents().where("dir_path = '/' AND slot = 0").select("card_id", F.lit("/").alias("path"), F.lit(True).alias("is_dir"), "length")
        return space.tree_sizes(e.unionByName(root))

    def saves(self) -> DataFrame:
        """(card_id, slot, name, title1, title2, title, size, protection, modified, normal_icon) of every save, from one decoding."""
        whole = F.trim(F.concat_ws(" ", "title1", "title2"))
        title = F.when(F.col("normal_icon").isNull(), F.col("title1")).when(whole == "", F.col("name")).otherwise(whole)
        return self._table(SAVES, _saves).select("card_id", "slot", "name", "title1", "title2", title.alias("title"), "size", modes.protection(F.col("mode")).alias("protection"), "modified", "normal_icon")

    def icons(self) -> DataFrame:
        """Parsed icon models of the saves whose icon.sys names one (names as they are written)."""
        e = self.entries().where("data IS NOT NULL")
        want = self.saves().select("card_id", F.concat(F.lit("/"), "name").alias("parent"), F.col("normal_icon").alias("name"))
        return e.join(want, ["card_id", "parent", "name"]).select("card_id", "path", icon_model(F.col("data")).alias("icon")).where("icon IS NOT NULL")

    def info(self) -> DataFrame:
        return space.summaries(self.free_space(), self.saves())

    def check(self) -> DataFrame:
        """(card_id, kind, path, detail) of all findings, from one decoding of each card; a card without any is sound."""
        return self._table(FINDINGS, _findings)

    def export(self, kind: str = "psu") -> DataFrame:
        return encode_saves(self.entries(), kind)


ICON_SYS = "title1 string, title2 string, normal_icon string, copy_icon string, delete_icon string, transparency long, colors array<long>, lights array<float>"
ICON = "vertex_count long, animation_shapes long, positions array<array<float>>, normals array<float>, uvs array<float>, vertex_colors binary, texture binary, frame_length long, anim_speed float, play_offset long, frame_count long"


def _icon_sys(raw):
    i = icons.IconSys.unpack(bytes(raw)) if raw is not None else None
    return (*i.titles, i.normal, i.copy, i.delete, i.transparency, list(i.colors), list(i.lights)) if i else None


def _icon_model(raw):
    return icons.parse_icon(bytes(raw)) if raw is not None else None


def _struct(fields: str) -> str:
    return f"struct<{', '.join(c.replace(' ', ': ', 1) for c in fields.split(', '))}>"


def icon_sys(data):
    """icon.sys bytes as a struct of ICON_SYS, null where they are none; batches of Arrow cross to Python."""
    return F.udf(_icon_sys, _struct(ICON_SYS), useArrow=True)(data)


def icon_model(data):
    return F.udf(_icon_model, _struct(ICON), useArrow=True)(data)


def read_cards(spark: SparkSession, path: str, ignore_ecc: bool = False) -> Cards:
    """Images of a path or glob, read by Spark's own file source."""
    files = spark.read.format("binaryFile").load(path)
    return Cards(files.select(F.col("path").alias("card_id"), "content"), ignore_ecc)


def read_folders(spark: SparkSession, path: str, now: int = 0) -> DataFrame:
    """Entries of host folders (a path or glob of folders) as saves: each folder's files by name; what lies deeper is left out."""
    files = spark.read.format("binaryFile").load(path)
    parts = F.split("path", "/")
    return folder_entries(files.select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), F.col("content").alias("data")), now)


def zip_groups(members: DataFrame, path: str = "path") -> DataFrame:
    """Members of zips with the top folder that makes each one's save; those at the top or without a name belong to none."""
    parts = F.split(path, "/")
    return members.withColumn("folder", parts[0]).where((F.size(parts) >= 2) & (F.element_at(parts, -1) != ""))


def in_order(files: DataFrame, folder: str = "folder", *order: str) -> DataFrame:
    """``slot``: the place of each file of a folder, by name, after the two dots."""
    return files.withColumn("slot", F.row_number().over(Window.partitionBy(folder).orderBy(*(order or ("name",)))) + 1)


def folder_entries(files: DataFrame, now: int = 0) -> DataFrame:
    """Entries of (folder, name, data) rows: a directory for each folder, its files in slots by name."""
    t = F.lit(now).cast("long")
    f = in_order(files).select(F.col("folder").alias("card_id"), F.concat(F.lit("/"), "folder", F.lit("/"), "name").alias("path"), F.concat(F.lit("/"), "folder").alias("parent"), "name", F.col("slot").cast("int").alias("slot"), F.lit(modes.NEW_FILE).alias("mode"), F.length("data").cast("long").alias("length"), t.alias("created"), t.alias("modified"), "data")
    d = files.groupBy("folder").agg(F.count(F.lit(1)).alias("length"))
    d = d.select(F.col("folder").alias("card_id"), F.concat(F.lit("/"), "folder").alias("path"), F.lit("").alias("parent"), F.col("folder").alias("name"), F.lit(None).cast("int").alias("slot"), F.lit(modes.NEW_DIR).alias("mode"), "length", t.alias("created"), t.alias("modified"), F.lit(None).cast("binary").alias("data"))
    return f.unionByName(d)


def blank_cards(spark: SparkSession, n: int, size_mb: int = 8, now: int | None = None, with_ecc: bool = True) -> Cards:
    entries = spark.createDataFrame([], FILES)
    ids = spark.range(n).select(F.concat(F.lit("card-"), F.col("id").cast("string")).alias("card_id"))
    return Cards(encode_images(entries, size_mb, now, with_ecc, ids))


def encode_images(entries: DataFrame, size_mb: int = 8, now: int | None = None, with_ecc: bool = True, cards: DataFrame | None = None) -> DataFrame:
    """Images (card_id, content, error) of ``entries``: each card is a unit of one task, at most 64 MB by the format.

    Entries keep their slots; those without one, or whose slot is taken, fill the slots that deleted entries left, by name, and
    then come after the last.
    """
    g, now = layout.geometry_of_mb(size_mb), int(time.time()) if now is None else now
    ids = (cards if cards is not None else entries.select("card_id")).distinct().select("card_id")
    root = ids.select("card_id", *[F.lit(None).cast(entries.schema[c].dataType).alias(c) for c in entries.columns if c != "card_id"])

    def one(key, table):
        rows = [r for r in table.to_pylist() if r["path"] is not None]
        below: dict[str, list] = {}
        for r in sorted(rows, key=lambda r: (r["slot"] is None, r["slot"] or 0, r["name"])):
            below.setdefault(r["parent"] or "", []).append(r)

        def slots(rows):
            placed, rest = {}, []
            for r in rows:
                if r["slot"] is None or r["slot"] < 2 or r["slot"] in placed:
                    rest.append(r)
                else:
                    placed[r["slot"]] = r
            holes = (s for s in itertools.count(2) if s not in placed)
            placed |= {s: r for r, s in zip(sorted(rest, key=lambda r: r["name"]), [next(holes) for _ in rest], strict=True)}
            return [placed.get(s) for s in range(2, max(placed, default=1) + 1)]

        def tree(path):
            out = []
            for r in slots(below.get(path, [])):
                if r is None:
                    out.append(None)
                    continue
                e = layout.Dirent(r["mode"], r["length"], r["created"], 0, 0, r["modified"], r["name"][:32])
                out.append((e, tree(r["path"]) if r["mode"] & modes.DIR else r["data"] or b""))
            return out

        try:
            raw, error = build(g, tree(""), now, with_ecc), None
        except CardError as e:
            raw, error = None, f"{e.kind}: {e}"
        return pa.table({"card_id": [key[0].as_py()], "content": pa.array([raw], pa.binary()), "error": pa.array([error], pa.string())})

    return entries.unionByName(root).groupBy("card_id").applyInArrow(one, "card_id string, content binary, error string")


def read_saves(files: DataFrame, now: int = 0) -> DataFrame:
    """Entries of save containers (card_id, content): the directory and its files, or a row with ``error``."""
    schema = FILES + ", error string"

    def rows(card, raw):
        try:
            s = containers.load(raw, now)
        except containers.FormatError as e:
            yield card, *[None] * 9, f"{e.kind}: {e}"
            return
        d = s.directory
        yield card, f"/{d.name}", "", d.name, None, d.mode, d.length, d.created, d.modified, None, None
        for e, data in s.files:
            yield card, f"/{d.name}/{e.name}", f"/{d.name}", e.name, None, e.mode, e.length, e.created, e.modified, data, None

    return kernel(files, schema, rows)


def encode_saves(entries: DataFrame, kind: str = "psu") -> DataFrame:
    """Containers (card_id, name, content, error) of every save in ``entries``; ``kind`` may be psu, max or zip."""
    top = F.regexp_extract("path", "^/([^/]*)", 1)

    def one(key, table):
        rows = table.to_pylist()
        name = key[1].as_py()
        d = next((r for r in rows if r["path"] == f"/{name}"), None)
        mine = sorted((r for r in rows if r["parent"] == f"/{name}" and r["mode"] & modes.FILE), key=lambda r: (r["slot"] is None, r["slot"] or 0, r["name"]))
        as_entry = lambda r: layout.Dirent(r["mode"], r["length"], r["created"], 0, 0, r["modified"], r["name"])
        try:
            if d is None:
                raise containers.FormatError("no directory entry")
            s = containers.Save(as_entry(d), [(as_entry(r), r["data"] or b"") for r in mine])
            raw, error = containers.to_zip([s]) if kind == "zip" else containers.dump(s, kind), None
        except containers.FormatError as e:
            raw, error = None, f"{e.kind}: {e}"
        return pa.table({"card_id": [key[0].as_py()], "name": [name], "content": pa.array([raw], pa.binary()), "error": pa.array([error], pa.string())})

    return entries.withColumn("__save", top).groupBy("card_id", "__save").applyInArrow(one, "card_id string, name string, content binary, error string")


def encode_zips(entries: DataFrame) -> DataFrame:
    """One zip (card_id, content) of all saves of each card, a folder for each; what a card holds is 64 MB at most."""

    def one(key, table):
        rows = table.to_pylist()
        as_entry = lambda r: layout.Dirent(r["mode"], r["length"], r["created"], 0, 0, r["modified"], r["name"])
        order = lambda r: (r["slot"] is None, r["slot"] or 0, r["name"])
        saves = []
        for d in sorted((r for r in rows if r["parent"] == "" and r["mode"] & modes.DIR), key=order):
            mine = sorted((r for r in rows if r["parent"] == d["path"] and not r["mode"] & modes.DIR), key=order)
            saves.append(containers.Save(as_entry(d), [(as_entry(r), r["data"] or b"") for r in mine]))
        return pa.table({"card_id": [key[0].as_py()], "content": pa.array([containers.to_zip(saves)], pa.binary())})

    return entries.groupBy("card_id").applyInArrow(one, "card_id string, content binary")


def read_zips(files: DataFrame, now: int = 0) -> DataFrame:
    """Entries of zips (card_id, content): each top folder is a save; what is no zip is a row with ``error``."""

    def rows(card, raw):
        try:
            saves = containers.from_zip(raw, now)
        except containers.FormatError as e:
            yield card, *[None] * 9, f"{e.kind}: {e}"
            return
        for s in saves:
            d = s.directory
            yield card, f"/{d.name}", "", d.name, None, d.mode, d.length, d.created, d.modified, None, None
            for e, data in s.files:
                yield card, f"/{d.name}/{e.name}", f"/{d.name}", e.name, None, e.mode, e.length, e.created, e.modified, data, None

    return kernel(files, FILES + ", error string", rows)


def convert(files: DataFrame, kind: str, now: int = 0) -> DataFrame:
    """Containers to containers of another kind; what can't be read is a row with its error."""
    got = read_saves(files, now)
    bad = got.where("error IS NOT NULL").select("card_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("binary").alias("content"), "error")
    return encode_saves(got.where("error IS NULL").drop("error"), kind).union(bad)
