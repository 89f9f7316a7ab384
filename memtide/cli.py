"""Command line for one card: ``python -m memtide.cli CARD COMMAND ...``; a thin layer over the tables.

Only one card's bytes (64 MB at most) ever come to this process.
"""

from __future__ import annotations

import argparse
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import modes
from .operators import listing, mutate
from .sources import cards, containers, layout, sinks

FLAGS = {"p": modes.PROTECTED, "w": modes.WRITE, "r": modes.READ, "x": modes.EXECUTE, "H": modes.HIDDEN, "s": modes.PSX, "k": modes.POCKETSTATION}


class Session:
    def __init__(self, path: str, ignore_ecc: bool = False) -> None:
        self.path, self.now, self.ignore_ecc = path, int(time.time()), ignore_ecc
        self.spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        self.spark.sparkContext.setLogLevel("ERROR")

    def card(self) -> cards.Cards:
        c = cards.read_cards(self.spark, os.path.abspath(self.path), self.ignore_ecc)
        sb = c.superblocks().first()
        if sb is None or sb.error:
            raise layout.CardError(sb.error if sb else "no such card")
        self.sb = sb
        return c

    def rows(self, *names: str, column: str = "path"):
        c = self.card().images.first().card_id
        return self.spark.createDataFrame([(c, "/" + n.strip("/")) for n in names], f"card_id string, {column} string")

    def write(self, entries, size_mb: int | None = None, ecc: bool = True, ids=None) -> None:
        out = cards.encode_images(entries, size_mb or self.sb.clusters // 1024, self.now, ecc, ids).first()
        if out.error:
            raise layout.CardError(out.error)
        with open(self.path + ".part", "wb") as f:
            f.write(out.content)
        os.replace(self.path + ".part", self.path)

    def apply(self, result) -> int:
        state, refused = result if isinstance(result, tuple) else (result, None)
        bad = refused.collect() if refused is not None else []
        for r in bad:
            print(f"{r.path}: {r.reason}", file=sys.stderr)
        self.write(state, ids=self.card().images.select("card_id"))
        return int(bool(bad))

    def saves_of(self, files: list[str]):
        c = self.card().images.first().card_id if os.path.exists(self.path) else self.path
        loaded = []
        for f in files:  # all are read before the card is touched
            if os.path.isdir(f):
                inside = {n: open(os.path.join(f, n), "rb").read() for n in sorted(os.listdir(f)) if os.path.isfile(os.path.join(f, n))}
                loaded.append(containers.from_files(os.path.basename(os.path.abspath(f)), inside, self.now))
            elif f.lower().endswith(".zip"):
                loaded += containers.from_zip(open(f, "rb").read(), self.now)
            else:
                loaded.append(containers.load(open(f, "rb").read(), self.now))
        rows = []
        for s in loaded:
            d = s.directory
            rows.append((c, f"/{d.name}", "", d.name, None, d.mode, d.length, d.created, d.modified, None))
            rows += [(c, f"/{d.name}/{e.name}", f"/{d.name}", e.name, None, e.mode, e.length, e.created, e.modified, data) for e, data in s.files]
        return self.spark.createDataFrame(rows, cards.FILES)

    def written(self, files, folder: str, policy: str) -> int:
        """Write files of a table under a folder of this machine and tell of each; 0 if nothing was in the way."""
        with tempfile.TemporaryDirectory() as report:
            done = sinks.write_files(files, os.path.abspath(folder), policy, f"file://{report}/written").orderBy("name").collect()
        for r in done:
            print(f"{r.name}: {r.state}")
        return int(not done or any(r.state == "exists" for r in done))


def run(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="memtide", description=__doc__)
    p.add_argument("--ignore-ecc", "-i", action="store_true", help="take the card for an image without codes")
    p.add_argument("card")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, *args, **flags):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a.rstrip("*+"), nargs=a[-1] if a[-1] in "*+" else None)
        for f, kind in flags.items():
            o = "--" + f.replace("_", "-")
            c.add_argument(o, action="store_true") if kind is bool else c.add_argument(o, type=kind)
        return c

    for name in ("df", "dir", "check", "help", "usage", "u"):
        command(name)
    command("ls", "paths*", created=bool)
    command("add", "files+", directory=str)
    command("extract", "files+", output=str, directory=str)
    command("mkdir", "paths+")
    command("remove", "paths+")
    command("delete", "paths+")
    command("rename", "old", "new")
    command("format", size=int, no_ecc=bool, overwrite_existing=bool)
    command("create", "files+", size=int, overwrite_existing=bool)
    command("convert", "output")
    command("import", "files+", ignore_existing=bool, overwrite_existing=bool)
    command("import-all", "files+", ignore_existing=bool, overwrite_existing=bool)
    for name in ("export", "export-files", "export-files-zip"):
        command(name, "paths+", type=str, directory=str, long_names=bool, ignore_existing=bool, overwrite_existing=bool)
    command("export-all", directory=str, ignore_existing=bool, overwrite_existing=bool)
    command("export-all-zip", output=str, directory=str, overwrite_existing=bool)
    for name in ("set", "clear"):
        command(name, "flags", "paths+", hex_mode=str)
    a = p.parse_args(argv)
    if a.command in ("help", "usage", "u"):
        p.print_help()
        return 0
    if getattr(a, "ignore_existing", False) and getattr(a, "overwrite_existing", False):
        print("--ignore-existing and --overwrite-existing exclude each other", file=sys.stderr)
        return 1
    policy = "skip" if getattr(a, "ignore_existing", False) else "replace" if getattr(a, "overwrite_existing", False) else "error"
    s = Session(a.card, a.ignore_ecc)
    try:
        return _run(a, s, policy)
    except (layout.CardError, containers.FormatError, OSError) as e:
        print(f"{a.card}: {e}", file=sys.stderr)
        return 1


def _run(a, s: Session, policy: str) -> int:
    now = F.lit(s.now).cast("long")
    if a.command == "convert":
        kind = containers.sniff(open(a.card, "rb").read(32)) and os.path.splitext(a.output)[1][1:].lower()
        raw = containers.dump(containers.load(open(a.card, "rb").read(), s.now), kind)
        with open(a.output, "wb") as f:
            f.write(raw)
        return 0
    if a.command in ("format", "create"):
        if os.path.exists(a.card) and not a.overwrite_existing:
            raise layout.IoError("exists already")
        if os.path.exists(a.card):
            os.remove(a.card)
        saves = s.saves_of(a.files) if a.command == "create" else s.spark.createDataFrame([], cards.FILES)
        s.write(saves, a.size or 8, not getattr(a, "no_ecc", False), s.spark.createDataFrame([(a.card,)], "card_id string"))
        return 0
    c = s.card()
    if a.command == "df":
        print(f"{a.card}: {c.free_space().first().free_bytes} bytes free.")
        return 0
    if a.command == "ls":
        for path in a.paths or ["/"]:
            for r in listing.ls_text(listing.ls(c.dirents().where(F.col("dir_path") == path.rstrip("/") + "/"), created=a.created)).orderBy("slot").collect():
                print(r.line)
        return 0
    if a.command == "dir":
        for r in listing.dir_text(c.saves()).orderBy("slot").collect():
            print(r.line1, r.line2, "", sep="\n")
        print(listing.free_text(c.free_space()).first().line)
        return 0
    if a.command == "check":
        found = c.check().collect()
        for r in found:
            print(f"{r.kind}: {r.path or ''} {r.detail}")
        print("No errors found." if not found else f"{len(found)} findings")
        return int(bool(found))
    e = c.entries()
    if a.command == "add":
        folder = "/" + (a.directory or "").strip("/")
        rows = [(c.images.first().card_id, f"{folder.rstrip('/')}/{os.path.basename(f)}", open(f, "rb").read()) for f in a.files]
        return s.apply(mutate.put_files(e, s.spark.createDataFrame(rows, "card_id string, path string, data binary"), now))
    if a.command == "extract":
        folder = "/" + (a.directory or "").strip("/")
        for f in a.files:
            r = e.where((F.col("path") == f"{folder.rstrip('/')}/{f.strip('/')}") & F.col("data").isNotNull()).first()
            if r is None:
                raise layout.PathNotFound(f)
            out = sys.stdout.buffer if a.output == "-" else open(a.output or os.path.basename(f), "wb")
            out.write(r.data)
        return 0
    if a.command == "mkdir":
        return s.apply(mutate.mkdir(e, s.rows(*a.paths), now))
    if a.command == "remove":
        return s.apply(mutate.remove(e, s.rows(*a.paths)))
    if a.command == "delete":
        return s.apply(mutate.remove_tree(e, s.rows(*a.paths)))
    if a.command == "rename":
        return s.apply(mutate.rename(e, s.rows(a.old).withColumn("target", F.lit("/" + a.new.strip("/")))))
    if a.command in ("set", "clear"):
        bits = 0
        for f in a.flags.strip("-"):
            if f not in FLAGS:
                raise layout.CardError(f"unknown flag {f}")
            bits |= FLAGS[f]
        mode = int(a.hex_mode, 16) if a.hex_mode else None
        return s.apply(mutate.set_modes(e, s.rows(*a.paths), bits if a.command == "set" else 0, bits if a.command == "clear" else 0, mode))
    if a.command in ("import", "import-all"):
        files = a.files
        if a.command == "import-all":
            files = [os.path.join(f, n) for f in files if os.path.isdir(f) for n in sorted(os.listdir(f))] + [f for f in files if not os.path.isdir(f)]
        return s.apply(mutate.import_saves(e, s.saves_of(files), policy))
    if a.command == "export-all":
        return s.written(sinks.folder_files(e), a.directory or ".", policy)
    if a.command == "export-all-zip":
        name = a.output or os.path.splitext(os.path.basename(a.card))[0] + ".zip"
        path = os.path.join(a.directory, name) if a.directory else name
        if os.path.exists(path) and not a.overwrite_existing:
            raise layout.IoError(f"{path} exists")
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "wb") as f:
            f.write(cards.encode_zips(e).first().content)
        return 0
    names = {n for p in a.paths for r in c.glob(p).collect() for n in [r.path.strip("/")]}
    missing = names - {r.name for r in e.where("parent = ''").select("name").collect()}
    for n in sorted(missing):
        print(f"{n}: not found", file=sys.stderr)
    e = e.where(F.regexp_extract("path", "^/([^/]*)", 1).isin(sorted(names)))
    if a.command == "export-files":
        return s.written(sinks.folder_files(e), a.directory or ".", policy) | int(bool(missing))
    kind = "zip" if a.command.endswith("zip") else a.type or "psu"
    files = sinks.save_files(cards.encode_saves(e, kind), kind, e if a.long_names else None)
    return s.written(files, a.directory or ".", policy) | int(bool(missing))


def main() -> None:
    sys.exit(run(sys.argv[1:]))


if __name__ == "__main__":
    main()
