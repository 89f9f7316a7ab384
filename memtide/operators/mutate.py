"""Changes to cards as pure functions of tables: state in, state out.

State is ``entries``: card_id, path, parent, name, slot, mode, length, created, modified, data (null for
directories).  Nothing is written until an image is encoded from it; a rejected row changes nothing and is
reported with its reason by the ``rejected`` of each function that can refuse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import modes

NAME_BYTES = 32


def first_free_slot(dirents: DataFrame) -> DataFrame:
    """(card_id, dir_path, free_slot): a deleted entry's slot, the lowest, or else the next one."""
    live = modes.exists(F.col("mode"))
    return dirents.groupBy("card_id", "dir_path").agg(F.coalesce(F.min(F.when(~live & (F.col("slot") >= 2), F.col("slot"))), F.max("slot") + 1).alias("free_slot"))


def assign_slots(new: DataFrame, dirents: DataFrame, order: str = "name") -> DataFrame:
    """Slots for new entries of each directory: deleted ones from the lowest on, then those after the last."""
    live = modes.exists(F.col("mode"))
    holes = dirents.where(~live & (F.col("slot") >= 2)).select("card_id", "dir_path", F.col("slot").alias("hole"), F.row_number().over(Window.partitionBy("card_id", "dir_path").orderBy("slot")).alias("k"))
    size = dirents.groupBy("card_id", "dir_path").agg((F.max("slot") + 1).alias("top"), F.count_if(~live & (F.col("slot") >= 2)).alias("holes"))
    n = new.withColumn("k", F.row_number().over(Window.partitionBy("card_id", "dir_path").orderBy(order)))
    got = n.join(holes, ["card_id", "dir_path", "k"], "left").join(size, ["card_id", "dir_path"], "left")
    after = F.coalesce("top", F.lit(2)) + F.col("k") - 1 - F.coalesce("holes", F.lit(0))
    return got.withColumn("slot", F.coalesce("hole", after).cast("int")).drop("k", "hole", "top", "holes")


def _keys(df: DataFrame) -> DataFrame:
    return df.select("card_id", "path").distinct()


def split_new(new: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose path is not there yet, rows whose path is)."""
    have = _keys(entries)
    return new.join(have, ["card_id", "path"], "left_anti"), new.join(have, ["card_id", "path"], "left_semi")


def rejected(rows: DataFrame, reason: str) -> DataFrame:
    return rows.select("card_id", "path", F.lit(reason).alias("reason"))


def mkdir(entries: DataFrame, new: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Add directories (card_id, path): each parent must be one already, each path must be new."""
    fresh, there = split_new(new.select("card_id", "path"), entries)
    fresh = fresh.withColumn("parent", F.regexp_replace("path", "/[^/]*$", "")).withColumn("name", F.substring(F.regexp_extract("path", "([^/]*)$", 1), 1, NAME_BYTES))
    dirs = entries.where(modes.is_dir(F.col("mode"))).select("card_id", F.col("path").alias("parent")).distinct()
    orphan = fresh.join(dirs, ["card_id", "parent"], "left_anti").where("parent <> ''")
    ok = fresh.join(dirs, ["card_id", "parent"], "left_semi").unionByName(fresh.where("parent = ''"))
    made = ok.select("card_id", "path", "parent", "name", F.lit(None).cast("int").alias("slot"), F.lit(modes.NEW_DIR).alias("mode"), F.lit(2).cast("long").alias("length"), now.alias("created"), now.alias("modified"), F.lit(None).cast("binary").alias("data"))
    return entries.unionByName(made), rejected(there, "directory exists").union(rejected(orphan, "path not found"))


def put_files(entries: DataFrame, new: DataFrame, now: Column, append: bool = False) -> DataFrame:
    """Create or rewrite files (card_id, path, data); with ``append`` bytes go after those that are there."""
    old = entries.select("card_id", "path", F.col("data").alias("__old"), F.col("created").alias("__created"), F.col("mode").alias("__mode"))
    got = new.join(old, ["card_id", "path"], "left")
    data = F.concat(F.coalesce("__old", F.lit(b"")), "data") if append else F.col("data")
    made = got.select("card_id", "path", F.regexp_replace("path", "/[^/]*$", "").alias("parent"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.lit(None).cast("int").alias("slot"), F.coalesce("__mode", F.lit(modes.NEW_FILE)).alias("mode"), F.length(data).cast("long").alias("length"), F.coalesce("__created", now).alias("created"), now.alias("modified"), data.alias("data"))
    return entries.join(_keys(new), ["card_id", "path"], "left_anti").unionByName(made)


def write_at(entries: DataFrame, writes: DataFrame, now: Column) -> DataFrame:
    """Write (card_id, path, offset, data) into files, one write a file: what lies around stays, a gap before it is filled with zeros."""
    old = entries.select("card_id", "path", F.coalesce("data", F.lit(b"")).alias("__old"))
    got = writes.join(old, ["card_id", "path"], "left").withColumn("__old", F.coalesce("__old", F.lit(b"")))
    before = F.expr("rpad(__old, cast(offset AS int), X'00')")
    after = F.expr("substring(__old, cast(offset AS int) + length(data) + 1)")
    return put_files(entries, got.select("card_id", "path", F.concat(before, "data", after).alias("data")), now)


def remove(entries: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove files and empty directories."""
    want = _keys(paths)
    full = want.join(entries.select("card_id", F.col("parent").alias("path")).distinct(), ["card_id", "path"], "left_semi")
    gone = want.join(full, ["card_id", "path"], "left_anti")
    missing = want.join(_keys(entries), ["card_id", "path"], "left_anti")
    return entries.join(gone, ["card_id", "path"], "left_anti"), rejected(full, "directory not empty").union(rejected(missing, "file not found"))


def remove_tree(entries: DataFrame, paths: DataFrame) -> DataFrame:
    """Remove directories with all that lies below: every entry's own path and its ancestors are looked up, no prefix join."""
    from .space import ancestors

    at = entries.withColumn("__at", F.explode(F.concat(ancestors(F.col("path")), F.array("path"))))
    gone = at.join(paths.select("card_id", F.col("path").alias("__at")).where("__at <> '/'").distinct(), ["card_id", "__at"], "left_semi").select("card_id", "path").distinct()
    return entries.join(gone, ["card_id", "path"], "left_anti")


def rename(entries: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Move (card_id, path, target): not the root, not onto what exists, not beneath itself; what lies below follows."""
    from .space import ancestors

    _, taken = split_new(moves.select("card_id", F.col("target").alias("path")), entries)
    taken = taken.select("card_id", F.col("path").alias("target"))
    beneath = moves.where(F.col("target").startswith(F.concat("path", F.lit("/"))) | (F.col("path") == "/"))
    missing = moves.join(_keys(entries), ["card_id", "path"], "left_anti")
    ok = moves.join(taken, ["card_id", "target"], "left_anti").join(beneath.select("card_id", "path"), ["card_id", "path"], "left_anti")
    at = entries.select("card_id", "path", F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("__at"))
    hit = at.join(ok.select("card_id", F.col("path").alias("__at"), "target"), ["card_id", "__at"]).groupBy("card_id", "path").agg(F.max_by(F.struct("__at", "target"), F.length("__at")).alias("__m"))
    got = entries.join(hit, ["card_id", "path"], "left")
    new = F.when(F.col("__m").isNull(), F.col("path")).otherwise(F.concat("__m.target", F.expr("substring(path, length(__m.__at) + 1)")))
    got = got.withColumn("path", new).withColumn("parent", F.regexp_replace("path", "/[^/]*$", "")).withColumn("name", F.regexp_extract("path", "([^/]*)$", 1)).drop("__m")
    no = rejected(moves.join(taken, ["card_id", "target"], "left_semi"), "target exists").union(rejected(beneath, "beneath itself")).union(rejected(missing, "file not found"))
    return got.select(*entries.columns), no


def set_modes(entries: DataFrame, paths: DataFrame, set_bits: int = 0, clear_bits: int = 0, mode: int | None = None) -> DataFrame:
    """Set and clear flags, or give a whole mode; the bits that say file, directory and exists stay."""
    new = modes.merged(F.col("mode"), F.lit(mode)) if mode is not None else modes.change(F.col("mode"), set_bits, clear_bits)
    mark = _keys(paths).withColumn("__hit", F.lit(True))
    return entries.join(mark, ["card_id", "path"], "left").withColumn("mode", F.when(F.col("__hit"), new).otherwise(F.col("mode"))).drop("__hit")


def import_saves(entries: DataFrame, saves: DataFrame, on_conflict: str = "error") -> tuple[DataFrame, DataFrame]:
    """Add whole saves: ``saves`` has the columns of ``entries`` for the directory and its files.

    ``on_conflict``: a save whose directory exists is rejected ("error"), left out silently ("skip") or replaces it ("replace").
    """
    top = saves.withColumn("__top", F.regexp_extract("path", "^(/[^/]*)", 1))
    dirs = top.select("card_id", F.col("__top").alias("path")).distinct()
    _, there = split_new(dirs, entries)
    if on_conflict == "replace":
        return remove_tree(entries, there).unionByName(saves), rejected(there.limit(0), "")
    fresh = top.join(there.select("card_id", F.col("path").alias("__top")), ["card_id", "__top"], "left_anti").select(*entries.columns)
    return entries.unionByName(fresh), rejected(there if on_conflict == "error" else there.limit(0), "directory exists")


def export_save(entries: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files of the named saves, what lies below them that is no file)."""
    below = entries.join(names.select("card_id", F.col("path").alias("parent")), ["card_id", "parent"], "left_semi")
    live = modes.is_file(F.col("mode"))
    return below.where(live), rejected(below.where(~live), "not a file")
