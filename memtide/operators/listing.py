"""Listings and predicates over directory entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import modes, text


def ls(dirents: DataFrame, zone: str = "UTC", created: bool = False) -> DataFrame:
    """Existing entries with their mode letters and time of day in a stated zone, a row for each line."""
    t = F.from_utc_timestamp(F.timestamp_seconds(F.col("created" if created else "modified")), zone)
    return dirents.where(modes.exists(F.col("mode"))).select("card_id", "dir_path", "slot", modes.mode_string(F.col("mode")).alias("mode_string"), "length", F.date_format(t, "yyyy-MM-dd HH:mm:ss").alias("time"), "name")


def ls_text(listing: DataFrame) -> DataFrame:
    return listing.select("card_id", "dir_path", "slot", F.format_string("%s %7d %s %s", "mode_string", "length", "time", "name").alias("line"))


def save_directories(dirents: DataFrame) -> DataFrame:
    """Live directories of the root, without the two dots."""
    return dirents.where((F.col("slot") >= 2) & modes.is_dir(F.col("mode")))


def dir_text(saves: DataFrame) -> DataFrame:
    """The two lines that a save's summary prints, from name, title1, title2, size and protection."""
    one = F.rtrim(F.concat(F.rpad("name", 32, " "), F.lit(" "), F.col("title1")))
    two = F.rtrim(F.concat(F.lpad(F.floor(F.col("size") / 1024).cast("string"), 4, " "), F.lit("KB "), F.rpad("protection", 25, " "), F.lit(" "), F.col("title2")))
    return saves.select("card_id", "slot", one.alias("line1"), two.alias("line2"))


def free_text(free: DataFrame) -> DataFrame:
    return free.select("card_id", F.concat(text.thousands(F.floor(F.col("free_bytes") / 1024)), F.lit(" KB Free")).alias("line"))


def glob(names: DataFrame, pattern: str, column: str = "name") -> DataFrame:
    """Rows whose name matches the pattern's last component; where none does, one row that holds the pattern itself.

    A pattern without * and ? is returned as it is, whether or not it exists.
    """
    spark = names.sparkSession
    literal = spark.range(1).select(*[F.lit(pattern if c == column else None).cast(names.schema[c].dataType).alias(c) for c in names.columns])
    if not text.is_pattern(pattern):
        return literal
    found = names.where(F.col(column).rlike(text.glob_regex(pattern)))
    none = literal.join(found.select(F.lit(1).alias("__any")).limit(1), F.lit(True), "left_anti")
    return found.union(none)


def absolute(path: str, cwd: str = "/") -> str:
    """A path as seen from a directory, its empty parts and '.' skipped and '..' going up."""
    kept: list[str] = []
    for x in (path if path.startswith("/") else f"{cwd}/{path}").split("/"):
        if x == "..":
            kept = kept[:-1]
        elif x not in ("", "."):
            kept.append(x)
    return "/" + "/".join(kept)


def glob_paths(dirents: DataFrame, cards: DataFrame, pattern: str, cwd: str = "/") -> DataFrame:
    """(card_id, path): live entries of the pattern's directory whose names match its last component, with that directory
    before them as it is written; a card without any gives the pattern itself."""
    folder, slash, _ = pattern.rpartition("/")
    prefix = "/".join(x for x in folder.split("/") if x) + "/" if folder.strip("/") else ""
    prefix = ("/" if pattern.startswith("/") else "") + prefix
    at = absolute(folder or slash or ".", cwd).rstrip("/") + "/"
    live = dirents.where(modes.exists(F.col("mode")) & (F.col("dir_path") == at) & F.col("name").rlike(text.glob_regex(pattern)))
    found = live.select("card_id", F.concat(F.lit(prefix), "name").alias("path"))
    return cards.join(found, "card_id", "left").select("card_id", F.coalesce("path", F.lit(pattern)).alias("path"))


def find(dirents: DataFrame, name: str) -> DataFrame:
    """Of each directory the first slot with a name."""
    return dirents.where((F.col("name") == name) & modes.exists(F.col("mode"))).groupBy("card_id", "dir_path").agg(F.min("slot").alias("slot"))


def normal_path(path: Column) -> Column:
    """An absolute path of its non-empty parts, '.' skipped and '..' going up."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def resolve(paths: DataFrame, entries: DataFrame, column: str = "path") -> DataFrame:
    """Add ``found`` and ``parent_found``: whether the entry, and the directory it would lie in, exist."""
    p = paths.withColumn("__p", normal_path(F.col(column))).withColumn("__up", F.regexp_replace("__p", "/[^/]*$", ""))
    e = entries.select(F.col("card_id").alias("__c"), F.col("path").alias("__e")).distinct()
    here = e.withColumn("found", F.lit(True))
    above = e.select("__c", F.col("__e").alias("__d")).withColumn("above", F.lit(True))
    got = p.join(here, (p["card_id"] == here["__c"]) & (p["__p"] == here["__e"]), "left").drop("__c", "__e")
    got = got.join(above, (got["card_id"] == above["__c"]) & (got["__up"] == above["__d"]), "left").drop("__c", "__d")
    return got.withColumn("found", F.coalesce("found", F.lit(False)) | (F.col("__p") == "/")).withColumn("parent_found", F.coalesce("above", F.lit(False)) | (F.col("__up") == "")).drop("above", "__up").withColumnRenamed("__p", "normal_path")
