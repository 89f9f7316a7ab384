"""Free space, sizes and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import modes
from ..functions.rounding import div_round_up, round_up

CLUSTER, DIRENT = 1024, 512


def geometry(sizes: DataFrame, mb: str = "size_mb") -> DataFrame:
    """The layout that a formatted card of each size gets, by arithmetic on columns."""
    g = sizes.withColumn("pages", F.col(mb).cast("long") * 2048).withColumn("clusters", F.floor(F.col("pages") / 2).cast("long"))
    g = g.withColumn("fat_clusters", div_round_up(F.col("clusters") - 10, 256)).withColumn("indirect_clusters", div_round_up(F.col("fat_clusters"), 256))
    g = g.withColumn("alloc_offset", F.lit(8) + F.col("indirect_clusters") + F.col("fat_clusters"))
    g = g.withColumn("alloc_end", (F.floor(F.col("pages") / 16).cast("long") - 2) * 8 - F.col("alloc_offset"))
    return g.withColumn("total_bytes", F.col("alloc_end") * CLUSTER).withColumn("image_bytes", F.col("pages") * 528)


def free_space(fat: DataFrame, cards: DataFrame) -> DataFrame:
    """(card_id, free_bytes, total_bytes): clusters of [0, alloc_end) without their allocated bit.

    ``fat`` may list allocated entries only: free is what is left of the range.
    """
    used = fat.where("allocated").groupBy("card_id").agg(F.count(F.lit(1)).alias("used"))
    got = cards.select("card_id", "alloc_end", "cluster_size").join(used, "card_id", "left")
    return got.select("card_id", ((F.col("alloc_end") - F.coalesce("used", F.lit(0))) * F.col("cluster_size")).alias("free_bytes"), (F.col("alloc_end") * F.col("cluster_size")).alias("total_bytes"))


def allocatable(cards: DataFrame) -> DataFrame:
    """(card_id, bytes) of the clusters that may be allocated."""
    return cards.select("card_id", (F.col("alloc_limit") * F.col("cluster_size")).alias("bytes"))


def ancestors(path: Column) -> Column:
    """All directories above an absolute path, '/' first."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    below = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit("/")), below)


def tree_sizes(entries: DataFrame, unit: int = CLUSTER) -> DataFrame:
    """(card_id, path, size) of every directory: its own slots and all that lies below, each rounded up to clusters.

    ``entries``: card_id, path, is_dir, length (slots for directories, bytes for files), live ones only.
    """
    own = F.when(F.col("is_dir"), round_up(F.col("length") * DIRENT, unit)).otherwise(round_up(F.col("length"), unit))
    at = F.when(F.col("is_dir") & (F.col("path") != "/"), F.concat(ancestors(F.col("path")), F.array("path"))).otherwise(ancestors(F.col("path")))
    return entries.select("card_id", F.explode(at).alias("path"), own.alias("bytes")).groupBy("card_id", "path").agg(F.sum("bytes").alias("size"))


def directory_sizes(dirs: DataFrame, files: DataFrame, unit: int = CLUSTER) -> DataFrame:
    """Sizes of flat save directories: (card_id, dir_id, n_files, size); slots count deleted files and the two dots too.

    Files are summed before they meet their directory, so the join is one row a directory.
    """
    live = modes.exists(F.col("mode"))
    sums = files.groupBy("dir_id").agg(F.count(F.lit(1)).alias("slots"), F.count_if(live).alias("n_files"), F.sum(F.when(live, round_up(F.col("length"), unit)).otherwise(0)).alias("bytes"))
    got = dirs.join(sums, "dir_id", "left")
    slots = F.coalesce("slots", F.lit(0)) + 2
    return got.select("card_id", "dir_id", "slot", "name", "mode", F.coalesce("n_files", F.lit(0)).alias("n_files"), (round_up(slots * DIRENT, unit) + F.coalesce("bytes", F.lit(0))).alias("size"))


def summaries(free: DataFrame, saves: DataFrame) -> DataFrame:
    """One row a card: free and total bytes, and its saves in slot order."""
    per = saves.groupBy("card_id").agg(F.array_sort(F.collect_list(F.struct("slot", "name", "size"))).alias("saves"))
    return free.join(per, "card_id", "left").withColumn("saves", F.coalesce("saves", F.array().cast(per.schema["saves"].dataType)))
