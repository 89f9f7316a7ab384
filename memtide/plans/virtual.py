"""Virtual cards: the driver's tables seen as card tables, so that card operators can be held against SQL.

A test harness, not a feature: customers are cards, orders their save directories, line items files, pages zip members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import modes
from ..functions.rounding import div_round_up

ALLOC_END = 8135
#: Of the line items' parquet to a partition, some 150,000 rows.
PART_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    mode = F.when(F.col("o_orderstatus") == "P", modes.NEW_DIR | modes.PROTECTED).when(F.col("o_orderstatus") == "F", modes.NEW_DIR & ~modes.WRITE).otherwise(modes.NEW_DIR)
    slot = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) + 1
    return o.select(F.col("o_custkey").alias("card_id"), F.col("o_orderkey").alias("dir_id"), slot.cast("long").alias("slot"), F.concat(F.lit("BASLUS-"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")).alias("name"), mode.alias("mode"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate")
    mode = F.when(F.col("l_returnflag") == "R", modes.NEW_FILE & ~modes.EXISTS).otherwise(modes.NEW_FILE)
    return li.select(F.col("l_orderkey").alias("dir_id"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), (F.col("l_quantity") * 100).cast("long").alias("length"), mode.alias("mode"), F.col("l_shipdate").alias("time"))


def parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for what is made of line items: one for every PART_BYTES of their table, and no fewer than the session's, which Spark would go back to in joins."""
    size = int(str(table(spark, sf_dir, "lineitem")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def starts(f: DataFrame, d: DataFrame, n: int) -> DataFrame:
    """(card_id, dir_id, start): clusters that the files of a card's earlier directories take. A directory that a card has twice starts once."""
    sizes = f.select("dir_id", "n").repartition(n, "dir_id").groupBy("dir_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("size"))
    sized = d.select("card_id", "dir_id").repartition(n, "dir_id").join(sizes, "dir_id").repartition(n, "card_id")
    upto, own = Window.partitionBy("card_id").orderBy("dir_id"), Window.partitionBy("card_id", "dir_id")
    return sized.select("card_id", "dir_id", (F.sum("size").over(upto) - F.sum("size").over(own)).alias("start"))


def runs(spark: SparkSession, sf_dir: str, how: str = "inner") -> DataFrame:
    """Files with the first of their n clusters, dealt out card by card in order; how="left" keeps files without a directory, whose first is null.

    Files are sent once, to their directory; only directories are summed card by card. The rows stay dealt out by dir_id.
    Files that differ in time alone make the same rows, so time is no part of the order.
    """
    n = parts(spark, sf_dir)
    f = files(spark, sf_dir).drop("time")
    clusters = div_round_up(F.col("length"), 1024)
    at = starts(f.withColumn("n", clusters), dirs(spark, sf_dir), n)
    w = Window.partitionBy("card_id", "dir_id").orderBy(*(F.asc_nulls_last(c) for c in ("line", "part", "supp", "length", "mode"))).rowsBetween(Window.unboundedPreceding, -1)
    placed = f.repartition(n, "dir_id").join(at.repartition(n, "dir_id"), "dir_id", how).withColumn("n", clusters)
    return placed.select("card_id", "dir_id", "line", "part", "supp", "length", "mode", "n", (F.col("start") + F.coalesce(F.sum("n").over(w), F.lit(0))).alias("first"))


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of every file; those of odd lines that are deleted stay allocated (lost)."""
    placed = runs(spark, sf_dir).where("n > 0").withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return placed.select("card_id", "dir_id", "line", "part", "supp", "length", "mode", "pos", (F.col("first") + F.col("pos")).alias("cluster"))


def fat(chain_rows: DataFrame, *more: Column) -> DataFrame:
    live = modes.exists(F.col("mode"))
    return chain_rows.select("card_id", "cluster", (live | (F.col("line") % 2 == 1)).alias("allocated"), *more)


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("card_id"), F.lit(ALLOC_END).cast("long").alias("alloc_end"), F.lit(1024).cast("long").alias("cluster_size"))


# The same tables in SQL.
DIRS = f"""v_dirs AS (SELECT o_custkey AS card_id, o_orderkey AS dir_id, 1 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS slot,
  'BASLUS-' || lpad(o_orderkey::VARCHAR, 7, '0') AS name,
  CASE o_orderstatus WHEN 'P' THEN {modes.NEW_DIR | modes.PROTECTED} WHEN 'F' THEN {modes.NEW_DIR & ~modes.WRITE} ELSE {modes.NEW_DIR} END AS mode FROM orders)"""
FILES = f"""v_files AS (SELECT l_orderkey AS dir_id, l_linenumber::BIGINT AS line, l_partkey AS part, l_suppkey AS supp, trunc(l_quantity * 100)::BIGINT AS length,
  CASE WHEN l_returnflag = 'R' THEN {modes.NEW_FILE & ~modes.EXISTS} ELSE {modes.NEW_FILE} END AS mode, l_shipdate AS time FROM lineitem)"""
CHAINS = f"""{DIRS}, {FILES},
placed AS (SELECT card_id, f.*, (length + 1023) // 1024 AS n,
  coalesce(sum((length + 1023) // 1024) OVER (PARTITION BY card_id ORDER BY dir_id, line, part, supp, length, f.mode, time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
  FROM v_files f JOIN (SELECT dir_id, card_id FROM v_dirs) USING (dir_id)),
v_chains AS (SELECT card_id, dir_id, line, part, supp, length, mode, pos, first + pos AS cluster FROM placed JOIN (VALUES (0::BIGINT), (1), (2), (3), (4)) r(pos) ON pos < n),
v_fat AS (SELECT card_id, cluster, (mode & 32768) <> 0 OR line % 2 = 1 AS allocated FROM v_chains)"""
