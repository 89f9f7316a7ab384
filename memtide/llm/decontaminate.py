"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions alone.

Every benchmark item gives windows of ``WINDOW`` words (a shorter item one
window).  The tokens of a window are ordered by how rare they are in the
documents; exact containment needs all of them, so its necessary prefix is the
single rarest token.  Document words join that prefix; the token's place in the
window bounds where the window may start (position) and that it fits (length);
what remains is compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

WINDOW = 8
#: Benchmark text up to this many bytes has its windows broadcast; a larger one is joined by shuffling.
BROADCAST_BYTES = 4 << 20
MIN_ITEMS = 2

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-case A-Z (``lower`` where the text is all ASCII, which is the same there and faster) and split."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, SEPARATORS), "")


def item_windows(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """Distinct windows (w, size, items); items without words give none, a null id counts as the empty id."""
    w = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words(F.coalesce(F.col(text), F.lit(""))).alias("ws")).where(F.size("ws") > 0)
    size = F.least(F.size("ws"), F.lit(window))
    return (
        w.select("item", size.alias("size"), "ws", F.explode(F.sequence(F.lit(1), F.size("ws") - size + 1)).alias("i"))
        .select("item", "size", F.slice("ws", F.col("i"), F.col("size")).alias("w"))
        .groupBy("w", "size")
        .agg(F.collect_set("item").alias("items"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, min_items: int = MIN_ITEMS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document row: (key, n_words, n_hit, n_items, items_sha256, contaminated) and ``text_hash``.

    Null and empty texts have no words and no hits.  Rows that share key and text share their result, rows that
    share only the key are told apart by a hash and the length of their text.  An item that is there twice counts once; ids are
    compared as strings.  A very long text's words are rows of one task until they meet the tokens.  An empty benchmark hits
    nothing, no documents give no rows, other columns are not read, whatever their names.
    """
    weight = benchmark.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0))).first()[0]
    small = (lambda df: F.broadcast(df)) if weight <= broadcast_bytes else (lambda df: df)
    body = F.coalesce(F.col(text), F.lit(""))
    docs = docs.select(F.col(key).alias("k"), F.xxhash64(body).alias("h"), F.octet_length(body).alias("b"), words(body).alias("ws")).withColumn("n", F.size("ws"))
    ident = ["k", "h", "b"]

    # rarity of the windows' tokens; the token '' (no word is empty) marks each document once, to count it and its words
    windows = base.stash(item_windows(benchmark, item, item_text, window), "windows")
    vocabulary = windows.select(F.explode("w").alias("token")).distinct().union(benchmark.sparkSession.range(1).select(F.lit("").alias("token")))
    met = docs.select(F.struct(*ident, "n").alias("d"), F.explode(F.concat("ws", F.array(F.lit("")))).alias("token")).join(small(vocabulary), "token")
    counted = base.stash(met.groupBy("token", F.when(F.col("token") == "", F.col("d")).alias("d")).agg(F.count(F.lit(1)).alias("c")), "rarity")

    rarity = counted.where("token <> ''").select("token", "c")
    prefix = (
        windows.select("w", "size", "items", F.posexplode("w").alias("at", "token"))
        .join(rarity, "token", "left")
        .groupBy("w", "size")
        .agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "token", "at")).alias("r"), F.first("items").alias("items"))
        .where("r.c > 0")  # a token that no document has: the window occurs nowhere
        .select(F.col("r.token").alias("token"), F.col("r.at").alias("at"), "w", "size", "items")
    )
    bounds = (F.col("p") >= F.col("at")) & (F.col("p") - F.col("at") + F.col("size") <= F.col("n"))
    exact = F.slice("ws", F.col("start") + 1, F.col("size")) == F.col("w")
    start = (F.col("p") - F.col("at")).alias("start")
    placed = lambda *more: docs.select(*ident, "n", *more, F.posexplode("ws").alias("p", "token"))
    if weight <= broadcast_bytes:
        found = placed("ws").join(F.broadcast(prefix), "token").where(bounds).select(*ident, "ws", start, "size", "w", "items").where(exact)
    else:
        near = placed().join(prefix, "token").where(bounds).select(*[F.col(c).alias(f"c{c}") for c in ident], start, "size", "w", "items")
        same = F.col("k").eqNullSafe(F.col("ck")) & (F.col("h") == F.col("ch")) & (F.col("b") == F.col("cb"))
        found = docs.join(near, same).where(exact)
    hits = base.stash(found.select(*ident, "start", "size", "items").distinct(), "hits")

    covered = hits.select(*ident, F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("p")).distinct().groupBy(*ident).agg(F.count(F.lit(1)).alias("n_hit"), F.lit(0).alias("i"))
    named = hits.select(*ident, F.explode("items").alias("i")).distinct().groupBy(*ident).agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("i")), ",").alias("names"))
    both = covered.drop("i").withColumnsRenamed({c: f"c{c}" for c in ident})
    same = lambda a, b, p: a["k"].eqNullSafe(b[f"{p}k"]) & (a["h"] == b[f"{p}h"]) & (a["b"] == b[f"{p}b"])
    result = named.join(both, same(named, both, "c")).select(*[F.col(c).alias(f"r{c}") for c in ident], "n_hit", "n_items", "names")
    each = counted.where("token = ''").select("d.*", F.explode(F.array_repeat(F.lit(0), F.col("c").cast("int"))).alias("copy")).drop("copy")
    return each.join(result, same(each, result, "r"), "left").select(
        F.col("k").alias(key),
        F.col("n").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_items", F.lit(0)) >= min_items).alias("contaminated"),
        F.col("h").alias("text_hash"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, s AS size, array_to_string(ws[i:i + s - 1], ' ') AS w FROM (SELECT item, ws, least(len(ws), {WINDOW}) AS s, unnest(range(1, len(ws) - least(len(ws), {WINDOW}) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, i, size, array_to_string(ws[i:i + size - 1], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d), (SELECT DISTINCT size FROM bw) WHERE i + size - 1 <= len(ws)),
h AS (SELECT DISTINCT doc_id, i, size, item FROM dw JOIN bw USING (size, w)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM h) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= {MIN_ITEMS} AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
