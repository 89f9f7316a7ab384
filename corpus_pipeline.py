"""Five stages over ``documents``: each keeps, merges or cuts what its predecessor kept, is written and reread.

Stages take (spark, docs, sf_dir) and return all columns of ``documents``; the last one returns the packed pieces.

All take null texts for empty ones and keep them (a null text stays null), take rows that share an id but no text for
different documents, and give no rows for none.  Null ids are documents like others, after all others where ids are ordered.
Very long texts are handled whole.  Columns besides doc_id and text, whatever their names, go along untouched.
"""

from __future__ import annotations

from memtide.llm import base, compact_windows, decontaminate, near_dedup, packing, registry, rule_ensemble
from pyspark.sql import functions as F


def quality(spark, docs, sf_dir):
    """Documents that the rule ensemble scores under its threshold go; each row carries its score, so nothing is shuffled."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    return rule_ensemble.classify(rows, base.table(spark, sf_dir, "labels"), keep=("row",)).where("predicted = 1").select("row.*")


def near_duplicates(spark, docs, sf_dir):
    """Of each class of near-duplicate documents the one with the smallest id stays; of rows equal in id and text one."""
    return near_dedup.keep_first(docs)


def passages(spark, docs, sf_dir):
    """Passages that are near an earlier document's are cut out; n_chars follows."""
    cut = compact_windows.remove_passages(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def decontaminated(spark, docs, sf_dir):
    """Documents of which windows of benchmark items cover WINDOW words or more go, so one item's passage is enough.

    The rows that go are ids and hashes in a table of known size: Catalyst broadcasts it if it is small, texts move only beyond that.
    """
    judged = decontaminate.decontaminate(docs, base.table(spark, sf_dir, "benchmark"))
    hit = judged.where(F.col("n_hit") >= decontaminate.WINDOW)
    bad = base.stash(hit.select(F.col("doc_id").alias("__i"), F.col("text_hash").alias("__b")).distinct(), "hit")
    rows = docs.withColumn("__h", F.xxhash64(F.coalesce("text", F.lit(""))))
    return rows.join(bad, rows["doc_id"].eqNullSafe(bad["__i"]) & (rows["__h"] == bad["__b"]), "left_anti").drop("__h")


def packed(spark, docs, sf_dir):
    """Every document's token pieces with their sequences and offsets."""
    return packing.pack(docs, registry.tokenizer_path())


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", passages),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]

#: Fitted models, samples and sequences are beyond SQL; tests/llm holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = base.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, before = base.stash(stage(spark, docs, sf_dir), "stage"), docs
        if hasattr(before, "_stashed_at"):
            base.release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
