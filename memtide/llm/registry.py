"""The registered queries of this subpackage and the SQL beside those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import base, compact_windows, decontaminate, license_scan, line_rules, near_dedup, packing, rule_ensemble, suffix_dedup, url_filter, warc

#: Where the public vocabulary files lie; a parameter of every operator that tokenises.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_license_scan(spark, sf_dir):
    docs = base.table(spark, sf_dir, "documents")
    files = docs.select("doc_id", "text", license_scan.document_path(F.col("source"), F.col("doc_id")).alias("path"))
    return license_scan.license_scan(files, keep=("doc_id",))


def op2_decontaminate(spark, sf_dir):
    got = decontaminate.decontaminate(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark"))
    return got.drop("text_hash")


def op3_rule_ensemble(spark, sf_dir):
    got = rule_ensemble.classify(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "labels"))
    return got.select("doc_id", "held_out", "score", "predicted")


def op4_pack(spark, sf_dir):
    return packing.pack(base.table(spark, sf_dir, "documents"), tokenizer_path())


def op5_warc(spark, sf_dir):
    back = warc.read_archives(warc.write_archives(base.table(spark, sf_dir, "pages")))
    return back.select(F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op6_suffix_dedup(spark, sf_dir):
    return suffix_dedup.suffix_dedup(base.table(spark, sf_dir, "documents"))


def op7_line_rules(spark, sf_dir):
    return line_rules.line_rules(base.table(spark, sf_dir, "documents"))


def op8_url_filter(spark, sf_dir):
    return url_filter.url_filter(base.table(spark, sf_dir, "pages"), url_filter.RULES)


def op9_near_dedup(spark, sf_dir):
    return near_dedup.near_dedup(base.table(spark, sf_dir, "documents"))


def op10_compact_windows(spark, sf_dir):
    return compact_windows.passage_dedup(base.table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_decontaminate": op2_decontaminate,
    "op3_rule_ensemble": op3_rule_ensemble,
    "op4_pack": op4_pack,
    "op5_warc": op5_warc,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_line_rules": op7_line_rules,
    "op8_url_filter": op8_url_filter,
    "op9_near_dedup": op9_near_dedup,
    "op10_compact_windows": op10_compact_windows,
}

ORACLES = {
    "op2_decontaminate": decontaminate.SQL,
    "op5_warc": warc.SQL,
    "op7_line_rules": line_rules.SQL,
    "op8_url_filter": url_filter.SQL,
}
