"""One query for each operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codehealth.llm import archives, blocks, bpe, langid, lexical_search, line_templates, mixing, near_dups, quality, secret_ledger, suffixes, tiling, whitening
from codehealth.llm.shared import fresh_path
from codehealth.llm.sql import SQL  # noqa: F401  read with QUERIES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents")).taken()


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_templates.without_recurring_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_recurring_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates, and lines that recur word for word."""
    cut = line_templates.without_recurring_lines(table(spark, sf_dir, "documents"), exact_docs=line_templates.EXACT_DOCS)
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def of_kind(kind: str):
    return lambda x: x["kind"] == kind


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one ledger: half of the documents with an earlier version of the first rule, then all of them."""
    files, ledger = table(spark, sf_dir, "documents"), secret_ledger.new_ledger(spark, fresh_path(spark, "ledger"))
    first, *others = secret_ledger.RULES
    secret_ledger.scan_into(files.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), ledger, rules=(first._replace(version=0), *others))
    found = secret_ledger.scan_into(files, ledger)
    base = tuple(r.kind for r in secret_ledger.BASE_RULES)
    counts = [F.size(F.filter("found", of_kind(k))).cast("long").alias(f"n_{k}") for k in base]
    return found.select(
        F.col("path").alias("doc_id"), *counts, F.sha2(secret_ledger.digest(F.col("found"), base), 256).alias("base_sha256"), secret_ledger.digest(F.col("found")).alias("spans")
    )


def op8_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = blocks.without_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.without_earlier(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["to"] - x["from"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_best_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There and back: the ids of each text, and the text of the ids."""
    ids = bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), packed_ids=True, drop_text=True)
    back = bpe.decoded(ids)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_dups,
        op2_source_mix,
        op3_line_templates,
        op3_recurring_lines,
        op4_warc,
        op5_language_id,
        op6_quality_rules,
        op7_secret_scan,
        op8_string_tiling,
        op9_block_anchors,
        op10_suffix_index,
        op11_best_positions,
        op12_bpe_stream,
        op13_whitening,
    )
}
