"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html_text, langid, pii, quality, toxicity
from .common import fold
from .exact_dedup import exact_dedup
from .license_scan import license_scan
from .license_scan import oracle as license_sql
from .packing import packed, tokenized_pieces
from .simhash import simhash_components

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its words, base places and labels, and the labels of the license templates it holds."""
    return license_scan(_table(spark, sf_dir, "documents")).drop("matches")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its tokens and its place in a sequence."""
    pieces = tokenized_pieces(_table(spark, sf_dir, "documents"), TOKENIZER)
    return packed(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its predicted language, learned from the rows that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold(F.col("doc_id"), 5) == 0)
    model = langid.fit(docs.filter("NOT held_out"))
    return langid.identify(docs.drop("lang"), model).drop("text")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its quality score, learned from the labels that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold(F.col("doc_id"), 3) == 1)
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs.filter("NOT held_out"), labels.filter(fold(F.col("doc_id"), 3) != 1))
    return quality.score(docs, model).select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the row that stays of its equal texts."""
    return exact_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its toxicity score, and where its offending sentences stand (start:end in code points)."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold(F.col("doc_id"), 5) == 0)
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs.filter("NOT held_out"), labels.filter(fold(F.col("doc_id"), 5) != 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("offending").alias("n_offending"), F.array_join(F.transform("offending", lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias("offending"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item found in it."""
    found = decontam.find_leaks(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: its main text."""
    pages = html_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its fingerprint and the component of fingerprints linked at 3 bits."""
    found = simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans with those that the model adds."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs)).select("doc_id", "pii", F.filter("pii", lambda x: x["base"]).alias("base"))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in pii.KINDS]
    added = F.filter("pii", lambda x: ~x["base"])
    return found.select(
        "doc_id",
        *counts,
        F.sha2(said(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        said(F.col("pii")).alias("spans"),
        F.size(added).cast("long").alias("n_added"),
        F.size(F.filter(added, lambda x: x["kind"] == pii.SECRET)).cast("long").alias("n_secret"),
        F.size("pii").cast("long").alias("n_spans"),
    )


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_best_fit_packing, op3_language_id, op4_quality, op5_exact_dedup, op6_toxicity, op7_benchmark_decontamination, op8_html_extraction, op9_simhash_near_dedup, op10_pii)}

_NORM = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')"
ORACLE_SQL = {
    "op1_license_scan": license_sql(),
    "op5_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_NORM} AS norm FROM documents), g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256 FROM d JOIN g ON d.norm = g.norm""",
}
