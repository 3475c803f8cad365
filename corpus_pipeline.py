"""From raw documents to packed sequences, in five stages over the operators of terrapix.llm.

Every stage reads what its predecessor kept and returns what it keeps, with the columns of documents; the last returns the
pieces of the packed sequences. run() stores each stage's rows as Parquet in the shared folder and reads them back.

For all stages: null texts count as empty; an empty table gives an empty one; further columns of documents, whatever their
names, are passed on. A null doc_id is an id that sorts after all others. Rows that repeat are judged alike, and the stages on
copies keep one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrapix.llm import decontam, toxicity
from terrapix.llm.common import Scratch, fold
from terrapix.llm.exact_dedup import exact_dedup
from terrapix.llm.packing import packed, tokenized_pieces
from terrapix.llm.simhash import near_components

TOKENIZER = "word_bpe_49k.json"
TOXIC_FROM = 0.5


def _kept(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs whose (doc_id, text_hash) decided keeps; of rows that repeat both, one."""
    key = lambda h: (F.coalesce("doc_id", F.lit(0)).alias("_a"), F.isnull("doc_id").alias("_b"), h.alias("_h"))
    kept = decided.filter("kept").select(*key(F.col("text_hash")))
    held = docs.select("*", *key(F.xxhash64(F.coalesce("text", F.lit(""))))).join(kept, ["_a", "_b", "_h"], "left_semi")
    first = F.row_number().over(Window.partitionBy("_a", "_b", "_h").orderBy("_h"))
    return held.withColumn("_n", first).filter("_n = 1").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity (6): rows whose score reaches TOXIC_FROM go. Without labels, or without a toxic one among them, all stay; empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs.filter(fold(F.col("doc_id"), 5) != 0), labels.filter(fold(F.col("doc_id"), 5) != 0))
    return toxicity.score(docs, model, locate=False, into="_toxicity").filter(F.col("_toxicity") < TOXIC_FROM).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup (5): of equal normalised texts the row of the smallest doc_id stays; of several rows with that id and text, one. All empty texts are equal."""
    return _kept(docs, exact_dedup(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup (9): of each component the row of the smallest doc_id stays; of several rows with that id, one.

    Texts are linked of which 0.8 or more of the words stand in five-word shingles that both hold. A changed word takes five
    shingles with it, so copies with a changed word in ten share no more than 0.4 of their shingle sets but 0.8 of their words.
    Fingerprints at 3 bits of 64, as in the query op9, would miss most of these: they differ in 8 bits and more.
    """
    return _kept(docs, near_components(docs, shingle=5, similarity=0.8, measure="covered"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (7): documents that hold a benchmark item go; empty texts hold none, and items without a text are passed over."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.find_leaks(docs, items, into="_leaks").filter(F.size("_leaks") == 0).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing (2): one row per piece, with its sequence and place. An empty text is one piece, its end token; rows that repeat are packed each."""
    pieces = tokenized_pieces(docs, TOKENIZER)
    return packed(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash_near_dedup", drop_near_copies), ("benchmark_decontamination", drop_leaks), ("best_fit_packing", pack)]

#: SQL can express neither the trained model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return docs
