"""A corpus from raw documents: good quality, one of each near-duplicate group, free of benchmark passages and personal data, as tokens.

Nulls, empty texts, repeated ids and further columns have the results that each stage states; an empty table gives an
empty one with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.bpe import bpe_encode
from quern.llm.common import drop_saved, save_alone, table
from quern.llm.decontaminate import decontaminate
from quern.llm.minhash_dedup import near_duplicates
from quern.llm.pii import find_pii, redact
from quern.llm.quality import THRESHOLD, fit_quality, score_quality


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents and the labels, doesn't reject. Null and empty texts have the score of a text without words."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, score_col="__score", write=False).where(F.col("__score") >= THRESHOLD).select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest id.

    Rows with the same id and text are one document; of such rows the one whose other columns come first stays. Rows
    with one id and other texts are documents of their own; if they are in one group, the smallest text hash decides.
    Rows without id stay.
    """
    marked = near_duplicates(docs, k=5, num=80, den=100).where(F.col("kept") & F.col("doc_id").isNotNull())
    group = F.coalesce("group_id", "text_hash").alias("group"), F.col("group_id").isNull().alias("alone")
    chosen = marked.groupBy("doc_id", *group).agg(F.min("text_hash").alias("hash")).select(F.col("doc_id").alias("kept_id"), F.col("hash").alias("kept_hash")).distinct()
    rest = [c for c in docs.columns if c != "doc_id"]
    hashed = docs.where("doc_id is not null").withColumn("__hash", F.xxhash64(F.col("text").cast("string")))
    once = hashed.groupBy("doc_id", "__hash").agg(F.min(F.struct(*rest)).alias("__row"))
    kept = once.join(chosen, (F.col("doc_id") == F.col("kept_id")) & (F.col("__hash") == F.col("kept_hash")), "left_semi")
    return kept.select("doc_id", "__row.*").select(docs.columns).unionByName(docs.where("doc_id is null"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark, edits included."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text. Null texts stay null."""
    found = find_pii(docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text")))
    clean = redact(F.col("row.text").cast("string"), F.col("pii_spans"))
    new = {"text": clean, "n_chars": F.length(clean).cast("long")}
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with n_tokens and ids. That ids give the text back is checked in the same pass."""
    return bpe_encode(docs, decoded=False, write=False)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_benchmark),
    ("PII", redact_personal_data),
    ("BPE encoding and decoding", encode),
]
#: SQL expresses neither the classifier nor the tokenizer; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over whole ``documents``, each written and read again. What a stage has left in the shared folder is removed when its result is written, and its input too."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = save_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), "stage-" + name.split()[0])
        drop_saved(before)
        before = docs
    return docs
