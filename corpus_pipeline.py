"""A corpus pipeline of five operators. Each stage gets what the stage before it kept, as a table written and read again."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volmesh.llm import ngram_join, packing, quality_gam, quality_rules, substring_dedup
from volmesh.llm.shared import remove, shared_dir, table, whole


def _packed(docs: DataFrame, apart: list[str]) -> DataFrame:
    """The columns apart, and all others as one struct, so that no name of theirs can clash."""
    others = [c for c in docs.columns if c not in apart]
    return docs.select(*apart, *([whole(docs, others).alias("row")] if others else []))


def _in_order(out: DataFrame, docs: DataFrame, new: dict) -> DataFrame:
    """The columns of docs: those of new, and the others from the struct."""
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model scores as good. Null and empty texts are scored like others; repeated rows stay or go together; an empty table stays
    empty; columns come back as they are, whatever their names; texts may be of any length."""
    model = quality_gam.train(docs, table(spark, sf_dir, "labels"))
    return _in_order(quality_gam.score(_packed(docs, ["text"]), model).where("predicted = 1"), docs, {"text": F.col("text")})


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the log-likelihood ratio keep. Null and empty texts go, as all of under 50 words; else as quality_classifier."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id (null before all, ties by a hash of the text), and of rows alike in id and text one. Texts without
    words all stay; else as quality_classifier."""
    return ngram_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that start earlier in the corpus; text and n_chars follow, a null text becomes "", and rows alike in id and text get the same
    text; else as quality_classifier."""
    out = substring_dedup.remove_repeats(_packed(docs, ["doc_id", "text"]), layout=True)
    return _in_order(out, docs, {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")})


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, placed in sequences of 1024. Null and empty texts are one token; repeated rows are packed once each; an empty table gives no pieces."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("packing", packed_sequences),
]

#: SQL can express neither the model nor the hashed counts nor the tokens; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table is deleted when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            remove(spark, f"{folder}/{last}")
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
