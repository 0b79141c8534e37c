"""A training-data pipeline of five of the operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
docs. A stage's output is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from murmuration.llm import bpe, mixing, near_dup, scratch, suffix_dedup, toxicity
from murmuration.llm.suffix_dedup import with_ids

SCOPE = "pipeline"
#: Stands before the names of docs' columns inside a stage, so that none clashes with an operator's.
OWN = "in_"


def _stage(work):
    """The stage's intermediate tables go when the next stage begins: by then its output has been written."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.release(spark, SCOPE)
        with scratch.scope(SCOPE):
            out = work(spark, docs.toDF(*[OWN + c for c in docs.columns]), sf_dir)
        return out.toDF(*[c.removeprefix(OWN) for c in out.columns])

    return run


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator gives less than 0.5 stay."""
    grammar, logistic = toxicity.train(docs.select(F.col("in_doc_id").alias("doc_id"), F.col("in_text").alias("text")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, grammar, logistic, "in_text").filter(F.col("score") < 0.5).select(*docs.columns)


@_stage
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that near-duplicate links connect, that of least id stays."""
    rows, key = with_ids(docs, "in_doc_id")
    found = near_dup.near_duplicates(rows, id_col=key, text="in_text")
    stay = found.filter(F.col(key) == F.col("class_id")).select(F.col(key).alias("stays"))
    return rows.join(stay, F.col(key) == F.col("stays"), "left_semi").select(*docs.columns)


@_stage
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat; documents stay, if need be with an empty text."""
    cut = suffix_dedup.dedup(docs, id_col="in_doc_id", text="in_text", form="text")
    return cut.withColumn("in_n_chars", F.char_length("in_text").cast(docs.schema["in_n_chars"].dataType)).select(*docs.columns)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    rows, key = with_ids(docs, "in_doc_id")
    taken = mixing.mix(rows.select(F.col(key).alias("doc_id"), F.col("in_text").alias("text"), F.col("in_source").alias("source"))).filter(F.col("repeats") > 0)
    times = taken.select(F.col("doc_id").alias("taken_id"), "repeats")
    joined = rows.join(times, F.col(key) == F.col("taken_id"))
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select(*docs.columns)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document of the mix."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, text="in_text", keep=("in_doc_id",), digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("suffix-array dedup", cut_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: Learned scores, transforms and merges are beyond SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        out = f"{scratch.shared_root(spark)}/stage-{scratch.unique()}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            scratch.delete(spark, before)
        before = out
    return STAGES[-1][1](spark, docs, sf_dir)
