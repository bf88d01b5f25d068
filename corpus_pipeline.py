"""Training-data pipeline over documents: toxicity, near-duplicates, benchmark decontamination, mixing, token-ID output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rxweave.llm import decontaminate, mixing, similar, tokens, toxicity
from rxweave.llm.common import scratch, table


REMEMBERED = 300_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; the model learns from the labelled ones that are not held out."""
    model = toxicity.fit(toxicity.labelled_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHashes of five-word shingles within the ring's budgets, similarity 0.8 or more."""
    return similar.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.filter("not contaminated").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' digests, as read back from them; workers that earlier stages left memory in remember fewer words."""
    return tokens.tokenize(docs, remembered=REMEMBERED)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_ids", write_tokens),
]

#: The classifier and the fingerprints have no SQL form; tests/llm/test_pipeline.py holds run() against plain definitions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
