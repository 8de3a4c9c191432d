"""A corpus from documents: toxicity, near-duplicates, benchmark leaks, mixing, token ids.

Each stage takes (spark, docs, sf_dir), where docs are all rows that the stage
before kept; the last one returns what was read back from the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavefold.llm import decontaminate, jaccard_join, mixing, queries, token_output, toxicity
from wavefold.llm.shared import discard, scratch_dir, table, written

#: SQL cannot express trained models, tokenizers and edit distances in bands.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chain = toxicity.fit_chain(docs, queries.toxicity_labels(spark, sf_dir), scratch_dir(spark))
    last = chain.cfg.categories[-1]
    return docs.filter(toxicity.probability(F.col("text"), chain)[last] < chain.cfg.threshold)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, scratch_dir(spark))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"), scratch_dir(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark)
    sizes = written(mixing.sized(docs), folder, "sizes")
    return mixing.mixed_documents(docs, written(mixing.source_plan(sizes), folder, "plan"))


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark) + "/tokens"
    token_output.write_tokens(docs, folder, queries.token_config())
    return token_output.read_digests(spark, folder)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token output", write_token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; each stage's rows are written as Parquet and read again, then deleted."""
    docs, folder = table(spark, sf_dir, "documents"), scratch_dir(spark)
    for n, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), folder, f"stage-{n}")
        discard(spark, folder, f"stage-{n - 1}")
    return docs
