"""A training-corpus pipeline: quality rules, line dedup, near-dedup, mixing, and encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result to the shared folder and reads
it again as the next stage's docs. All stages but the last return the columns of documents.

Defined results: null, empty and wordless texts are rejected for their few words; a null source is a source of its own; rows
without an id are in no line dedup or near-dedup, and stay. Rows that repeat an id and its text are treated alike. Ties go to
the smaller id. Other columns are carried, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import bpe, common, lines, minhash, mixing, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go; none goes for its length alone."""
    return quality.keep(docs, "v2")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; a document whose every line was a repeat goes."""
    return lines.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays."""
    return minhash.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become the words that the mix takes of them, repeats included; documents it takes nothing of go."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and digests of its ids and of the text that they decode to."""
    return bpe.digests(bpe.encode_decode(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]
#: Near-dedup and encoding are not expressible in SQL; the tests hold the pipeline against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return common.saved(STAGES[-1][1](spark, docs, sf_dir), f"pipeline-{STAGES[-1][0]}")
