"""The corpus pipeline: toxicity, line dedup, near-duplicate documents, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of `documents`.  `run` writes each stage's result to the shared folder and reads it
again as the next one's documents.

In every stage a null or empty text is a document without words: it is not toxic, has no lines, is no
copy, is not contaminated, and is packed as its end token.  Null keys are allowed; rows that repeat a key
are documents of their own, and rows that repeat key and text are copies.  Texts of any length are taken whole.
Further columns, whatever their names, are carried along by all stages but the last.  An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitaudit.llm import decontaminate, jaccard, lines, packing, toxicity
from splitaudit.llm.common import crc_mod, cut, fresh
from splitaudit.session import prepare


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the cut; learned from labels outside the held-out fold."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(crc_mod(F.col("doc_id"), 3) != 1)
    model = toxicity.fit(docs, labels)
    scored = fresh(docs, "toxicity")
    return toxicity.score(docs, model, out=scored).where(F.col(scored)["score"] < toxicity.CUT).drop(scored)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less their duplicate lines."""
    prepare(spark)
    return lines.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links at Jaccard 0.75 of 5-word shingles."""
    prepare(spark)
    return jaccard.one_per_component(docs, n=5, threshold=(75, 100))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words benchmark windows cover less than a twentieth."""
    prepare(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), action="drop")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    prepare(spark)
    return packing.pack(docs, packing.tokenizer_path("byte_bpe_50k.json"), ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: Classifier, edit distances and tokenizer have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
