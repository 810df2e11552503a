"""The corpus pipeline: five stages, each on all that its predecessor kept.

Every stage takes the documents (doc_id, text, lang, source, n_chars and any further columns) and the folder of the
tables, and its result is written as Parquet to the shared folder and read again as the next one's documents.

- toxicity: documents whose score reaches 0.7 go.
- near_duplicates: one document of each group of near copies (five-word shingles, similarity 0.8 or more) stays.
- decontamination: documents with a benchmark window of ten words go.
- secrets: secrets are replaced by a mark, except examples that several sources or very many documents have; no document goes.
- mixing: one row per draw of a document, with shard, pass and words_taken, by shard in hashed order.

Nulls, empty tables, repeated rows and further columns are handled as the operators say; all but the last stage return
the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from elastiq.llm import decontaminate, mixing, neardup, secrets, toxicity
from elastiq.llm.common import keep_rows, table
from elastiq.sources.staging import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    verdict = found.select("doc_id", "text_hash", (F.col("n_hit") == 0).alias("clean"))
    return keep_rows(docs, verdict, "clean")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.materialise(docs, mixing.mix(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

# Learned scores, hashed sketches and seeded draws have no SQL; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
