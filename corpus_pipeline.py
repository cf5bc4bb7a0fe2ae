"""A corpus pipeline in five stages over the table of documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next one's docs. All but the last return the
columns of docs.

1. language ID: documents without a language go (no letters, or a score below
   0.2); ``lang`` becomes the predicted language;
2. near duplicates (5-word shingles, similarity 0.8): the document with the
   smallest doc_id of each group stays;
3. decontamination: documents in which a window of a benchmark item occurs go;
4. secrets: spans are replaced by a mark, ``n_chars`` counts the new text;
5. byte-level BPE: doc_id, lang, source, n_chars, the number of tokens, the ids
   and the digests of ids and of the decoded bytes.

A null text, an empty one and one without letters have no language and go in the
first stage; of texts whose languages tie the first by name counts. Very long texts go
through all stages whole. Of rows that repeat, or of a group, the one with the smallest
doc_id stays (any of rows equal in doc_id and text; a null doc_id gives way to all
others). Further columns are kept through the first four stages, whatever their names,
and through the last but for text and names that it makes itself. An empty table gives an
empty result; without benchmark items no document is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import byte_bpe, decontamination, language_id, near_dedup, secrets
from tidelog.llm._common import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.reject_unknown(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.with_tokens(docs).drop("text")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("secrets", redact),
    ("tokens", tokenize),
]

#: Language models, MinHash and BPE are beyond SQL: tests hold run() against a version in plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
