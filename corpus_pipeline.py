"""A corpus pipeline: five operators, each on all that the one before keeps.

Every stage's result is written as Parquet in the cluster's shared folder and read again by the next, so a lost
executor costs its tasks, not the stages before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cognate_spark.llm import decontam, mixing, ngram_join, quality, tokenbin
from cognate_spark.llm.common import table, written
from cognate_spark.llm.queries import tokenizer_path
from cognate_spark.shared import TABLES, drop_tables


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.cascade(docs).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class linked by similarities of 0.8 or more."""
    return ngram_join.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per copy of a document, what is read back from the token store: doc_id, k (copy), start, n_tokens, ids_crc32."""
    store = tokenbin.write_store(docs, tokenizer_path())
    return store.lookup(tokenbin.numbered(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", source_mix),
    ("token ids", token_output),
]

#: The mix and the token store are beyond SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage writes on its way is deleted when its result is there, a result when the next one is."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        before = len(TABLES)
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_tables(spark, TABLES[before:-1] + ([last] if last else []))
        last = TABLES[-1]
    return docs
