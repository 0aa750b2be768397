"""A corpus pipeline of four stages: what each keeps is written, read again and given to the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grovekit.llm.common import documents, staged
from grovekit.llm.decontamination import without_contaminated
from grovekit.llm.jaccard_join import one_of_each
from grovekit.llm.packing import pack_documents
from grovekit.llm.toxicity import learn, score_documents


#: Near copies of the corpus: shingles of five words, a similarity of 0.8 or more. The query op3 has its own contract.
NEAR_SIZE, NEAR_PERCENT = 5, 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar doesn't call toxic."""
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model).filter("predicted = 0").select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of near copies."""
    return one_of_each(docs, NEAR_SIZE, NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no run of words of a benchmark item."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed into sequences."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", jaccard_join),
    ("benchmark_decontamination", decontamination),
    ("packing", packing),
]

#: No SQL expresses a learned grammar or a tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
