"""Training-data pipeline: five stages over documents, each of them one operator.

STAGES: (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of
documents, whatever else these have.

Nulls and empty tables: a null id or text is a row like others (sampled, scored as without hits, linked with nothing, free of
benchmark passages, encoded as no ids). Repeated rows stay or go together, but for copies under different
ids, of which one stays. Without labels, or without labels of both kinds, every document is worth the same and the seed
terms decide on toxicity; an empty benchmark removes nothing; an empty documents table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordspark.llm import bpe, common, decontam, importance, jaccard, toxicity
from recordspark.llm.queries import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling towards documents labelled good; as many stay as are expected to be good."""
    return importance.keep_sampled(docs, common.table(spark, sf_dir, "labels"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half."""
    return toxicity.keep_clean(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of 5-word shingle sets that are 0.8 or more alike; ids are whole numbers, null ids stay."""
    return jaccard.keep_one(docs, words=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.remove_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left: doc_id, lang, source, n_tokens, ids."""
    return bpe.encode_documents(docs, tokenizer_file("word_bpe_49k.json"), keep=("lang", "source"))


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxic),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding", encoding),
]

#: Sampling, learned scores and tokenizers are beyond SQL: each stage's operator is tested against a plain version of its own,
#: and tests/llm/test_pipeline.py tests the stages together on planted rows and against their plain composition.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
