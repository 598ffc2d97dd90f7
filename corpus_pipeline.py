"""The training-data pipeline: documents in, encoded clean documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that run() stores and reads again as the next one's
documents. All but the last return the columns of documents. Stages handle nulls in any column, empty and very long
texts, repeated rows, empty tables and further columns as their operators say:

toxicity             rejects the documents whose predicted toxicity is 0.5 or more; a null text has no evidence and stays
line dedup           cuts repeated lines out of texts; every document stays, its n_chars set anew (null text: empty)
simhash near-dedup   keeps one document, the least doc_id, of each group of exact and near copies
decontamination      drops documents that hold a benchmark item, also with other numbers, names or units
bpe                  encodes texts: doc_id, n_tokens, ids, decoded
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.llm import line_dedup, simhash, templates, toxicity, transducer
from lagloom.llm.common import id_and_text, stored
from lagloom.llm.queries import tokenizer


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    texts = id_and_text(docs)
    model = toxicity.fit(texts.where(~toxicity.held_out(F.col("doc_id"))), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(docs)
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return done.select(*[new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return templates.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return transducer.encode_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", dedup_near_copies),
    ("benchmark decontamination", decontaminate),
    ("bpe", encode),
]

#: Learned scores, fuzzy fingerprints and token merges have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
