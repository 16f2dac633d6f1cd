"""A corpus pipeline: toxic texts, exact copies, near copies and contaminated texts go, the rest is tokenized.

STAGES are run in order; each reads what the one before it wrote. All but the last return the columns of documents.
"""

import os

from panelspark.llm import byte_bpe, decontaminate, exact_dedup, ngram_join, toxicity
from panelspark.llm.queries import vocabulary
from panelspark.session import cut_lineage, ship

HERE = os.path.dirname(os.path.abspath(__file__))


def _workers_have_the_library(spark):
    ship(spark, os.path.join(HERE, "panelspark"))


def drop_toxic(spark, docs, sf_dir):
    _workers_have_the_library(spark)
    return toxicity.filter_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark, docs, sf_dir):
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark, docs, sf_dir):
    _workers_have_the_library(spark)
    return ngram_join.keep_one(docs)


def drop_contaminated(spark, docs, sf_dir):
    _workers_have_the_library(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark, docs, sf_dir):
    _workers_have_the_library(spark)
    return byte_bpe.digests(byte_bpe.encode(docs, vocabulary()))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies),
          ("benchmark decontamination", drop_contaminated), ("byte-level BPE", tokenize)]

#: SQL can't express the toxicity model; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the documents that stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
