"""A corpus pipeline of five stages over the documents table.

Each stage takes what the one before it kept, written as Parquet and read again:

1. quality: documents that the classifier rejects go;
2. near duplicates: one document of each component stays, the one with the smallest id;
3. secrets: what the scan finds is masked in the text;
4. mixing: documents outside their leaf's share of the token budget go;
5. tokens: every text is encoded, and decoded again as a check.

All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, jaccard, mixing, quality, secrets
from tidemark.llm.common import broadcast_if_few, held_out, materialize, table
from tidemark.llm.queries import QUALITY_THRESHOLD, VOCABULARY, mix_domain

#: The target mixture: nine tenths of the tokens, each document once at most.
MIXTURE = {"lang": {"en": 0.55, "de": 0.16, "fr": 0.17, "es": 0.12}}
SHARE = 0.9

#: No stage but the second can be written in SQL. Near duplicates, secrets, mixing and tokens are tested against brute
#: force or the tokenizers library in the tests of their operators, quality on held-out labels.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score at least the threshold. Null, empty and blank texts score 0 and go;
    a very long text is scored whole, repeated rows fare alike, and an empty table stays empty."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"), lambda i: ~held_out(i, 5, 0))
    return quality.kept(docs, model, QUALITY_THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component; rows without an id or without words all stay.

    Of rows that repeat an id one stays, the least in the order of the columns. Very long texts are compared whole; an
    empty table stays empty.
    """
    found = materialize(jaccard.similar_components(docs))
    per_id = materialize(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("__rows"), F.min("component_id").alias("__component")))
    gone = per_id.where("__component <> doc_id").select(F.col("doc_id").alias("__gone"))
    kept = docs.join(broadcast_if_few(gone), F.col("doc_id") == F.col("__gone"), "left_anti")
    repeated = per_id.where("__rows > 1").select(F.col("doc_id").alias("__again"))
    if repeated.isEmpty():
        return kept
    repeated = broadcast_if_few(repeated)
    again = kept.join(repeated, F.col("doc_id") == F.col("__again"), "left_semi")
    one = again.groupBy(F.col("doc_id").alias("__id")).agg(F.min(F.struct(*docs.columns)).alias("__row")).select(*(F.col("__row")[c].alias(c) for c in docs.columns))
    return kept.join(repeated, F.col("doc_id") == F.col("__again"), "left_anti").unionByName(one)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows, with secrets masked and n_chars following. A null text stays null, an empty one empty; a
    very long one is read whole; repeated rows are masked alike."""
    return secrets.redacted(docs, secrets.learn(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that fill the budget, each once at most. Null and empty texts cost nothing and go where their
    place in the order is behind the end; a very long one is taken whole; rows that repeat an id share its place;
    an empty table stays empty."""
    return mixing.mix(docs, mix_domain(), MIXTURE, share=SHARE, max_epochs=1, seed=17).where("__epochs > 0").drop("__epochs")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests of ids and of the decoded text, and the token ids. A null text counts as
    empty and has no tokens; a very long one is encoded whole; repeated rows have the same tokens; an empty table
    gives no rows."""
    return bpe.round_trip(docs, VOCABULARY, keep_ids=True)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("tokens", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
