"""The registered queries of the corpus operators: thin calls with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, audit, bpe, html, jaccard, language, lexical, media, mixing, oracles, pii, quality, rules, secrets
from tidemark.llm.common import held_out, materialize, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
QUALITY_THRESHOLD = 0.3
#: The least probability of a good text that the quality rules keep.
RULES_THRESHOLD = 0.3
MIX_WEIGHTS = {"domain": {"domain0": 0.3, "domain1": 0.3, "domain2": 0.25, "domain3": 0.15}, "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}}


def mix_domain(source: str = "source"):
    """The domain of a source: its number's remainder by 4 names one of four; other names have none."""
    number = F.regexp_extract(F.col(source), "([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit("domain"), (F.substring(number, -9, 9).cast("long") % 4).cast("string")))


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest other vectors of every vector whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where(F.col("vec_id") % 20 == 0), k=20)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; the fold with remainder 0 of 5 is never learned from."""
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"), lambda i: ~held_out(i, 5, 0))
    return quality.score(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding of every whole text."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), VOCABULARY)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return html.main_text(pages, html.learn(pages))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken when 60 % of the tokens are shared out by domain and language.

    Texts are counted once; from there on only ids, leaves and counts are read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", mixing.token_count(F.col("text")).alias("n_tokens"))
    mixed = mixing.mix(materialize(docs), mix_domain(), MIX_WEIGHTS, share=0.6, max_epochs=4, seed=17, tokens=F.col("n_tokens"))
    return mixed.select("doc_id", "n_tokens", F.col("__epochs").alias("epochs"), (F.col("__epochs") * F.col("n_tokens")).alias("tokens_taken"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at Jaccard 0.8 on five-word shingles."""
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; the fold with remainder 1 of 3 is never learned from."""
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs, lambda i: ~held_out(i, 3, 1))
    return language.identify(docs, model).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score", "rejected")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a stored image, found through the figure of one of the table's pages: the pages with their figures are
    read as sequences of texts and references, whose digests are resolved in the store.

    Documents that no page could take have no position, and all else as the others."""
    stored = media.store(table(spark, sf_dir, "documents"))
    listed = materialize(stored.select(F.monotonically_increasing_id().cast("string").alias("entry"), "doc_id", "n_bytes", "digest"))
    entries = listed.select("entry", "digest", F.concat(F.lit("Bytes of document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias("caption"))
    refs = media.references(media.interleave(media.place(table(spark, sf_dir, "pages"), entries)))
    once = refs.groupBy("entry").agg(F.min(F.struct("page_id", "position", "caption")).alias("r")).select("entry", "r.*")
    found = listed.join(once, "entry", "left")
    return media.resolve(found, media.describe(stored)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "page_id", "position", "caption")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text, by built-in functions only."""
    return pii.find(table(spark, sf_dir, "documents"), pii.learn(spark))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text."""
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.learn(docs))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How five filters interact in every order of them, by source."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents of the highest scores for every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document; like the classifier's, its held-out fold is never learned from."""
    docs = table(spark, sf_dir, "documents")
    model = rules.learn(docs, table(spark, sf_dir, "labels"), lambda i: ~held_out(i, 5, 0))
    return rules.judge(docs, model, RULES_THRESHOLD)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of this subpackage by name."""
    return {f.__name__: f for f in (op1_nearest, op2_quality, op3_bpe, op4_html, op5_mixing, op6_jaccard, op7_language, op8_media, op9_pii, op10_secrets, op11_audit, op12_lexical, op13_rules)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those that SQL can express."""
    return {"op5_mixing": oracles.mixing(MIX_WEIGHTS["domain"], MIX_WEIGHTS["lang"], 0.6, 4, 17), "op6_jaccard": oracles.JACCARD, "op11_audit": oracles.AUDIT, "op12_lexical": oracles.LEXICAL}
