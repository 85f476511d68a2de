"""The queries of the corpus operators: thin, each takes its rows from its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_dedup, hilbert, language, licences, mixing, near_dedup, quality, secrets, url_tree, winnowing
from .durable import durable
from .tables import table

SHARDS = 8


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of equal row counts along a Hilbert curve (law ``rows``)."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", "lang", "source", "text", F.crc32(text).alias("text_crc32"), (F.octet_length(text) + 1).cast("long").alias("size"))
    narrow = durable(narrow.select("doc_id", "lang", "source", "text_crc32", "size"))
    dimensions = {c: F.col(c) for c in ("lang", "source", "size")}
    out = hilbert.hilbert_shards(narrow, dimensions, [F.col("doc_id"), F.col("text_crc32")], SHARDS)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert"
    )


def op2_chunk_recipe_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy that stays for it, by lists of verified chunk identifiers."""
    out = chunk_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix with targets by source takes of every document."""
    sized = mixing.with_size(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    plan = mixing.mix_plan(durable(sized.select("doc_id", "source", "size", "text_tie")))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base patterns, and long tokens that look random; how many base spans look so too."""
    model = secrets.train(secrets.labelled_samples(spark))
    out = secrets.secret_spans(table(spark, sf_dir, "documents"), model)
    count = lambda kind: F.size(F.filter("base", lambda s: s["rank"] == secrets.KINDS.index(kind))).cast("long")
    return out.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secrets.listed("base"), 256).alias("base_sha256"),
        secrets.listed("spans").alias("spans"),
        F.size("markov").cast("long").alias("n_markov"),
        F.size(F.filter("base", lambda s: s["random"])).cast("long").alias("n_random"),
    )


def op5_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence sentences of every document, in order, and the licences whose rules they meet."""
    out = licences.licence_matches(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licences", ",").alias("licences"),
    )


def op6_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document."""
    rows = durable(quality.measured(table(spark, sf_dir, "documents")))
    return quality.scored(rows, quality.learn(rows, table(spark, sf_dir, "labels")))


def op7_url_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on the URL of every page."""
    return url_tree.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "template", "shared", "purity")


def op8_fast_sketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 2-word shingles have similarity 0.8 or more."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80).drop("key")


def op9_marginal_unigram_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    return language.predicted(docs, language.learn(docs))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a 10-word window of a benchmark item."""
    out = winnowing.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_hilbert_shards,
        op2_chunk_recipe_dedup,
        op3_systematic_mix,
        op4_markov_secrets,
        op5_licence_rules,
        op6_quadratic_quality,
        op7_url_template_tree,
        op8_fast_sketch_near_dedup,
        op9_marginal_unigram_language,
        op10_winnowing,
    )
}
