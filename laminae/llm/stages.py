"""Operators as filters of a documents table: all columns in, those of the kept rows out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mixing, near_dedup, quality, winnowing
from .durable import compact
from .lookup import lookup

#: Keys of 8 bytes that may be broadcast: 8 MB as a table of longs.
BROADCAST_KEYS = 500_000


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose row key is not among ``dropped`` (one column ``key``).

    Up to ``BROADCAST_KEYS`` keys no document moves; beyond, documents are dealt by key and salt.
    """
    gone = dropped.select(F.col("key").alias("__key")).distinct().withColumn("__gone", F.lit(True))
    keyed = docs.withColumn("__key", near_dedup.row_key())
    return lookup(keyed, gone, ["__key"], "doc_id", BROADCAST_KEYS).filter("__gone is null").select(*docs.columns)


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose text the discriminant, learned from the labels, scores 0.5 or more.

    A null or empty text is scored as it is; rows of equal texts go or stay together. Without labels
    of both classes every score is the share of label 1, so all rows stay or go. An empty table gives
    an empty one, and further columns pass through.
    """
    return quality.accepted(docs, quality.learn(quality.measured(docs), labels))


def keep_one_of_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Exactly one row of each group of near copies: of the smallest doc_id, and of rows equal in doc_id and text one.

    Rows without words are in no group but that of their doc_id and text. An empty table gives an
    empty one, and further columns pass through.
    """
    rows = near_dedup.grouped(docs, k, percent).groupBy("group", "key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    keys, _ = compact(rows)
    other = F.coalesce(F.col("doc_id") != F.col("group"), F.lit(True))
    stays = keys.groupBy("group").agg(F.min(F.struct(other.alias("other"), "key"))["key"].alias("stays"), F.count("*").alias("m")).filter("m > 1")
    marked = lookup(keys, stays.drop("m"), ["group"], "key")
    out = without(docs, marked.filter("key <> stays").select("key"))
    repeated, n_repeated = compact(marked.filter("n > 1 and (stays is null or key = stays)").select(F.col("key").alias("__key")))
    if not n_repeated:
        return out
    keyed = lookup(out.withColumn("__key", near_dedup.row_key()), repeated.withColumn("__many", F.lit(True)), ["__key"], "doc_id", BROADCAST_KEYS)
    keyed = keyed.withColumn("__key", near_dedup.row_key())  # the lookup drops its keys
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = keyed.filter("__many").groupBy("__key").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("__doc"))
    return keyed.filter("__many is null").select(*columns).unionByName(one.select("__doc.*"))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that hold no window of a benchmark item, items without an id included.

    A null or empty text holds none. Rows equal in doc_id and text go or stay together. Without
    items, or of an empty table, all rows stay; further columns pass through.
    """
    keyed = docs.select(near_dedup.row_key().alias("key"), "text")
    return without(docs, winnowing.contaminated(keyed, benchmark, ("key",)).filter("n_hit > 0").select("key"))


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Documents as often as the mix takes them; a second copy is a second row.

    A null source is a source; null and empty texts have no words, and a copy of them is taken or not
    as the sum of expected copies has it. Rows that repeat are documents of their own. An empty table
    gives an empty one; all columns, of clashing names too, pass through.
    """
    names = docs.columns
    inner = docs.select("doc_id", "source", "text", F.struct(*(F.col(f"`{c}`") for c in names)).alias("__doc"))
    plan = mixing.mix_plan(mixing.with_size(inner).drop("text"), seed)
    return mixing.emit_copies(plan).select("__doc.*")
