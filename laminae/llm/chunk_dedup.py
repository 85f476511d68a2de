r"""Exact deduplication by content-defined chunk recipes.

A text, each ``[\x20\x09-\x0D]+`` in it replaced by one space, is cut where a rolling hash of its
last 32 bytes meets a mask, so equal passages give equal chunks wherever they stand. A chunk's
identifier is 64 bits of its SHA-256, verified against a second digest and its length over all
chunks of the corpus; where two chunks share an identifier, an ordinal tells them apart. A document
is then its ordered list of identifiers, and documents are equal when the lists are. Texts are read
once and never shuffled: only recipes move, some 24 bytes for each KB of text.

A null text counts as empty; the empty text has an empty list, so all empty texts are equal. Rows
that repeat a doc_id with one text stay or go together. A group whose doc_ids are all null keeps
null. Ties: the smallest doc_id stays. An empty table gives an empty result. Texts of any length are
cut and compared whole. Only the columns doc_id and text are read; further columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrow import arrow_map
from .durable import durable
from .kernels import SPACED, random_words, text_slices
from .lookup import lookup

SMALLEST, MASK, LARGEST = 256, np.uint32(1023 << 20), 16_384
_GEAR = (random_words(256, 7) >> np.uint64(32)).astype(np.uint32)


def squeeze(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run of white space within a row becomes one space."""
    if not len(data):
        return data, starts
    space = ~SPACED[data]
    again = np.zeros_like(space)
    again[1:] = space[1:] & space[:-1]
    again[starts[starts < len(data)]] = False
    kept = np.concatenate([[0], np.cumsum(~again)])
    return np.where(space, np.uint8(32), data)[~again], kept[starts]


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """At each byte, a hash of the 32 bytes that end there (of fewer at the start)."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8, 16):
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
    return h


def cut_points(marks: np.ndarray, begin: int, end: int) -> list[int]:
    """Ends of the chunks of ``begin:end``, given the ascending places after which a cut is allowed."""
    cuts, at = [], begin
    i = int(np.searchsorted(marks, begin + SMALLEST))
    while end - at > SMALLEST:
        while i < len(marks) and marks[i] < at + SMALLEST:
            i += 1
        at = min(int(marks[i]) if i < len(marks) else end, at + LARGEST, end)
        cuts.append(at)
    if at < end:
        cuts.append(end)
    return cuts


_RECIPE = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("text_sha256", pa.string()),
        ("chunks", pa.list_(pa.struct([("id", pa.int64()), ("digest", pa.int64()), ("n", pa.int32())]))),
    ]
)
_RECIPE_DDL = "doc_id long, n_bytes long, text_sha256 string, chunks array<struct<id: long, digest: long, n: int>>"


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for first, last, data, starts in text_slices(batch.column(1)):
            data, starts = squeeze(data, starts)
            marks = np.flatnonzero((rolling_hash(data) & MASK) == 0) + 1
            raw, whole, recipes = data.tobytes(), [], []
            for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                whole.append(hashlib.sha256(raw[begin:end]).hexdigest())
                recipe, at = [], begin
                for cut in cut_points(marks, begin, end):
                    chunk = raw[at:cut]
                    recipe.append(
                        {
                            "id": int.from_bytes(hashlib.sha256(chunk).digest()[:8], "big", signed=True),
                            "digest": int.from_bytes(hashlib.blake2b(chunk, digest_size=8).digest(), "big", signed=True),
                            "n": cut - at,
                        }
                    )
                    at = cut
                recipes.append(recipe)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, last - first), pa.array(np.diff(starts)), pa.array(whole), pa.array(recipes, _RECIPE.field("chunks").type)], schema=_RECIPE
            )


def chunk_recipes(docs: DataFrame) -> DataFrame:
    """One row a document: ``doc_id, n_bytes, text_sha256`` (of the squeezed text) and ``chunks``."""
    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text")), _recipes, _RECIPE_DDL)


def chunk_table(recipes: DataFrame) -> DataFrame:
    """Distinct chunks ``id, digest, n``, with ``ordinal`` among those of one id and ``refs``."""
    found = recipes.select(F.explode("chunks").alias("c")).groupBy("c.id", "c.digest", "c.n").agg(F.count("*").alias("refs"))
    return found.withColumn("ordinal", F.row_number().over(Window.partitionBy("id").orderBy("digest", "n")) - 1)


def verified_lists(recipes: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, text_sha256, ids``: the ordered list of verified identifiers of each document."""
    chunks = recipes.select(F.explode("chunks").alias("c")).select("c.*")
    # One row an identifier, summed in each task first, so that a chunk of a third of all texts is one row a task.
    spread = chunks.groupBy("id").agg(*(f(c).alias(f"{c}_{k}") for c in ("digest", "n") for k, f in (("lo", F.min), ("hi", F.max))))
    clashes = durable(spread.filter("digest_lo <> digest_hi or n_lo <> n_hi").select("id"))
    plain = recipes.withColumn("ids", F.transform("chunks", lambda c: F.struct(c["id"].alias("id"), F.lit(0).alias("ordinal")))).drop("chunks")
    if clashes.isEmpty():
        return plain
    ordinals = chunk_table(recipes).join(clashes, "id", "left_semi").select("id", "digest", "n", "ordinal")
    rows = recipes.withColumn("__row", F.monotonically_increasing_id())
    rows = durable(rows)
    parts = rows.select("__row", F.posexplode("chunks").alias("at", "c")).select("__row", "at", "c.*")
    parts = lookup(parts, ordinals, ["id", "digest", "n"], "__row")
    lists = parts.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("at", "id", F.coalesce("ordinal", F.lit(0)).alias("ordinal")))).alias("ids"))
    lists = lists.withColumn("ids", F.transform("ids", lambda c: F.struct(c["id"].alias("id"), c["ordinal"].alias("ordinal"))))
    empty = F.array().cast("array<struct<id: bigint, ordinal: int>>")
    return rows.join(lists, "__row", "left").withColumn("ids", F.coalesce("ids", empty)).drop("__row", "chunks")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, n_bytes, n_chunks`` for every row of ``docs``.

    ``keep_id`` is the smallest doc_id among documents with the same list of verified identifiers. The
    digests of the whole texts follow as an exact check: should the texts of one list differ after
    all, their digests join the key.
    """
    lists = verified_lists(durable(chunk_recipes(docs)))

    def repeated(key: list[str]) -> DataFrame:
        of = lists.groupBy(*key).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.min("text_sha256").alias("lo"), F.max("text_sha256").alias("hi"))
        return durable(of.filter("group_size > 1"))

    key = ["ids"]
    groups = repeated(key)
    if not groups.filter("lo <> hi").isEmpty():
        key = ["ids", "text_sha256"]
        groups = repeated(key)
    groups = groups.drop("lo", "hi")
    out = lookup(lists, groups, key, "doc_id", limit=0)  # a long document's list is long
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
        "n_bytes",
        F.size("ids").alias("n_chunks"),
    )
