r"""Benchmark decontamination by winnowing.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z. Of the 5-word hashes in each
window of 10 words the smallest is a fingerprint (``WINDOW - GRAM + 1`` hashes a window), so every
shared span of 10 words or more shares one. Benchmark fingerprints go into a bit map of bounded size;
document fingerprints that it lets through are extended to the windows they stand for, and those
windows are joined with the benchmark's by their words, which verifies them. An item of fewer than
10 words, but not none, is one window of its own length, found by a hash of that length.

Null has no words. Items without an id count for hits, and are left out of the lists of ids only. Rows
that repeat are documents or items of their own (repeated item_ids count once). A benchmark without words hits nothing; empty tables give empty results. A word of a document
is hit when it lies in any occurrence of a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap
from .arrow import arrow_map
from .durable import durable
from .kernels import ALNUM, LOWER, gram_hashes, hash_spans, mix64, text_slices, word_spans
from .lookup import lookup

WINDOW, GRAM = 10, 5


def window_fingerprints(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """For each window of ``window`` words its fingerprint, the least hash of ``gram`` words in it."""
    grams = gram_hashes(words, gram)
    span = window - gram + 1
    return sliding_window_view(grams, span).min(axis=1) if len(grams) >= span else np.zeros(0, np.uint64)


def _of_length(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of whole short windows, apart from fingerprints and from other lengths."""
    return mix64(hashes ^ np.uint64(n))


def _joined(data: np.ndarray, begin: np.ndarray, end: np.ndarray, starts: np.ndarray, n: int) -> list[str]:
    """The words of the windows of ``n`` words that begin at the given words, joined by spaces."""
    return [" ".join(data[begin[j] : end[j]].tobytes().decode("utf-8", "replace") for j in range(i, i + n)) for i in starts.tolist()]


_ITEM_DDL = "item_id long, length int, fingerprint long, words string"


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for first, _, data, starts in text_slices(batch.column(1)):
            data = LOWER[data]
            begin, end, before = word_spans(data, starts, ALNUM)
            hashes = hash_spans(data, begin, end)
            out_id, out_n, out_print, out_words = [], [], [], []
            for row, (a, b) in enumerate(zip(before[:-1].tolist(), before[1:].tolist(), strict=True)):
                n = min(WINDOW, b - a)
                if not n:
                    continue
                prints = window_fingerprints(hashes[a:b]) if n == WINDOW else _of_length(gram_hashes(hashes[a:b], n), n)
                out_id += [ids[first + row].as_py()] * len(prints)
                out_n += [n] * len(prints)
                out_print.append(prints)
                out_words += _joined(data, begin, end, np.arange(a, a + len(prints)), n)
            prints = np.concatenate(out_print) if out_print else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_id, pa.int64()), pa.array(out_n, pa.int32()), pa.array(prints.view(np.int64)), pa.array(out_words, pa.string())],
                names=["item_id", "length", "fingerprint", "words"],
            )


def _hits(data: np.ndarray, starts: np.ndarray, known: bitmap.BitMap, lengths: list[int]) -> tuple[pa.Array, pa.Array]:
    """For each row of a slice its number of words and the windows that may be the benchmark's."""
    data = LOWER[data]
    begin, end, before = word_spans(data, starts, ALNUM)
    hashes = hash_spans(data, begin, end)
    counts = np.diff(before)
    owner = np.repeat(np.arange(len(counts)), counts)
    rows, places, sizes, words = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], []
    for n in lengths:
        prints = window_fingerprints(hashes) if n == WINDOW else _of_length(gram_hashes(hashes, n), n)
        within = np.flatnonzero(owner[: len(prints)] == owner[n - 1 :]) if len(prints) else np.zeros(0, np.int64)
        hit = within[known.hits(prints[within])]
        rows.append(owner[hit])
        places.append(hit - before[owner[hit]])
        sizes.append(np.full(len(hit), n, np.int32))
        words += _joined(data, begin, end, hit, n)
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(counts)))]).astype(np.int32)
    values = pa.StructArray.from_arrays(
        [pa.array(np.concatenate(places)[order].astype(np.int32)), pa.array(np.concatenate(sizes)[order]), pa.array(words, pa.string()).take(pa.array(order))],
        names=["at", "length", "words"],
    )
    return pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), values)


def _document_windows(known: bitmap.BitMap, lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, starts in text_slices(batch.column(batch.num_columns - 1)):
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *_hits(data, starts, known, lengths)], names=[*part.schema.names[:-1], "n_words", "hits"]
                )

    return run


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Distinct windows ``length, fingerprint, words`` of the items with ``items``, the ids that hold them (none, where only items
    without an id do).

    Windows held by the same items share one list's content, and are told apart by their words.
    """
    rows = arrow_map(benchmark.select(F.col("item_id").cast("long"), F.col("text")), _item_windows, _ITEM_DDL)
    return rows.groupBy("length", "fingerprint", "words").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


_HITS_DDL = "n_words long, hits array<struct<at: int, length: int, words: string>>"


def contaminated(docs: DataFrame, benchmark: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a document: ``keys``, ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted ids, as strings) and ``spans`` (hit ranges of words).

    Texts are read once; only windows that pass the bit map are shuffled, dealt by window and salt.
    """
    table = durable(benchmark_windows(benchmark))
    lengths = sorted(r[0] for r in table.select("length").distinct().collect())  # 10 at most
    n_windows = table.count()
    known = bitmap.build(table, F.col("fingerprint"), n_windows)
    narrow = docs.select(*(F.col(k) for k in keys), F.col("text"))
    schema = ", ".join(f"`{k}` {narrow.schema[k].dataType.simpleString()}" for k in keys)
    rows = arrow_map(narrow, _document_windows(known, lengths), f"{schema}, {_HITS_DDL}").withColumn("__row", F.monotonically_increasing_id())
    rows = rows.select(*keys, "__row", "n_words", F.explode_outer("hits").alias("h")).select(*keys, "__row", "n_words", "h.*")
    # A row without a window goes by its own number, not to the partition of null.
    rows = rows.withColumn("words", F.coalesce("words", F.concat(F.lit("\0"), F.col("__row").cast("string"))))
    window = table.select("words", F.array_join("items", ",").alias("items"))
    rows = lookup(rows, window, ["words"], "__row", rows=n_windows)
    hit = F.when(F.col("items").isNotNull(), F.struct("at", (F.col("at") + F.col("length")).alias("end")))
    per = rows.groupBy("__row").agg(
        *(F.first(k).alias(k) for k in keys),
        F.first("n_words").alias("n_words"),
        F.sort_array(F.collect_set(hit)).alias("spans"),
        F.collect_set("items").alias("lists"),  # the many windows of a passage bring one list
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda s, h: F.struct(
            (s["n"] + F.greatest(F.lit(0), h["end"] - F.greatest(h["at"], s["upto"]))).cast("long").alias("n"),
            F.greatest(s["upto"], h["end"]).alias("upto"),
        ),
        lambda s: s["n"],
    )
    ids = F.flatten(F.transform("lists", lambda x: F.split(x, ",")))
    items = F.array_sort(F.array_distinct(F.filter(ids, lambda x: x != "")))  # an empty list is split to one empty id
    return per.select(*keys, "n_words", covered.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), "spans")
