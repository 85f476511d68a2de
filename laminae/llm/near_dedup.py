r"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set holds its distinct shingles of ``k`` words (``[^\x20\x09-\x0D]+``, A-Z lower-cased);
with fewer words the whole sequence is its one shingle, without words the set is empty and linked
with nothing. Two documents are linked when 100 * intersection >= percent * union.

1. Equal sets are one class. Each class is sketched in 288 coordinates, in 48 bands of 6: a pair of
   similarity 0.8 shares a band but for a chance of 5e-7.
2. In every bucket of a band the members are compared with the bucket's least member alone, and the
   linked ones are joined into components. This is linear in the size of a bucket.
3. In buckets that still hold members of different components, those outside the bucket's largest
   component (the odd ones) are compared with all others, so that no link is lost. Pairs are tested in
   the join, by set sizes and by odd sketches (which prove most pairs below the threshold unlike),
   and only in their first common band. Large buckets are cut into a grid over many tasks, for which
   rows are copied by the root of the bucket's size at most.
4. What passes is confirmed on the full sets, in both 2 and 3.

Rows of equal sets are one class, so copies are never expanded to pairs. A doc_id is one document:
rows that repeat it, with equal texts or with others, are of one component, and what any of their
texts is linked with is reachable through it (a row without words stays alone). A null doc_id takes part, row by row, and is never a
component's name unless no other is there (then null). Texts of any length are compared whole. An
empty table gives an empty result. Only doc_id and text are read; further columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bitmap
from .arrow import arrow_map
from .components import components
from .durable import compact, durable
from .kernels import LOWER, SPACED, gram_hashes, hash_spans, text_slices, word_spans
from .lookup import lookup
from .sketch import BANDS, band_keys, common, fast_sketch, parity_sketch

#: Node numbers from here on stand for classes whose doc_ids are all null.
NAMELESS = 1 << 62
#: A task compares as many pairs of a bucket as so many members make with all, and pairs that one copy of a set serves.
BLOCK, PAIRS_A_COPY = 512, 1000


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The ascending distinct shingle hashes of each text."""
    for _, _, data, starts in text_slices(column):
        data = LOWER[data]
        begin, end, before = word_spans(data, starts, SPACED)
        words = hash_spans(data, begin, end)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            yield np.unique(gram_hashes(words[a:b], min(k, b - a))) if b > a else words[:0]


def _digest(members: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(members.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _nameless(lo: int) -> int:
    return NAMELESS | (lo & ((1 << 61) - 1))


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, lo, hi, keys = [], [], [], []
            for members in shingle_sets(batch.column(1), k):
                sizes.append(len(members))
                digest = _digest(members)
                lo.append(digest[0])
                hi.append(digest[1])
                keys.append(band_keys(fast_sketch(members)).view(np.int64) if len(members) else np.zeros(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), bands],
                names=["doc_id", "key", "n_shingles", "lo", "hi", "bands"],
            )

    return run


def _candidate_sets(k: int, wanted: bitmap.BitMap):
    schema = pa.schema([("node", pa.int64()), ("lo", pa.int64()), ("n", pa.int64()), ("parity", pa.list_(pa.int64())), ("keys", pa.list_(pa.int32())), ("members", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            named = np.asarray(ids.fill_null(0))
            take = np.flatnonzero(wanted.hits(named.view(np.uint64)) | np.asarray(ids.is_null()))
            part = batch.take(pa.array(take))
            out: list[list] = [[], [], [], [], [], []]
            for doc, members in zip(part.column(0).to_pylist(), shingle_sets(part.column(1), k), strict=True):
                if not len(members):
                    continue
                lo = _digest(members)[0]
                row = (
                    doc if doc is not None else _nameless(lo),
                    lo,
                    len(members),
                    parity_sketch(members),
                    (band_keys(fast_sketch(members)) >> np.uint64(32)).astype(np.uint32).view(np.int32),
                    members.tobytes(),
                )
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = common(x, y)
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    return run


def _size_ok(x: Column, y: Column, percent: int) -> Column:
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _parity_ok(x: str, y: str, n: Column, percent: int) -> Column:
    """Sets of ``n`` members together that differ in more than n (100 - p) / (100 + p) are not linked."""
    differ = sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(32)), F.lit(0))
    return differ * (100 + percent) <= n * (100 - percent)


def _attach(pairs: DataFrame, sets: DataFrame, end: str, columns: dict[str, str]) -> DataFrame:
    """Join the columns of node ``end`` to pairs; a node in many pairs is copied, one for each 1000 pairs."""
    copies = pairs.groupBy(F.col(end).alias("__node")).agg(F.ceil(F.count("*") / PAIRS_A_COPY).cast("int").alias("__copies"))
    other = "b" if end == "a" else "a"
    pairs = lookup(pairs, copies.withColumnRenamed("__node", end), [end], other, limit=0)
    pairs = pairs.withColumn("__copy", F.pmod(F.xxhash64(other), F.col("__copies")).cast("int")).drop("__copies")
    sets = sets.select(F.col("node").alias("__node"), *(F.col(c).alias(to) for c, to in columns.items())).join(copies, "__node")
    sets = sets.withColumn("__at", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1))).drop("__copies")
    joined = pairs.join(sets, (F.col(end) == F.col("__node")) & (F.col("__copy") == F.col("__at")))
    return joined.drop("__node", "__copy", "__at")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are linked."""
    # The odd sketches go first: they are 256 bytes, a set is 8 for each shingle.
    for end in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col("parity").alias(f"p{end}")), end)
    pairs = pairs.filter(_size_ok(F.col("na"), F.col("nb"), percent) & _parity_ok("pa", "pb", F.col("na") + F.col("nb"), percent)).select("a", "b")
    pairs, _ = compact(pairs.distinct())
    full = pairs
    for end in "ab":
        full = _attach(full, sets, end, {"members": f"m{end}"})
    return arrow_map(full.select("a", "b", "ma", "mb"), _confirm(percent), "a long, b long").distinct()


def _grid(m: Column, odd: Column) -> tuple[Column, Column]:
    """``parts`` of a bucket's odd members and ``blocks`` of all its ``m``, a task for each of both.

    A task compares about ``BLOCK`` x m pairs at most. Odd members are copied to every block and all
    members to every part: m + odd + 2 odd (m / BLOCK) ** 0.5 rows at most, never the square of m.
    """
    parts = F.ceil(odd / F.sqrt(m * BLOCK)).cast("int").alias("parts")
    return parts, F.ceil(F.sqrt(m / BLOCK)).cast("int").alias("blocks")


def _open_pairs(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes that share a bucket, not a component, and that sizes and odd sketches do not rule out."""
    # A class has a row a band at most, so a node's key is not hot. A hot bucket's rows meet in one partition here (see the README).
    rows = members.join(labels.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    counts = rows.groupBy("band", "label").agg(F.count("*").alias("m"))
    mixed = counts.groupBy("band").agg(F.sum("m").alias("m"), F.count("*").alias("labels"), F.max(F.struct("m", "label")).alias("most"))
    mixed = mixed.filter("labels > 1 and m > 2").select("band", F.col("most.label").alias("most"), *_grid(F.col("m"), F.col("m") - F.col("most.m")))
    rows = durable(rows.join(mixed, "band").withColumn("odd", F.col("label") != F.col("most")).drop("most"))
    # A node has a set for each text of its doc_id; a band row goes with the one it came from.
    wide = sets.select("node", "lo", "n", "parity", "keys").join(rows.select("node", "lo").distinct(), ["node", "lo"], "left_semi")
    rows = rows.join(wide.dropDuplicates(["node", "lo"]), ["node", "lo"])
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.filter("odd").withColumn("part", own("parts")).withColumn("block", each("blocks")).drop("parts", "blocks", "odd")
    right = rows.withColumn("block", own("blocks")).withColumn("part", each("parts")).drop("parts", "blocks")
    left = left.select(*(F.col(c).alias(f"l_{c}") for c in left.columns))
    right = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    here = F.shiftright("l_band", 32).cast("int")
    first_common = F.element_at(F.filter(F.zip_with("l_keys", "r_keys", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull()), 1) == here
    # Members of different components are not both of the bucket's largest one; two odd ones meet once with the smaller node on the left.
    on = (
        (F.col("l_band") == F.col("r_band"))
        & (F.col("l_part") == F.col("r_part"))
        & (F.col("l_block") == F.col("r_block"))
        & (~F.col("r_odd") | (F.col("l_node") < F.col("r_node")))
        & (F.col("l_label") != F.col("r_label"))
        & _size_ok(F.col("l_n"), F.col("r_n"), percent)
        & _parity_ok("l_parity", "r_parity", F.col("l_n") + F.col("r_n"), percent)
        & first_common
    )
    return left.join(right, on).select(F.least("l_node", "r_node").alias("a"), F.greatest("l_node", "r_node").alias("b"))


def _node() -> Column:
    """A class's name: its smallest doc_id, or without any a number from ``NAMELESS`` on."""
    return F.coalesce(F.min("doc_id"), F.lit(NAMELESS).bitwiseOR(F.first("lo").bitwiseAND(F.lit((1 << 61) - 1))))


def _repeats(signatures: DataFrame) -> DataFrame | None:
    """Edges ``a, b`` between the classes of each doc_id that has several; None where, as is usual, none has."""
    sets = signatures.filter("n_shingles > 0 and doc_id is not null")
    several = sets.groupBy("doc_id").agg(F.min("lo").alias("least"), F.max("lo").alias("most")).filter("least <> most").select("doc_id")
    several, n = compact(several)
    if not n:
        return None
    named = signatures.filter("n_shingles > 0").groupBy("lo", "hi").agg(_node().alias("node"))
    rows = sets.join(several, "doc_id", "left_semi").select("doc_id", "lo", "hi").distinct().join(named, ["lo", "hi"])
    # A class's name is a doc_id of it, so a doc_id and the names of its classes are one star.
    return rows.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).filter("a <> b").distinct()


def links(docs: DataFrame, signatures: DataFrame, k: int, percent: int) -> DataFrame:
    """``node, component`` of the classes that are linked with another class."""
    node = _node()
    classes = signatures.filter("n_shingles > 0").groupBy("lo", "hi").agg(node.alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    rows = classes.select("node", "lo", F.explode("bands").alias("band"))
    hubs = rows.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("__last")).filter("hub <> __last").drop("__last")
    members = durable(rows.join(hubs, "band"))
    known, n_known = compact(members.select("node").distinct())
    sets = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = durable(
        arrow_map(
            sets, _candidate_sets(k, bitmap.build(known, F.col("node"), n_known)), "node long, lo long, n long, parity array<long>, keys array<int>, members binary"
        )
    )
    stars = members.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    edges = confirmed(compact(stars)[0], sets, percent)
    if (repeats := _repeats(signatures)) is not None:
        edges = edges.unionByName(repeats)
    edges, _ = compact(edges)
    labels, _ = compact(components(edges))
    rest, n_rest = compact(_open_pairs(members.drop("hub"), labels, sets, percent))
    if not n_rest:
        return labels
    more = confirmed(rest, sets, percent)
    return components(edges.unionByName(more))


def row_key() -> Column:
    """A long by which a row of documents is found again: rows equal in doc_id and text share it."""
    return F.xxhash64("doc_id", "text")


def grouped(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, key (row_key), n_shingles, group`` for every row of ``docs``.

    ``group`` is the smallest doc_id reachable over links, or a number from ``NAMELESS`` on where there is none.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("key"))
    signatures = durable(arrow_map(narrow, _signatures(k), "doc_id long, key long, n_shingles long, lo long, hi long, bands array<long>"))
    linked, _ = compact(links(docs, signatures, k, percent))
    classes = signatures.filter("n_shingles > 0").groupBy("lo", "hi").agg(_node().alias("node"), F.count("*").alias("size"))
    # Only classes of several documents, or linked with others, have anything to look up.
    classes = classes.join(linked, "node", "left").filter("size > 1 or component is not null")
    classes = classes.select("lo", "hi", F.coalesce("component", "node").alias("component"))
    out = lookup(signatures.drop("bands"), classes, ["lo", "hi"], "doc_id")
    alone = F.col("key").bitwiseAND(F.lit(NAMELESS - 1)).bitwiseOR(F.lit(NAMELESS))  # no id, no words
    group = F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), F.col("doc_id"), alone)
    return out.select("doc_id", "key", "n_shingles", group.alias("group"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, key (row_key), n_shingles, component_id, kept`` for every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links; ``kept`` marks that document. The
    sketches make a link of similarity ``percent`` / 100 a candidate but for a chance of
    (1 - s**6)**48.
    """
    component = F.when(F.col("group") < NAMELESS, F.col("group"))
    rows = grouped(docs, k, percent)
    return rows.select("doc_id", "key", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
