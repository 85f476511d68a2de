import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from laminae.llm import chunk_dedup, hilbert, kernels, mixing, queries, stages, winnowing
from pyspark.sql import functions as F


def rows(df):
    return [r.asDict() for r in df.collect()]


def documents(spark, sf_dir, name="documents"):
    return rows(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


# -- kernels


@pytest.mark.parametrize("table, pattern", [(kernels.SPACED, r"[^\x20\x09-\x0D]+"), (kernels.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words(table, pattern):
    import pyarrow as pa

    texts = ["ab cd", "", None, "ef\x0bgh é東 1", "  ", "x", "y-z"]
    got = []
    for first, last, data, starts in kernels.text_slices(pa.array(["skip", *texts]).slice(1), limit=8):
        begin, end, before = kernels.word_spans(data, starts, table)
        words = [data[b:e].tobytes().decode() for b, e in zip(begin, end)]
        got += [words[a:b] for a, b in zip(before[:-1], before[1:])]
        hashes = kernels.hash_spans(data, begin, end)
        assert len(set(hashes.tolist())) == len(set(words))
    assert got == [re.findall(pattern, t or "") for t in texts]


def test_word_hash_does_not_depend_on_place():
    import pyarrow as pa

    def one(text, i):
        (_, _, data, starts), = kernels.text_slices(pa.array([text]))
        begin, end, _ = kernels.word_spans(data, starts, kernels.SPACED)
        return kernels.hash_spans(data, begin, end)[i]

    assert one("alpha beta", 1) == one("beta", 0) != one("betb", 0)


# -- op1


@pytest.mark.parametrize("n, bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_steps_to_neighbours(spark, n, bits):
    points = list(itertools.product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(points, ", ".join(f"x{i} long" for i in range(n)))
    order = df.withColumn("h", hilbert.curve_index([F.col(f"x{i}") for i in range(n)], bits)).orderBy("h").collect()
    assert [r["h"] for r in order] == list(range(len(points)))
    assert all(sum(abs(x - y) for x, y in zip(a[:n], b[:n])) == 1 for a, b in zip(order, order[1:]))


def test_cut_points_of_many_long_strings(spark):
    """More values than places, which differ past their first bytes only."""
    values = [f"https://example.org/dumps/{i:05d}" for i in range(3000)]
    df = spark.createDataFrame([(v,) for v in values * 2] + [(None,)], "v string").repartition(7)
    cuts = hilbert.string_cuts(df, "v", 1024)
    assert cuts == values[:: -(-3000 // 1023)] and len(cuts) < 1024
    assert hilbert.string_cuts(df.filter("v < 'https://example.org/dumps/00050'"), "v", 1024) == values[:50]
    got = df.select("v", hilbert.reached(F.col("v"), cuts, "string").alias("n")).distinct().collect()
    assert {r["v"]: r["n"] for r in got} == {None: 0} | {v: sum(c <= v for c in cuts) for v in values}


def curve_by_hand(axes, bits):
    steps, state, out = hilbert.curve_steps(len(axes)), 0, 0
    for level in range(bits - 1, -1, -1):
        cell = 0
        for x in axes:
            cell = cell << 1 | (x >> level & 1)
        entry = steps[state << len(axes) | cell]
        out, state = out << len(axes) | entry & ((1 << len(axes)) - 1), entry >> len(axes)
    return out


def test_op1_order_by_hand(spark, sf_dir):
    """The curve index of every row, from cut points taken by sorting."""
    docs = documents(spark, sf_dir)
    size = lambda d: len((d["text"] or "").encode()) + 1
    sizes = sorted(map(size, docs))
    cuts = {
        "size": sorted({sizes[max(math.ceil(i / 1024 * len(sizes)) - 1, 0)] for i in range(1, 1024)}),
        **{c: sorted({d[c] for d in docs if d[c] is not None}) for c in ("lang", "source")},
    }
    place = lambda c, v: math.floor((0 if v is None else sum(x <= v for x in cuts[c])) * (1024 / (len(cuts[c]) + 1)))
    want = {d["doc_id"]: curve_by_hand([place("lang", d["lang"]), place("source", d["source"]), place("size", size(d))], 10) for d in docs}
    got = rows(queries.op1_hilbert_shards(spark, sf_dir))
    assert {r["doc_id"]: r["hilbert"] for r in got} == want
    assert len(set(want.values())) > len(docs) / 2


def check_shards(got, docs, n=8):
    import zlib

    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d["doc_id"], size(d["text"]), zlib.crc32((d["text"] or "").encode())) for d in docs)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    counts = [len(by[s]) for s in range(n)]
    assert set(by) <= set(range(n)) and max(counts) - min(counts) <= 1
    last = -1
    for s in range(n):
        part = sorted(by[s], key=lambda r: r["slot"])
        assert [r["slot"] for r in part] == list(range(len(part)))
        for r in part:
            assert r["hilbert"] >= last
            last = r["hilbert"]


def test_op1(spark, sf_dir):
    check_shards(rows(queries.op1_hilbert_shards(spark, sf_dir)), documents(spark, sf_dir))


def test_shards_of_odd_rows(odd_docs, no_docs):
    out = hilbert.document_shards(odd_docs, 3)
    assert out.columns == [c for c in odd_docs.columns if c != "shard"] + ["hilbert", "shard", "slot"]
    assert sorted(out.groupBy("shard").count().select("count").toPandas()["count"]) == [3, 4, 4]
    assert out.select("doc_id", "text").exceptAll(odd_docs.select("doc_id", "text")).isEmpty()
    assert hilbert.document_shards(no_docs, 3).collect() == []


# -- op2


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def check_dedup(got, docs):
    groups = defaultdict(list)
    for d in docs:
        groups[normal(d["text"])].append(d["doc_id"])
    want = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    assert Counter(want) == Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got)


def test_op2(spark, sf_dir):
    check_dedup(rows(queries.op2_chunk_recipe_dedup(spark, sf_dir)), documents(spark, sf_dir))


def test_dedup_of_odd_rows(odd_docs, no_docs):
    check_dedup(rows(chunk_dedup.exact_dedup(odd_docs)), rows(odd_docs))
    assert chunk_dedup.exact_dedup(no_docs).collect() == []


def test_equal_passages_give_equal_chunks():
    rng = np.random.default_rng(1)
    shared = rng.integers(97, 123, 60_000, dtype=np.uint8)
    chunks = []
    for head in (b"", b"a different beginning " * 40):
        data = np.concatenate([np.frombuffer(head, np.uint8), shared])
        marks = np.flatnonzero((chunk_dedup.rolling_hash(data) & chunk_dedup.MASK) == 0) + 1
        cuts = [0, *chunk_dedup.cut_points(marks, 0, len(data))]
        assert cuts[-1] == len(data) and all(b - a <= chunk_dedup.LARGEST for a, b in zip(cuts, cuts[1:]))
        chunks.append({data[a:b].tobytes() for a, b in zip(cuts, cuts[1:])})
    assert len(chunks[0] & chunks[1]) > 0.8 * len(chunks[0])


def test_clashing_identifiers_are_told_apart(spark):
    struct = "array<struct<id: long, digest: long, n: int>>"
    data = [(1, 2, "s1", [(5, 1, 2)]), (2, 2, "s2", [(5, 9, 2)]), (3, 2, "s1", [(5, 1, 2)]), (4, 4, "s4", [(6, 1, 2), (5, 9, 2)]), (5, 0, "s5", [])]
    recipes = spark.createDataFrame(data, f"doc_id long, n_bytes long, text_sha256 string, chunks {struct}")
    got = {r["doc_id"]: [tuple(i) for i in r["ids"]] for r in rows(chunk_dedup.verified_lists(recipes))}
    assert got == {1: [(5, 0)], 2: [(5, 1)], 3: [(5, 0)], 4: [(6, 0), (5, 1)], 5: []}


# -- op3


def targets_by_hand(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if 2 * sizes[s] <= weight[s] * unit}
        if not full:
            return out | {s: weight[s] * unit for s in free}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        free -= full
    return out


def check_mix(got, docs, slack):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d["doc_id"], count(d["text"])) for d in docs)
    sizes = Counter()
    for d in docs:
        sizes[d["source"]] += count(d["text"])
    want, source = targets_by_hand(sizes), {d["doc_id"]: d["source"] for d in docs}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= slack * max((count(d["text"]) for d in docs if d["source"] == s), default=0)


def test_op3(spark, sf_dir):
    first = rows(queries.op3_systematic_mix(spark, sf_dir))
    check_mix(first, documents(spark, sf_dir), 2)
    assert Counter(map(str, first)) == Counter(map(str, rows(queries.op3_systematic_mix(spark, sf_dir))))


def test_mix_of_odd_rows(odd_docs, no_docs):
    plan = mixing.mix_plan(mixing.with_size(odd_docs))
    check_mix(rows(plan.withColumn("taken", F.col("copies") * F.col("size"))), rows(odd_docs), 2)
    assert mixing.emit_copies(plan).count() == plan.agg(F.sum("copies")).first()[0]
    assert mixing.mix_plan(mixing.with_size(no_docs)).collect() == []


# -- op10


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def check_contamination(got, docs, items):
    windows = defaultdict(set)
    for item in items:
        w = words(item["text"])
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(str(item["item_id"]))
    want = []
    for d in docs:
        w, hit, found = words(d["text"]), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if k := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= k
        want.append((d["doc_id"], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert Counter(want) == Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got)


def test_op10(spark, sf_dir):
    got = rows(queries.op10_winnowing(spark, sf_dir))
    check_contamination(got, documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    assert any(r["contaminated"] for r in got)


def test_contamination_of_odd_rows(spark, odd_docs, no_docs):
    text = "one two three four five six seven eight nine ten eleven"
    items = [(1, text), (1, text), (2, "東京 STRASSE"), (3, "naïve 東京"), (4, ""), (5, None), (6, "-- ;"), (7, "three"), (None, text)]
    items = spark.createDataFrame(items, "item_id long, text string")
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    run = lambda d, b: rows(winnowing.contaminated(d, b).select("*", digest, (F.col("n_hit") > 0).alias("contaminated")))
    named = items.filter("item_id is not null")
    check_contamination(run(odd_docs, items), rows(odd_docs), rows(named))
    check_contamination(run(odd_docs, items.filter("false")), rows(odd_docs), [])
    assert run(no_docs, items) == []


def test_items_without_an_id_hit(spark):
    one, two = "one two three four five six seven eight nine ten", "a b c d e f g h i j"
    items = spark.createDataFrame([(None, one), (None, two), (7, two)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {one} y"), (2, f"{one} {two}"), (3, "one two three")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items"]) for r in rows(winnowing.contaminated(docs, items))}
    assert got == {1: (10, 0, []), 2: (20, 1, ["7"]), 3: (0, 0, [])}
    assert [r["doc_id"] for r in rows(stages.keep_uncontaminated(docs, items))] == [3]
