from collections import Counter

import corpus_pipeline
from laminae.llm import quality, stages
from pyspark.sql import functions as F
from test_near_dedup import by_hand
from test_simple_operators import check_shards, targets_by_hand, words


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_stages_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    benchmark = rows(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    windows = set()
    for b in benchmark:
        w = words(b["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)} if len(w) >= 10 else {tuple(w)} if w else set()
    before = rows(docs)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).persist()
        after = rows(out)
        ids = Counter(r["doc_id"] for r in after)
        if name == "quality classifier":
            measured = quality.measured(docs)
            good = {r["doc_id"] for r in rows(quality.scored(measured, quality.learn(measured, spark.read.parquet(f"{sf_dir}/labels.parquet")))) if r["predicted"]}
            assert set(ids) == good and 0 < len(good) < len(before)
        elif name == "MinHash near-dedup":
            assert set(ids) == {i for i, _, component, _ in by_hand(before, 5) if i == component}
        elif name == "benchmark decontamination":
            has = lambda w: any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
            assert set(ids) == {d["doc_id"] for d in before if not has(words(d["text"]))} and len(ids) < len(before)
        elif name == "mixing sources to target weights":
            size = {d["doc_id"]: len(d["text"].split()) for d in before}
            sizes, taken = Counter(), Counter()
            for d in before:
                sizes[d["source"]] += size[d["doc_id"]]
            for r in after:
                taken[r["source"]] += size[r["doc_id"]]
            assert max(ids.values()) <= 2
            longest = max(size.values())
            assert all(abs(taken[s] - t) <= 2 * longest for s, t in targets_by_hand(sizes).items())
        else:
            check_shards([r | {"size": len(r["text"].encode()) + 1, "text_crc32": __import__("zlib").crc32(r["text"].encode())} for r in after], before)
        if name != "sharding":
            assert out.columns == columns
            by_id = {d["doc_id"]: d for d in before}
            assert all(r == by_id[r["doc_id"]] for r in after)
        docs, before = out, after
    assert Counter(map(str, before)) == Counter(map(str, rows(corpus_pipeline.run(spark, sf_dir))))


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    benchmark = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for docs in (odd_docs, no_docs):
        assert stages.keep_quality(docs, labels).columns == docs.columns
        near, clean, mix = stages.keep_one_of_near_copies(docs), stages.keep_uncontaminated(docs, benchmark), stages.mixed(docs)
        assert near.columns == clean.columns == mix.columns == docs.columns
        n = docs.count()
        assert clean.count() == max(0, n - 1) and mix.exceptAll(docs.union(docs)).isEmpty()
        assert sorted(str(r[0]) for r in near.select("doc_id").collect()) == (["1", "3", "4", "5", "6", "8", "None"] if n else [])
    assert stages.without(odd_docs, odd_docs.select(F.xxhash64("doc_id", "text").alias("key"))).isEmpty()


def test_near_dedup_leaves_one_row_of_each_group(spark, odd_docs):
    """A batch loaded twice, many copies without an id, and texts under one doc_id."""
    near = stages.keep_one_of_near_copies
    assert Counter(r["doc_id"] for r in rows(near(odd_docs.union(odd_docs)))) == Counter(r["doc_id"] for r in rows(near(odd_docs)))
    text = "one two three four five six seven"
    data = [(None, text, "a")] * 5 + [(None, f"other {text} {text}", "a")] * 2 + [(None, None, "a"), (None, None, "b"), (None, " ", "a"), (4, "x y", "a"), (4, "x z", "a"), (9, "x y", "b")]
    data += [(8, "same", "a"), (8, "same", "b"), (8, "same", "b"), (7, "lone", "c")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(5)
    out = near(docs)
    assert out.columns == docs.columns and out.exceptAll(docs).isEmpty()
    got = Counter((r["doc_id"], r["text"] if r["doc_id"] != 4 else "x") for r in rows(out))
    assert got == Counter([(None, text), (None, f"other {text} {text}"), (None, None), (None, " "), (4, "x"), (8, "same"), (7, "lone")])
