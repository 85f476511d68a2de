import re
from collections import Counter

import numpy as np
import pytest
from laminae.llm import components, near_dedup, queries, sketch
from laminae.llm.kernels import random_words


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def by_hand(docs, k, percent=80):
    sets = [shingles(d["text"], k) for d in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    inverse = {}
    for i, s in enumerate(sets):
        for x in s:
            inverse.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in inverse[x] if j < i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    first = {}
    for i, d in enumerate(docs):
        if d["doc_id"] is not None and sets[i]:
            a, b = find(i), find(first.setdefault(d["doc_id"], i))
            root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(docs):
        if d["doc_id"] is not None:
            least[find(i)] = min(least.get(find(i), d["doc_id"]), d["doc_id"])
    return Counter((d["doc_id"], len(sets[i]), least.get(find(i)), least.get(find(i)) == d["doc_id"]) for i, d in enumerate(docs))


def got(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("n", [1, 5, 300, 20_000])
def test_every_coordinate_fills_and_agreement_is_similarity(n):
    members = random_words(2 * n, 5)
    a, b = sketch.fast_sketch(members[: n + n // 2]), sketch.fast_sketch(members[n // 2 :])
    assert not (a == sketch._EMPTY).any()
    union, both = 2 * n, n + n // 2 + 2 * n - n // 2 - 2 * n
    assert abs((a == b).mean() - both / union) < 0.13
    assert (sketch.fast_sketch(members[::-1].copy()) == sketch.fast_sketch(members)).all()


def test_parity_sketch_never_overstates_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(50):
        members = random_words(600, int(rng.integers(1000)))
        a, b = np.sort(members[: rng.integers(300, 600)]), np.sort(members[rng.integers(0, 300) :])
        bits = np.unpackbits((sketch.parity_sketch(a) ^ sketch.parity_sketch(b)).view(np.uint8)).sum()
        assert bits <= len(a) + len(b) - 2 * sketch.common(a, b)
        assert sketch.common(a, b) == len(set(a.tolist()) & set(b.tolist()))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (300, 299), (299, 300)]
    found = {r["node"]: r["component"] for r in rows(components.components(spark.createDataFrame(edges, "a long, b long")))}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {299: 299, 300: 299}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_op8(spark, sf_dir):
    docs = rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert got(queries.op8_fast_sketch_near_dedup(spark, sf_dir)) == by_hand(docs, 2)


def test_larger_table(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(near_dedup.near_duplicates(documents)) == by_hand(rows(documents), 5)


def test_group_without_a_common_centre(spark):
    """Chains whose ends are unlike, and a cloud near the threshold, in which stars alone lose links."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[i:] + [f"c{j}" for j in range(i)]) for i in range(0, 40, 3)]
    for i in range(120):
        words = list(base)
        for j in rng.choice(60, size=rng.integers(2, 8), replace=False):
            words[j] = f"x{rng.integers(6)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert got(near_dedup.near_duplicates(docs, k=1)) == by_hand(rows(docs), 1)


def bucket(spark, n_large, n_odd, linked):
    """One bucket: ``n_large`` nodes of component 0, ``n_odd`` alone; ``linked`` pairs have equal odd sketches."""
    n = n_large + n_odd
    parity = random_words(32 * n, 7).view(np.int64).reshape(n, 32)
    for a, b in linked:
        parity[b] = parity[a]
    sets = [(i, 10_000 + i, 100, parity[i].tolist(), [9] + [1000 + 48 * i + j for j in range(47)], b"") for i in range(n)]
    members = spark.createDataFrame([(i, 10_000 + i, 9 << 32) for i in range(n)], "node long, lo long, band long")
    labels = spark.createDataFrame([(i, 0) for i in range(n_large)], "node long, component long")
    return members, labels, spark.createDataFrame(sets, "node long, lo long, n long, parity array<long>, keys array<int>, members binary")


def rows_made(df, node):
    """Output rows of all plan nodes of this name, after ``df`` ran."""
    plans, made = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        plan = plans.pop()
        name = plan.nodeName()
        if name == node:
            made += plan.metrics().apply("numOutputRows").value()
        if name == "AdaptiveSparkPlan":
            plans.append(plan.executedPlan())
        elif name.endswith("QueryStage"):
            plans.append(plan.plan())
        else:
            plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return made


def test_a_large_component_is_not_copied_for_each_block(spark):
    pairs = near_dedup._open_pairs(*bucket(spark, 5940, 60, [(3, 5950), (5941, 5999), (7, 8)]), 80)
    assert sorted(map(tuple, pairs.collect())) == [(3, 5950), (5941, 5999)]
    # 6,000 members, and 60 odd ones in four blocks; each member in each of 12 blocks would be 72,000.
    assert 6000 <= rows_made(pairs, "Generate") <= 6000 + 4 * 60


@pytest.mark.parametrize(("n_large", "n_odd"), [(0, 300), (30, 270), (150, 150), (290, 10)])
def test_pairs_of_a_cut_bucket_meet_once(spark, monkeypatch, n_large, n_odd):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    n = n_large + n_odd
    linked = [(0, n - 1)] + [(i, i + 1) for i in range(1, n - 2, 2)] + [(1, n - 3)]
    members, labels, sets = bucket(spark, n_large, n_odd, linked)
    sketches = {}
    for r in sets.collect():
        sketches.setdefault(tuple(r["parity"]), []).append(r["node"])
    large = range(n_large)
    want = sorted((a, b) for same in sketches.values() for a in same for b in same if a < b and not (a in large and b in large))
    assert sorted(map(tuple, near_dedup._open_pairs(members, labels, sets, 80).collect())) == want


def test_links_by_another_text_of_a_doc_id(spark):
    """Pairs that share only buckets of lesser, unlike members; both ends have a second text in a row of its own."""
    rng = np.random.default_rng(5)
    docs, other = [], []
    for g in range(8):
        shared = [f"g{g}b{i}" for i in range(80)]
        docs += [{"doc_id": 100 * g + i, "text": " ".join(rng.permutation(shared)[:70])} for i in range(60)]
        for d in (100 * g + 90, 100 * g + 91):
            docs.append({"doc_id": d, "text": " ".join(shared + [f"d{d}x{j}" for j in range(9)])})
            other.append({"doc_id": d, "text": " ".join(f"d{d}o{j}" for j in range(400))})
    want = by_hand(docs, 1)
    component = {d: (c, kept) for d, _, c, kept in want}
    assert all(component[d["doc_id"]][0] % 100 == 90 for d in other)
    want += Counter((d["doc_id"], 400, *component[d["doc_id"]]) for d in other)
    for both in (docs + other, other + docs):
        table = spark.createDataFrame([(d["doc_id"], d["text"]) for d in both], "doc_id long, text string")
        assert got(near_dedup.near_duplicates(table, k=1)) == want


def test_odd_rows(spark, odd_docs, no_docs):
    for k in (1, 2, 5):
        assert got(near_dedup.near_duplicates(odd_docs, k=k)) == by_hand(rows(odd_docs), k)
    assert near_dedup.near_duplicates(no_docs).collect() == []


def test_a_doc_id_with_several_texts_is_one_document(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta eta theta " * 2, "uno dos tres quatro cinco seis siete ocho " * 2, "un deux trois quatre cinq six sept huit " * 2)
    data = [(1, a), (5, a), (2, b), (5, b), (9, c), (9, b + "nueve"), (4, c), (7, None), (7, a + "iota"), (8, "else where"), (None, c)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    out = near_dedup.near_duplicates(docs, k=2)
    assert got(out) == by_hand(rows(docs), 2)
    assert {r["component_id"] for r in rows(out.filter("doc_id in (1, 2, 4, 5, 9)"))} == {1}
