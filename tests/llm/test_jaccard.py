import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import jaccard_join as jj


def sets_of(texts):
    out = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def brute(ids, texts):
    sets, up = sets_of(texts), list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    best = {}
    for i in range(len(ids)):
        best[root(i)] = min(best.get(root(i), ids[i]), ids[i])
    return [(ids[i], len(sets[i]), best[root(i)]) for i in range(len(ids))]


def corpus(seed, groups, size, words=120):
    r = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [None, "", " \n", "a b", "A  b", "x y z", "a b c d e", "a b c d e"]
    for g in range(groups):
        base = [f"g{g}w{r.randrange(400)}" for _ in range(words)]
        for _ in range(r.randrange(1, size)):
            t = list(base)
            for _ in range(r.randrange(0, 9)):
                t[r.randrange(len(t))] = f"e{r.randrange(10**6)}"
            texts.append(" ".join(t) + (" " + passage if r.random() < 0.5 else ""))
    r.shuffle(texts)
    return texts


def near(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


@pytest.mark.parametrize(("seed", "groups", "size", "region", "block"), [(1, 25, 12, 4096, 1024), (2, 2, 150, 4096, 1024), (3, 3, 40, 5, 3)])
def test_components_and_links_match_brute_force(spark, seed, groups, size, region, block):
    texts = corpus(seed, groups, size)
    ids = random.Random(seed).sample(range(10_000), len(texts))
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in zip(ids, texts)], "doc_id long, text string, n long, key string").repartition(3)
    rows = jj.link_groups(df, region=region, block=block).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == sorted(brute(ids, texts))
    sets = sets_of(texts)
    want = {ids[i]: sum(near(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)}
    assert {r.doc_id: r.n_links for r in rows} == want and max(want.values()) >= 3


def test_pairs_match_brute_force(spark):
    texts = corpus(9, 3, 30)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    member, pairs = jj.link_pairs(df, region=7, block=4)
    points = [s for s in {frozenset(s) for s in sets_of(texts)} if s]
    assert pairs.count() == pairs.distinct().count() == sum(near(a, b) for i, a in enumerate(points) for b in points[:i])
    assert member.where("point is not null").select("point").distinct().count() == len(points) and member.count() == len(texts)


def test_keep_one_from_memory_and_from_files(spark, tmp_path):
    texts = corpus(1, 25, 12)
    ids = random.Random(1).sample(range(10_000), len(texts))
    df = spark.createDataFrame([(i, t, 1, "k", 5) for i, t in zip(ids, texts)], "doc_id long, text string, n long, key string, row_tag long").repartition(3)
    want = sorted({c if n else i for i, n, c in brute(ids, texts)})
    assert sorted(r.doc_id for r in jj.keep_one(df).collect()) == want
    df.write.parquet(str(tmp_path / "d"))
    kept = jj.keep_one(spark.read.parquet(str(tmp_path / "d")))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == want


def test_repeated_rows_null_ids_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "x y z"), (None, "x  y z"), (4, None), (4, None), (7, long), (8, long + " tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.n_links) for r in jj.link_groups(df).collect()))
    assert got == sorted([(1, 2, 1, 2), (1, 2, 1, 2), (-1, 2, 1, 2), (-1, 1, -1, 1), (-1, 1, -1, 1), (4, 0, 4, 0), (4, 0, 4, 0), (7, 199_996, 7, 1), (8, 199_997, 7, 1)])
    kept = [(r.doc_id, (r.text or "")[:5]) for r in jj.keep_one(df).collect()]
    assert sorted(kept, key=str) == sorted([(1, "a b c"), (None, kept[[k[1][:1] for k in kept].index("x")][1]), (4, ""), (4, ""), (7, "w0 w1")], key=str)


def planted(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 1 << 60, rng.integers(40, 200)).astype(np.uint64)
        for _ in range(12):
            keep = base[rng.random(len(base)) > rng.choice([0.02, 0.1, 0.3])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 60, rng.integers(0, 8)).astype(np.uint64)])))
    return sets


@pytest.mark.parametrize("leaf", [16, 32, 10_000])
def test_voronoi_regions_lose_nothing(leaf):
    sets = planted(5)
    n = np.array([len(s) for s in sets])
    got = jj.voronoi_links(n, jj.set_bits(sets), leaf=leaf)
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            assert got[i, j] == got[j, i] == (100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both))


def test_sketches_exclude_no_link():
    sets = planted(6)
    label = jj.near_classes(np.array([len(s) for s in sets]), [jj.sketch(s) for s in sets], np.zeros(len(sets), int), False)
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                assert label[i] == label[j]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jj.link_groups(df).count() == 0 and jj.keep_one(df).count() == 0


def test_all_of_a_table_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", F.col("text")).collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jj.link_groups(docs).collect())
    assert got == sorted(brute([i for i, _ in rows], [t for _, t in rows]))
