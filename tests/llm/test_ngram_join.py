import numpy as np
import pytest
from pyspark.sql import functions as F

from tideflow.llm import ngram_join as nj


def brute(texts, settings=nj.Settings()):
    hashes = nj.WordHashes()
    sets = [set(nj.shingles(t or "", 5, hashes).tolist()) or {"text", t or ""} for t in texts]
    n = len(sets)
    links = [{j for j in range(n) if j != i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} for i in range(n)]
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([root[i], *(root[j] for j in links[i])])
            if low < root[i]:
                root[i], changed = low, True
    return root, [len(x) for x in links]


def near_copies(seed, n):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(6):
        base = list(rng.choice(words, rng.integers(60, 160)))
        for _ in range(n):
            copy = list(base)
            for _ in range(rng.integers(0, 7)):
                copy[rng.integers(len(copy))] = str(rng.choice(words))
            texts.append(" ".join(copy))
    texts += [" ".join(rng.choice(words, 50)) for _ in range(30)] + [texts[0]] * 3 + [None, "", "a b", "A b!", "?", "?"]
    return texts


@pytest.mark.parametrize("seed,block", [(0, 256), (1, 4), (2, 16)])
def test_links_and_groups_equal_brute_force(spark, seed, block):
    texts = near_copies(seed, 14)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.class_id, r.n_links) for r in nj.report(df, nj.Settings(block=block)).collect()}
    root, links = brute(texts)
    assert got == {i: (root[i], links[i]) for i in range(len(texts))}
    assert max(links) > 5


def test_a_large_cluster_is_counted_by_distances(spark):
    """120 near copies of one text, most of them close to the hub and some far, in blocks of 4: links equal brute force, and few blocks are verified."""
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(300)]
    texts = []
    for k in range(120):
        copy = list(base)
        for _ in range((0, 1, 2, 5)[k % 4]):
            copy[rng.integers(len(copy))] = f"x{rng.integers(10**6)}"
        texts.append(" ".join(copy))
    texts += texts[:9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    settings = nj.Settings(block=4)
    got = {r.doc_id: (r.class_id, r.n_links) for r in nj.report(df, settings).collect()}
    root, links = brute(texts)
    assert got == {i: (root[i], links[i]) for i in range(len(texts))}
    members = spark.createDataFrame([(f"c{k}".encode(), b"c0", 1, nj.shingles(t, 5, nj.WordHashes()).tobytes()) for k, t in enumerate(texts[:120])], "cls binary, hub binary, copies long, grams binary").withColumn("size", F.length("grams"))
    places = nj.placed(members, settings).toPandas()
    assert len(places) == 120 and (places.groupby("block").size() < 30).all()
    assert (places.ring * 2 * (settings.limit // 10) <= settings.limit).mean() > 0.6


def test_repeated_rows_are_verified_once(spark):
    base = [f"w{k}" for k in range(60)]
    near = " ".join(base[:-1] + ["other"])
    rows = [(None, " ".join(base))] * 400 + [(3, near), (4, near + " end")]
    got = nj.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == 402 and {r.class_id for r in got} == {3} and {r.n_links for r in got} == {401}


def test_clashing_names_keep_their_values(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "h", "i", "o"), (2, "a b c d e f", "h2", "i2", "o2"), (3, None, "h3", "i3", "o3")], "doc_id long, text string, __hash string, __id string, own string")
    assert sorted(map(tuple, nj.one_of_each(docs).collect())) == [(1, "a b c d e f", "h", "i", "o"), (3, None, "h3", "i3", "o3")]


def test_one_of_each(spark):
    texts = near_copies(3, 5)
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(0, texts[0], "again", 0), (None, texts[1], "null", 1), (None, "quite alone in this world today", "null", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, cls string, band long")
    kept = nj.one_of_each(df)
    assert kept.columns == df.columns
    root, _ = brute(texts)
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(root)) and ids.count(None) == 1


def test_bands_reach_the_recall():
    for recall in (0.9, 0.99, 0.9999):
        s = nj.Settings(recall=recall)
        assert 1 - (1 - 0.8**s.rows) ** s.bands >= recall > 1 - (1 - 0.8**s.rows) ** (s.bands - 1)


def test_measured_recall_of_bands_alone():
    """Pairs at the threshold collide in a band about as often as the choice of bands promises."""
    rng = np.random.default_rng(4)
    settings = nj.Settings(recall=0.99)
    signer = nj.Signer(settings)
    hit = 0
    for _ in range(300):
        common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (80, 10, 10))
        keys = [signer.minima(np.unique(np.concatenate([common, x]))).reshape(settings.bands, settings.rows) for x in (a, b)]
        hit += bool((keys[0] == keys[1]).all(1).any())
    assert hit >= 291


def test_components_of_long_chains(spark):
    names = [f"{k:04d}".encode() for k in np.random.default_rng(0).permutation(300)]
    edges = [(bytes(a), bytes(b)) for a, b in zip(names[:200], names[1:200])] + [(bytes(names[k]), bytes(names[200])) for k in range(201, 300)]
    df = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in edges], "cls binary, root binary")
    got = {bytes(r.cls): bytes(r.root) for r in nj.components(df).collect()}
    low, high = min(names[:200]), min(names[200:])
    assert got == {n: low for n in names[:200] if n != low} | {n: high for n in names[200:] if n != high}


def test_wide_sets_in_slices():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 20_000, n).astype(np.uint64)) for n in (15_000, 15_000, 3, 0)]
    sets.append(np.unique(np.concatenate([sets[0][:14_000 if len(sets[0]) > 14_000 else None], sets[0][-5:]])))
    want = [[5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)) for b in sets] for a in sets]
    got = nj.linked(sets, None, 0.8)
    assert all(got[i, j] == want[i][j] for i in range(5) for j in range(5) if i != j)  # a set is not compared with itself
    assert nj.linked(sets[:2], sets[2:], 0.8).tolist() == [r[2:] for r in want[:2]]
