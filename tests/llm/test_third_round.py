"""Alignment, MinHash near-dedup and centroid clustering against plain Python, on given tables and on awkward rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lemniscate.llm import align, centroids, minhash
from lemniscate.llm.components import components
from tests.llm import brute
from tests.llm.test_corpus import AWKWARD, SCHEMA, SF, key, rows, texts

SPACES = "a b c　 d▁e \x1cf\tg\n\n h  i\r\nj  k"
ODD = ["<|endoftext|> <s> </s> <unk> <0x0A>", SPACES, SPACES.replace("▁", ""), " ", "\n", "  lead", "trail  ", "x\n y \n\nz", "naïve déjà 😀👩‍👩‍👧 漢字かな", "=" * 700 + "-" * 301, "a\0b", "ﬁ ́", "1234567890 3.14", "don't we'll"]


@pytest.fixture(scope="module")
def awkward(spark):
    given = [*AWKWARD, *[(100 + i, t, "en", "o") for i, t in enumerate(ODD)]]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "w", 1, "t", 2) for r in given], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("name", ["docs", "awkward", "empty"])
def test_alignment(name, request):
    df = request.getfixturevalue(name)
    given = texts(df)
    want = sorted(str((i, *x)) for (i, _, _), x in zip(given, brute.alignments([t for _, t, _ in given])))
    assert sorted(str((r["doc_id"], *[r[n] for n in NAMES])) for r in rows(align.alignment_report(df))) == want
    # The same by the shuffle, where few pairs may be broadcast.
    if name != "empty":
        assert sorted(str((r["doc_id"], *[r[n] for n in NAMES])) for r in rows(align.alignment_report(df, hot_pairs=50))) == want


def test_alignment_of_other_spaces(awkward):
    got = {r["doc_id"]: r for r in rows(align.alignment_report(awkward))}
    assert got[101]["n_a"] == 0 and got[101]["groups_sha256"] == ""  # a literal mark
    assert got[102]["n_a"] > 0 and got[100]["n_a"] > 0 and got[103]["n_groups"] == 1


def test_coalescing():
    rnd = random.Random(4)
    for _ in range(300):
        n = rnd.randrange(1, 40)
        ends = [sorted({n, *(rnd.randrange(1, n + 1) for _ in range(rnd.randrange(20)))}) for _ in "ab"]
        (sa, ea), (sb, eb) = [(np.array([0, *e[:-1]]), np.array(e)) for e in ends]
        a, b = align.coalesced(sa, ea, sb, eb)
        common = sorted(set(ends[0]) & set(ends[1]))
        assert a.tolist() == [sum(c < e for c in common) for e in ends[0]] and b.tolist() == [sum(c < e for c in common) for e in ends[1]]


def _report(given, percent):
    sizes, first = brute.similar_sets([t for _, t, _ in given], percent)
    least = {}
    for (i, _, _), f in zip(given, first):
        least[f] = min(least.get(f), i, key=key) if f in least else i
    return sorted(str((i, n, least[f], i == least[f])) for (i, _, _), n, f in zip(given, sizes, first))


def _found(df, rules=minhash.MinHashRules()):
    return sorted(str((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])) for r in rows(minhash.near_duplicates(df, rules)))


@pytest.mark.parametrize("name", ["docs", "awkward", "empty"])
def test_minhash(name, request):
    df = request.getfixturevalue(name)
    assert _found(df) == _report(texts(df), 85)


def _cluster_texts(rnd, n, size, most):
    """Variants of one text, each with up to ``most`` words changed."""
    base = [f"w{rnd.randrange(5000)}" for _ in range(size)]
    for _ in range(n):
        words = list(base)
        for k in rnd.sample(range(size), rnd.randrange(most + 1)):
            words[k] = f"x{rnd.randrange(10**6)}"
        yield " ".join(words)


@pytest.mark.parametrize("rules", [minhash.MinHashRules(), minhash.MinHashRules(stars=2, small=4, block=2000)])
def test_minhash_large_groups(spark, rules):
    """Variants around the limit: buckets that many sets share, joined, in star rounds and in blocks."""
    rnd = random.Random(9)
    data = [*_cluster_texts(rnd, 120, 120, 6), *_cluster_texts(rnd, 60, 200, 9), *_cluster_texts(rnd, 40, 30, 1)]
    data += data[:5] * 4
    rnd.shuffle(data)
    given = [(i, t, None) for i, t in enumerate(data)]
    df = spark.createDataFrame([x[:2] for x in given], "doc_id long, text string")
    assert _found(df, rules) == _report(given, 85)


def test_forest_keeps_components(spark):
    import pyarrow as pa

    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 1 << 62, 60)
    sets = [np.unique(np.concatenate([base[rnd.random(60) < 0.9], rnd.integers(0, 1 << 62, 3)])) for _ in range(80)]
    found = minhash._forest(70)(pa.table({"node": pa.array(range(80)), "set": pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))}))
    assert found.num_rows < 80
    near = [(i, j) for i in range(80) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 70 * len(np.union1d(sets[i], sets[j]))]
    roots = lambda e: {r["node"]: r["root"] for r in components(spark.createDataFrame(e, "u long, v long"), 80).collect()}
    assert len(near) > 80 and roots(near) == roots(list(zip(found["u"].to_pylist(), found["v"].to_pylist())))


def test_signatures_estimate_similarity():
    """Shares of equal components are near the Jaccard similarity, and vary less than independent minima would."""
    rnd = np.random.default_rng(3)
    for n, shared in ((40, 30), (400, 350), (1, 1), (3, 2)):
        got = []
        for _ in range(100):
            x = rnd.integers(0, 1 << 63, 2 * n - shared).astype(np.uint64)
            a, b = minhash.signatures([np.unique(x[:n]), np.unique(x[n - shared :])], 150)
            assert (a >> np.uint64(32) < 150).all()
            got.append(float((a == b).mean()))
        j = shared / (2 * n - shared)
        assert abs(np.mean(got) - j) < 0.02
        assert np.var(got) <= 1.3 * j * (1 - j) / 150 + 1e-9


def test_signature_by_definition():
    """Rank by rank with whole permutations."""
    for n in (1, 2, 7, 90, 700):
        x = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
        m, best = 40, [1 << 64] * 40
        for e in x:
            p = list(range(m))
            for rank in range(m):
                r = int(minhash.mix(np.array([e]) + np.uint64((2 * rank + 1) * int(minhash.GOLDEN) % (1 << 64)))[0])
                k = rank + ((r >> 32) * (m - rank) >> 32)
                p[rank], p[k] = p[k], p[rank]
                best[p[rank]] = min(best[p[rank]], rank << 32 | r & 0xFFFFFFFF)
        assert minhash.signatures([x], m)[0].tolist() == best


def _vectors(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, cluster int, distance string")


def _check_clusters(df, vectors):
    want, final = brute.lloyd(vectors, 8, 10)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final]
    inertia = {c: sum(d for k, d in want.values() if k == c) for c in range(8)}
    got = {r["vec_id"]: r for r in rows(centroids.cluster_report(df))}
    assert set(got) == set(vectors)
    for i, r in got.items():
        c, d = want[i]
        held = [min(x, (1 << 63) - 1) for x in (inertia[c], sum(inertia.values()))]
        assert (r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) == (c, d, *held, sha[c])


def test_clusters_of_awkward_vectors(spark):
    rnd = random.Random(5)
    vectors = {i: [rnd.randrange(-300, 300) + 700 * (i % 5 == k % 5) for k in range(64)] for i in range(300)}
    vectors |= {300 + i: vectors[7] for i in range(60)}
    data = [(i, [x / 1024 for x in v], 1, "x") for i, v in vectors.items()]
    bad = [None, [1.0] * 63, [1.0] * 65, [], [1.0] * 63 + [None], [float("nan")] * 64, [float("inf")] * 64, [1e30] * 64]
    df = _vectors(spark, data + [(900 + i, x, 1, "x") for i, x in enumerate(bad)])
    _check_clusters(df, vectors)
    few = {i: vectors[i] for i in range(5)}
    assert len(rows(centroids.cluster_report(df.filter("vec_id < 5")))) == len(few)
    assert rows(centroids.cluster_report(df.filter("false"))) == []
    # Large numbers: distances near a long's limit stay exact.
    huge = {i: [rnd.randrange(-(1 << 27) + 1, 1 << 27) for _ in range(64)] for i in range(40)}
    _check_clusters(_vectors(spark, [(i, [x / 1024 for x in v], 1, "x") for i, v in huge.items()]), huge)


def test_cluster_null_and_repeated_ids(spark):
    v = [[float(i == k) for k in range(64)] for i in range(10)]
    data = [(None, v[0], 1, ""), (1, v[1], 1, ""), (1, v[1], 1, ""), (1, v[2], 1, ""), *[(i, v[i], 1, "") for i in range(3, 10)]]
    got = rows(centroids.cluster_report(_vectors(spark, data)))
    assert len(got) == 11 and sum(r["vec_id"] == 1 for r in got) == 3 and sum(r["vec_id"] is None for r in got) == 1
    repeated = [r for r in got if r["vec_id"] == 1 and r["distance"] == 0]
    assert len({r["cluster"] for r in repeated}) <= 2


def test_bounds_skip_distances_and_change_nothing():
    rnd = np.random.default_rng(8)
    centres = rnd.integers(-4000, 4000, (8, 64))
    v = (centres[rnd.integers(0, 8, 3000)] + rnd.integers(-300, 300, (3000, 64))).astype(np.int64)
    history = [v[:8].copy()]
    own, dist, seen = np.zeros(len(v), np.int64), np.zeros((len(v), 8)), np.full((len(v), 8), -1, np.int32)
    evaluated = []
    for _ in range(10):
        evaluated.append(centroids.reassign(v, own, dist, seen, np.array(history)))
        full = ((v[:, None, :] - history[-1][None]) ** 2).sum(axis=2)
        assert (own == full.argmin(axis=1)).all()
        history.append(np.array([v[own == c].sum(axis=0) // max(1, (own == c).sum()) if (own == c).any() else history[-1][c] for c in range(8)]))
    assert evaluated[0] == 8 * len(v) and sum(evaluated[1:]) < 0.5 * 9 * 8 * len(v)


def test_drift_is_the_norm_of_the_sum():
    """A centroid that went away and came back loosens nothing: no distance is evaluated again."""
    v = np.array([[0, 0], [100, 0]])
    a, b = [[0, 0], [100, 0]], [[40, 0], [60, 0]]
    own, dist, seen = np.zeros(2, np.int64), np.zeros((2, 2)), np.full((2, 2), -1, np.int32)
    assert centroids.reassign(v, own, dist, seen, np.array([a])) == 4
    assert centroids.reassign(v, own, dist, seen, np.array([a, b, a])) == 0
    assert own.tolist() == [0, 1]


def test_operators_leave_only_their_results(spark, docs):
    from lemniscate.llm import common

    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    for make, given in ((align.alignment_report, docs), (minhash.near_duplicates, docs), (centroids.cluster_report, vectors)):
        with common.scratch():
            out = make(given)
            assert out.count() == given.count()
            assert out.filter(F.col(out.columns[0]).isNull()).count() == 0
