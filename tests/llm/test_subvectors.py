"""Centroid clustering: odd tables against plain Python rounds. The whole table is held against SQL."""

import hashlib
import random

import numpy as np
import pytest

from logweave.llm import subvectors

NAN = float("nan")


def _rounds(rows, k, rounds):
    """Brute force: (id, cluster, distance) of every row and the centroids."""
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]

    def assign():
        out = []
        for i, v in rows:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((i, d.index(min(d)), min(d)))
        return out
    for _ in range(rounds):
        own = assign()
        for c in range(len(centroids)):
            members = [v for (_, v), a in zip(rows, own) if a[1] == c]
            if members:
                centroids[c] = [sum(x) // len(members) for x in zip(*members)]
    return assign(), centroids


@pytest.mark.parametrize("dim, count, spread", [(3, 60, 2), (4, 200, 1000), (1, 40, 1), (5, 10, 9)])
def test_agrees_with_plain_rounds(spark, monkeypatch, dim, count, spread):
    monkeypatch.setattr(subvectors, "CHUNK", 16)
    rng = random.Random(dim)
    rows = [(rng.randint(0, count // 2), [rng.randint(-spread, spread) for _ in range(dim)]) for _ in range(count)]
    rows += [(7, [1] * dim)] * count + [(None, [0] * dim)]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "id long, v array<long>, cluster int, distance string")
    got, centroids = subvectors.cluster(df, 16, 3, dim=dim)
    want, expected = _rounds(rows, 16, 3)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    assert centroids.tolist() == expected
    total = sum(r[2] for r in want)
    for r in subvectors.report(got, centroids).collect():
        assert r.inertia == total and r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, expected[r.cluster])).encode()).hexdigest()


def test_rows_that_take_no_part_and_empty_tables(spark):
    rows = [(1, [0.5, -0.01]), (2, None), (3, [0.5]), (4, [0.5, NAN]), (5, [0.5, None]), (6, [float("inf"), 0.0]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    kept = subvectors.whole_vectors(df, dim=2)
    assert [tuple(r) for r in kept.collect()] == [(1, [32, -1])]
    got, centroids = subvectors.cluster(kept, dim=2)
    assert [tuple(r) for r in got.collect()] == [(1, 0, 0)] and centroids.tolist() == [[32, -1]]
    got, centroids = subvectors.cluster(kept.limit(0), dim=2)
    assert subvectors.report(got, centroids).count() == 0


def test_dictionaries_lose_nothing():
    m = np.random.default_rng(1).integers(-3, 3, (500, 7))
    codes, books = subvectors.encode_blocks(m)
    assert (np.concatenate([b[codes[:, i]] for i, b in enumerate(books)], axis=1) == m).all()
    assert all(len(np.unique(b, axis=0)) == len(b) for b in books)


def test_components_beyond_the_exact_range_are_an_error(spark):
    df = spark.createDataFrame([(1, [2**40, 0])], "id long, v array<long>")
    with pytest.raises(Exception, match="64 bits"):
        subvectors.cluster(df, dim=2)
