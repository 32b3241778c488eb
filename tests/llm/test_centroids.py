"""Centroid clustering against a plain version in whole numbers."""

import hashlib
import math
import random

from ledgerlens.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, v string, norm string, cluster string, distance string"


def plain(rows, k, rounds, dims, seed=2, scale=256.0):
    import numpy as np
    kept = [(i, [min(max(math.floor(scale * float(np.float32(x))), -centroids.LARGEST), centroids.LARGEST) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cents = [v for _, v in starts]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cents = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(cents)]
    out = [(i, *near(v)) for i, v in kept]
    inertia = {j: sum(d for _, d, c in out if c == j) for j in range(len(cents))}
    total = sum(inertia.values())
    return sorted(((i is None, i or 0), c, d, inertia[c], total, hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, d, c in out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0, *"abcd") for i, v in rows], SCHEMA).repartition(3)
    got = centroids.with_inertia(*centroids.cluster(df, **options)).collect()
    return sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got)


def vectors(n, dims, seed):
    r = random.Random(seed)
    return [(i, [r.choice([-1, 1]) * r.random() for _ in range(dims)]) for i in range(n)]


def test_random_vectors(spark):
    rows = vectors(300, 64, 1)
    assert run(spark, rows) == plain(rows, 40, 5, 64)


def test_odd_vectors(spark):
    rows = vectors(60, 4, 2)
    rows += [(100, None), (101, []), (102, [1.0] * 3), (103, [1.0] * 5), (104, [1.0, None, 0.0, 0.0]), (105, [float("nan")] * 4), (106, [float("inf"), 0.0, 0.0, 0.0]),
             (None, [0.5, 0.25, -0.75, -0.125]), (107, [1e30, -1e30, 3e38, -0.0]), *[(108, [0.1, 0.1, 0.1, 0.1])] * 40, (108, [0.2, 0.1, 0.1, 0.1]), rows[0]]
    for k in (1, 7, 40):
        assert run(spark, rows, k=k, rounds=3, dims=4) == plain(rows, k, 3, 4)


def test_ties_and_empty_clusters(spark):
    same = [(i, [0.5, 0.5]) for i in range(9)]  # equal centroids: the smallest number takes all, the others stay
    got = run(spark, same, k=4, rounds=2, dims=2)
    assert {r[1] for r in got} == {0} and got == plain(same, 4, 2, 2)
    few = vectors(3, 2, 5)
    assert run(spark, few, k=10, rounds=2, dims=2) == plain(few, 10, 2, 2)


def test_empty_table(spark):
    assert run(spark, [], k=3, rounds=2, dims=2) == []
    assert run(spark, [(1, [1.0])], k=3, rounds=2, dims=2) == []


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(i, v, 0, *"abcd") for i, v in vectors(20, 4, 3)], SCHEMA)
    assigned, cents = centroids.cluster(df, k=3, rounds=1, dims=4)
    plan = assigned._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and len(cents) == 3
