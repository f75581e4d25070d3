import hashlib
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException

from stayloom.llm import table_clustering as C

SCHEMA = "vec_id bigint, embedding array<float>, label int, cluster string, x int, sums int"


def plain(rows, k, rounds, dimensions):
    kept = [(i, [int(np.floor(1024 * float(np.float32(v)))) for v in e]) for i, e in rows
            if e is not None and len(e) == dimensions and all(v is not None and np.isfinite(v) for v in e)]
    order = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)
    centroids = [x for _, x in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for c in range(len(centroids)):
            members = [x for (_, x), o in zip(kept, own) if o == c]
            if members:
                centroids[c] = [sum(v) // len(members) for v in zip(*members)]
    last = [nearest(x) for _, x in kept]
    per = {c: sum(d for d, o in last if o == c) for c in range(len(centroids))}
    return sorted(((i is not None, i or 0), c, d, per[c], sum(per.values()), centroids[c]) for (i, _), (d, c) in zip(kept, last))


def got(df, **kwargs):
    return sorted(((r.vec_id is not None, r.vec_id or 0), r.cluster, r.distance, r.cluster_inertia, r.inertia, list(r.centroid))
                  for r in C.cluster_vectors(df, **kwargs).collect())


def odd_rows(n, dimensions, seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1.5, -0.25, 0.0, rng.gauss(0, 1)]) for _ in range(dimensions)]) for i in range(n)]
    rows += [(None, rows[0][1]), (None, rows[1][1]), (3, rows[5][1]), (3, rows[5][1]), (n, None), (n + 1, []), (n + 2, rows[0][1][:-1]),
             (n + 3, [None, *rows[0][1][1:]]), (n + 4, [float("nan"), *rows[0][1][1:]]), (n + 5, [float("-inf"), *rows[0][1][1:]])]
    return rows


@pytest.mark.parametrize("n, k, rounds, block", [(120, 8, 10, 7), (6, 20, 3, 65536), (300, 3, 1, 64)])
def test_clusters_equal_brute_force(make, n, k, rounds, block):
    rows = odd_rows(n, 6)
    df = make([(i, e, 1, "a", 2, None) for i, e in rows], SCHEMA).repartition(3)
    assert got(df, k=k, rounds=rounds, dimensions=6, block=block) == plain(rows, k, rounds, 6)


def test_ties_copies_and_empty_clusters(make):
    same = [(i, [0.5, -0.5]) for i in range(20)]  # every centroid is the same, all vectors go to the first, the others stay empty
    df = make([(i, e, None, None, None, None) for i, e in same], SCHEMA)
    found = got(df, k=4, dimensions=2)
    assert found == plain(same, 4, 10, 2) and {r[1] for r in found} == {0}


def test_empty_table_and_large_components(make):
    empty = C.cluster_vectors(make([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    with pytest.raises(PySparkException):
        C.cluster_vectors(make([(1, [1e6, 0.0], 0, "", 0, 0)], SCHEMA), dimensions=2).collect()


def test_tables_give_the_distances():
    rng = np.random.default_rng(0)
    x, centroids = rng.integers(-9, 9, (50, 5)), rng.integers(-9, 9, (4, 5))
    import pyarrow as pa
    ids = pa.array([None if i == 3 else i for i in range(50)], pa.int64())
    block = C.Block(pa.RecordBatch.from_pydict(C._block(ids, x)), 0)
    cluster, distance = block.assign(centroids)
    want = ((x[:, None] - centroids) ** 2).sum(axis=2)
    assert block.ids.to_pylist() == ids.to_pylist()
    assert (distance == want.min(axis=1)).all() and (cluster == want.argmin(axis=1)).all()
    count, sums = block.sums(cluster, 4)
    assert all((sums[c] == x[cluster == c].sum(axis=0)).all() and count[c] == (cluster == c).sum() for c in range(4))
