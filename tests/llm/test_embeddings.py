"""op4 where vec_ids repeat, and in one dense run, against brute force."""

import numpy as np

from loomline.llm import embedding_dedup
from loomline.llm.components import Forest


def plain(rows):
    """n_links by row and component by vec_id, over all pairs of (vec_id, vector)."""
    distinct = sorted({(i, tuple(v)) for i, v in rows})
    x = np.array([v for _, v in distinct])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near, forest = x @ x.T >= 0.95, Forest(len(x))
    forest.union(*np.nonzero(near))
    ids = np.array([i for i, _ in distinct])
    forest.union(np.arange(len(x)), np.searchsorted(ids, ids))
    links = dict(zip(distinct, (near.sum(1) - 1).tolist(), strict=True))
    # positions come in order of vec_id, so the root is the smallest
    return sorted((i, links[i, tuple(v)], int(ids[r])) for (i, v), r in zip(rows, forest.roots(np.array([distinct.index((i, tuple(v))) for i, v in rows])).tolist(), strict=True))


def found(spark, rows, **more):
    table = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in rows], "vec_id long, embedding array<double>, node int")
    return sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.embedding_dedup(table, **more).collect())


def test_a_repeated_vec_id_keeps_the_links_of_all_its_vectors(spark):
    rows = [(1, (1.0, 0.0)), (1, (0.0, 1.0)), (2, (0.0, 1.0)), (3, (1.0, 0.0))]
    assert found(spark, rows) == plain(rows) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_repeated_ids_ties_and_copies_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 8))
    x = np.round(centres[rng.integers(0, 12, 200)] + 0.1 * rng.standard_normal((200, 8)), 3)
    rows = [(int(i), tuple(x[j])) for i, j in zip(rng.integers(0, 150, 300), rng.integers(0, 200, 300), strict=True)]
    rows += rows[:5]
    assert found(spark, rows) == plain(rows)


def test_a_dense_run_longer_than_windows_and_chunks(spark):
    rng = np.random.default_rng(6)
    x = np.round(np.ones(8) + 0.1 * rng.standard_normal((1500, 8)), 3)
    rows = [(i, tuple(v)) for i, v in enumerate(x)]
    got, expected = np.array(found(spark, rows, window=64)), np.array(plain(rows))
    assert (got[:, [0, 2]] == expected[:, [0, 2]]).all() and (got[:, 1] <= expected[:, 1]).all()
    assert got[:, 1].sum() >= 0.999 * expected[:, 1].sum()
