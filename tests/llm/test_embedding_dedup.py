import brute
import numpy as np
import pytest

from rhoscope.llm import embedding_dedup


def vectors(seed=2):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.standard_normal(24)) for i in range(200)]
    centre = rng.standard_normal(24)
    rows += [(1000 + i, centre + rng.standard_normal(24) * 0.05) for i in range(120)]
    rows += [(2000 + i, rows[i % 40][1] * rng.choice([1.0, 2.5])) for i in range(80)]
    rows += [(3000 + i, rows[i][1] + rng.standard_normal(24) * 0.15) for i in range(60)]
    out = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    return out + [(4000 + i, out[1][1]) for i in range(30)]


ODD = [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, []), (5004, [None] + [1.0] * 23), (5005, [float("inf")] + [1.0] * 23)]


@pytest.mark.parametrize("chunk", [1024, 16])
def test_links_are_exact_and_nearly_all(spark, chunk):
    rows = vectors()
    df = spark.createDataFrame([(d, v, 3, "x") for d, v in rows + ODD], "vec_id long, embedding array<float>, label int, kept string").repartition(5)
    got = {r.vec_id: r for r in embedding_dedup.link_embeddings(df, chunk=chunk).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    want = near.sum(1)
    have = np.array([got[d].n_links for d, _ in rows])
    assert (have <= want).all() and have.sum() >= 0.95 * want.sum()
    up = brute.roots([d for d, _ in rows], [(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(np.triu(near)), strict=True)])
    assert sum(got[d].component_id == up[d] for d, _ in rows) >= 0.97 * len(rows)
    assert all(got[d].kept == (d == got[d].component_id) for d, _ in rows)
    assert [tuple(got[d]) for d, _ in ODD] == [(d, 0, d, True) for d, _ in ODD]


def test_empty_lengths_and_null_ids(spark):
    schema = "vec_id long, embedding array<float>"
    assert embedding_dedup.link_embeddings(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [1.0, 2.0, 0.0]), (None, [1.0, 2.0]), (4, [1.0, 2.0])]
    got = {r.vec_id: tuple(r)[1:] for r in embedding_dedup.link_embeddings(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (3, 1, True), 2: (3, 1, False), 3: (0, 3, True), None: (3, 1, False), 4: (3, 1, False)}


def test_plan_keeps_recall_at_every_size():
    near = embedding_dedup.meets((2 - 2 * 0.95) ** 0.5)
    for n in (10, 10_000, 10_000_000):
        depth, tables = embedding_dedup.plan(n, 0.95, 0.975)
        assert 1 - (1 - near**depth) ** tables >= 0.975
