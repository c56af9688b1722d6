"""Vector search and near-duplicates against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tensorfold.llm import lsh_search, multi_index, vectors


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i) if i is not None else None, None if v is None else [None if c is None else float(c) for c in v], "extra") for i, v in zip(ids, x)], "vec_id bigint, embedding array<float>, score string")


def odd_rows(d):
    """Rows that take no part: null, zero, wrongly sized, null or non-finite components."""
    return [None, [0.0] * d, [1.0] * (d - 1), [None] + [1.0] * (d - 1), [float("nan")] + [1.0] * (d - 1), [float("inf")] + [1.0] * (d - 1)]


def test_matrix():
    d = 3
    mask, x = vectors.matrix(pa.array([*odd_rows(d), [1.0, 2.0, 3.0]], pa.list_(pa.float32())), d)
    assert mask.tolist() == [False] * 6 + [True] and x.tolist() == [[1.0, 2.0, 3.0]]
    assert vectors.matrix(pa.array([], pa.list_(pa.float32())), d)[1].shape == (0, d)


def test_perturbations_come_by_success():
    fraction = np.random.default_rng(0).uniform(size=(5, 6))
    moves = lsh_search.perturbations(fraction, 32)
    assert (moves[:, 0] == 0).all() and len({tuple(m) for m in moves[0]}) == 32
    cost = (np.where(moves == -1, fraction[:, None] ** 2, np.where(moves == 1, (1 - fraction[:, None]) ** 2, 0))).sum(-1)
    assert (cost[:, 1] <= cost[:, 2] + 1e-12).all() and cost[:, :8].mean() < cost[:, 24:].mean()


def test_search(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, size=(1500, 1))
    x[700:760] = x[40]
    x = x.astype(np.float32).astype(float)
    rows = [*x, *odd_rows(16), x[0]]
    ids = [*range(1500), *range(2000, 2006), None]
    out = lsh_search.nearest(table(spark, rows, ids), F.col("id") % 20 == 0, block=64).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 1500, 20))
    hits = 0
    for q, found in by.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = sorted(range(1500), key=lambda i: (-s[i], i))[:20]
        assert [r["rank"] for r in found] == list(range(1, len(found) + 1)) and len(found) == 20
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hits += len({r.vec_id for r in found} & set(best))
    assert hits / (20 * len(by)) >= 0.9
    few = lsh_search.nearest(table(spark, x[:5]), F.col("id") == 0).collect()
    assert sorted(r["rank"] for r in few) == [1, 2, 3, 4]
    assert lsh_search.nearest(table(spark, x[:1]), F.col("id") == 0).count() == 0
    assert lsh_search.nearest(table(spark, x[:1]).limit(0), F.col("id") == 0).count() == 0


def recall_of(spark, x, every, **options):
    x = x.astype(np.float32).astype(float)
    out = lsh_search.nearest(table(spark, x), F.col("id") % every == 0, **options).collect()
    asked, hits, by = range(0, len(x), every), 0, {}
    for r in out:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = min(20, len(x) - 1)
    for q in asked:
        s = x @ x[q]
        s[q] = -np.inf
        assert sorted(r for r, _, _ in by[q]) == list(range(1, want + 1))
        assert all(abs(score - s[v]) < 1e-9 * max(1, abs(score)) for _, v, score in by[q])
        least = np.partition(s, -want)[-want]
        hits += sum(score >= least - 1e-9 * abs(least) for _, _, score in by[q])
    return hits / (want * len(asked))


@pytest.mark.parametrize("kind", ["equal", "lognormal 1", "lognormal 1.5", "outlier", "clusters", "negative"])
@pytest.mark.parametrize("d", [16, 64])
def test_search_recall(spark, kind, d):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(1600, d))
    if kind == "equal":
        x /= np.linalg.norm(x, axis=1)[:, None]
    elif kind.startswith("lognormal"):
        x *= rng.lognormal(sigma=float(kind.split()[1]), size=(1600, 1))
    elif kind == "outlier":
        x[11] *= 1000
    elif kind == "clusters":
        x = x[rng.integers(0, 40, 1600)] + 0.3 * rng.normal(size=x.shape)
    elif kind == "negative":
        # Two opposite clouds: the query's own has few rows.
        x = np.where(np.arange(1600)[:, None] < 10, -1, 1) * (3 + rng.normal(size=x.shape))
    assert recall_of(spark, x, 20) >= 0.9


@pytest.mark.parametrize("n, d", [(500, 768), (21, 8), (2, 3), (5, 1)])
def test_search_recall_of_other_sizes(spark, n, d):
    x = np.random.default_rng(n).normal(size=(n, d))
    assert recall_of(spark, x, 5) >= 0.9


def test_near_duplicates(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16))
    x[300:420] = x[7] + 0.05 * rng.normal(size=(120, 16))
    x[420:440] = x[3] * 2
    x = x.astype(np.float32).astype(float)
    rows, ids = [*x, *odd_rows(16), x[0], x[7]], [*range(600), *range(2000, 2006), None, 7]
    out = {r.vec_id: r for r in multi_index.near_duplicates(table(spark, rows, ids), block=32).collect()}
    assert len(out) == 607 and out[None].n_links == 0 and out[2000].component_id == 2000
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    found = sum(r.n_links for i, r in out.items() if i is not None and i < 600)
    assert found >= 0.9 * near.sum() and all(out[i].n_links <= near[i].sum() for i in range(600))
    assert len({out[i].component_id for i in [7, *range(300, 420)]}) == 1 and out[420].component_id == 3
    assert multi_index.near_duplicates(table(spark, x[:2]).limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["subspace", "decaying", "permuted", "clusters", "copies"])
def test_near_duplicate_recall(spark, kind):
    rng = np.random.default_rng(31)
    n, d = 1500, 64
    if kind == "subspace":
        turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
        x = rng.normal(size=(n, 6)) @ turn[:6]
    elif kind in ("decaying", "permuted"):
        scale = 0.6 ** np.arange(d)
        x = rng.normal(size=(n, d)) * (scale if kind == "decaying" else rng.permutation(scale))
    elif kind == "clusters":
        x = rng.normal(size=(60, d))[rng.integers(0, 60, n)] + 0.25 * rng.normal(size=(n, d))
    else:
        x = rng.normal(size=(n, d))
        x[200:900] = x[3]
        x[900:1000] = 2 * x[5]
    x = x.astype(np.float32).astype(float)
    out = {r.vec_id: r for r in multi_index.near_duplicates(table(spark, x)).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    got = np.array([out[i].n_links for i in range(n)])
    assert (got <= near.sum(axis=1)).all() and got.sum() >= 0.98 * near.sum()
    if kind == "copies":
        assert {out[i].component_id for i in range(200, 900)} == {3} and {out[i].component_id for i in range(900, 1000)} == {5}
        assert got[200] == near[200].sum() >= 700


def test_multi_sequence_orders_cells():
    rng = np.random.default_rng(4)
    grid = multi_index.MultiIndex(rng.normal(size=(9, 4)), rng.normal(size=(7, 4)))
    x = rng.normal(size=(20, 8))
    a, b = grid.distances(x)
    visits = grid.visits(x, 15)
    for i in range(20):
        heap = [p * 7 + q for p, q in multi_index.multi_sequence(a[i], b[i], 15)]
        assert visits[i].tolist() == heap and visits[i][0] == grid.cell(x[i : i + 1])[0]
