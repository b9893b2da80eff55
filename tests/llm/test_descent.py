import numpy as np
import pytest

from docloom.llm import descent as D
from docloom.llm.queries import op3_nn_descent


def plain(ids, x, threshold=0.9):
    """{row: (links, component, kept)} by comparing all pairs."""
    good = [i for i, v in enumerate(x) if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)]
    links, parent = {i: 0 for i in range(len(x))}, list(range(len(x)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, i in enumerate(good):
        for j in good[k + 1:]:
            a, b = np.asarray(x[i], dtype=float), np.asarray(x[j], dtype=float)
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i in range(len(x)):
        if ids[i] is not None:
            least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return sorted(((ids[i], links[i], least.get(root(i))) for i in range(len(x))), key=str)


def run(spark, ids, x, kind="double"):
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in zip(ids, x, strict=True)], f"vec_id long, embedding array<{kind}>, node int, vec int")
    rows = D.near_vectors(table).collect()
    assert all(r.kept == (r.id == r.component_id) for r in rows)
    return sorted(((r.id, r.n_links, r.component_id) for r in rows), key=str)


def test_query_table(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in op3_nn_descent(spark, small).collect()), key=str)
    assert got == plain([r.vec_id for r in rows], [r.embedding for r in rows])


@pytest.mark.parametrize("spread", [0.02, 0.055])
def test_clusters_pairs_and_hot_group(spark, monkeypatch, spread):
    monkeypatch.setattr(D, "TILE", 32)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(120, 24))
    x = [v for c in centre for v in [c, *(c + rng.normal(size=(rng.integers(0, 4), 24)) * 0.08)]]
    x += list(centre[0] + rng.normal(size=(260, 24)) * spread * np.linalg.norm(centre[0]))
    x = [v.tolist() for v in x]
    x[3] = x[7]
    ids = rng.permutation(len(x)).tolist()
    got, want = run(spark, ids, x), plain(ids, x)
    assert len(got) == len(want) and sum(a == b for a, b in zip(got, want, strict=True)) >= 0.99 * len(want)
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want) and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))


def test_odd_rows(spark):
    x = [None, [], [0.0, 0.0], [1.0, None], [1.0, float("nan")], [float("inf"), 1.0], [1.0, 2.0], [2.0, 4.0], [1.0, 2.0], [1.0, 2.0, 0.0],
         [1e300, 2e300], [-1.0, 0.5], [1e-310, 2e-310]]
    ids = [1, 2, 3, 4, 5, 6, 7, 8, 8, 9, None, 11, 12]
    got = run(spark, ids, x)
    want = plain(ids, [v if v is None or None in v or not np.isfinite(v).all() or not np.any(v) else (np.array(v) / np.abs(v).max()).tolist() for v in x])
    assert got == want
    assert run(spark, [], []) == []


def test_recall_holds_beyond_the_audited_nodes(spark, monkeypatch):
    monkeypatch.setattr(D, "TABLES", 1)
    monkeypatch.setattr(D, "BLOCK", 64)
    rng = np.random.default_rng(6)
    one = rng.normal(size=(700, 24))
    other = one + rng.normal(size=one.shape) * 0.3
    x = [v.tolist() for pair in zip(one, other, strict=True) for v in pair]
    near = (one * other).sum(axis=1) / np.linalg.norm(one, axis=1) / np.linalg.norm(other, axis=1) >= 0.9
    got = {i: links for i, links, _ in run(spark, list(range(len(x))), x)}
    found = np.array([got[2 * k] > 0 for k in np.flatnonzero(near)])
    assert near.sum() > 500 and found.mean() >= 0.97


def test_links_between_dense_groups_are_found(spark, monkeypatch):
    monkeypatch.setattr(D, "audit", lambda nodes, *_: (1.0, nodes.sparkSession.createDataFrame([], D._EDGES)))  # no help from it
    rng = np.random.default_rng(7)
    axes = np.eye(24)
    angle = np.arccos(0.9) * 0.97
    poles = [axes[0], np.cos(angle) * axes[0] + np.sin(angle) * axes[1]]
    x = [(p + rng.normal(size=24) * 0.006).tolist() for p in poles for _ in range(60)]  # all lists are full of own members
    ids = list(range(len(x)))
    assert run(spark, ids, x) == plain(ids, x)
