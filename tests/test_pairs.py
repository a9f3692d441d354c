"""Clusterings that compare all pairs, in tasks and tiles as on large tables, against brute force."""

import numpy as np
import pytest

from kwicloom.concordance import Concordance
from kwicloom.operators import cluster, partition


def made(spark, v):
    lines = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "line_id long, embedding array<double>")
    tokens = lines.selectExpr("line_id", "0 as id_in_line", "0 as offset", "'x' as word")
    return Concordance(lines, tokens, lines.selectExpr("line_id", "0L as match_start", "0L as match_end", "0 as slot")).view()


@pytest.fixture
def spread(monkeypatch):
    """Limits that small tables exceed."""
    from kwicloom.operators import pairs

    monkeypatch.setattr(pairs, "ALONE", 50)
    monkeypatch.setattr(pairs, "TILE", 64)
    monkeypatch.setattr(cluster, "ONE_TASK", 20, raising=False)
    for module in (partition, cluster):
        monkeypatch.setattr(module, "MAX_LINES", 10, raising=False)


def vectors(n, seed=0):
    v = np.random.default_rng(seed).normal(size=(n, 6)) + 3 * np.eye(6)[np.arange(n) % 4]
    v[7], v[9] = v[3], 0
    return v


def test_mean_linkage_without_a_matrix(spark, spread):
    v = vectors(60)
    for k in (1, 4, 20):
        g = partition.partition_by_embeddings(made(spark, v), "embedding", k, method="agglomerative")
        got = {r["line_id"]: r["label"] for r in g.members.join(g.groups.select("id", "label"), "id").collect()}
        assert [got[i] for i in range(60)] == [f"Cluster_{c}" for c in partition.agglomerate(v, k)]


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_core_points_in_tiles(spark, spread, metric):
    v = vectors(50)
    if metric == "cosine":
        norm = np.linalg.norm(v, axis=1)
        d = 1 - v @ v.T / np.where(np.outer(norm, norm) == 0, 1, np.outer(norm, norm))
    else:
        d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    eps = float(np.quantile(d, 0.2))
    near = (d <= eps).sum(1)
    rows = spark.createDataFrame([*[(i, x.tolist()) for i, x in enumerate(v)], (50, None), (51, [None] * 6), (52, [1.0])], "line_id long, v array<double>")
    got = {r["line_id"]: r["n"] for r in cluster.core_points(rows, eps, 5, metric).where("line_id < 50").collect()}
    assert got == {i: n for i, n in enumerate(near.tolist()) if n >= 5} and got
    assert not cluster.core_points(rows, eps, 5, metric).where("line_id in (50, 51)").count()


@pytest.mark.parametrize("metric, eps", [("cosine", 0.12), ("euclidean", 1.8)])
def test_density_clusters_in_tiles(spark, spread, metric, eps):
    v = vectors(80)
    g = cluster.clustering_hierarchical_embeddings(made(spark, v), "embedding", depth=2, eps=eps, metric=metric)
    want = cluster.dbscan(v, eps, 3, metric)
    names = {r["id"]: r["label"] for r in g.groups.collect()}
    got = {r["line_id"]: names[r["id"]] for r in g.members.where("id > 1").collect()}
    assert len(set(got.values())) > 2 and [got[i] for i in range(80)] == ["noise" if c < 0 else str(c) for c in want]
    assert g.members.where("id = 1").count() == 80


def test_random_tree_of_many_lines(spark, spread):
    g = cluster.clustering_random(made(spark, vectors(40)))
    rows = g.members.collect()
    assert sorted(r["line_id"] for r in rows if r["own"]) == list(range(40))
    assert [(r["line_id"], round(r["prototypicality"], 4)) for r in rows if r["id"] == 1][:3] == [(10, 0.6394), (29, 0.025), (39, 0.275)]
