"""Findings of round 4: the tiles of op6 on disk once, rows that meet their class by short keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from annualis.llm import op06_pca_tiles as tiles
from annualis.llm.op06_pca_tiles import cosine_components


def _grouped(n=900, dim=24, seed=3):
    """Scattered vectors, near and equal copies of some, and what brute force makes of them."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    k = n // 8
    x[4 * k:5 * k] = x[:k] + 0.1 * rng.normal(size=(k, dim))
    x[-k // 2:] = x[5]
    x = x.astype(np.float32)
    u = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1))[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    comp = np.arange(n)
    while (new := np.minimum(comp, np.where(near, comp, n).min(axis=1))).tolist() != comp.tolist():
        comp = new
    return x, {i: (int(near[i].sum()), int(comp[i]), bool(comp[i] == i)) for i in range(n)}


def _vectors(spark, x, kind="float"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")


def _links(out):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out.collect()}


def _shuffled(spark):
    """Bytes of all shuffle files of the session's one executor."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if "shuffle" in files.apply(i).getName())


def test_tiles_are_not_shuffled_once_per_tile(spark):
    """Forty times the tiles: no more bytes shuffled, and the same result."""
    x, want = _grouped()
    df = _vectors(spark, x)
    sent = []
    for tile_bytes in (1 << 20, 24 * 8 * 22):
        before = _shuffled(spark)
        assert _links(cosine_components(df, tile_bytes=tile_bytes)) == want
        sent.append(_shuffled(spark) - before)
    assert sent[1] < 2 * sent[0]


@pytest.mark.parametrize("tile_bytes", [1, 24 * 8 * 2, 24 * 8 * 7])
def test_tiles_of_a_few_rows(spark, tile_bytes):
    x, want = _grouped(60)
    assert _links(cosine_components(_vectors(spark, x), tile_bytes=tile_bytes)) == want


def test_double_vectors_and_shared_keys(spark, monkeypatch):
    """Doubles keep their precision, and vectors whose short keys are equal stay apart."""
    x, want = _grouped(300)
    assert _links(cosine_components(_vectors(spark, x, "double"))) == want
    close = [[1.0, 0.0, 0.5], [1.0, 1e-12, 0.5], [0.0, 1.0, 0.0]]
    df = spark.createDataFrame(list(enumerate(close)), "vec_id long, embedding array<double>")
    assert _links(cosine_components(df)) == {0: (1, 0, True), 1: (1, 0, False), 2: (0, 2, True)}
    monkeypatch.setattr(tiles, "_keys", lambda v: {"key0": F.lit(1)})
    assert _links(cosine_components(_vectors(spark, x))) == want


def test_close_pairs_against_all_pairs():
    """Every pair once, over block edges, with a bound on few leading dimensions."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2300, 16)) * np.linspace(2, 0.2, 16)
    u = tiles._units(x)
    values, axes = np.linalg.eigh(u.T @ u / len(u))
    axes, values = axes[:, ::-1].copy(), values[::-1]
    for lead in (8, tiles.leading(values, 0.9), 16):
        a, b = tiles.rotated(u[:1100], axes, lead), tiles.rotated(u[1100:], axes, lead)
        got = [(i, j) for part in tiles.close_pairs(a, b, 0.9) for i, j in zip(*(p.tolist() for p in part), strict=True)]
        assert len(set(got)) == len(got) and set(got) == set(zip(*(p.tolist() for p in np.nonzero(u[:1100] @ u[1100:].T >= 0.9)), strict=True))
        got = [(i, j) for part in tiles.close_pairs(a, a, 0.9) for i, j in zip(*(p.tolist() for p in part), strict=True)]
        assert len(set(got)) == len(got) and set(got) == set(zip(*(p.tolist() for p in np.nonzero(np.triu(u[:1100] @ u[:1100].T >= 0.9, 1))), strict=True))


def test_a_dense_group_adds_few_edges(spark, monkeypatch):
    """600 vectors that all link, in tiles of 40: an edge a member and one more for each meeting of two tiles."""
    x = np.concatenate([np.ones((600, 8)) + 0.01 * np.random.default_rng(4).normal(size=(600, 8)), -np.eye(8)])
    seen, joined = [], tiles.connected_components
    monkeypatch.setattr(tiles, "connected_components", lambda e, *ends: (seen.append(e.count()), joined(e, *ends))[1])
    got = _links(cosine_components(_vectors(spark, x, "double"), tile_bytes=8 * 8 * 40))
    assert all(got[i] == (599, 0, i == 0) for i in range(600)) and all(got[i] == (0, i, True) for i in range(600, 608))
    assert 599 <= seen[0] <= 608 + 20 * 19
