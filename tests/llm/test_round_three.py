"""Integer centroids, cover anchors and slicing whitening against brute force, their DuckDB twins
and their edge cases."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as E
from annualis.llm.op11_nsimplex_centroids import Simplex, bounds, cluster_vectors, nearest, squared_distances
from annualis.llm.op12_cover_anchors import COVER, PERIOD, Shape, combine, remove_repeats
from annualis.llm.op13_slicing_whitening import covariance, leading_pairs, pivots_above, whiten
from annualis.sources.tables import TABLES
from tools.oracle_check import digest

SF = "/root/testdata/sf0.001"
VEC = "vec_id long, embedding array<float>, cluster string, n long, id string"


@pytest.mark.parametrize("name", ["op11_nsimplex_centroids", "op12_cover_anchors"])
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    got = cur.fetchall()
    assert rows and digest(df.columns, rows)[0] == digest(cols, got)[0]


# ---------------------------------------------------------------- op11

def brute_clusters(ids, x, k=40, rounds=5):
    order = sorted(range(len(ids)), key=lambda i: (hashlib.sha256(f"2:{ids[i]}".encode()).hexdigest(), x[i].tolist()))
    c = x[order[:k]].copy()
    for _ in range(rounds):
        near = squared_distances(x, c).argmin(axis=1)
        for j in set(near.tolist()):
            c[j] = x[near == j].sum(axis=0) // int((near == j).sum())
    d = squared_distances(x, c)
    return d.argmin(axis=1), d.min(axis=1), c


def test_simplex_bounds_hold_and_skip_centroids():
    rng = np.random.default_rng(0)
    flat = (rng.standard_normal((300, 4)) @ rng.standard_normal((4, 64)) * 200).astype(np.int64)
    flat[7] = flat[3]
    for x in (flat, rng.integers(-300, 300, (300, 64)), np.zeros((5, 64), np.int64)):
        s = Simplex(x[:40], 12)
        low, high = bounds(s.apexes(x), s.apexes(x[:40]))
        d = squared_distances(x, x[:40])
        assert (low <= d).all() and (d <= high).all()
        cluster, distance, tried = nearest(x, s.apexes(x), x[:40], s.apexes(x[:40]))
        assert (cluster == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
        if x is flat:
            assert tried < 0.1 * d.size  # the vectors lie in few dimensions, so the bounds are tight


def test_clusters_against_brute_force_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((130, 64)).astype(np.float32)
    v[50:90] = v[3]  # a third of all rows is one vector, first centroids repeat: ties, empty clusters
    ids = [*range(129), 5]
    rows = [(i, x.tolist(), "a", 1, "b") for i, x in zip(ids, v, strict=True)]
    odd = [(200, None), (201, []), (202, [1.0] * 63), (203, [None] + [1.0] * 63), (204, [float("nan")] * 64),
           (205, [float("-inf")] + [0.0] * 63), (206, [3e38] + [0.0] * 63)]
    df = spark.createDataFrame(rows + [(i, x, "a", 1, "b") for i, x in odd], VEC)
    got = cluster_vectors(df).collect()
    x = np.floor(256 * v.astype(float)).astype(np.int64)
    near, dist, c = brute_clusters(ids, x)
    want = sorted((i, int(k), int(d), int(dist[near == k].sum()), int(dist.sum()),
                   hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for i, k, d in zip(ids, near, dist, strict=True))
    assert sorted(tuple(r) for r in got if r["vec_id"] != 206) == want
    assert [tuple(r)[1:] for r in got if r["vec_id"] == 206] == [(None,) * 5]  # too large for a long
    few = cluster_vectors(df.where("vec_id < 3")).collect()
    assert sorted(r["distance"] for r in few) == [0, 0, 0] and len({r["cluster"] for r in few}) == 3
    none = cluster_vectors(df.where("vec_id > 300"))
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    lone = spark.createDataFrame([(None, v[0].tolist(), "a", 1, "b")], VEC)
    assert cluster_vectors(lone).collect()[0][:3] == (None, 0, 0)


# ---------------------------------------------------------------- op12

def brute_repeats(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = {}
    for w in words:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i:i + window])] = seen.get(tuple(w[i:i + window]), 0) + 1
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_any_two_positions_share_an_offset_on_the_cover():
    on = {c for c in COVER}
    for i in range(PERIOD):
        for j in range(PERIOD):
            assert any((i + d) % PERIOD in on and (j + d) % PERIOD in on for d in range(PERIOD))
    with pytest.raises(ValueError):
        Shape(35, 21, (0, 1, 2))


def test_a_buffer_sends_few_rows_of_a_hot_stretch():
    a = np.array([5] * 1000 + [7, 7, 8])
    c = np.array([1] * 900 + list(range(2, 102)) + [1, 2, 1])
    sent, repeated, opened = combine(a, c)
    assert sent[:1000].sum() == 1 and repeated[:1000].sum() == 900 and opened[:1000].sum() == 101
    assert sent[1000:].all() and not repeated[1000:].any() and not opened[1000:].any()


@pytest.mark.parametrize(("window", "period", "cover"), [(35, 21, COVER), (9, 7, (1, 2, 4)), (7, 7, (1, 2, 4)), (3, 1, (0,))])
def test_repeats_against_brute_force(spark, monkeypatch, window, period, cover):
    rng = random.Random(window)
    pool = [f"w{i}é" for i in range(9)] + ["\x1cx\x85 y"]
    prose = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    passage = [prose(n) for n in (window, window + 1, 2 * window, 90)]
    texts = [None, "", " \t\n", "one", "a " * 400, "a " * window, "a " * (window - 1), prose(3000)]
    for _ in range(60):
        parts = [prose(rng.randrange(0, 30)) for _ in range(3)]
        texts.append("\n".join([parts[0], rng.choice(passage), parts[1], rng.choice(passage + [""]), parts[2]]))
    texts += [texts[20]] * 40 + [texts[21] + " end", "start " + texts[21]]
    want = brute_repeats(texts, window)
    rows = [(i if i % 7 else None, t, "en", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k1 string, n_words long").repartition(3)
    got = remove_repeats(df, window=window, period=period, cover=cover)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    key = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    assert sorted(map(key, got.collect())) == sorted(key((r[0], *w)) for r, w in zip(rows, want, strict=True))


def test_repeats_of_equal_rows_and_of_nothing(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, text), (1, text), (2, "w0 " + text), (3, None)], "doc_id long, text string")
    got = sorted(remove_repeats(df, keep_text=True).collect())
    assert [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got] == [
        (1, 50, 50, ""), (1, 50, 50, ""), (2, 51, 50, "w0"), (3, 0, 0, "")]
    assert remove_repeats(df.where("doc_id > 9")).collect() == []


# ---------------------------------------------------------------- op13

def test_inertia_counts_and_leading_pairs():
    rng = np.random.default_rng(2)
    for dim in (1, 2, 6, 40):
        a = rng.standard_normal((3 * dim, dim)) * np.logspace(0, -3, dim)
        for m in (a.T @ a, np.eye(dim), np.ones((dim, dim)), a.T @ a - 0.5 * np.eye(dim)):
            w = np.linalg.eigvalsh(m)
            for shift in rng.uniform(w[0] - 1, w[-1] + 1, 8):
                assert pivots_above(m, shift) == (w > shift).sum()
            if w[0] > -1e-9:
                e, v = leading_pairs(m, 32)
                assert len(e) == min(32, (w > 1e-12 * np.trace(m)).sum())
                assert np.allclose(e, w[::-1][:len(e)], rtol=1e-9, atol=1e-13 * np.trace(m))
                assert np.abs(v @ v.T - np.eye(len(e))).max() < 1e-12 and np.abs(m @ v.T - v.T * e).max() < 1e-11 * np.trace(m)
    assert pivots_above(np.array([[0.0, 1], [1, 0]]), 0.0) == 1
    assert len(leading_pairs(np.zeros((3, 3)), 2)[0]) == 0


def test_whitening_against_numpy_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    v = (rng.standard_normal((200, 6)) @ rng.standard_normal((6, 6)) + 3).astype(np.float32)
    v[100:170] = v[0]
    rows = [(i if i else None, x.tolist(), "a", 1, "b") for i, x in enumerate(v)]
    odd = [(300, None), (301, []), (302, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (303, [float("inf")] * 6), (304, [3e38] * 6),
           (305, [1.0, 2.0]), (306, [2.0, 4.0]), (307, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows + [(i, x, "a", 1, "b") for i, x in odd], VEC)
    got = whiten(df).toPandas()
    x = np.floor(64 * v.astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    cov = np.cov((x - 1_000_000).T, bias=True)
    e, axes = np.linalg.eigh(cov)
    six = got[got["n"] == n]
    assert len(six) == 200 * 6 and six.identity_error.max() < 1e-10
    dev = {i if i else -1: int(((n * a - s) ** 2).sum()) for i, a in enumerate(x)}
    assert {(-1 if np.isnan(i) else int(i), d) for i, d in zip(six.vec_id, six.deviation, strict=True)} == set(dev.items())
    for c in range(6):
        part = six[six.component == c + 1].fillna({"vec_id": -1}).set_index("vec_id").whitened
        want = ((x - s / n) @ axes[:, 5 - c]) / np.sqrt(e[5 - c])
        own = np.array([part[i if i else -1] for i in range(200)])
        assert min(np.abs(own - want).max(), np.abs(own + want).max()) < 1e-8
        assert np.allclose(six[six.component == c + 1].explained, e[5 - c] / e.sum(), rtol=1e-9)
    two = got[got["n"] == 2]  # two vectors span one component; a vector alone none
    assert sorted(zip(two.vec_id, two.component, two.whitened.abs().round(9), strict=True)) == [(305, 1, 1.0), (306, 1, 1.0)]
    assert set(got.vec_id.dropna()) & {300, 301, 302, 303, 304, 307} == set()
    none = whiten(df.where("vec_id > 900"))
    assert none.collect() == [] and none.columns[:2] == ["vec_id", "component"]


def test_moments_of_large_integers_stay_exact(spark):
    big = [[2.0 ** 24, 1.0], [-(2.0 ** 24), 2.0], [2.0 ** 23, 3.0]]
    df = spark.createDataFrame(list(enumerate(big)), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["deviation"] for r in whiten(df).where("component = 1").collect()}
    x = [[int(64 * c) + 1_000_000 for c in v] for v in big]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = {i: sum((3 * c - t) ** 2 for c, t in zip(v, s, strict=True)) for i, v in enumerate(x)}
    assert want[1] >= 1 << 63 and got == {i: d if d < 1 << 63 else None for i, d in want.items()}
    q = np.array([[a * b for b in (7, 9)] for a in (7, 9)], dtype=object) * 10 ** 30
    assert covariance(10 ** 30, np.array([7 * 10 ** 30, 9 * 10 ** 30], dtype=object), q).max() == 0.0


def test_texts_that_lose_every_word():
    from annualis.llm.op12_cover_anchors import kept_words, slices

    s = next(iter(slices(pa.array(["a b", "", "c"]))))
    assert kept_words(s, np.ones(3, bool)) == [b"", b"", b""]
    assert kept_words(s, np.array([False, True, False])) == [b"a", b"", b"c"]
