"""Whitening against a plain eigendecomposition."""

from __future__ import annotations

import numpy as np
import pytest

from perilframe.llm import whitening
from perilframe.llm.queries import queries
from perilframe.llm.whitening import Spectrum, rank_one


def check(x: np.ndarray, s: Spectrum) -> None:
    d = x.shape[1]
    v = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
    e, size = np.linalg.eigvalsh(v), max(np.abs(v).max(), 1e-300)
    assert np.abs(s.values - e).max() <= 1e-11 * size * d
    assert np.abs(s.vectors.T @ s.vectors - np.eye(d)).max() < 1e-11
    assert np.abs(s.vectors * s.values @ s.vectors.T - v).max() <= 1e-11 * size * d


@pytest.mark.parametrize("kind", ["plain", "equal", "axes", "small", "wide", "lengths"])
def test_updates_and_combining(kind):
    rng = np.random.default_rng(2)
    x = {
        "plain": np.floor(256 * rng.normal(size=(300, 20))), "equal": np.ones((7, 5)), "axes": np.r_[np.eye(6), 2 * np.eye(6), np.zeros((3, 6))],
        "small": rng.integers(-1, 2, (60, 7)).astype(float), "wide": rng.normal(size=(4, 16)), "lengths": rng.normal(size=(90, 6)) * 10.0 ** np.arange(6),
    }[kind]
    parts = []
    for part in np.array_split(x, 3):
        s = Spectrum(x.shape[1])
        for v in part:
            s.add(v)
        check(part, s)
        parts.append(s)
    check(x, parts[0].combine(parts[1]).combine(parts[2]))


def test_deflated_updates_leave_orthogonal_vectors():
    values, vectors = np.array([1.0, 1.0, 1.0, 2.0, 2.0 + 1e-15]), np.eye(5)
    v = np.array([1.0, 1.0, 0.0, 1.0, 1.0])
    new, turned = rank_one(values, vectors, 0.5, v)
    want = np.diag(values) + 0.5 * np.outer(v, v)
    assert np.abs(turned * new @ turned.T - want).max() < 1e-13
    assert np.abs(turned.T @ turned - np.eye(5)).max() < 1e-13


def expected(x: np.ndarray, rows: list[tuple[int | None, np.ndarray]]) -> dict:
    fit = np.unique(x, axis=0)
    n, total = len(fit), [sum(int(v) for v in c) for c in fit.T]
    c = (fit * n - np.array(total)) / n
    e, w = np.linalg.eigh(c.T @ c / n)
    e, w = e[::-1], w[:, ::-1]
    return {"n": n, "e": e, "w": w, "rows": [(i, sum((n * int(a) - t) ** 2 for a, t in zip(v, total)), (v * n - np.array(total)) / n @ w[:, :4] / np.sqrt(e[:4])) for i, v in rows]}


def test_query_equals_plain_eigenvectors(spark):
    sf = "/root/testdata/sf0.001"
    got = queries()["op12_whitening"](spark, sf).orderBy("vec_id", "component").collect()
    raw = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()]
    ok = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in raw if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    want = expected(np.stack([v for _, v in ok]), ok)
    assert [(r["vec_id"], r["component"]) for r in got] == [(i, c) for i, _ in ok for c in (1, 2, 3, 4)]
    white = np.array([r["whitened"] for r in got]).reshape(-1, 4)
    plain = np.stack([w for _, _, w in want["rows"]])
    sign = np.sign((white * plain).sum(axis=0))
    assert np.abs(white - plain * sign).max() < 1e-9
    assert [r["deviation"] for r in got[::4]] == [d for _, d, _ in want["rows"]]
    assert {r["n"] for r in got} == {want["n"]}
    for k in range(4):
        assert abs(got[k]["explained"] - want["e"][k] / want["e"].sum()) < 1e-12
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_edges(spark):
    """Null ids, vectors and components, other lengths, repeated rows, ties and clashing names."""
    rng = np.random.default_rng(5)
    vectors = [[float(v) for v in rng.normal(size=5)] for _ in range(40)]
    rows = [(k if k else None, v) for k, v in enumerate(vectors)] + [(90, vectors[3]), (3, vectors[3]), (2**62 + 1, vectors[4])]
    bad = [(91, None), (92, [1.0, None, 0.0, 0.0, 0.0]), (93, [float("nan")] * 5), (94, [1.0] * 4), (95, []), (96, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + bad], "vec_id long, embedding array<double>, x int, n int").repartition(5)
    got = whitening.whiten(df).collect()
    assert len(got) == 4 * len(rows) and {r["n"] for r in got} == {40}
    assert {r["vec_id"] for r in got} == {i for i, _ in rows}
    assert all(r["identity_error"] < 1e-9 for r in got)
    assert whitening.whiten(df.limit(0)).collect() == []
    equal = whitening.whiten(spark.createDataFrame([(k, [0.5, 0.25]) for k in range(3)], "vec_id long, embedding array<double>")).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in equal] == [(c, 1, 0, None, None) for _ in range(3) for c in (1, 2)]
    line = whitening.whiten(spark.createDataFrame([(k, [0.5 * k, 0.25]) for k in range(4)], "vec_id long, embedding array<double>")).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line) and line[0]["explained"] == 1.0
    huge = whitening.whiten(spark.createDataFrame([(k, [1e15 * (k + 1), 1.0]) for k in range(4)], "vec_id long, embedding array<double>")).collect()
    assert {r["deviation"] for r in huge} == {None}
