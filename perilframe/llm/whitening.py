"""Whitening of embeddings by an incremental eigendecomposition.

The fit list is every distinct vector of integers once. Each partition of it keeps a spectrum (count, sum,
mean, eigenvalues, eigenvectors of the scatter about the mean) and takes its vectors in one at a time: a
centred rank-one update, whose new eigenvalues are the roots of a secular equation; directions that the
update leaves alone, and eigenvalues that are all but equal, are deflated before. Spectra are combined ``FAN`` at
a time: the smaller one's eigenpairs, and the difference of the means, are rank-one updates of the larger
one. What is left after the last round is one spectrum of d * d numbers. It is the basis of a Rayleigh-Ritz
step over the whole fit list: partitions add up centred products in that basis, and a d * d problem turns
the basis into the eigenvectors, to double precision whatever the updates have lost.

An update costs some d^3 operations, so that fitting is linear in the distinct vectors. Memory is d * d a
task. Sums are exact integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilframe.llm.common import checkpointing, one_thread, small_batches, stored

#: Spectra and sums that one task combines.
FAN = 16
COMPONENTS = 4
#: Eigenvalues below this share of the largest count as none.
FLOOR = 1e-13
_EPS = np.finfo(float).eps
_RESULT = "vec_id string, component int, n long, deviation long, whitened double, explained double, identity_error double"


# --- one rank-one update ------------------------------------------------------------------------


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + rho * sum(z2 / (d - x)) = 0, one in each gap of the rising d and one above: (origin, offset).

    A root is d[origin] + offset, its origin the nearer end of its gap, so that differences to d keep all digits.
    Steps solve the rational function with the poles of the gap that has the same value and slopes; a
    step out of the bracket is halved instead.
    """
    k = len(d)
    at, top = np.arange(k), d[-1] + rho * z2.sum()
    above = np.r_[d[1:], top]
    width = above - d
    middle = 1 + rho * (z2 / (d - (d + width / 2)[:, None])).sum(axis=1)
    near = middle >= 0
    origin = np.where(near | (at == k - 1), at, np.minimum(at + 1, k - 1))
    delta = d[None, :] - d[origin][:, None]
    low, high = np.where(near, 0.0, -width / 2), np.where(near, width / 2, 0.0)
    if not near[-1]:
        low[-1], high[-1] = width[-1] / 2, width[-1] * (1 + 4 * _EPS)
    x = (low + high) / 2
    lower = at[None, :] <= at[:, None]
    right = np.minimum(at + 1, k - 1)
    for _ in range(100):
        gap = delta - x[:, None]
        term = rho * z2 / gap
        value = 1 + term.sum(axis=1)
        size = 1 + np.abs(term).sum(axis=1)
        low, high = np.where(value < 0, x, low), np.where(value < 0, high, x)
        open_ = (np.abs(value) > 4 * _EPS * size) & (high - low > 2 * _EPS * np.maximum(np.abs(low), np.abs(high)))
        if not open_.any():
            break
        slope = term / gap
        below = np.where(lower, slope, 0.0).sum(axis=1)
        over = slope.sum(axis=1) - below
        a, b = gap[at, at], gap[at, right]
        with np.errstate(all="ignore"):
            c = value - a * below - b * over
            p = (a + b) * value - a * b * (below + over)
            root = np.sqrt(np.maximum(p * p - 4 * a * b * value * c, 0))
            step = np.where(p > 0, 2 * a * b * value / (p + root), (p - root) / (2 * c))
            step[-1] = a[-1] + below[-1] * a[-1] ** 2 / (value[-1] - a[-1] * below[-1])
        new = x + step
        fine = np.isfinite(new) & (new > low) & (new < high)
        x = np.where(open_, np.where(fine, new, (low + high) / 2), x)
    return origin, x


def rank_one(values: np.ndarray, vectors: np.ndarray, rho: float, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of vectors @ diag(values) @ vectors.T + rho * v v.T, for rho >= 0."""
    z = vectors.T @ v
    norm = float(z @ z)
    rho = rho * norm
    if not rho > 0:
        return values, vectors
    z = z / np.sqrt(norm)
    tolerance = 8 * _EPS * max(abs(values[0]), abs(values[-1]), rho)
    live = np.flatnonzero(rho * np.abs(z) > tolerance)
    if len(live) > 1:
        d, w = values[live], z[live]
        if (np.diff(d) * np.abs(w[1:] * w[:-1]) <= tolerance * (w[1:] ** 2 + w[:-1] ** 2)).any():
            values, vectors, z = values.copy(), vectors.copy(), z.copy()
            i = live[0]
            for j in live[1:]:  # all but equal neighbours: turn them so that one has no share in the update
                r = np.hypot(z[i], z[j])
                c, s = z[j] / r, z[i] / r
                if abs((values[j] - values[i]) * c * s) <= tolerance:
                    vi, vj = vectors[:, i].copy(), vectors[:, j].copy()
                    vectors[:, i], vectors[:, j] = c * vi - s * vj, s * vi + c * vj
                    values[i], values[j] = values[i] * c * c + values[j] * s * s, values[i] * s * s + values[j] * c * c
                    z[i], z[j] = 0.0, r
                i = j
            live = np.flatnonzero(rho * np.abs(z) > tolerance)
            live = live[np.argsort(values[live], kind="stable")]
    if not len(live):
        return values, vectors
    d = values[live]
    origin, x = secular_roots(d, z[live] ** 2, rho)
    gap = (d[None, :] - d[origin][:, None]) - x[:, None]  # d_j - root_i
    apart = d[:, None] - d[None, :]
    np.fill_diagonal(apart, 1.0)
    # The z for which these roots are exact: its vectors are orthogonal however near roots are.
    exact = np.sqrt(np.abs(np.prod(-gap / apart, axis=0)) / rho) * np.sign(z[live])
    turn = (exact[None, :] / gap).T
    turn /= np.sqrt((turn * turn).sum(axis=0))
    new_values, new_vectors = values.copy(), vectors.copy()
    new_values[live] = d[origin] + x
    new_vectors[:, live] = vectors[:, live] @ turn
    order = np.argsort(new_values, kind="stable")
    return new_values[order], new_vectors[:, order]


class Spectrum:
    """n vectors: their mean, and eigenvalues and eigenvectors of their scatter about it."""

    def __init__(self, d: int):
        self.n, self.mean, self.values, self.vectors = 0, np.zeros(d), np.zeros(d), np.eye(d)

    def add(self, x: np.ndarray) -> None:
        off = x - self.mean
        self.n += 1
        self.mean = self.mean + off / self.n
        self.values, self.vectors = rank_one(self.values, self.vectors, (self.n - 1) / self.n, off)

    def combine(self, other: Spectrum) -> Spectrum:
        a, b = (self, other) if self.n >= other.n else (other, self)
        out = Spectrum(len(a.mean))
        out.n, out.values, out.vectors = a.n + b.n, a.values, a.vectors
        for value, vector in zip(b.values, b.vectors.T):
            out.values, out.vectors = rank_one(out.values, out.vectors, max(value, 0.0), vector)
        off = b.mean - a.mean
        out.values, out.vectors = rank_one(out.values, out.vectors, a.n * b.n / max(out.n, 1), off)
        out.mean = a.mean + off * (b.n / max(out.n, 1))
        return out

    def row(self) -> dict:
        return {"n": [self.n], "mean": [self.mean.tobytes()], "eigenvalues": [self.values.tobytes()], "eigenvectors": [np.ascontiguousarray(self.vectors).tobytes()]}

    @staticmethod
    def of(row) -> Spectrum:
        out = Spectrum(len(row["mean"]) // 8)
        out.n = int(row["n"])
        out.mean, out.values = (np.frombuffer(bytes(row[c]), float).copy() for c in ("mean", "eigenvalues"))
        out.vectors = np.frombuffer(bytes(row["eigenvectors"]), float).reshape(len(out.mean), -1).copy()
        return out


# --- exact integers --------------------------------------------------------------------------------


def sums(x: np.ndarray) -> list[int]:
    """Exact sums of a column of long vectors."""
    high = x >> 32
    return [(int(h) << 32) + int(low) for h, low in zip(high.sum(axis=0), (x - (high << 32)).sum(axis=0))]


def scaled(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - total, exactly: as longs if they fit, else as Python integers."""
    most = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max((abs(s) for s in total), default=0)
    if most < 2**62:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    return (scaled(x, n, total) / n).astype(float)


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """The exact sum of squares of n * x - total; None if it doesn't fit a long."""
    off = scaled(x, n, total)
    if off.dtype == np.int64 and float(np.abs(off).max(initial=0)) ** 2 * off.shape[1] < 2**62:
        return (off * off).sum(axis=1).tolist()
    every = [sum(int(v) ** 2 for v in row) for row in off]
    return [v if v < 2**63 else None for v in every]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in column])


# --- Spark -----------------------------------------------------------------------------------------


def integers(df: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, x array<long>): floor(scale * component) of vectors without null or non-finite components."""
    v = F.transform("embedding", lambda c: c.cast("double"))
    rows = df.where("embedding is not null and size(embedding) > 0").select("vec_id", v.alias("v")).where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (usual[0]["d"] if usual else 0)).select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("long")).alias("x"))


def _folded(rows: DataFrame, fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str, parts: int):
    """One row of partitions' rows (part, ...), folded FAN at a time; None of none."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        one_thread()
        return fold(frame.sort_values("part")).assign(part=int(frame["part"].iloc[0]) // FAN)[list(frame.columns)]

    while True:
        rows = rows.groupBy(F.floor(F.col("part") / FAN).alias("_group")).applyInPandas(run, schema)
        if parts <= FAN:
            return rows.first()
        parts = -(-parts // FAN)


_SPECTRUM = "part long, n long, sums array<string>, mean binary, eigenvalues binary, eigenvectors binary"


def spectrum(fit: DataFrame) -> tuple[Spectrum, list[int]] | None:
    """The spectrum and the exact sums of a stored table of vectors x; None of none."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_thread()
        own, total = None, None
        for frame in frames:
            if not len(frame):
                continue
            x = _matrix(frame["x"])
            own = own or Spectrum(x.shape[1])
            total = [a + b for a, b in zip(total or [0] * x.shape[1], sums(x))]
            for v in x.astype(float):
                own.add(v)
        if own is not None:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "sums": [[str(s) for s in total]]} | own.row())[["part", "n", "sums", "mean", "eigenvalues", "eigenvectors"]]

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.to_dict("records")
        own, total = Spectrum.of(rows[0]), [int(s) for s in rows[0]["sums"]]
        for r in rows[1:]:
            own, total = own.combine(Spectrum.of(r)), [a + int(b) for a, b in zip(total, r["sums"])]
        return pd.DataFrame({"sums": [[str(s) for s in total]]} | own.row())

    found = _folded(fit.mapInPandas(scan, _SPECTRUM), fold, _SPECTRUM, fit.rdd.getNumPartitions())
    return (Spectrum.of(found), [int(s) for s in found["sums"]]) if found is not None else None


def _products(fit: DataFrame, basis: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """The covariance over the fit list of its centred vectors in a basis."""
    schema, k = "part long, data binary", basis.shape[1]

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_thread()
        own = np.zeros((k, k))
        for frame in frames:
            if len(frame):
                y = centred(_matrix(frame["x"]), n, total) @ basis
                own += y.T @ y
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "data": [own.tobytes()]})

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"data": [np.sum([np.frombuffer(bytes(x), float) for x in frame["data"]], axis=0).tobytes()]})

    found = _folded(fit.mapInPandas(scan, schema), fold, schema, fit.rdd.getNumPartitions())
    return np.frombuffer(bytes(found["data"]), float).reshape(k, k) / n


def ritz(fit: DataFrame, basis: np.ndarray, n: int, total: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors of the fit list's covariance within the span of a basis."""
    basis, _ = np.linalg.qr(basis)
    values, turn = np.linalg.eigh(_products(fit, basis, n, total))
    return np.maximum(values[::-1], 0.0), (basis @ turn)[:, ::-1]


def whiten(df: DataFrame, components: int = COMPONENTS, scale: float = 256.0) -> DataFrame:
    """A row for each usable vector of df (vec_id, embedding) and each of its first components.

    (vec_id, component from 1, n, deviation, whitened, explained, identity_error); see the module. Vectors
    that are null or empty, hold null or non-finite components, or haven't the usual (most frequent) length
    are left out. Rows that repeat a vector count once in the fit, and have a row for each here; a null
    vec_id stays null. A component without variance (all vectors equal, or fewer of them than dimensions)
    has a null ``whitened`` and no share in identity_error; without any variance ``explained`` and
    identity_error are null. Of equal eigenvalues any eigenvectors are taken, the same for all rows. A
    deviation that doesn't fit a long is null. No rows give none; other columns are not looked at.
    """
    spark = df.sparkSession
    checkpointing(spark)
    small_batches(spark)
    rows = stored(integers(df, scale), "vectors")
    fit = stored(rows.select("x").distinct(), "fit")
    found = spectrum(fit)
    if found is None:
        return spark.createDataFrame([], _RESULT).withColumn("vec_id", F.col("vec_id").cast("long"))
    own, total = found
    n = own.n
    values, vectors = ritz(fit, own.vectors, n, total)
    k = min(components, len(values))
    live = np.flatnonzero(values[:k] > FLOOR * max(values[0], 0.0))
    to = np.zeros((len(values), k))
    to[:, live] = vectors[:, live] / np.sqrt(values[live])
    error = float(np.abs(_products(fit, to[:, live], n, total) - np.eye(len(live))).max()) if len(live) else None
    explained = (values[:k] / values.sum()).tolist() if len(live) else [None] * k
    dead = [c for c in range(k) if c not in live]

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_thread()
        for frame in frames:
            m = len(frame)
            if not m:
                continue
            x = _matrix(frame["x"])
            y = centred(x, n, total) @ to
            y[:, dead] = np.nan
            white = pd.array(y.ravel(), dtype="Float64")
            white[np.isnan(y.ravel())] = pd.NA
            yield pd.DataFrame({
                "vec_id": frame["vec_id"].repeat(k).array, "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m), "n": n,
                "deviation": pd.array(np.repeat(np.array(deviations(x, n, total), object), k), dtype="Int64"), "whitened": white,
                "explained": pd.array(explained * m, dtype="Float64"), "identity_error": pd.array([error] * (m * k), dtype="Float64"),
            })

    out = rows.select(F.col("vec_id").cast("string"), "x").mapInPandas(project, _RESULT)  # as strings: pandas turns longs with nulls into doubles
    return out.withColumn("vec_id", F.col("vec_id").cast("long"))
