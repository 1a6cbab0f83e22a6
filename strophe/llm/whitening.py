"""Whitening of embeddings by a polarisation covariance.

Entries become integers, so every sum is exact. For each dimension and for each pair of dimensions the squares of the
centred values, x[i] and x[i] + x[j], are summed in tasks; as

    cov(a, b) = (var(a + b) - var(a) - var(b)) / 2,

differences of these variances are all covariances. They are whole numbers over a common divisor, rounded once to
doubles, assembled for ``eigh`` in the driver. Centring is by the nearest whole number to the mean, which keeps the
squares small; the rest of it is taken off exactly afterwards. A fit list has each distinct vector once; projecting is
a scan of the table.

The driver holds a matrix of dimensions times dimensions and its sums, which do not grow with the rows.

Defined cases: rows whose vector is null or holds null or non-finite entries have no result; vectors of each other length
are whitened apart, by their own fit list, and empty ones have no components; entries beyond 2 ** 62 / 64 are taken as
that; a component without variance (its eigenvalue within rounding of nothing) has whitened null and takes no part in
identity_error, which is null if no component has any; a deviation that no long holds is null; null ids and repeated
rows have a row each for every component; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, scratch
from .exact_sums import NAMES, joined, schema, small, split, summed

COMPONENTS, SCALE, OFFSET = 16, 64, 1_000_000
#: Entries whose squares are summed at a time, and the largest centred value whose sums' squares they can add up in 64 bits.
ENTRIES, FITS = 1 << 18, 1 << 20
_LIMIT = 1 << 62
#: Share of the largest eigenvalue below which there is no variance.
NOTHING = 1e-12


def whole(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """floor(scale * c) + offset of each entry c, as double."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(_LIMIT))), F.lit(-float(_LIMIT)))) + offset)


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def rows_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of the vectors (no nulls among them): the length, the rows' places and the entries as a matrix."""
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(ends)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield int(d), at, flat[ends[at][:, None] + np.arange(d)]


@dataclass(frozen=True)
class Whitener:
    """How vectors of one length are whitened: number and sums of the fit list, whole centres, components as columns."""

    n: int
    total: list[int]
    centre: list[int]
    components: np.ndarray
    roots: np.ndarray
    explained: np.ndarray

    @property
    def rest(self) -> list[int]:
        return [s - self.n * c for s, c in zip(self.total, self.centre, strict=True)]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return small(x, _LIMIT // 2) - np.array(self.centre, np.int64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """A column for each component; nan where it has no variance."""
        part = np.array([float(Fraction(r, self.n)) for r in self.rest])
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.roots > 0, (self.centred(x).astype(np.float64) - part) @ self.components / self.roots, np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        y = self.centred(x)
        most = self.n * (max(abs(int(y.max())), abs(int(y.min()))) + 1) if y.size else 0
        if most * most * x.shape[1] >= 1 << 63:
            y = y.astype(object)
        z = y * self.n - np.array(self.rest, y.dtype)
        return [v if v < 1 << 63 else None for v in (z * z).sum(1).tolist()]


def _accumulated(work: Callable[[int, np.ndarray], list[int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over x: the sums of work(length, some rows' matrix) over a task's rows, as limbs by length and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in rows_of(b["x"]):
                step = max(64, ENTRIES // max(1, d))
                for a in range(0, len(x), step):
                    got = np.array(work(d, x[a : a + step]), object)
                    found[d] = found[d] + got if d in found else got
        for d, got in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(got), pa.int32()), pa.array(range(len(got)), pa.int32()), *(pa.array(v, pa.int64()) for v in split(got.tolist()))], names=["d", "at", *NAMES])

    return run


def _totals(fit: DataFrame, work: Callable[[int, np.ndarray], list[int]]) -> dict[int, list[int]]:
    rows = summed(fit.mapInArrow(_accumulated(work), schema("d int, at int")), "d", "at").collect()  # a row for each length and place
    out: dict[int, dict[int, int]] = defaultdict(dict)
    for r in rows:
        out[r["d"]][r["at"]] = joined(r)
    return {d: [v[i] for i in range(len(v))] for d, v in out.items()}


def fitted(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Whitener]:
    """A whitener for each length of fit(x), which has each vector once."""

    def first(d: int, x: np.ndarray) -> list[int]:
        return [len(x), *small(x, _LIMIT >> 24).sum(0).tolist()]

    moments = {d: (v[0], v[1:]) for d, v in _totals(fit, first).items() if d}
    centres = {d: [(2 * s + n) // (2 * n) for s in total] for d, (n, total) in moments.items()}

    def squares(d: int, x: np.ndarray) -> list[int]:
        """For each dimension, then for each pair with a later one, the sum of squares."""
        if not d:
            return []
        y = small(small(x, _LIMIT // 2) - np.array(centres[d], np.int64), FITS)
        one = (y * y).sum(0).tolist()
        for i in range(d - 1):
            both = y[:, i + 1 :] + y[:, i : i + 1]
            one += (both * both).sum(0).tolist() if y.dtype == object else np.einsum("ij,ij->j", both, both).tolist()
        return one

    sums = _totals(fit, squares)
    return {d: _decomposed(n, total, centres[d], sums[d], components) for d, (n, total) in moments.items()}


def _decomposed(n: int, total: list[int], centre: list[int], sums: list[int], components: int) -> Whitener:
    d = len(total)
    rest = [s - n * c for s, c in zip(total, centre, strict=True)]
    var = [n * n * q - n * r * r for q, r in zip(sums, rest, strict=False)]  # n ** 3 times the variance, as all that follows
    matrix, at = np.empty((d, d)), d
    for i in range(d):
        matrix[i, i] = var[i] / n**3
        for j in range(i + 1, d):
            both = n * n * sums[at] - n * (rest[i] + rest[j]) ** 2
            matrix[i, j] = matrix[j, i] = (both - var[i] - var[j]) / (2 * n**3)
            at += 1
    e, v = np.linalg.eigh(matrix)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)  # the largest entry is positive
    trace = sum(var) / n**3
    real = e > NOTHING * max(e[0], 0)
    return Whitener(n, total, centre, v, np.where(real, np.sqrt(np.where(real, e, 0)), 0), np.where(real, e, 0) / trace if trace else np.full(len(e), np.nan))


def identity_error(fit: DataFrame, whiteners: dict[int, Whitener]) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance less the identity, over components with variance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in rows_of(b["x"]):
                if d and (whiteners[d].roots > 0).any():
                    w = whiteners[d].whitened(x)[:, whiteners[d].roots > 0]
                    w = np.concatenate((w, np.ones((len(w), 1))), 1)  # sums beside products
                    found[d] = found.get(d, 0) + w.T @ w
        for d, got in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * got.size, pa.int32()), pa.array(range(got.size), pa.int32()), pa.array(got.reshape(-1))], names=["d", "at", "v"])

    rows = fit.mapInArrow(run, "d int, at int, v double").groupBy("d", "at").agg(F.sum("v").alias("v")).collect()
    worst: float | None = None
    for d in {r["d"] for r in rows}:
        v = np.array([r["v"] for r in sorted((r for r in rows if r["d"] == d), key=lambda r: r["at"])])
        m = v.reshape(int(len(v) ** 0.5), -1) / whiteners[d].n
        worst = max(worst or 0.0, float(np.abs(m[:-1, :-1] - np.outer(m[-1, :-1], m[-1, :-1]) - np.eye(len(m) - 1)).max()))
    return worst


def whiten(table: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for table(vec_id, vector)."""
    rows = table.where(usable(F.col(vector))).select("vec_id", whole(F.col(vector)).alias("x"))
    with scratch(table.sparkSession):
        fit = materialize(rows.select("x").distinct(), "fit-list")
        whiteners = fitted(fit, components)
        error = identity_error(fit, whiteners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in rows_of(b["x"]):
                if not d:
                    continue
                one = whiteners[d]
                k, every = len(one.roots), np.repeat(at, len(one.roots))
                w = one.whitened(x).reshape(-1)
                share = np.tile(one.explained, len(at))
                columns = [
                    b["vec_id"].take(pa.array(every)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(every), one.n, np.int64)),
                    pa.array(one.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))),
                    pa.array(w, mask=np.isnan(w)),
                    pa.array(share, mask=np.isnan(share)),
                    pa.array([error] * len(every), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = table.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op12_polarisation_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))
