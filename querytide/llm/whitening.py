"""Whitening of embeddings by incremental eigendecomposition.

Each task keeps the spectrum of its centred vectors and takes them in by rank-one updates: the new
eigenvalues are the roots of a secular equation, after directions that an update leaves alone
have been deflated. Spectra are combined in a tree, one's eigenpairs being the other's updates. A
last distributed Rayleigh-Ritz step measures the covariance in the basis found and turns it to
the eigenvectors. What a task or the driver holds is a few matrices of the vectors' dimension.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querytide.llm.common import prepare
from querytide.session import write_and_read

OUTPUT_SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)
#: Entries from here on do not fit a long when scaled, and count as not finite.
TOO_LARGE = 2.0**55


@dataclass(frozen=True)
class WhiteningParams:
    """Scaling of entries, number of components, and the sizes that bound a task's work."""

    components: int = 16
    scale: int = 64
    shift: int = 1_000_000
    #: Vectors that are condensed by QR to as many as they have dimensions, with the same scatter,
    #: before they are taken in one by one.
    condensed: int = 4096
    #: Spectra that one task combines.
    fan: int = 16
    #: Directions with a smaller share of the largest eigenvalue have no variance and are left out.
    least_share: float = 1e-13


# --- one spectrum -------------------------------------------------------------------------


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + sum(weights / (poles - x)), as the index of the nearest pole and the distance.

    `poles` rise and `weights` are positive, so there is a root after every pole. Each is found
    in coordinates around the nearer of its two poles, by fitting both poles' sides with a
    rational function, and by halving its interval where that leads out of it.
    """
    k = len(poles)
    index = np.arange(k)
    upper = np.append(poles[1:], poles[-1] + weights.sum())
    middle = (upper - poles) / 2
    at_middle = 1 + (weights / ((poles[None, :] - poles[:, None]) - middle[:, None])).sum(axis=1)
    nearest = np.where((at_middle >= 0) | (index == k - 1), index, index + 1)
    gaps = poles[None, :] - poles[nearest][:, None]  # from the nearest pole to every pole
    low = np.where(nearest == index, 0.0, -middle)
    high = np.where(nearest == index, np.where(at_middle >= 0, middle, upper - poles), 0.0)
    x = (low + high) / 2
    left = index[None, :] <= index[:, None]
    own = gaps[index, index]
    after = np.where(index < k - 1, gaps[index, np.minimum(index + 1, k - 1)], np.inf)
    for _ in range(80):
        terms = weights / (gaps - x[:, None])
        slopes = terms / (gaps - x[:, None])
        value = 1 + terms.sum(axis=1)
        small = np.abs(value) <= 4e-16 * k * (1 + np.abs(terms).sum(axis=1))
        low, high = np.where(value < 0, x, low), np.where(value > 0, x, high)
        narrow = high - low <= 4e-16 * np.abs(x)
        if (small | narrow).all():
            break
        rise_left, rise = np.where(left, slopes, 0.0).sum(axis=1), slopes.sum(axis=1)
        to_own, to_after = own - x, after - x
        with np.errstate(all="ignore"):
            # a root of c + s / (to_own - step) + t / (to_after - step)
            c = value - to_own * rise_left - np.where(np.isinf(after), 0.0, to_after * (rise - rise_left))
            a = (to_own + to_after) * value - to_own * to_after * rise
            b = to_own * to_after * value
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            last = to_own + to_own * to_own * rise / c  # no pole after the last
            moved = x + np.where(np.isinf(after), last, step)
        inside = np.isfinite(moved) & (moved > low) & (moved < high)
        x = np.where(small | narrow, x, np.where(inside, moved, (low + high) / 2))
    return nearest, x


class Spectrum:
    """Eigenvalues, rising, and eigenvectors of a sum of outer products."""

    def __init__(self, dimension: int):
        self.values, self.vectors = np.zeros(dimension), np.eye(dimension)

    def update(self, vector: np.ndarray) -> None:
        """Add the outer product of a vector with itself."""
        z = self.vectors.T @ vector
        size = z @ z
        if not size:
            return
        least = 8 * np.finfo(float).eps * max(self.values[-1], size)
        self._deflate_equal(z, least)
        # An update hardly moves a direction that it hardly touches.
        kept = np.flatnonzero(np.abs(z) * np.sqrt(size) > least)
        if not len(kept):
            return
        poles = self.values[kept]
        nearest, distance = secular_roots(poles, z[kept] ** 2)
        apart = poles[nearest][:, None] - poles[None, :] + distance[:, None]  # root less pole
        # The update that has exactly these roots; its eigenvectors are orthogonal.
        k = len(kept)
        index = np.arange(k)
        below = index[:, None] < index[None, :]
        other = np.where(below, poles[:, None], np.append(poles[1:], 0.0)[:, None]) - poles[None, :]
        other[-1] = 1.0
        exact = np.sqrt(np.abs((apart / other).prod(axis=0))) * np.sign(z[kept])
        turned = exact[:, None] / -apart.T
        turned /= np.linalg.norm(turned, axis=0)
        self.values[kept] = poles[nearest] + distance
        self.vectors[:, kept] = self.vectors[:, kept] @ turned
        order = np.argsort(self.values, kind="stable")
        self.values, self.vectors = self.values[order], self.vectors[:, order]

    def _deflate_equal(self, z: np.ndarray, least: float) -> None:
        """Turn directions with equal eigenvalues so that the update touches one of them."""
        start = 0
        for end in range(1, len(z) + 1):
            if end < len(z) and self.values[end] - self.values[start] <= least:
                continue
            if end - start > 1:
                part = z[start:end]
                length = np.linalg.norm(part)
                mirror = part.copy()
                mirror[0] += np.copysign(length, part[0])
                if mirror @ mirror:
                    group = self.vectors[:, start:end]
                    group -= np.outer(group @ mirror, mirror) * (2 / (mirror @ mirror))
                z[start] = -np.copysign(length, part[0])
                z[start + 1 : end] = 0
            start = end

    def take_in(self, rows: np.ndarray) -> None:
        """Add the outer products of all rows; many rows are condensed first."""
        if len(rows) > len(self.values):
            rows = np.linalg.qr(rows, mode="r")
        for row in rows:
            self.update(row)

    def pairs(self) -> np.ndarray:
        """Rows whose outer products add up to what the spectrum holds."""
        held = self.values > 0
        return np.sqrt(self.values[held])[:, None] * self.vectors[:, held].T


# --- all vectors --------------------------------------------------------------------------


def _tree(partials: DataFrame, merge: Callable[[list[bytes]], bytes], fan: int) -> bytes | None:
    """Merge `data` of all rows, `fan` at a time and then their results, to one."""
    partials = write_and_read(partials, "partials")
    number = partials.count()

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        slot = int(frame["slot"].iloc[0])
        return pd.DataFrame({"slot": [slot], "data": [merge(list(frame["data"]))]})

    while number > 1:
        slot = F.floor(F.col("slot") / F.lit(fan)).cast("long")
        partials = write_and_read(
            partials.withColumn("slot", slot).groupBy("slot").applyInPandas(merged, "slot long, data binary"), "partials"
        )
        number = partials.count()
    found = partials.collect()
    return bytes(found[0]["data"]) if found else None


def _matrices(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield np.asarray(batch.column("x").flatten()).reshape(-1, dimension)


@dataclass(frozen=True)
class Whitener:
    """What was fitted: `n` and the exact sums of shifted vectors, eigenvectors and eigenvalues."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Rows less the mean; the numerators are exact wherever they are longs."""
        return self.numerators(x).astype(float) / self.n

    def numerators(self, x: np.ndarray) -> np.ndarray:
        sums = np.array(self.sums, object)
        most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * self.n + max(map(abs, self.sums), default=0)
        if most < 2**62:
            return x * self.n - sums.astype("i8")
        return x.astype(object) * self.n - sums


def scaled(rows: DataFrame, params: WhiteningParams = WhiteningParams()) -> DataFrame:
    """`vec_id` and `x`, each entry scaled, rounded down, less the shift that the contract's x has.

    Rows are left out whose vector is null, empty or holds entries that are null, not finite or
    too large for a long. So are vectors of another length than most rows have (of the longer of
    two as frequent). Repeated rows stay; other columns are not read.
    """
    vectors = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(TOO_LARGE)))
    vectors = vectors.filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(fine, F.lit(False)))
    lengths = vectors.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("rows"))
    usual = lengths.orderBy(F.desc("rows"), F.desc("length")).first()
    x = F.transform("v", lambda e: F.floor(e * F.lit(float(params.scale))).cast("long"))
    return vectors.filter(F.size("v") == F.lit(usual["length"] if usual else 0)).select("vec_id", x.alias("x"))


def fit(vectors: DataFrame, params: WhiteningParams = WhiteningParams()) -> Whitener | None:
    """Fit on each distinct `x` once; None without vectors."""
    spark = vectors.sparkSession
    prepare(spark)
    fitted = write_and_read(vectors.select("x").distinct(), "fit")
    some = fitted.first()
    if some is None:
        return None
    dimension = len(some["x"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = 0, np.zeros(dimension, object)
        for x in _matrices(batches, dimension):
            number += len(x)
            fits = max(abs(int(x.max())), abs(int(x.min()))) * len(x) < 2**62
            total = total + (x if fits else x.astype(object)).sum(axis=0).astype(object)
        places = list(range(-1, dimension))
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array([str(v) for v in (number, *total)])], ["place", "total"])

    totals = fitted.mapInArrow(sums, "place int, total string").groupBy("place")
    exact = {r["place"]: int(r["total"]) for r in totals.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    n = exact[-1]
    start = Whitener(n, tuple(exact[k] for k in range(dimension)), np.eye(dimension), np.ones(dimension), 1.0, 0.0)

    def whole(batches: Iterator[pa.RecordBatch], function: Callable[[Iterator[np.ndarray]], np.ndarray]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId()
        data = function(start.centred(x) for x in _matrices(batches, dimension)).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([data], pa.binary())], ["slot", "data"])

    def spectrum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_rows(blocks: Iterator[np.ndarray]) -> np.ndarray:
            held, waiting = Spectrum(dimension), []
            for block in blocks:
                waiting.append(block)
                if sum(map(len, waiting)) >= params.condensed:
                    held.take_in(np.concatenate(waiting))
                    waiting = []
            if waiting:
                held.take_in(np.concatenate(waiting))
            return held.pairs()

        return whole(batches, of_rows)

    def united(spectra: list[bytes]) -> bytes:
        held = Spectrum(dimension)
        for data in spectra:
            for row in np.frombuffer(data).reshape(-1, dimension):
                held.update(row)
        return held.pairs().tobytes()

    def added(matrices: list[bytes]) -> bytes:
        return np.sum([np.frombuffer(data) for data in matrices], axis=0).tobytes()

    def scatter(basis: np.ndarray) -> np.ndarray:
        """The covariance of the fit list in a basis, measured over all of it."""

        def of_rows(blocks: Iterator[np.ndarray]) -> np.ndarray:
            total = np.zeros((basis.shape[1], basis.shape[1]))
            for block in blocks:
                projected = block @ basis
                total += projected.T @ projected
            return total

        measured = fitted.mapInArrow(lambda batches: whole(batches, of_rows), "slot long, data binary")
        data = _tree(measured, added, params.fan)
        return np.frombuffer(data).reshape(basis.shape[1], -1) / n

    data = _tree(fitted.mapInArrow(spectrum, "slot long, data binary"), united, params.fan)
    held = Spectrum(dimension)
    for row in np.frombuffer(data).reshape(-1, dimension):
        held.update(row)
    basis, _ = np.linalg.qr(held.vectors[:, ::-1])
    ritz = scatter(basis)
    values, turned = np.linalg.eigh((ritz + ritz.T) / 2)
    values, vectors = values[::-1], basis @ turned[:, ::-1]
    # A zero spectrum has no component at all.
    kept = [k for k in range(min(params.components, dimension)) if values[k] > max(values[0], 0) * params.least_share]
    values, vectors, trace = values[kept], vectors[:, kept], float(values.sum())
    error = float(np.abs(scatter(vectors / np.sqrt(values)) - np.eye(len(kept))).max()) if kept else 0.0
    return Whitener(n, start.sums, vectors, values, trace, error)


def apply(vectors: DataFrame, whitener: Whitener | None) -> DataFrame:
    """A row for each row of `vectors` and component.

    Eigenvectors and sums travel to the tasks; they have the size of the vectors' dimension times
    the components. `deviation` is null where it is no long. Directions without variance have no row.
    """
    spark = vectors.sparkSession
    if whitener is None or not len(whitener.values):
        return spark.createDataFrame([], OUTPUT_SCHEMA)
    prepare(spark)
    k, dimension = len(whitener.values), len(whitener.sums)
    basis = whitener.vectors / np.sqrt(whitener.values)
    explained = whitener.values / whitener.trace

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("x").flatten()).reshape(-1, dimension)
            numerators = whitener.numerators(x)
            largest = max(abs(int(numerators.max())), abs(int(numerators.min())))
            if largest * largest * dimension >= 2**63:
                squares = (numerators.astype(object) ** 2).sum(axis=1)
                deviation = pa.array([int(s) if s < 2**63 else None for s in squares], pa.int64())
            else:
                deviation = pa.array((numerators.astype("i8") ** 2).sum(axis=1))
            rows = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(rows),
                    pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), len(x))),
                    pa.array(np.full(len(x) * k, whitener.n)),
                    deviation.take(rows),
                    pa.array((numerators.astype(float) / whitener.n @ basis).ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(x) * k, whitener.identity_error)),
                ],
                [c.split()[0] for c in OUTPUT_SCHEMA.split(", ")],
            )

    return vectors.select("vec_id", "x").mapInArrow(whiten, OUTPUT_SCHEMA)


def whiten(rows: DataFrame, params: WhiteningParams = WhiteningParams()) -> DataFrame:
    """Scale, fit and apply. An empty table, or one without a usable vector, gives no row."""
    vectors = scaled(rows, params)
    return apply(vectors, fit(vectors, params))
