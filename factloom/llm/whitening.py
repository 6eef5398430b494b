"""Whitening of embeddings by matrix-free block subspace iteration.

No covariance matrix is gathered for its own sake: a pass over the rows computes X'(XQ) for a block Q of directions, where X
holds the centred rows. Each partition sends one sum, and Spark adds these by place. On the driver, where only matrices of
(dimensions x block) are, Rayleigh-Ritz in the block gives approximate eigenpairs and their residuals; the next block is the
best vectors so far, their residuals and the best of the round before, made orthonormal by QR (so that the space holds the next
step of plain subspace iteration, and needs far fewer passes where eigenvalues are close). It ends when the residuals certify all
k components: that of a component is below ``tolerance`` times its distance to the nearest other eigenvalue, which bounds the
error of its direction, or at the rounding of a pass. A round limit raises; it never returns what is not certified.

Entries become integers (``floor(1024 c) + 100000``), so sums and deviations are exact. A row is centred as (n x - S) / n, an
exact integer before the division, and before anything is multiplied.

Defined cases: rows whose vector is null, empty, or has a null or non-finite entry are dropped, and so are those whose length
isn't the most frequent one; an entry beyond 2^40 raises, as its integer form would not stay exact; repeated rows and
rows without an identifier are rows like others; directions in which the rows don't differ (an eigenvalue below 1e-12 of the
largest) are no components, so equal rows and an empty table give an empty result; a deviation that doesn't fit 64 bits is
null; columns of other names are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import settle
from factloom.llm.vectors import finite, list_array, main_length, matrix

#: Fixed by the contract.
SCALE, OFFSET = 1024, 100_000
LARGEST = 1 << 40


@dataclass
class Whitening:
    """A fitted transformation: n rows, their sums S, components as columns, eigenvalues, the trace, passes taken."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    passes: int
    residuals: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """The whitened rows: one column a component."""
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)


def integers(embeddings: DataFrame) -> DataFrame:
    """Rows (vec_id, x) that take part, written once: every pass reads them."""
    kept = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("x")).where(finite(F.col("x")))
    d = main_length(kept, "x")
    whole = F.transform("x", lambda c: F.when(F.abs(c.cast("double")) <= LARGEST, F.floor(c.cast("double") * SCALE) + OFFSET).otherwise(F.raise_error(F.lit("an entry is beyond 2^40"))).cast("long"))
    return settle(kept.where(F.size("x") == d).select("vec_id", whole.alias("x")))


def summed(rows: DataFrame, part, kind: str) -> dict[int, int | float]:
    """The sums, by place, of the arrays that ``part`` makes of each batch's matrix: one array a partition leaves a task."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(matrix(batch.column(0), np.int64))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], ["sums"])

    sums = rows.select("x").mapInArrow(run, f"sums array<{kind}>")
    return {r["pos"]: r["total"] for r in sums.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("total")).collect()}


def _array(sums: dict, shape: tuple, dtype=np.float64) -> np.ndarray:
    return np.array([sums[i] for i in range(len(sums))], dtype).reshape(shape)


def _orthonormal(blocks: list[np.ndarray]) -> np.ndarray:
    """An orthonormal basis of the span, without directions that are rounding only; the first block's come first."""
    basis = blocks[0][:, :0]
    for block in blocks:
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 0] / size[size > 0]
        for _ in range(2):
            block = block - basis @ (basis.T @ block)
        q, r = np.linalg.qr(block)
        basis = np.hstack([basis, q[:, np.abs(np.diag(r)) > 1e-10]])[:, : len(basis)]
        basis = np.linalg.qr(basis)[0]
    return basis


def fit(rows: DataFrame, k: int = 8, block: int = 32, tolerance: float = 1e-9, most_passes: int = 500) -> Whitening | None:
    """The first k components of ``rows`` (see ``integers``); None if there is no row."""
    first = summed(rows, lambda x: np.r_[len(x), x.sum(0)], "bigint")
    if not first:
        return None
    n, sums = int(first[0]), _array(first, (-1,), np.int64)[1:]
    d = len(sums)
    best, before = np.linalg.qr(np.random.default_rng(0).normal(size=(d, min(d, max(block, 2 * k)))))[0], None
    basis = best
    for passes in range(1, most_passes + 1):

        def product(x: np.ndarray, q=basis) -> np.ndarray:
            y = (n * x - sums) / n
            return np.r_[(y.T @ (y @ q)).ravel(), (y * y).sum()]

        got = _array(summed(rows, product, "double"), (-1,)) / n
        image, trace = got[:-1].reshape(basis.shape), float(got[-1])
        values, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors = basis @ turn
        rest = image @ turn - vectors * values
        residual = np.linalg.norm(rest, axis=0)
        top = max(values[0], 0.0)
        real = int((values[: min(k, len(values))] > 1e-12 * max(top, 1e-300)).sum()) if trace > 0 else 0
        apart = np.array([min((abs(values[i] - values[j]) for j in range(len(values)) if j != i), default=top) for i in range(real)])
        # in the whole space there is nothing that the block could have missed
        if len(values) == d or not real and trace == 0 or bool((residual[:real] <= np.maximum(tolerance * apart, 4e-15 * d * top)).all() and real):
            vectors = vectors[:, :real]
            sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(real)]) if real else np.ones(0)
            return Whitening(n, sums, vectors * sign, values[:real], trace, passes, residual[:real])
        width = best.shape[1]
        before, best = best, vectors[:, :width]
        basis = _orthonormal([best, rest[:, :width], before])
    raise RuntimeError(f"{k} components are not certified after {most_passes} passes")


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """The exact sum of (n x - S)^2 over a row's dimensions."""
    y = n * x - sums
    if not len(y) or float(np.abs(y).max()) ** 2 * y.shape[1] < 2.0**62:
        return pa.array((y * y).sum(1) if len(y) else [], pa.int64())
    exact = [sum(int(v) * int(v) for v in row) for row in y]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over all rows."""

    def part(x: np.ndarray) -> np.ndarray:
        z = w.scaled(x)
        return np.r_[z.sum(0), (z.T @ z).ravel()]

    k = len(w.eigenvalues)
    got = _array(summed(rows, part, "double"), (-1,)) / w.n
    return float(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max())


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, w: Whitening | None) -> DataFrame:
    """A row for each of ``rows`` and component."""
    k = 0 if w is None else len(w.eigenvalues)
    if not k:
        return rows.sparkSession.createDataFrame([], SCHEMA)
    error, explained = identity_error(rows, w), w.eigenvalues / w.trace

    def run(batches):
        for batch in batches:
            x, m = matrix(batch.column("x"), np.int64), batch.num_rows
            if m:
                each = pa.array(np.repeat(np.arange(m), k))
                columns = [batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n)), deviations(x, w.n, w.sums).take(each)]
                columns += [pa.array(w.scaled(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(columns, SCHEMA.replace(",", "").split()[::2])

    return rows.mapInArrow(run, SCHEMA)


def transformed(rows: DataFrame, w: Whitening) -> DataFrame:
    """``rows`` (vec_id, x) with their whitened vector as one array: what a search index or a training job takes."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), list_array(w.scaled(matrix(batch.column("x"), np.int64)))], ["vec_id", "whitened"])

    return rows.mapInArrow(run, "vec_id long, whitened array<double>")


def op12_embedding_whitening(spark, sf_dir):
    rows = integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return whitened(rows, fit(rows))
