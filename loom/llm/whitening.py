"""Whitening of embeddings: exact integer means, a covariance in two passes, a symmetric eigensolver, a projection.

Entries become integers, so sums are exact and a mean doesn't depend on the order of rows.  The first
pass adds them up per dimension; the second centres each row with those sums before it multiplies,
adds outer products by one matrix product a batch, and ``treeAggregate`` merges the tasks' matrices,
so that the driver gets a few of d * d numbers.  LAPACK solves that matrix; the mean and d * 16
numbers go to the tasks with the projection.  What is sent grows with the dimension, never with rows.

Odd rows: a row whose vector is null, empty, or holds nulls, NaN or infinities is dropped.  Of
vectors of different lengths those of the commonest one (the longer of a tie) remain.  Repeated rows
are all returned, but a vector counts once in the fit.  Components without variance (below 1e-12 of
the largest) can't be scaled to one and are left out.  A deviation beyond a long is null.  Columns of
other names are ignored; an empty table, or a fit of one vector, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loom.llm.common import discard, materialise, released, small_batches, table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Entries stop here, so that they and their products with SCALE fit a long.
LARGEST = 2.0**62
#: A variance below this part of the largest is rounding.
LEAST_VARIANCE = 1e-12


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column without nulls and of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _quantised(scale: int, shift: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, xs = [], []
            for i, v in zip(batch.column(0), batch.column(1), strict=True):
                if v.is_valid and len(v.values) and not v.values.null_count:
                    c = v.values.to_numpy(zero_copy_only=False).astype(float)
                    if np.isfinite(c).all():
                        ids.append(i)
                        xs.append(np.clip(np.floor(scale * c), -LARGEST, LARGEST).astype(np.int64) + shift)
            yield pa.RecordBatch.from_arrays([pa.array([i.as_py() for i in ids], batch.schema.field(0).type), pa.array(xs, pa.list_(pa.int64()))], ["vec_id", "x"])

    return run


def quantised(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, x: floor(scale * entry) + shift of each vector that is whole, as longs."""
    kind = dict(vectors.dtypes)["vec_id"]
    return small_batches(vectors).select("vec_id", "embedding").mapInArrow(_quantised(scale, shift), f"vec_id {kind}, x array<long>")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's count and sums, exact: as text, for they can outgrow a long."""
    n, total = 0, 0
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0))
            small = abs(x).max() <= 2**62 // len(x)
            n, total = n + len(x), total + x.sum(0, dtype=None if small else object).astype(object)
    if n:
        yield pa.RecordBatch.from_pydict({"n": [n], "sums": [[str(s) for s in total]]})


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows of fit and the sums of each dimension of its column x."""
    zero = (0, None)
    add = lambda a, b: b if not a[0] else a if not b[0] else (a[0] + b[0], [p + q for p, q in zip(a[1], b[1], strict=True)])
    parts = fit.select("x").mapInArrow(_sums, "n long, sums array<string>").rdd.map(lambda r: (r.n, [int(s) for s in r.sums]))
    n, sums = parts.treeAggregate(zero, add, add)
    return n, sums or []


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: in longs where they hold it, else in Python's integers."""
    fits = n * int(abs(x).max(initial=0)) < 2**61 and max(map(abs, sums)) < 2**61
    return x * n - np.array(sums, np.int64) if fits else x.astype(object) * n - np.array(sums, object)


def _products(centred):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if batch.num_rows:
                c = centred(batch.column(0))
                total = total + c.T @ c
        if not isinstance(total, int):
            yield pa.RecordBatch.from_pydict({"products": [total.ravel().tolist()]})

    return run


def covariance(fit: DataFrame, column: str, centred, n: int, width: int) -> np.ndarray:
    """Sum of outer products over n; ``centred`` makes rows of numbers, less their means, of an Arrow column."""
    parts = fit.select(column).mapInArrow(_products(centred), "products array<double>").rdd.map(lambda r: np.array(r.products))
    return parts.treeAggregate(np.zeros(width * width), lambda a, b: a + b, lambda a, b: a + b).reshape(width, width) / n


class Whitening:
    """The fit: n, sums, variance, directions (columns) and trace; a few arrays of the dimension's size."""

    def __init__(self, fit: DataFrame, components: int) -> None:
        self.n, self.sums = exact_sums(fit)
        self.components, self.error = 0, 0.0
        if self.n < 2:
            return
        n, sums = self.n, self.sums
        v = covariance(fit, "x", lambda x: (deviations(_matrix(x), n, sums) / n).astype(float), n, len(sums))
        variance, directions = np.linalg.eigh((v + v.T) / 2)
        variance, directions = variance[::-1], directions[:, ::-1]
        self.trace = float(np.trace(v))
        self.components = min(components, int((variance > LEAST_VARIANCE * variance[0]).sum())) if variance[0] > 0 else 0
        self.variance, self.directions = variance[: self.components], directions[:, : self.components]
        sign = np.sign(self.directions[abs(self.directions).argmax(0), range(self.components)])
        self.projection = self.directions * sign / np.sqrt(self.variance)
        if self.components:
            self.error = self._identity_error(fit)

    def project(self, off: np.ndarray) -> np.ndarray:
        """Rows of ``deviations`` to whitened ones."""
        return (off / self.n).astype(float) @ self.projection

    def _identity_error(self, fit: DataFrame) -> float:
        """Whitens the fit list anew and measures its covariance, centred by its own mean."""
        n, sums, project, width = self.n, self.sums, self.project, self.components

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_pydict({"sums": [project(deviations(_matrix(batch.column(0)), n, sums)).sum(0).tolist()]})

        parts = fit.select("x").mapInArrow(added, "sums array<double>").rdd.map(lambda r: np.array(r.sums))
        mean = parts.treeAggregate(np.zeros(width), lambda a, b: a + b, lambda a, b: a + b) / n
        found = covariance(fit, "x", lambda x: project(deviations(_matrix(x), n, sums)) - mean, n, width)
        return float(abs(found - np.eye(width)).max())


def _projected(model: Whitening):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = model.components
        for batch in batches:
            if batch.num_rows and k:
                off = deviations(_matrix(batch.column(1)), model.n, model.sums)
                w = model.project(off)
                if off.dtype != object and float(abs(off).max(initial=0)) ** 2 * off.shape[1] < 2**62:
                    total = [int(t) for t in (off * off).sum(1)]
                else:
                    total = [t if t < 2**63 else None for t in (off.astype(object) ** 2).sum(1)]
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(w)), k)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(w))), pa.array(np.full(len(w) * k, model.n)), pa.array([t for t in total for _ in range(k)], pa.int64()), pa.array(w.ravel()), pa.array(np.tile(model.variance / model.trace, len(w))), pa.array(np.full(len(w) * k, model.error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each whole vector and component.

    Components are numbered from 1 by falling variance; a direction's largest entry is positive.
    explained is a component's share of all variance; identity_error, one value, the largest absolute
    entry of the whitened fit list's covariance less the identity.  Odd rows: see the module.
    """
    rows = quantised(vectors, scale, shift)
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    dimension = lengths[0].d if lengths else 0
    rows = rows.where(F.size("x") == dimension)
    fit = materialise(rows.select("x").distinct(), "fit-list")
    model = Whitening(fit, components)
    discard(fit)
    kind = dict(vectors.dtypes)["vec_id"]
    return rows.mapInArrow(_projected(model), f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole vectors of ``embeddings``, 16 components."""
    return whitened(table(spark, sf_dir, "embeddings"))


#: What SQL can express: rows, n and deviation.
WHITENED_ROWS_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT) + {SHIFT}) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)),
f AS (SELECT DISTINCT x FROM v), e AS (SELECT unnest(x) AS x, generate_subscripts(x, 1) AS i FROM f), s AS (SELECT list(s ORDER BY i) AS s FROM (SELECT i, CAST(sum(x) AS BIGINT) AS s FROM e GROUP BY i)), n AS (SELECT count(*) AS n FROM f)
SELECT vec_id, CAST(unnest(range(1, {COMPONENTS + 1})) AS INTEGER) AS component, n, CAST(list_sum(list_transform(x, lambda c, i: (n * c - s[i]) * (n * c - s[i]))) AS BIGINT) AS deviation FROM v, s, n
"""
