"""Embedding whitening: eigenvectors of a distributed covariance in float32, refined by matrix products."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import table

#: Entries become floor(SCALE * c) + OFFSET; those beyond LIMIT keep to it, so that sums of integers stay exact.
SCALE, OFFSET, LIMIT = 64, 1_000_000, 1 << 46
#: Values of vectors that a task turns into arrays of numbers at a time.
BLOCK = 1 << 20


@dataclass
class Whitening:
    """What is fitted: n vectors with sums (Python integers) by dimension, eigenvalues and components (columns) of their
    covariance by falling eigenvalue, and the covariance's trace."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def varied(self) -> np.ndarray:
        """Which components have any variance."""
        most = self.eigenvalues.max(initial=0.0)
        return self.eigenvalues > len(self.sums) * np.finfo(np.float64).eps * most

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly: int64 where that surely fits, otherwise Python integers."""
        fits = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0) < 1 << 62
        return self.n * x - np.array(self.sums, np.int64) if fits else self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(np.float64)

    def whiten(self, x: np.ndarray, components: int) -> np.ndarray:
        """Rows projected on the first components, over their standard deviations; NaN where there is no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.varied, 1 / np.sqrt(self.eigenvalues), np.nan)[:components]
        return self.centred(x) @ self.components[:, :components] * scale


def refine(a: np.ndarray, x: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors of the symmetric matrix a, from approximate ones, by matrix products.

    Ogita and Aishima's iteration: with r = I - x'x and s = x'ax, each eigenvector is corrected along every other one
    by (s_ij + l_j r_ij) / (l_j - l_i), and by r_ij / 2 along those whose eigenvalue is too near to divide by: closer
    than what off-diagonal and orthogonality errors leave open. Eigenvalues that near form a cluster; its space is
    right then but not its basis, which comes from the eigenproblem of the cluster alone, shifted by its mean so
    that the differences are not rounded away. Rounds stop once the correction no longer shrinks; the last one takes its
    residuals in extended precision.
    """
    d, norm = len(a), max(float(np.abs(a).sum(axis=1).max(initial=0.0)), np.finfo(float).tiny)
    before, wide = np.inf, False
    for _ in range(rounds):
        kind = np.longdouble if wide else np.float64
        y, m = x.astype(kind), a.astype(kind)
        r, s = np.eye(d, dtype=kind) - y.T @ y, y.T @ m @ y
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(-values, kind="stable")
        y, values, r, s = y[:, order], values[order], r[np.ix_(order, order)], s[np.ix_(order, order)]
        near = 2 * (np.linalg.norm((s - np.diag(values)).astype(np.float64)) + norm * np.linalg.norm(r.astype(np.float64)))
        near = max(near, 8 * d * float(np.finfo(kind).eps) * norm)
        gaps = values[None, :] - values[:, None]
        apart = np.abs(gaps) > near
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gaps, 1), r / 2)
        y = y + y @ e
        edges = np.concatenate(([0], np.flatnonzero(values[:-1] - values[1:] > near) + 1, [d]))
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            if j - i > 1:
                y[:, i:j] = subspace(m, y[:, i:j], kind)
        y = y + y @ (np.eye(d, dtype=kind) - y.T @ y) / 2  # orthonormal, where the clusters' bases met the others'
        x = y.astype(np.float64)
        size = float(np.abs(e).max(initial=0.0))
        if wide:
            break
        wide = size < 1e-14 or size > before / 2
        before = size
    return values.astype(np.float64), x


def subspace(a: np.ndarray, q: np.ndarray, kind) -> np.ndarray:
    """The eigenbasis of a within the space of the columns of q."""
    gram = q.T @ q
    q = q @ (1.5 * np.eye(q.shape[1], dtype=kind) - 0.5 * gram)  # one Newton step to orthonormal columns
    mean = np.trace(q.T @ a @ q) / q.shape[1]
    small = q.T @ (a @ q - mean * q)
    small = ((small + small.T) / 2).astype(np.float64)
    return q @ np.linalg.eigh(small)[1][:, ::-1].astype(kind)


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors of a covariance to double precision; of each vector the largest entry is
    positive. The start is a float32 decomposition."""
    scale = float(np.abs(v).max(initial=0.0))
    if not scale:
        return np.zeros(len(v)), np.eye(len(v))
    start = np.linalg.eigh((v / scale).astype(np.float32))[1][:, ::-1]
    values, x = refine(v / scale, start.astype(np.float64))
    x = x * np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(v))])
    return np.maximum(values, 0) * scale, x


def _blocks(batches, dimension: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches (id, vector) without the rows that don't count, with their integers."""
    for batch in batches:
        step = max(1, BLOCK // max(1, dimension))
        for k in range(0, batch.num_rows, step):
            part = batch.slice(k, step)
            flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            c = np.floor(flat.reshape(part.num_rows, dimension) * SCALE)
            yield part, np.clip(c, -LIMIT, LIMIT).astype(np.int64) + OFFSET


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows whose vector is neither null nor holds null or non-finite entries."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"))
    return rows.filter(F.col("v").isNotNull() & F.forall("v", lambda c: F.coalesce(c.between(-1.7976931348623157e308, 1.7976931348623157e308), F.lit(False))))


def _partial(rows: DataFrame, dimension: int, of) -> tuple[int, list[int], np.ndarray]:
    """n, sums and summed products of what `of` makes of each block (integers, numbers to be multiplied): one row of
    products for each task and dimension, added up by dimension in tasks again; one row a dimension comes back."""

    def run(batches):
        n, sums, products = 0, None, None
        for _, x in _blocks(batches, dimension):
            ints, y = of(x)
            n += len(x)
            if ints is not None:
                added = ints.sum(axis=0, dtype=object)
                sums = added if sums is None else sums + added
            if y is not None:
                products = y.T @ y if products is None else products + y.T @ y
        if n:
            size = len(products) if products is not None else 1
            yield pa.RecordBatch.from_pydict({"i": list(range(size)), "n": [n] * size, "sums": [[str(s) for s in sums] if sums is not None and not k else [] for k in range(size)], "row": [products[k].tolist() if products is not None else [] for k in range(size)]}, _PARTIAL)

    def add(batches):
        n, sums, row = {}, {}, {}
        for batch in batches:
            for k in range(batch.num_rows):
                i = batch.column(0)[k].as_py()
                n[i] = n.get(i, 0) + batch.column(1)[k].as_py()
                for into, column, kind in ((sums, 2, lambda a: np.array([int(s) for s in a], object)), (row, 3, np.array)):
                    more = kind(batch.column(column)[k].as_py())
                    into[i] = into[i] + more if i in into else more
        if n:
            yield pa.RecordBatch.from_pydict({"i": list(n), "n": list(n.values()), "sums": [[str(s) for s in sums[i]] for i in n], "row": [row[i].tolist() for i in n]}, _PARTIAL)

    schema = "i int, n long, sums array<string>, row array<double>"
    parts = rows.mapInArrow(run, schema).repartition("i").mapInArrow(add, schema).toArrow().sort_by("i")
    if not parts.num_rows:
        return 0, [], np.zeros((0, 0))
    return parts["n"][0].as_py(), [int(s) for s in parts["sums"][0].as_py()], np.array(parts["row"].to_pylist())


_PARTIAL = pa.schema([("i", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("row", pa.list_(pa.float64()))])


def fit(rows: DataFrame, dimension: int) -> Whitening:
    """The whitening of the vectors of rows (id, v), all of that length: two passes, sums and then products of centred
    vectors. What comes to the driver is a matrix of the vectors' length squared."""
    n, sums, _ = _partial(rows, dimension, lambda x: (x, None))
    model = Whitening(n, sums, np.zeros(0), np.zeros((0, 0)), 0.0)
    if not n or not dimension:
        return model
    _, _, products = _partial(rows, dimension, lambda x: (None, model.centred(x)))
    v = products / n
    model.eigenvalues, model.components = eigen((v + v.T) / 2)
    model.trace = float(np.trace(v))
    return model


def identity_error(rows: DataFrame, model: Whitening, components: int) -> float:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity, over the components that
    have variance: one more pass. Whitened numbers are centred once more before they are multiplied."""
    varied = model.varied[:components]
    if not model.n or not varied.any():
        return 0.0
    ones = lambda y: np.concatenate((y, np.ones((len(y), 1))), axis=1)  # noqa: E731  the last column gives the sums
    _, _, products = _partial(rows, len(model.sums), lambda x: (None, ones(model.whiten(x, components)[:, varied])))
    mean = products[-1, :-1] / model.n
    return float(np.abs(products[:-1, :-1] / model.n - np.outer(mean, mean) - np.eye(len(mean))).max())


def whiten_vectors(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened coordinates of each vector: (id, n, deviation, whitened array), and explained and identity_error.

    Entries c become integers x = floor(64 * c) + 1000000. The covariance of all vectors (divisor n) is centred before
    it is multiplied; its eigenvectors are those of eigen(). deviation is the sum of (n * x - S)^2, exact, null where it
    exceeds a long. whitened holds (x - S/n) on each component over the root of its eigenvalue, null where a
    component has no variance (identity_error leaves these out; it is 0 if all are); explained the components'
    shares of the trace, 0 if that is 0.

    Rows with a null vector, or null or non-finite entries, are dropped; so are those of another length than most
    have (of equally many the longest), and empty ones. Null and repeated ids stay, each row counts. Entries beyond 2^46
    keep to that. An empty table gives no rows; other columns are ignored. Narrow but for sums: each task sends one
    matrix of the vectors' length.
    """
    rows = usable(vectors, id_col, vector_col).filter(F.size("v") > 0)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    dimension = lengths[0].d if lengths else 0
    rows = rows.filter(F.size("v") == dimension)
    model = fit(rows, dimension)
    components = min(components, dimension)
    error = identity_error(rows, model, components)
    shares = (model.eigenvalues / model.trace if model.trace else np.zeros(dimension))[:components]

    def run(batches):
        for part, x in _blocks(batches, dimension):
            off = model.deviations(x)
            big = off.dtype == object or int(np.abs(off).max(initial=0)) ** 2 * dimension >= 1 << 63
            total = (off.astype(object) if big else off) ** 2
            deviation = [int(t) if t < 1 << 63 else None for t in total.sum(axis=1)]
            y = model.whiten(x, components)
            flat = pa.array(y.ravel(), pa.float64(), mask=np.isnan(y.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * components, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(deviation, pa.int64()), lists], names=["id", "deviation", "whitened"])

    out = rows.mapInArrow(run, f"id {vectors.schema[id_col].dataType.simpleString()}, deviation long, whitened array<double>")
    explained = F.array(*[F.lit(float(s)) for s in shares]) if components else F.lit(None).cast("array<double>")
    return out.select(F.col("id").alias(id_col), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """The first 32 whitened coordinates of all embeddings, a row each."""
    rows = whiten_vectors(table(spark, sf_dir, "embeddings"))
    each = rows.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "x"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", F.col("x.whitened").alias("whitened"), F.col("x.explained").alias("explained"), "identity_error")
