"""Embedding whitening by Chebyshev-filtered subspace iteration over distributed centred products.

Entries become whole numbers x = floor(1024 c) + 100000; their sums are exact, and each product V Q (V the covariance of x
over all rows, divisor n) is one pass over the rows: a task centres its batches, (x - S / n), before it multiplies, adds
up its own d x k part of Yᵀ(Y Q), and hands that on; no task and not the driver ever holds more than a few such parts, and
nothing of the size of the rows or of d x d is gathered. A block of k columns (four times the components) starts at
random. In each round a Chebyshev polynomial of V, by its three-term recurrence, damps what lies below the block's
lowest Ritz value; QR and a Rayleigh-Ritz step follow. Columns whose residual is at rounding level are locked: they
are projected out of every product, so that the strongest direction doesn't drown the others, and stay in the
Rayleigh-Ritz step. It ends when the residuals of all components are certified: |V q - e q| <= TOLERANCE times the first
eigenvalue, which bounds the eigenvalues' error by the same and a vector's by that over its gap. Where the spectrum is so
flat that a filter would take too long, the block doubles, up to all dimensions, where Rayleigh-Ritz alone is exact.

Rows whose vector is null, or holds null or non-finite entries, go; so do rows with another number of entries than most
rows have (of equal counts, the larger number stays). Entries beyond 2^30 count as 2^30. Equal rows all count. A null vec_id is
kept. Components whose eigenvalue is zero (fewer rows than components, or equal ones) can't be whitened and are left out;
one row, or none, has no components and gives no rows. A very long vector is one row; its pass holds batches of about
a million entries. Other columns are not read and may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import discard, staged

COMPONENTS = 8
#: Columns of the first block for each component; degree of a filter at most; what a filter may spread the columns' scales by.
BLOCK, DEGREE, SPREAD = 4, 12, 1e6
#: Residual over the first eigenvalue at which a component is certified, and at which a column is locked; degrees worth waiting for.
TOLERANCE, LOCKED, PATIENCE = 1e-13, 2e-14, 200
#: Entries that one numpy step works on, parts that one task adds up, and bounds of an entry.
STEP, FAN, MOST = 1 << 20, 64, 1 << 30
PART = "part int, sums binary"


def cleaned(table: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that are fitted and whitened."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return table.select("vec_id", "embedding").filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(fine)


def _blocks(batch: pa.RecordBatch, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch with their entries as whole numbers, one row a vector."""
    step = max(1, STEP // d)
    for i in range(0, batch.num_rows, step):
        part = batch.slice(i, step)
        cells = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield part, (np.floor(1024 * np.clip(cells, -MOST, MOST)).astype(np.int64) + 100000).reshape(-1, d)


def _added(rows: DataFrame, d: int, dtype, own: Callable[[np.ndarray], np.ndarray], many: bool) -> np.ndarray | None:
    """The sum over all rows of own(entries), which a task adds up for its rows: a flat array of one length.

    Parts are added up in the order of their tasks, so reruns agree. Where there are many, FAN tasks add them up first.
    """

    def task(batches):
        total = None
        for batch in batches:
            for _, x in _blocks(batch, d):
                more = own(x)
                total = more if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([_task_number()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])

    def merged(batches):
        held = sorted((p, s) for b in batches for p, s in zip(b.column("part").to_pylist(), b.column("sums").to_pylist()))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([held[0][0]], pa.int32()), pa.array([_sum(held, dtype).tobytes()], pa.binary())], ["part", "sums"])

    parts = rows.select("embedding").mapInArrow(task, PART)
    if many:
        parts = parts.repartition(FAN, F.col("part") % FAN).mapInArrow(merged, PART)
    held = sorted((r["part"], bytes(r["sums"])) for r in parts.collect())
    return _sum(held, dtype) if held else None


def _task_number() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _sum(parts: list, dtype) -> np.ndarray:
    out = np.frombuffer(parts[0][1], dtype).copy()
    for _, p in parts[1:]:
        out += np.frombuffer(p, dtype)
    return out


def _centre(x: np.ndarray, whole: np.ndarray, rest: np.ndarray, n: int) -> np.ndarray:
    """x - S / n as doubles, from whole numbers: whole is S div n, rest is S mod n."""
    return (x - whole) - rest / n


class Covariance:
    """V = Yᵀ Y / n of the centred rows, as a product with a d x k matrix: one pass over the rows."""

    def __init__(self, rows: DataFrame, d: int):
        self.rows, self.d = rows, d
        self.passes = 0
        # Parts are added up in two steps if there are more of them than one task should.
        last = rows.select(F.spark_partition_id().alias("p")).agg(F.max("p").alias("p")).first()["p"]
        self.many = last is not None and last >= 4 * FAN
        first = _added(rows, d, np.int64, lambda x: np.concatenate([[len(x), 1], x.sum(0)]), self.many)
        self.n = 0 if first is None else int(first[0])
        s = np.zeros(d, np.int64) if first is None else first[2:]
        self.whole, self.rest = (s // self.n, s % self.n) if self.n else (s, s)
        self.trace = 0.0

    def times(self, q: np.ndarray) -> np.ndarray:
        whole, rest, n, d = self.whole, self.rest, self.n, self.d

        def own(x):
            y = _centre(x, whole, rest, n)
            return np.concatenate([(y.T @ (y @ q)).ravel(), [np.einsum("ij,ij->", y, y)]])

        self.passes += 1
        out = _added(self.rows, d, np.float64, own, self.many)
        self.trace = out[-1] / n
        return out[:-1].reshape(d, -1) / n


def _rayleigh_ritz(v: Covariance, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values in falling order, their vectors, and the residuals' norms, from one product."""
    q, _ = np.linalg.qr(q)
    w = v.times(q)
    h = q.T @ w
    e, u = np.linalg.eigh((h + h.T) / 2)
    e, u = e[::-1], u[:, ::-1]
    return e, q @ u, np.linalg.norm(w @ u - (q @ u) * e, axis=0)


def _filtered(v: Covariance, q: np.ndarray, held: np.ndarray, degree: int, edge: float, top: float) -> np.ndarray:
    """The Chebyshev polynomial of V that is small on [0, edge], times q; scaled so that it is about one at `top`."""
    c = half = edge / 2
    apart = lambda y: y - held @ (held.T @ y)  # noqa: E731  locked columns stay out
    first = sigma = half / (top - c)
    before, now = q, apart(v.times(q) - c * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, apart((v.times(now) - c * now) * (2 * after / half) - sigma * after * before)
        sigma = after
    return now


def eigen(v: Covariance, components: int = COMPONENTS, seed: int = 0, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors) of the largest `components` of V that aren't zero, certified."""
    want = min(components, v.d)
    rng = np.random.default_rng(seed)
    k = min(v.d, BLOCK * want)
    e, q, r = _rayleigh_ritz(v, rng.standard_normal((v.d, k)))
    best, stalled = np.inf, 0
    for _ in range(rounds):
        top = max(e[0], 0.0)
        # Directions in which all rows agree have no eigenvalue to whiten by.
        worst = r[:want].max()
        if worst <= TOLERANCE * top or top <= 1e-12 * max(1.0, v.trace):
            break
        stalled = stalled + 1 if worst > 0.5 * best else 0
        best = min(best, worst)
        if stalled >= 3 and worst <= 100 * TOLERANCE * top:
            break  # what is left is the products' own rounding
        locked = int(np.argmax(np.append(r > LOCKED * top, True)))
        locked = min(locked, want - 1)
        edge, last = max(e[-1], 0.0), max(e[want - 1], 0.0)
        gain = np.arccosh(max(1.0, 2 * last / edge - 1)) if edge > 0 else np.inf
        need = np.log(2 * worst / (TOLERANCE * top))
        if k < v.d and (gain <= 0 or need / gain > PATIENCE or stalled >= 6):
            more = rng.standard_normal((v.d, min(k, v.d - k)))
            k, stalled, best = k + more.shape[1], 0, np.inf
            e, q, r = _rayleigh_ritz(v, np.hstack([q, more]))
            continue
        if edge <= 0:
            e, q, r = _rayleigh_ritz(v, np.hstack([q[:, :want], v.times(q[:, want:])]) if k > want else v.times(q))
            continue
        lead = np.arccosh(max(1.0, 2 * e[locked] / edge - 1))
        degree = int(np.clip(need / max(gain, 1e-9), 1, DEGREE))
        degree = int(max(1, min(degree, np.log(SPREAD) / max(lead - gain, 1e-9))))
        y = _filtered(v, q[:, locked:], q[:, :locked], degree, edge, max(e[locked], edge * (1 + 1e-12)))
        size = np.linalg.norm(y, axis=0)
        y = np.where(size > 0, y / np.where(size > 0, size, 1), rng.standard_normal(y.shape))
        e, q, r = _rayleigh_ritz(v, np.hstack([q[:, :locked], y]))
    else:
        raise RuntimeError(f"not certified after {v.passes} passes: residuals up to {r[:want].max() / e[0]:.3g} of the first eigenvalue")
    there = e[:want] > 1e-12 * max(v.trace, 1e-300)
    q = q[:, :want][:, there]
    # Either sign is an eigenvector; the largest entry is made positive, so that reruns agree.
    return e[:want][there], q * np.sign(q[np.abs(q).argmax(0), np.arange(q.shape[1])])


def fitted(table: DataFrame, components: int = COMPONENTS, seed: int = 0) -> tuple[DataFrame, Covariance | None, np.ndarray, np.ndarray]:
    """(rows, covariance, eigenvalues, eigenvectors) of a table (vec_id, embedding); rows are written once."""
    rows = staged(cleaned(table), "whitening-rows")
    lengths = sorted(((r["n"], r["d"]) for r in rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()), reverse=True)
    if not lengths:
        return rows, None, np.zeros(0), np.zeros((0, 0))
    d = lengths[0][1]
    own = rows.filter(F.size("embedding") == d)
    own.staged_at = rows.staged_at
    v = Covariance(own, d)
    e, q = eigen(v, components, seed)
    return own, v, e, q


def _deviations(x: np.ndarray, whole: np.ndarray, rest: np.ndarray, n: int) -> list[int | None]:
    """Sums of (n x - S)^2 by row, exact; none beyond 64 bits."""
    y = x - whole
    most = int(np.abs(y).max(initial=0)) * n + n
    if most * most * x.shape[1] < 1 << 63:
        z = y * n - rest
        return (z * z).sum(1).tolist()
    big = (y.astype(object) * n - rest.astype(object)) ** 2
    return [int(s) if s < 1 << 63 else None for s in big.sum(1)]


def identity_error(v: Covariance, axes: np.ndarray) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity: a pass for the means, one for the products."""
    whole, rest, n = v.whole, v.rest, v.n
    k = axes.shape[1]
    mean = _added(v.rows, v.d, np.float64, lambda x: (_centre(x, whole, rest, n) @ axes).sum(0), v.many) / n

    def own(x):
        z = _centre(x, whole, rest, n) @ axes - mean
        return (z.T @ z).ravel()

    found = _added(v.rows, v.d, np.float64, own, v.many).reshape(k, k) / n
    return float(np.abs(found - np.eye(k)).max())


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(table: DataFrame, components: int = COMPONENTS, seed: int = 0) -> DataFrame:
    """A row for each vector that is left and each component: see OUT. The operator's passes run when it is called."""
    rows, v, e, q = fitted(table, components, seed)
    if v is None or not len(e):
        discard(rows)
        return table.sparkSession.createDataFrame([], OUT)
    axes = q / np.sqrt(e)
    share, error = e / v.trace, identity_error(v, axes)
    whole, rest, n, d, k = v.whole, v.rest, v.n, v.d, len(e)

    def task(batches):
        for batch in batches:
            for part, x in _blocks(batch, d):
                z = _centre(x, whole, rest, n) @ axes
                m = len(x)
                again = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(again)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n, np.int64)),
                        pa.array(_deviations(x, whole, rest, n), pa.int64()).take(pa.array(again)),
                        pa.array(z.ravel()),
                        pa.array(np.tile(share, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    [c.split()[0] for c in OUT.split(", ")],
                )

    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").mapInArrow(task, OUT)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every usable embedding on the first eight components."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
