"""Embedding whitening (operator 11): pivoted Cholesky of the centred scatter, then one-sided Jacobi on the factor.

One pass gathers, in each task, the number of vectors, their exact sums and their scatter, every batch centred on its own
mean before it is multiplied; parts are merged by the exact difference of their means, first by Spark among a few tasks, then
one by one on the driver, which holds one matrix of dimension by dimension. The covariance V = L L' comes from Cholesky with
the largest remaining pivot; Jacobi rotates pairs of the columns of L until all are orthogonal, all disjoint pairs of a round
at once. Then the squared norms of the columns are V's eigenvalues and the normalised columns its eigenvectors. A second pass
measures the covariance of the whitened rows themselves, and a third returns them.

Entries are taken as ``floor(64 * c) + 1000000``, held within the range of a long. Defined results: rows whose vector is null
or holds a null or non-finite entry are dropped; an empty vector has no component and gives no row; vectors of each length are
whitened among themselves, as a table of their own; a direction whose variance is below 1e-11 of that of its dimension counts
as constant and is no component, so a constant table gives no rows; rows with a null or repeated id stay rows of their own and
count each time; eigenvalues that tie come in either order; a deviation that does not fit a long is null there and whole in
``deviation_exact`` (null beyond 38 digits); an empty table gives no rows; further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import partitions

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
BATCH_ENTRIES = 1 << 20
#: Relative to a dimension's variance: what is left of it below this is rounding.
LEAST_PIVOT = 1e-11
MERGERS = 16
PART = "part int, length int, n long, sums array<string>, scatter binary"


class Moments:
    """Number, sums and centred scatter of vectors; the sums are Python integers where the vectors are integers."""

    def __init__(self, n: int, sums: np.ndarray, scatter: np.ndarray):
        self.n, self.sums, self.scatter = n, sums, scatter

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        n = len(x)
        if x.dtype == np.int64:
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            sums = np.array([(int(a) << 32) + int(b) for a, b in zip(high, low, strict=True)], object)
            middle = np.array([s // n for s in sums], object)
            # differences from a whole number near the mean are exact unless entries are near the ends of a long
            apart = max(abs(int(x.min())), abs(int(x.max())), *(abs(m) for m in middle)) >= 1 << 62
            y = (x.astype(object) - middle).astype(float) if apart else (x - middle.astype(np.int64)).astype(float)
            y -= np.array([(s - m * n) / n for s, m in zip(sums, middle, strict=True)], float)
        else:
            sums = x.sum(axis=0)
            y = x - sums / n
        return cls(n, sums, y.T @ y)

    def merge(self, other: Moments) -> Moments:
        n = self.n + other.n
        if self.sums.dtype == object:
            apart = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums, strict=True)], float)
        else:
            apart = self.sums / self.n - other.sums / other.n
        return Moments(n, self.sums + other.sums, self.scatter + other.scatter + np.outer(apart, apart) * (self.n * (other.n / n)))

    def row(self, part: int) -> dict:
        exact = self.sums.dtype == object
        return {"part": part, "length": len(self.sums), "n": self.n, "sums": [("i%d" % s) if exact else float(s).hex() for s in self.sums], "scatter": self.scatter.tobytes()}

    @classmethod
    def read(cls, row: dict) -> Moments:
        said = row["sums"]
        exact = bool(said) and said[0].startswith("i")
        sums = np.array([int(s[1:]) for s in said], object) if exact else np.array([float.fromhex(s) for s in said])
        return cls(row["n"], sums, np.frombuffer(row["scatter"]).reshape(len(said), len(said)))


def matrices(batches: Iterator[pa.RecordBatch], most: int = BATCH_ENTRIES) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The ids and whole-number vectors of rows that count, those of one length together, in blocks of about ``most`` entries."""
    for whole in batches:
        step = max(1, most // max(1, len(whole.column(1).values) // max(1, whole.num_rows)))
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            vectors = batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = pc.fill_null(vectors.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            for length in np.unique(lengths[lengths > 0]):
                rows = np.flatnonzero(lengths == length)
                block = values[(ends[rows] - length)[:, None] + np.arange(length)]
                fine = np.isfinite(block).all(axis=1)
                if fine.any():
                    yield batch.column(0).take(pa.array(rows[fine])), whole_numbers(block[fine])


def whole_numbers(block: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        y = np.floor(block * SCALE)
    edge = 2.0**63 - 2048  # the last double below the largest long, less the shift
    return np.where(y >= edge - SHIFT, 2**63 - 1, np.clip(y, -(2.0**63), edge - SHIFT).astype(np.int64) + SHIFT)


def merged(parts: Iterator[Moments]) -> dict[int, Moments]:
    out: dict[int, Moments] = {}
    for m in parts:
        length = len(m.sums)
        out[length] = out[length].merge(m) if length in out else m
    return out


def gather(vectors: DataFrame, measure) -> dict[int, tuple[int, Moments]]:
    """Moments of ``measure(length, x)`` over all rows, by the vectors' length."""

    def gather_parts(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % MERGERS
        held: dict[int, Moments] = {}
        for _, x in matrices(batches):
            length = x.shape[1]
            if (y := measure(length, x)) is not None:
                m = Moments.of(y)
                held[length] = held[length].merge(m) if length in held else m
        for length, m in held.items():
            yield _part_batch([m.row(part) | {"length": length}])

    def merge_parts(batches):
        held: dict[int, Moments] = {}
        for batch in batches:
            for row in batch.to_pylist():
                m, length = Moments.read(row), row["length"]
                held[length] = held[length].merge(m) if length in held else m
        for length, m in held.items():
            yield _part_batch([m.row(0) | {"length": length}])

    parts = vectors.mapInArrow(gather_parts, PART).repartition(min(MERGERS, partitions(vectors.sparkSession)), "part").mapInArrow(merge_parts, PART)
    out: dict[int, Moments] = {}
    for row in parts.toLocalIterator():
        m, length = Moments.read(row.asDict()), row["length"]
        out[length] = out[length].merge(m) if length in out else m
    return out


def _part_batch(rows: list[dict]) -> pa.RecordBatch:
    kind = pa.schema([("part", pa.int32()), ("length", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("scatter", pa.binary())])
    return pa.RecordBatch.from_pylist(rows, schema=kind)


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with L L' = v, one column for each pivot; rows stay in the order of v, so up to that order L is triangular."""
    left, d = v.copy(), len(v)
    least = LEAST_PIVOT * np.diagonal(v)
    columns = []
    for _ in range(d):
        pivots = np.diagonal(left)
        j = int(np.argmax(np.where(pivots > least, pivots, 0)))
        if not pivots[j] > least[j]:
            break
        column = left[:, j] / np.sqrt(pivots[j])
        columns.append(column)
        left -= np.outer(column, column)
        left[j, :] = left[:, j] = 0
    return np.array(columns).T.reshape(d, len(columns))


def rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n columns in rounds of disjoint pairs (a round-robin tournament)."""
    even = n + n % 2
    ring = np.arange(even)
    for _ in range(even - 1):
        p, q = ring[: even // 2], ring[even // 2 :][::-1]
        real = (p < n) & (q < n)
        yield np.minimum(p, q)[real], np.maximum(p, q)[real]
        ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])


def one_sided_jacobi(factor: np.ndarray, most_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) of factor factor' and their unit eigenvectors as columns."""
    g = factor.copy()
    close = 4 * np.finfo(float).eps
    for _ in range(most_sweeps):
        turned = False
        for p, q in rounds(g.shape[1]):
            a, b = g[:, p], g[:, q]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            turn = np.abs(ab) > close * np.sqrt(len(g)) * np.sqrt(aa * bb)
            if not turn.any():
                continue
            turned = True
            zeta = (bb[turn] - aa[turn]) / (2 * ab[turn])
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            s = c * t
            a, b = a[:, turn], b[:, turn]
            g[:, p[turn]], g[:, q[turn]] = c * a - s * b, s * a + c * b
        if not turned:
            break
    else:
        raise RuntimeError(f"the columns are not orthogonal after {most_sweeps} sweeps")
    norms = np.sqrt((g * g).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    return norms[order] ** 2, g[:, order] / norms[order]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, dict]:
    """For each length of vectors: n, sums, eigenvalues, eigenvectors and the trace."""
    models = {}
    for length, m in gather(vectors, lambda _, x: x).items():
        v = m.scatter / m.n
        values, unit = one_sided_jacobi(pivoted_cholesky((v + v.T) / 2))
        models[length] = {"n": m.n, "sums": list(m.sums), "values": values[:components], "unit": unit[:, :components], "trace": float(np.trace(v))}
    return models


def deviations(model: dict, x: np.ndarray) -> np.ndarray:
    """n * x - S, exactly: longs where they fit, else Python integers."""
    n, sums = model["n"], model["sums"]
    most = max(abs(int(x.min())), abs(int(x.max())))
    if n * most + max(map(abs, sums)) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def whitened(model: dict, t: np.ndarray) -> np.ndarray:
    return (t / model["n"]).astype(float) @ model["unit"] / np.sqrt(model["values"])


def squares(t: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The sums of squares of each row as longs (null where too large) and as decimals."""
    if t.dtype == np.int64 and t.shape[1] * max(abs(int(t.min())), abs(int(t.max()))) ** 2 < 1 << 63:
        out = pa.array((t * t).sum(axis=1), pa.int64())
        return out, out.cast(pa.decimal128(38, 0))
    sums = (t.astype(object) ** 2).sum(axis=1)
    return pa.array([s if s < 1 << 63 else None for s in sums], pa.int64()), pa.array([Decimal(s) if s < 10**38 else None for s in sums], pa.decimal128(38, 0))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact of every row and component."""
    kind = rows.schema[id_col].dataType.simpleString()
    vectors = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"))
    models = {k: m for k, m in fit(vectors, components).items() if len(m["values"])}
    measured = gather(vectors, lambda length, x: whitened(models[length], deviations(models[length], x)) if length in models else None) if models else {}
    for length, m in measured.items():
        models[length]["error"] = float(np.abs(m.scatter / m.n - np.eye(len(m.scatter))).max())
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"]

    def project(batches):
        for ids, x in matrices(batches, BATCH_ENTRIES // 4):
            if (model := models.get(x.shape[1])) is None:
                continue
            t = deviations(model, x)
            k, n = len(model["values"]), len(x)
            each = pa.array(np.repeat(np.arange(n), k))
            short, exact = squares(t)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * k, model["n"])),
                    short.take(each),
                    pa.array(whitened(model, t).ravel()),
                    pa.array(np.tile(model["values"] / model["trace"], n)),
                    pa.array(np.full(n * k, model["error"])),
                    exact.take(each),
                ],
                columns,
            )

    return vectors.mapInArrow(project, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)")
