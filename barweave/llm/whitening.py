"""Embedding whitening with components from QDWH spectral divide-and-conquer.

Entries become whole numbers (64ths above a large offset). Spark adds up their sums exactly, then the products of the centred entries, per
task and (dimension, dimension). The covariance, whose size is the dimension's alone, is split on the driver: the polar factor of the
shifted covariance (QR-based dynamically weighted Halley iterations) gives the projector on the eigenvalues above the shift, its range and
complement are invariant subspaces, and both parts are split again until they have one dimension. The directions go to the tasks, which project the
centred entries; the covariance of what they give is checked against the identity in a pass of its own.

The dimension is at most ``MAX_DIMENSION``; what travels to the driver and the tasks is bounded by its square.
"""
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
MAX_DIMENSION = 2048
OFFSET, STEPS = 1_000_000, 64
LARGEST = 2.0 ** 45  # entries beyond would not be exact as whole numbers
EPS = np.finfo(float).eps


def usable(vector: Column) -> Column:
    """Neither null nor with null or non-finite entries."""
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True))


def whole_numbers(lists, dimension=None):
    """The entries of a column of equally long lists as a matrix of whole numbers."""
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if len(values) and np.abs(values).max() > LARGEST:
        raise ValueError("an entry is too large to become a whole number")
    return (np.floor(STEPS * values) + OFFSET).astype(np.int64).reshape(len(lists), dimension or -1)


def polar(a, rounds=30):
    """The orthogonal polar factor of a symmetric matrix by QDWH; an eigenvalue of almost nothing leaves no clean factor."""
    x = a / max(np.linalg.norm(a), 1e-300)
    low, one = 1e-16, np.eye(len(a))
    for _ in range(rounds):
        d = np.cbrt(4 * (1 - low * low) / low ** 4) if low < 1 else 0.0
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low * low) / (low * low * np.sqrt(1 + d)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, one]))[0]
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:len(a)] @ q[len(a):].T
        low, moved, x = min(1.0, low * (wa + wb * low * low) / (1 + wc * low * low)), np.linalg.norm(new - x), (new + new.T) / 2
        if moved < 1e-9 * np.sqrt(len(a)) and 1 - low < 1e-9:
            break
    return x


def split(a, shift, rng):
    """Orthonormal bases of the spaces of eigenvalues above the shift and below; None where the shift cuts nothing off or meets an eigenvalue."""
    p = (polar(a - shift * np.eye(len(a))) + np.eye(len(a))) / 2
    k = round(float(np.trace(p)))
    if not 0 < k < len(a) or np.linalg.norm(p @ p - p) > 1e-10 * len(a):
        return None
    q = np.linalg.qr(p @ rng.standard_normal((len(a), k)), mode="complete")[0]
    for _ in range(2):
        q = np.linalg.qr(p @ q[:, :k], mode="complete")[0]
    return q[:, :k], q[:, k:]


def spectrum(a, size=None, rng=None):
    """Eigenvalues in falling order and their unit eigenvectors as columns, by divide-and-conquer."""
    n = len(a)
    size, rng = np.linalg.norm(a) if size is None else size, rng or np.random.default_rng(11)
    off = a - np.diag(np.diag(a))
    if n == 1 or np.linalg.norm(off) <= 2 * EPS * size:
        order = np.argsort(-np.diag(a), kind="stable")
        return np.diag(a)[order], np.eye(n)[:, order]
    diagonal = np.sort(np.diag(a))
    radius = np.abs(off).sum(axis=1)
    low, high = (np.diag(a) - radius).min(), (np.diag(a) + radius).max()
    shifts = [np.median(diagonal), diagonal.mean(), *(low + (high - low) * f for f in np.linspace(0, 1, 33)[1:-1]), *(diagonal[:-1] + np.diff(diagonal) * 0.37)]
    parts = next((s for s in (split(a, t, rng) for t in shifts) if s), None)
    if parts is None:  # a cluster that no shift parts: turn the largest entry away, as in Jacobi's method
        i, j = divmod(int(np.abs(off).argmax()), n)
        angle = 0.5 * np.arctan2(2 * a[i, j], a[j, j] - a[i, i])
        turn = np.eye(n)
        turn[[i, j, i, j], [i, j, j, i]] = np.cos(angle), np.cos(angle), np.sin(angle), -np.sin(angle)
        values, vectors = spectrum((b := turn.T @ a @ turn) / 2 + b.T / 2, size, rng)
        return values, turn @ vectors
    solved = [(spectrum((b := v.T @ a @ v) / 2 + b.T / 2, size, rng), v) for v in parts]
    values, vectors = np.concatenate([e for (e, _), _ in solved]), np.hstack([v @ w for (_, w), v in solved])
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Whitening:
    n: int
    sums: np.ndarray        # exact, of the whole numbers
    values: np.ndarray      # of the components kept
    directions: np.ndarray  # their unit eigenvectors, as columns
    trace: float

    def centred(self, x):
        """x - sums / n, with the whole part taken off before anything is rounded."""
        return (x - self.sums // self.n) - (self.sums % self.n) / self.n

    def whitened(self, x):
        return self.centred(x) @ (self.directions / np.sqrt(self.values))

    def deviations(self, x):
        """Sums of the squares of n * x - sums, exact; beyond 64 bits an OverflowError."""
        far = float(np.abs(self.centred(x)).max(initial=0.0)) * self.n + self.n
        if far * far * max(1, x.shape[1]) < 2.0 ** 62:
            return ((self.n * x - self.sums) ** 2).sum(axis=1).tolist()
        out = [sum((self.n * int(v) - int(s)) ** 2 for v, s in zip(row, self.sums)) for row in x]
        if max(out) >= 2 ** 63:
            raise OverflowError("a deviation does not fit in 64 bits")
        return out


def _vectors(vectors, id_col, vector_col):
    vector = F.col(vector_col).cast("array<double>")
    return vectors.select(F.col(id_col).alias("id"), vector.alias("v")).where(usable(F.col("v")))


def _sums(rows):
    """(length, number of vectors, exact sums) of the only length there is; None of an empty table."""
    def run(batches):
        n, total = {}, {}
        for b in batches:
            lists = b.column(0)
            sizes = np.diff(lists.offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                x = whole_numbers(lists.filter(pa.array(sizes == size)), size)
                n[size] = n.get(size, 0) + len(x)
                total[size] = total.get(size, 0) + x.sum(axis=0)
        for size in n:
            values = [size] * (size + 1), range(-1, size), [n[size], *total[size].tolist()]  # place -1 counts the vectors
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in values], names=["size", "i", "total"])

    got = rows.select("v").mapInArrow(run, "size long, i long, total long").groupBy("size", "i").agg(F.sum("total").alias("total"))
    sizes = [r["size"] for r in got.where("i = -1").select("size").limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError(f"vectors of more than one length, such as {sizes}")
    if sizes and sizes[0] > MAX_DIMENSION:
        raise ValueError(f"vectors of {sizes[0]} entries; at most {MAX_DIMENSION} are taken")
    at = {r["i"]: r["total"] for r in got.collect()} if sizes else {}
    return (sizes[0], at[-1], np.array([at[i] for i in range(sizes[0])], np.int64)) if at else None


def _products(rows, dimension, made, width):
    """Sum over all rows of the products of what ``made`` gives of them, as a width x width matrix."""
    def run(batches):
        total = np.zeros((width, width))
        for b in batches:
            y = made(whole_numbers(b.column(0), dimension))
            total += y.T @ y
        i, j = np.indices((width, width))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "total"])

    got = rows.select("v").mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).toArrow()
    out = np.zeros((width, width))
    out[got.column("i").to_numpy(), got.column("j").to_numpy()] = got.column("total").to_numpy()
    return out


def fit(vectors: DataFrame, components=COMPONENTS, id_col="vec_id", vector_col="embedding"):
    """The whitening of all usable vectors, or None where there are none or all are equal.

    Components whose eigenvalue is rounding only (a constant dimension, repeated dimensions) are left out, as they cannot be scaled to one.
    """
    rows = _vectors(vectors, id_col, vector_col)
    found = _sums(rows)
    if found is None or found[0] == 0:
        return None
    dimension, n, sums = found
    model = Whitening(n, sums, np.zeros(0), np.zeros((dimension, 0)), 0.0)
    covariance = _products(rows, dimension, model.centred, dimension) / n
    values, directions = spectrum((covariance + covariance.T) / 2)
    kept = values[:components] > max(values[0], 0) * dimension * 16 * EPS
    model.values, model.directions, model.trace = values[:components][kept], directions[:, :components][:, kept], float(np.trace(covariance))
    return model if kept.any() else None


def identity_error(vectors: DataFrame, model: Whitening, id_col="vec_id", vector_col="embedding") -> float:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity. They are centred by then."""
    k = len(model.values)
    return float(np.abs(_products(_vectors(vectors, id_col, vector_col), len(model.sums), model.whitened, k) / model.n - np.eye(k)).max())


def whiten(vectors: DataFrame, model, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """One row per usable vector: vec_id, deviation, whitened array<double> in component order. Without a model no rows.

    Vectors that are null or hold a null or non-finite entry are left out; null ids, repeated rows and zero vectors are vectors like others. Vectors
    of more than one length raise, when the model is fitted. Other columns are ignored; an empty table gives no rows.
    """
    rows = _vectors(vectors, id_col, vector_col)

    def run(batches):
        for b in batches:
            x = whole_numbers(b.column(1), len(model.sums))
            z = model.whitened(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1]), pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.deviations(x), pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, deviation long, whitened array<double>"
    return rows.limit(0).select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("deviation"), F.col("v").alias("whitened")) if model is None else rows.mapInArrow(run, schema)


def whitened_components(vectors: DataFrame, components=COMPONENTS, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """One row per usable vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error. See ``fit`` and ``whiten``."""
    model = fit(vectors, components, id_col, vector_col)
    error = identity_error(vectors, model, id_col, vector_col) if model else 0.0
    explained = F.array(*[F.lit(float(v) / model.trace) for v in model.values]) if model else F.lit(None).cast("array<double>")
    return (whiten(vectors, model, id_col, vector_col).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
                    F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error")))
