"""Whitening of embeddings by FEAST contour integration.

Vectors become integer vectors x, so that the count, the sums S and the scatter
matrix are exact whatever the order of their parts: tasks subtract the integer
next to the mean before they multiply, and one rank-one correction moves the
rest, below a half, exactly. The eigenvalues sought are those of an interval
whose ends come from inertia counts (Sylvester: the signs of a factorisation
of the shifted matrix). Quadrature over a circle around the interval, with a
complex shifted solve at each node, projects a random block onto their
eigenvectors; Rayleigh-Ritz extracts them, and the block goes round again
until residuals are at rounding level. A block that gains little in a round,
as other eigenvalues are near the interval, gets more columns, up to the
dimension. The inertia count of the interval says
how many there must be, so none is missed.

The driver holds the matrix, whose size is that of the dimension squared, and
never a vector. Vectors of null, without entries, or with an entry that is
null, not finite or beyond ``MAX_ENTRY`` are dropped, and so are those of
another length than most have (ties: the longer). Components whose eigenvalue is
rounding noise of the trace are left out, so one vector, or equal ones, give no
row; so does an empty table. Repeated rows count as often as they occur, ids are
never compared and may be null. A deviation beyond a long is null. Other columns
do not matter, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import staged

SCALE, SHIFT = 1024, 100_000
#: Entries up to here stay apart from the next integer and keep all sums within 38 digits.
MAX_ENTRY = float(1 << 30)
#: Nodes on the upper half of the circle (the lower half is their mirror image).
NODES = 16
ROUNDS = 40
LONG = (1 << 63) - 1
_WIDE = "decimal(38,0)"


def integer_vectors(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``id, x``: the integer vectors of the rows that are whole, of the most common length."""
    v = F.col(vector)
    whole = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) <= MAX_ENTRY), F.lit(False)))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long"))
    found = rows.where(whole).select(F.col(id_col).alias("id"), x.alias("x"))
    lengths = found.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return found.where(F.size("x") == (lengths[0]["d"] if lengths else 0))


def matrix_of(column: pa.Array) -> np.ndarray:
    """int64[rows, d] of a list column whose lists are equally long."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), -1)


def exact_gram(y: np.ndarray) -> np.ndarray:
    """The integers ``y.T @ y``, exact: in doubles while they hold them, else of halves of 21 bits."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < 1 << 53:
        z = y.astype(np.float64)
        return (z.T @ z).astype(np.int64).astype(object)
    low, high = (y & ((1 << 21) - 1)).astype(object), (y >> 21).astype(object)
    cross = high.T @ low
    return ((high.T @ high) << 42) + ((cross + cross.T) << 21) + low.T @ low


def _sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """``n, S``: the number of vectors and their exact sum."""

    def partial(batches):
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column(0))
                part = x.sum(0).astype(object)
                n, total = n + len(x), part if total is None else total + part
        if n:
            values = [n, *total.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(map(Decimal, values), pa.decimal128(38, 0))], ["i", "s"])

    got = {r["i"]: int(r["s"]) for r in vectors.select("x").mapInArrow(partial, f"i int, s {_WIDE}").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    return got.get(0, 0), [got[i] for i in range(1, len(got))]


def _scatter(vectors: DataFrame, middle: list[int]) -> list[list[int]]:
    """The exact sum of ``(x - middle)(x - middle)`` transposed; each task adds up its own before it sends the upper triangle once."""
    d, m = len(middle), np.array(middle, np.int64)
    rows, cols = np.triu_indices(d)

    def partial(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = exact_gram(matrix_of(batch.column(0)) - m)
                total = part if total is None else total + part
        if total is not None:
            values = pa.array(map(Decimal, total[rows, cols].tolist()), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(rows * d + cols, pa.int64()), values], ["at", "g"])

    out = [[0] * d for _ in range(d)]
    for r in vectors.select("x").mapInArrow(partial, f"at long, g {_WIDE}").groupBy("at").agg(F.sum("g").alias("g")).collect():
        i, j = divmod(r["at"], d)
        out[i][j] = out[j][i] = int(r["g"])
    return out


def count_above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``v`` exceed ``shift``: the positive pivots of ``v - shift``.

    Pivots are chosen over the whole rest (Bunch and Parlett): one diagonal
    entry, or a block of two by two, which has one eigenvalue of each sign.
    """
    a, found = v - shift * np.eye(len(v)), 0
    alpha = (1 + 17**0.5) / 8
    while len(a):
        size, diagonal = np.abs(a), np.abs(np.diag(a))
        p = int(diagonal.argmax())
        i, j = divmod(int(size.argmax()), len(a))
        if size[i, j] == 0:
            break
        picked = [p] if diagonal[p] >= alpha * size[i, j] or i == j else [i, j]
        rest = np.setdiff1d(np.arange(len(a)), picked, assume_unique=True)
        found += 1 if len(picked) == 2 else int(a[p, p] > 0)
        c = a[np.ix_(rest, picked)]
        a = a[np.ix_(rest, rest)] - c @ np.linalg.solve(a[np.ix_(picked, picked)], c.T)
        a = (a + a.T) / 2
    return found


def _edge(v: np.ndarray, low: float, high: float, wanted: int, width: float, exact: bool = False) -> tuple[float, float]:
    """Narrows ``low < high`` where at least ``wanted`` eigenvalues exceed ``low`` and fewer exceed ``high`` to that width; with ``exact``, only until just so many exceed ``low``."""
    while high - low > width:
        mid = (low + high) / 2
        found = count_above(v, mid)
        low, high = (mid, high) if found >= wanted else (low, mid)
        if exact and found == wanted:
            break
    return low, high


def interval_of_top(v: np.ndarray, k: int) -> tuple[float, float, int]:
    """``(low, high, count)``: an interval with the ``k`` largest eigenvalues, and how many it holds.

    It ends in the gap below them; eigenvalues that rounding cannot tell from
    the last one are inside too. Those of rounding level never are.
    """
    bound = float(np.abs(v).sum(1).max()) * 1.01
    noise = len(v) * np.finfo(float).eps * bound * 64
    k = min(k, count_above(v, noise)) if bound > 0 else 0
    if k <= 0:
        return 0.0, 0.0, 0
    low, above = _edge(v, noise, bound, k, noise, exact=True)
    if count_above(v, low) == k:
        low = _edge(v, low, above, k, max(noise, low / 64))[0]
    count, step = count_above(v, low), noise
    while low > noise and count_above(v, low - step) != count:  # an edge among equal eigenvalues
        low, step = max(noise, low - step), 2 * step
        count = count_above(v, low)
    below = noise if count_above(v, noise) == count else _edge(v, noise, low, count + 1, max(noise, low / 256))[1]
    low = (low + below) / 2
    return low, _edge(v, low, bound, 1, max(noise, bound / 64))[1] * 1.1, count


def slices(v: np.ndarray, low: float, high: float) -> list[tuple[float, float, int]]:
    """The interval in parts ``(low, high, count)`` whose ends differ by a small factor and, where there are any, lie in gaps; without empty parts."""
    edges, clear = [high], lambda c: count_above(v, c * 0.97) == count_above(v, c * 1.03)
    while edges[-1] > 6 * low:
        cuts = [edges[-1] / f for f in (4, 5, 3.3, 2.7)]
        edges.append(next(filter(clear, cuts), cuts[0]))
    edges.append(low)
    above = [0, *[count_above(v, e) for e in edges[1:]]]
    return [(b, a, n - m) for a, b, m, n in zip(edges, edges[1:], above, above[1:]) if n > m]


def feast_slice(v: np.ndarray, low: float, high: float, count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues between ``low`` and ``high``, falling, with their vectors."""
    d, norm = len(v), float(np.linalg.norm(v))
    centre, radius = (low + high) / 2, (high - low) / 2
    turn = np.exp(1j * np.pi * (np.arange(NODES) + 0.5) / NODES)
    rng, width = np.random.default_rng(seed), min(d, count + max(4, count // 2))
    y = rng.standard_normal((d, width))
    best = last = np.inf
    for _ in range(ROUNDS):
        q = sum((radius * t * np.linalg.solve((centre + radius * t) * np.eye(d) - v, y)).real for t in turn) / NODES
        u, size, _ = np.linalg.svd(q, full_matrices=False)
        u = u[:, size > 1e-9 * size[0]]  # what the filter left of other eigenvectors is noise
        h = u.T @ v @ u
        values, w = np.linalg.eigh((h + h.T) / 2)
        y = u @ w
        inside = np.flatnonzero((values > low) & (values <= high))[::-1]
        error = float(np.linalg.norm(v @ y[:, inside] - y[:, inside] * values[inside], axis=0).max(initial=0)) / norm
        if len(inside) == count:
            if error < 1e-15 or best <= 1e-12 and error > best / 2:
                break
            best = min(best, error)
        if len(inside) != count or error > last / 16:  # others are too near to be filtered out: hold them too
            width = min(d, 2 * width)
            y = np.concatenate([y, rng.standard_normal((d, max(0, width - y.shape[1])))], 1)
        last = error
    if len(inside) != count or error > 1e-10:
        raise ArithmeticError(f"{len(inside)} of {count} eigenvalues found, residual {error}")
    return values[inside], y[:, inside]


def feast(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(eigenvalues[k'], vectors[d, k'])``: the ``k`` largest of the symmetric ``v``, falling; fewer if the rest is noise."""
    low, high, count = interval_of_top(v, k)
    if not count:
        return np.zeros(0), np.zeros((len(v), 0))
    found = [feast_slice(v, *s) for s in slices(v, low, high)]
    values, vectors = np.concatenate([f[0] for f in found])[:k], np.concatenate([f[1] for f in found], 1)[:, :k]
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    return values, vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(values))] < 0, -1.0, 1.0)


@dataclass(frozen=True)
class Whitening:
    """What a fit leaves: ``n``, the integer ``middle``, ``rest = S - n * middle``, eigenvalues, vectors and the trace."""

    n: int
    middle: list
    rest: list
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def fit(vectors: DataFrame, k: int) -> Whitening:
    """Fit on all ``vectors`` (``x``); one pass for the sums, one for the scatter matrix."""
    n, sums = _sums(vectors)
    if not n:
        return Whitening(0, [], [], np.zeros(0), np.zeros((0, 0)), 0.0)
    middle = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, middle)]
    g = _scatter(vectors, middle)
    # integers divided once: every entry is rounded correctly
    v = np.array([[(n * g[i][j] - rest[i] * rest[j]) / (n * n) for j in range(len(rest))] for i in range(len(rest))])
    return Whitening(n, middle, rest, *feast(v, k), float(np.trace(v)))


def transform(vectors: DataFrame, model: Whitening) -> DataFrame:
    """``id, deviation, whitened``: each vector's exact distance and its whitened coordinates."""
    middle, rest, n = np.array(model.middle, np.int64), model.rest, model.n
    mean_rest, projection = np.array([r / n for r in rest]), model.vectors / np.sqrt(model.values)
    k = projection.shape[1]

    def rows(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            y = matrix_of(batch.column(1)) - middle
            if (n * (int(np.abs(y).max()) + 1)) ** 2 * y.shape[1] <= LONG:
                deviation = ((n * y - np.array(rest, np.int64)) ** 2).sum(1).tolist()
            else:
                deviation = [t if t <= LONG else None for t in ((n * y.astype(object) - np.array(rest, object)) ** 2).sum(1)]
            white = (y - mean_rest) @ projection
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(y) + 1, k), pa.int32()), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), lists], ["id", "deviation", "whitened"])

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "x").mapInArrow(rows, f"id {kind}, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, k: int) -> float:
    """The largest entry of the coordinates' covariance minus the identity, over all rows."""
    w, pairs = F.col("whitened"), [(i, j) for i in range(k) for j in range(i, k)]
    row = whitened.agg(*[F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i, j in pairs]).head()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 8) -> DataFrame:
    """A row for each vector and component: ``id, component, n, deviation, whitened, explained, identity_error``."""
    vectors = integer_vectors(rows, id_col, vector)
    model = fit(vectors, k)
    found = len(model.values)
    if not found:
        return vectors.limit(0).select(F.col("id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))])
    white = staged(transform(vectors, model), "whitened")
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    at = white.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return at.select(F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(identity_error(white, found)).alias("identity_error"))
