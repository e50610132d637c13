"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

Entries become integers, so the scatter ``A = n * sum(x x') - S S'`` is an integer matrix, summed
exactly in tasks. Its characteristic polynomial is found modulo many primes, a prime a row of a
Spark job (reduction to Hessenberg form, then the recurrence of leading blocks), and put together
by Chinese remainders. All its roots are real, so Descartes' rule counts the roots beyond a point
exactly; bisection on that count isolates them and bisection on signs refines them. Components
come from inverse iteration on ``A - root``, with as many digits as the gaps between roots ask
for, a root (or a cluster of equal ones) a row of a second job. Only numbers that depend on the
dimension alone reach the driver.
"""

from __future__ import annotations

import decimal as dc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.scratch import table

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
#: Entries of this size or more have no exact long and count as not finite.
LARGEST = float(1 << 40)
#: Rows of a block whose products are summed in doubles without rounding.
BLOCK_ROWS = 4096
#: Bits of a root beyond its own size, and of a slice of a component.
ROOT_BITS, SLICE_BITS, SLICES, LIMB_BITS = 110, 24, 4, 18


# ---------------------------------------------------------------- exact sums


def finite(vector: Column) -> Column:
    """The vector is there and every entry is a number that a long holds."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda v: F.coalesce(F.abs(v.cast("double")) < LARGEST, F.lit(False))), F.lit(False))


def usable(vectors: DataFrame, vector_col: str) -> tuple[DataFrame, int]:
    """The rows that can be fitted and their dimension, the most frequent length (ties: the shortest)."""
    ok = vectors.where(finite(F.col(vector_col)))
    sizes = ok.groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = sizes[0]["d"] if sizes else 0
    return ok.where(F.size(vector_col) == dim), dim


def integers(column: pa.Array, dim: int) -> np.ndarray:
    """floor(64 * entry) of each vector, without the offset, which no covariance sees."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * values).astype(np.int64).reshape(len(column), dim)


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Doubles of ``bits`` bits at most that add up to x, times 2**(bits * k); the last has the sign."""
    top = int(np.abs(x).max()) if x.size else 0
    out = []
    while top >> bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x, top = x >> bits, top >> bits
    return [*out, x.astype(np.float64)]


def block_sums(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and products of one block, as Python integers."""
    parts = limbs(y, 20)
    products = np.zeros((y.shape[1], y.shape[1]), object)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            products = products + (a.T @ b).astype(np.int64).astype(object) * (1 << (20 * (i + j)))
    return y.sum(axis=0).astype(object), products


def scatter(rows: DataFrame, vector_col: str, dim: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums by dimension and the sums of products of all vectors, exact."""
    upper = np.triu_indices(dim)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            y = integers(batch.column(0), dim)
            for at in range(0, len(y), BLOCK_ROWS):
                s, p = block_sums(y[at : at + BLOCK_ROWS])
                sums, products = sums + s, products + p
            n += len(y)
        if n:
            flat = [n, *sums, *products[upper]]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array([dc.Decimal(int(v)) for v in flat], pa.decimal128(38, 0))], ["k", "v"])

    got = rows.select(vector_col).mapInArrow(task, "k int, v decimal(38,0)").groupBy("k").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect()
    flat = [int(r["v"]) for r in sorted(got)]
    products = np.zeros((dim, dim), object)
    products[upper] = flat[1 + dim :]
    return flat[0], flat[1 : 1 + dim], np.triu(products) + np.triu(products, 1).T


# ---------------------------------------------------------------- the polynomial


def is_prime(n: int) -> bool:
    """Miller and Rabin's test; these bases decide every n below 2**32."""
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 7, 61):
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(r - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_for(matrix: np.ndarray) -> list[int]:
    """Primes below 2**31 whose product is more than twice any coefficient.

    A coefficient is an elementary symmetric mean of roots that are not negative, so it is at
    most C(d, k) * (trace / d)**k.
    """
    d, trace = len(matrix), int(np.trace(matrix))
    bound = 2 * max(math.comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    out, product, p = [], 1, (1 << 31) - 1
    while product <= bound:
        if is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def charpoly_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(t - matrix) modulo p, lowest first, by Hessenberg reduction."""
    h = (matrix % p).astype(np.int64)
    d = len(h)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        j = k + 1 + int(below[0])
        if j != k + 1:
            h[[k + 1, j]] = h[[j, k + 1]]
            h[:, [k + 1, j]] = h[:, [j, k + 1]]
        u = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * u % p).sum(axis=1)) % p
    # polys[k] belongs to the leading k by k block
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        polys[k, 1:] = polys[k - 1, :-1]
        weights, below = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):
            weights[i] = int(h[i, k - 1]) * below % p
            below = below * int(h[i, i - 1]) % p if i else 0
        polys[k] = (polys[k] - (weights[:, None] * polys[:k] % p).sum(axis=0)) % p
    return polys[d]


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Exact coefficients of det(t - matrix), lowest first; a prime is a row of the job."""
    primes = primes_for(matrix)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([charpoly_mod(matrix, primes[k]).tolist() for k in ks], pa.list_(pa.int64()))], ["k", "c"])

    parts = min(len(primes), spark.sparkContext.defaultParallelism)
    got = spark.range(0, len(primes), 1, parts).mapInArrow(task, "k long, c array<long>").collect()
    product = math.prod(primes)
    total = [0] * (len(matrix) + 1)
    for row in got:
        p = primes[row["k"]]
        rest = product // p
        weight = rest * pow(rest, -1, p)
        total = [t + c * weight for t, c in zip(total, row["c"], strict=True)]
    total = [t % product for t in total]
    return [t - product if 2 * t > product else t for t in total]


# ---------------------------------------------------------------- its roots


def count_above(poly: list[int], m: int, s: int) -> int:
    """Roots above m / 2**s, with multiplicity: the sign changes after a shift by that point.

    Descartes' rule is exact here, because all roots are real.
    """
    d = len(poly) - 1
    c = [v << (s * (d - k)) for k, v in enumerate(poly)]
    for i in range(d):
        carry = c[d]
        for k in range(d - 1, i - 1, -1):
            carry = c[k] = c[k] + m * carry
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def sign_at(poly: list[int], m: int, s: int) -> int:
    """The sign of the polynomial at m / 2**s."""
    d, r = len(poly) - 1, 0
    for k in range(d, -1, -1):
        r = r * m + (poly[k] << (s * (d - k)))
    return (r > 0) - (r < 0)


def positive_roots(poly: list[int], most: int) -> list[tuple[int, int, int]]:
    """The largest roots above 0, falling, as (m, s, multiplicity) for m / 2**s, until they are
    at least ``most`` with multiplicity. Each is right to ``ROOT_BITS`` bits of its own size;
    roots that agree so far are one."""
    while poly and poly[0] == 0:  # roots that are 0
        poly = poly[1:]
    d = len(poly) - 1
    if d < 1:
        return []
    top = 1 << (abs(poly[d - 1]).bit_length() + 1)  # above the trace
    out: list[tuple[int, int, int]] = []
    # intervals (m, m + w] / 2**s with the roots above either end; the highest is taken first
    stack = [(0, top, 0, d, 0)]
    while stack and sum(r[2] for r in out) < most:
        m, w, s, above_low, above_high = stack.pop()
        roots = above_low - above_high
        if not roots:
            continue
        if m and m.bit_length() - w.bit_length() >= ROOT_BITS:
            out.append((m, s, roots))
            continue
        if roots == 1 and m:
            out.append(_refine(poly, m, w, s))
            continue
        if w == 1:
            m, w, s = 2 * m, 2, s + 1
        half = w // 2
        middle = count_above(poly, m + half, s)
        stack.append((m, half, s, above_low, middle))
        stack.append((m + half, w - half, s, middle, above_high))
    return out


def _refine(poly: list[int], m: int, w: int, s: int) -> tuple[int, int, int]:
    """The one root in (m, m + w] / 2**s, by its sign change."""
    high = sign_at(poly, m + w, s)
    if not high:
        return m + w, s, 1
    while m.bit_length() - w.bit_length() < ROOT_BITS:
        if w == 1:
            m, w, s = 2 * m, 2, s + 1
        half = w // 2
        at = sign_at(poly, m + half, s)
        if not at:
            return m + half, s, 1
        if at == high:
            w = half
        else:
            m, w = m + half, w - half
    return m, s, 1


# ---------------------------------------------------------------- its components


def _solve(lu: np.ndarray, order: list[int], b: np.ndarray) -> np.ndarray:
    """Forward and back substitution."""
    y = b[order].copy()
    d = len(y)
    for k in range(d):
        y[k + 1 :] = y[k + 1 :] - lu[k + 1 :, k] * y[k]
    for k in range(d - 1, -1, -1):
        y[k] = y[k] / lu[k, k]
        y[:k] = y[:k] - lu[:k, k] * y[k]
    return y


def null_vectors(matrix: np.ndarray, root: dc.Decimal, count: int, digits: int) -> np.ndarray:
    """``count`` orthonormal vectors that ``matrix - root`` takes to almost nothing, by inverse
    iteration with ``digits`` digits; of each the largest entry is positive."""
    d = len(matrix)
    with dc.localcontext() as ctx:
        ctx.prec = digits
        lu = np.array([[dc.Decimal(int(v)) for v in row] for row in matrix], object)
        norm = max(sum(abs(v) for v in row) for row in lu) or dc.Decimal(1)
        for k in range(d):
            lu[k, k] = lu[k, k] - root
        order = list(range(d))
        for k in range(d):
            j = max(range(k, d), key=lambda i: abs(lu[i, k]))
            if j != k:
                lu[[k, j]] = lu[[j, k]]
                order[k], order[j] = order[j], order[k]
            if abs(lu[k, k]) < norm.scaleb(-digits):
                lu[k, k] = norm.scaleb(-digits)
            if k + 1 < d:
                lu[k + 1 :, k] = lu[k + 1 :, k] / lu[k, k]
                lu[k + 1 :, k + 1 :] = lu[k + 1 :, k + 1 :] - np.outer(lu[k + 1 :, k], lu[k, k + 1 :])
        found: list[np.ndarray] = []
        for c in range(count):
            # a start that no given vector is orthogonal to, but by chance
            v = np.array([dc.Decimal(1) + dc.Decimal((i * i * 7919 + (c + 1) * (i + 1) * 104729) % 10007) / 10007 for i in range(d)], object)
            for _ in range(4):
                for f in found:
                    v = v - f * (f @ v)
                v = _solve(lu, order, v / (v @ v).sqrt())
                v = v / (v @ v).sqrt()
            for _ in range(2):
                for f in found:
                    v = v - f * (f @ v)
                v = v / (v @ v).sqrt()
            found.append(v)
        out = []
        for v in found:
            big = max(range(d), key=lambda i: (abs(v[i]).quantize(dc.Decimal("1e-12")), -i))
            out.append(v if v[big] > 0 else -v)
        return np.array(out, object)


def slices_of(v: dc.Decimal, prec: int = 60) -> list[float]:
    """``v`` as ``SLICES`` doubles of ``SLICE_BITS`` bits each, the largest first, times 2**24."""
    with dc.localcontext() as ctx:
        ctx.prec = prec
        out = []
        for _ in range(SLICES):
            v = v * (1 << SLICE_BITS)
            whole = v.to_integral_value()
            out.append(float(whole))
            v -= whole
        return out


class Whitening:
    """What ``fit`` learns: exact sums, eigenvalues of the scatter and sliced components.

    ``roots`` and ``slices`` belong to components with an eigenvalue above 0, ``zeros`` is how
    many of the asked for components have none.
    """

    def __init__(self, n: int, sums: list[int], trace: int, roots: list[dc.Decimal], slices: np.ndarray, zeros: int) -> None:
        self.n, self.sums, self.trace, self.roots, self.slices, self.zeros = n, sums, trace, roots, slices, zeros
        self.explained = [float(r / trace) for r in roots]

    @property
    def components(self) -> np.ndarray:
        """Unit vectors in doubles, one a row."""
        weights = 2.0 ** (-SLICE_BITS * np.arange(1, SLICES + 1))
        return (self.slices * weights[:, None, None]).sum(axis=0)

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n * x - S, exact: as longs where they fit, else as Python integers."""
        most = (int(np.abs(y).max()) if y.size else 0) * self.n + max((abs(s) for s in self.sums), default=0)
        if most < 1 << 62:
            return y * self.n - np.array(self.sums, np.int64)
        return y.astype(object) * self.n - np.array(self.sums, object)

    def project(self, t: np.ndarray) -> np.ndarray:
        """Rows ``n * x - S`` on all components over the root of their eigenvalue.

        Limbs and slices multiply without rounding; their sums are kept as pairs of doubles, so
        that what cancels leaves no noise in components of little variance.
        """
        high = np.zeros((len(t), len(self.roots)))
        low = np.zeros_like(high)
        parts = limbs(t, LIMB_BITS)
        for i in range(len(parts) - 1, -1, -1):
            for j in range(SLICES):
                term = (parts[i] @ self.slices[j].T) * 2.0 ** (LIMB_BITS * i - SLICE_BITS * (j + 1))
                total = high + term
                back = total - high
                low += (high - (total - back)) + (term - back)
                high = total
        return (high + low) / np.array([float(r.sqrt()) for r in self.roots])


def fit(rows: DataFrame, vector_col: str, dim: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all rows of dimension ``dim``; None if there is no row or no dimension."""
    if not dim:
        return None
    n, sums, products = scatter(rows, vector_col, dim)
    column = np.array(sums, object)
    a = products * n - np.outer(column, column)
    trace, wanted = int(np.trace(a)), min(components, dim)
    if not trace:
        return Whitening(n, sums, 1, [], np.zeros((SLICES, 0, dim)), wanted)
    spark = rows.sparkSession
    common = math.gcd(*(int(v) for v in a.ravel()))
    small = a // common
    roots = positive_roots(characteristic_polynomial(spark, small), wanted)
    with dc.localcontext() as ctx:
        ctx.prec = 60
        values = [dc.Decimal(m) / (1 << s) for m, s, _ in roots]
        gaps = [x - y for x, y in zip(values, values[1:], strict=False)] + [values[-1]]
        # of the digits of the norm, those down to the smallest gap, and those of the result
        digits = 40 + 2 * max(0, *((dc.Decimal(int(np.trace(small))) / g).adjusted() for g in gaps))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                m, s, count = roots[k]
                with dc.localcontext() as inner:
                    inner.prec = digits + 20
                    root = dc.Decimal(m) / (1 << s)
                vectors = null_vectors(small, root, count, digits)
                flat = [[x for e in v for x in slices_of(e)] for v in vectors]
                yield pa.RecordBatch.from_arrays([pa.array([k] * count, pa.int64()), pa.array(range(count), pa.int32()), pa.array(flat, pa.list_(pa.float64()))], ["k", "c", "v"])

    got = spark.range(0, len(roots), 1, min(len(roots), spark.sparkContext.defaultParallelism)).mapInArrow(task, "k long, c int, v array<double>").collect()
    got = sorted(got)[:wanted]
    slices = np.array([r["v"] for r in got]).reshape(len(got), dim, SLICES).transpose(2, 0, 1)
    with dc.localcontext() as ctx:
        ctx.prec = 60
        return Whitening(n, sums, trace, [values[r["k"]] * common for r in got], slices, wanted - len(got))


def identity_error(rows: DataFrame, vector_col: str, dim: int, model: Whitening) -> float | None:
    """The largest absolute entry of the whitened rows' covariance minus the identity; None
    without a component that varies. Whitened rows are centred exactly, so plain sums do."""
    k = len(model.roots)
    if not k:
        return None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            y = integers(batch.column(0), dim)
            for at in range(0, len(y), BLOCK_ROWS):
                w = model.project(model.centred(y[at : at + BLOCK_ROWS]))
                total[:k] += w.T @ w
                total[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["k", "v"])

    got = rows.select(vector_col).mapInArrow(task, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    total = np.array([r["v"] for r in sorted(got)]).reshape(k + 1, k) / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each vector's coordinates on the leading components of all vectors, in unit variance.

    Returns a row for each usable vector and component: the id, ``component`` from 1, ``n``,
    ``deviation`` (sum of (n * x - S)**2, exact; null beyond a long), ``whitened``, ``explained``
    and ``identity_error``.

    * A vector that is null, or has an entry that is null, not finite or of 2**40 or more, goes;
      so does one whose length is not the most frequent length (ties: the shortest).
    * Repeated rows and ids count and come back as often as they stand. Ids may be null.
    * A component without variance (few rows, constant or dependent dimensions) has a null
      ``whitened`` and 0 as ``explained``; with no varying component ``identity_error`` is null.
    * Other columns of ``vectors`` are left behind, so that none can clash.
    * No usable vector, or only empty ones: no rows.
    """
    narrow = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    rows, dim = usable(narrow, "vector")
    id_type = narrow.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(rows, "vector", dim, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    error = identity_error(rows, "vector", dim, model)
    k = len(model.roots) + model.zeros
    explained = np.array([*model.explained, *[0.0] * model.zeros])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                r = batch.num_rows
                t = model.centred(integers(batch.column(1), dim))
                deviation = [v if v < 1 << 63 else None for v in (t.astype(object) ** 2).sum(axis=1)]
                w = np.concatenate([model.project(t), np.zeros((r, model.zeros))], axis=1)
                lost = np.broadcast_to(np.arange(k) >= len(model.roots), (r, k)).ravel()
                of = np.repeat(np.arange(r), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(of)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)),
                        pa.array(np.full(r * k, model.n, np.int64)),
                        pa.array(deviation, pa.int64()).take(pa.array(of)),
                        pa.array(w.ravel(), mask=lost),
                        pa.array(np.tile(explained, r)),
                        pa.array([error] * (r * k), pa.float64()),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(task, schema).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``whiten`` over all embeddings."""
    return whiten(table(spark, sf_dir, "embeddings"))
