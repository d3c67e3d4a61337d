"""Whitening of embeddings by components that are exact to double precision.

Vectors become whole numbers, so their scatter is a matrix of integers, summed
without rounding. Its characteristic polynomial is found modulo many primes, by
reduction to Hessenberg form in one task each, and put together by Chinese
remainders. All its roots are real, so the sign changes of its coefficients,
shifted to a point, count the roots beyond that point exactly: this isolates
the largest roots, and bisection makes them as sharp as wanted. A component is
what inverse iteration finds in the null space of the scatter less its root, in
long fixed-point numbers.

What passes through the driver is bounded by the dimension d of the vectors:
sums of d * (d + 1) / 2 products, d + 1 remainders for each prime, and d numbers
for each component. Vectors stay in their tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from strandframe.llm.common import extended
from strandframe.scratch import Scratch

#: A component c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries from here on would leave the range of a long; their rows count as not finite.
LARGEST = float(1 << 52)
#: Bits of the roots, relative to the largest that they might be, and of the fixed-point numbers of inverse iteration.
ROOT_BITS, FIXED_BITS, ROUNDS = 160, 384, 3
#: Bits of the parts that products and sums are split into.
_LIMB, _PART = 21, 40


@dataclass
class Whitening:
    """What was fitted: n vectors of d entries, sums of floor(SCALE * c), the scatter (n times the sum of products less the product of sums), its characteristic polynomial by rising power, and per component its root, unit vector, and share of the trace."""

    n: int
    sums: list[int]
    scatter: list[list[int]]
    polynomial: list[int]
    roots: list[Fraction]
    vectors: np.ndarray
    explained: list[float | None]


def usable(embeddings: DataFrame) -> DataFrame:
    """Rows whose vector is not null, has finite entries alone, and as many as most vectors have (of equally frequent lengths the longest); empty vectors don't count."""
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", _finite)
    rows = embeddings.where(F.coalesce(fine, F.lit(False)))
    most = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("embedding") == (most.d if most else -1))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < LARGEST)


def _whole(column: pa.Array) -> np.ndarray:
    """floor(SCALE * c) of a batch of vectors, one row each."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat).astype(np.int64).reshape(len(column), -1)


def _product(rows: np.ndarray) -> np.ndarray:
    """The sum of products of all columns, in Python's integers: parts of LIMB bits are multiplied as doubles, few enough rows at once that nothing is rounded."""
    d = rows.shape[1]
    out = np.zeros((d, d), object)
    parts, rest = [], rows
    while True:
        low = rest - (rest >> _LIMB << _LIMB) if np.abs(rest).max(initial=0) >= 1 << _LIMB else rest
        parts.append(low.astype(np.float64))
        if low is rest:
            break
        rest = rest >> _LIMB
    step = 1 << 53 - 2 * _LIMB
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            both = np.zeros((d, d), np.int64)
            for at in range(0, len(rows), step):
                both += (a[at : at + step].T @ b[at : at + step]).astype(np.int64)
            out += both.astype(object) * (1 << _LIMB * (i + j))
    return out


def _exact_sums(rows: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of rows, the sums of their whole numbers and of all products. Each task hands on one number for each pair of columns, in parts that add up in longs."""

    def run(batches):
        products, sums, n = np.zeros((d, d), object), np.zeros(d, object), 0
        for batch in batches:
            whole = _whole(batch.column("embedding"))
            products = products + _product(whole)
            sums = sums + np.array([sum(c) for c in whole.T.tolist()], object) if np.abs(whole).max(initial=0) >= 1 << 40 else sums + whole.sum(0).astype(object)
            n += len(whole)
        if n:
            upper = np.triu_indices(d)
            places = [*zip(*(x.tolist() for x in upper), strict=True), *((-1, i) for i in range(d)), (-2, 0)]
            values = [*products[upper].tolist(), *sums.tolist(), n]
            out = []
            for (i, j), v in zip(places, values, strict=True):
                k = 0
                while v:
                    low = (v + (1 << _PART - 1)) % (1 << _PART) - (1 << _PART - 1)
                    out.append((i, j, k, low))
                    v, k = (v - low) >> _PART, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(),) * 3 + (pa.int64(),), strict=True)], ["i", "j", "k", "v"])

    found = rows.select("embedding").mapInArrow(run, "i int, j int, k int, v long").groupBy("i", "j", "k").agg(F.sum("v").alias("v")).collect()
    products, sums, n = np.zeros((d, d), object), np.zeros(d, object), 0
    for r in found:
        value = r.v << _PART * r.k
        if r.i >= 0:
            products[r.i, r.j] += value
        elif r.i == -1:
            sums[r.j] += value
        else:
            n += value
    return n, sums, np.triu(products) + np.triu(products, 1).T


def primes(n: int) -> list[int]:
    """The n largest primes below 2**31, whose products fit a long; no more than four bases are needed to tell them apart."""
    out, p = [], (1 << 31) - 1
    while len(out) < n:
        if all(_passes(p, base) for base in (2, 3, 5, 7)):
            out.append(p)
        p -= 2
    return out


def _passes(p: int, base: int) -> bool:
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    x = pow(base, odd, p)
    return x in (1, p - 1) or any((x := x * x % p) == p - 1 for _ in range(twos - 1))


def characteristic_mod(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients by rising power of the characteristic polynomial of a matrix of longs modulo p, through its Hessenberg form."""
    a, n = a.copy() % p, len(a)
    for m in range(1, n - 1):
        held = np.flatnonzero(a[m:, m - 1])
        if not len(held):
            continue
        i = m + int(held[0])
        if i != m:
            a[[i, m]] = a[[m, i]]
            a[:, [i, m]] = a[:, [m, i]]
        u = a[m + 1 :, m - 1] * pow(int(a[m, m - 1]), -1, p) % p
        a[m + 1 :] = (a[m + 1 :] - u[:, None] * a[m] % p) % p
        a[:, m] = (a[:, m] + (a[:, m + 1 :] * u % p).sum(1)) % p
    # the polynomials of leading minors, each from those before it
    minors = np.zeros((n + 1, n + 1), np.int64)
    minors[0, 0] = 1
    below = [int(a[j, j - 1]) for j in range(1, n)]
    for k in range(1, n + 1):
        run, weights = 1, np.zeros(k, np.int64)
        for i in range(k - 1, -1, -1):
            weights[i] = int(a[i, k - 1]) * run % p
            if i:
                run = run * below[i - 1] % p
        minors[k, 1:] = minors[k - 1, :-1]
        minors[k] = (minors[k] - (weights[:, None] * minors[:k] % p).sum(0)) % p
    return minors[n]


def characteristic(spark: SparkSession, scatter: np.ndarray) -> list[int]:
    """Coefficients by rising power of the characteristic polynomial of a positive semidefinite matrix of integers.

    No root exceeds the largest row sum r, so no coefficient (1 + r) ** d; that
    says how many primes are needed.
    """
    d = len(scatter)
    most = (1 + max(int(x) for x in np.abs(scatter).sum(1))) ** d
    used = primes(most.bit_length() // 30 + 2)
    rows = scatter.tolist()

    def run(batches):
        matrix = np.array(rows, object)
        for batch in batches:
            at = batch.column("id").to_pylist()
            found = [characteristic_mod((matrix % used[i]).astype(np.int64), used[i]).tolist() for i in at]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.int64()))], ["id", "remainders"])

    parts = min(len(used), max(1, spark.sparkContext.defaultParallelism))
    found = {r.id: r.remainders for r in spark.range(0, len(used), 1, parts).mapInArrow(run, "id long, remainders array<long>").collect()}
    out, modulus = [0] * (d + 1), 1
    for i, p in enumerate(used):
        inverse = pow(modulus % p, -1, p)
        out = [c + modulus * ((r - c) * inverse % p) for c, r in zip(out, found[i], strict=True)]
        modulus *= p
    return [c - modulus if 2 * c > modulus else c for c in out]


def _beyond(polynomial: list[int], at: int) -> int:
    """How many roots of a real-rooted polynomial lie beyond at, counted with their multiplicity: the sign changes after a shift to at."""
    c = list(polynomial)
    for i in range(len(c) - 1):
        for k in range(len(c) - 2, i - 1, -1):
            c[k] += at * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _value(polynomial: list[int], at: int) -> int:
    out = 0
    for c in reversed(polynomial):
        out = out * at + c
    return out


def largest_roots(polynomial: list[int], n: int, bits: int = ROOT_BITS) -> list[tuple[Fraction, int]]:
    """(root, multiplicity) of the n largest roots, from the largest, of a monic integer polynomial whose roots are all real and not negative.

    Roots are as sharp as 2**-bits of the bound of all; those that are closer
    to each other count as one. Zero is exact.
    """
    d = len(polynomial) - 1
    bound = 1 - min(0, polynomial[d - 1])  # the sum of all roots, and one
    fine = max(0, bits - bound.bit_length())
    scaled = [c << fine * (d - k) for k, c in enumerate(polynomial)]
    out: list[tuple[Fraction, int]] = []
    todo = [(-1, bound << fine, d, 0)]
    while todo:
        lo, hi, n_lo, n_hi = todo.pop()  # the roots in (lo, hi]
        if n_lo == n_hi or n_hi >= n:
            continue
        if n_lo - n_hi == 1:
            while hi - lo > 1:
                mid = (lo + hi) // 2
                v = _value(scaled, mid)
                if v == 0:
                    lo, hi = mid - 1, mid
                elif (v > 0) == (n_hi % 2 == 0):
                    hi = mid
                else:
                    lo = mid
        if hi - lo == 1:
            root = Fraction(hi, 1 << fine) if hi == 0 or _value(scaled, hi) == 0 else Fraction(2 * hi - 1, 2 << fine)
            out.append((root, n_lo - n_hi))
            continue
        mid = (lo + hi) // 2
        n_mid = _beyond(scaled, mid)
        todo += [(lo, mid, n_lo, n_mid), (mid, hi, n_mid, n_hi)]
    return out


def null_space(scatter: list[list[int]], root: Fraction, n: int) -> np.ndarray:
    """n orthogonal unit vectors that the matrix multiplies by root, by inverse iteration in fixed-point numbers."""
    d, one = len(scatter), 1 << FIXED_BITS
    size = max(1, max(abs(x) for row in scatter for x in row)).bit_length()
    a = np.array([[(x << FIXED_BITS) >> size for x in row] for row in scatter], object)
    shift = (root.numerator << FIXED_BITS) // (root.denominator << size)
    for i in range(d):
        a[i, i] -= shift
    steps = []  # the row that takes each place, and what of it the rows below lose
    for k in range(d):
        best = max(range(k, d), key=lambda r: abs(a[r, k]))
        a[[k, best]] = a[[best, k]]
        if a[k, k] == 0:
            a[k, k] = 1  # the root is exact: the smallest number stands for its distance
        f = np.array([(x << FIXED_BITS) // a[k, k] for x in a[k + 1 :, k]], object)
        if len(f):
            a[k + 1 :, k + 1 :] -= f[:, None] * a[k, k + 1 :] >> FIXED_BITS
        steps.append((best, f))

    def solve(v: np.ndarray) -> np.ndarray:
        v = v.copy()
        for k, (best, f) in enumerate(steps):
            v[[k, best]] = v[[best, k]]
            if len(f):
                v[k + 1 :] -= f * v[k] >> FIXED_BITS
        for k in range(d - 1, -1, -1):
            known = int((a[k, k + 1 :] * v[k + 1 :]).sum()) >> FIXED_BITS
            v[k] = (v[k] - known << FIXED_BITS) // a[k, k]
        return v

    def unit(v: np.ndarray) -> np.ndarray:
        length = isqrt(int((v * v).sum()))
        return np.array([(x << FIXED_BITS) // length for x in v], object)

    found: list[np.ndarray] = []
    # the first vectors are any that are unlikely to miss a component
    block = [unit(np.array([pow(3, (i + 1) * d + j + 1, (1 << 31) - 1) - (1 << 30) for j in range(d)], object)) for i in range(n)]
    for _ in range(ROUNDS):
        found = []
        for v in block:
            v = unit(solve(v))
            for _ in range(2):
                for w in found:
                    v = v - (w * (int((v * w).sum()) >> FIXED_BITS) >> FIXED_BITS)
                v = unit(v)
            found.append(v)
        block = found
    out = np.array([[x / one for x in v.tolist()] for v in found])
    # either sign is a component: the first of its largest entries is made positive
    return out * np.sign(out[np.arange(n), np.abs(out).argmax(1)])[:, None]


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on all of rows (of usable); None if there are none."""
    spark = rows.sparkSession
    first = rows.select(F.size("embedding").alias("d")).first()
    if first is None:
        return None
    d = first.d
    n, sums, products = _exact_sums(rows, d)
    scatter = n * products - np.outer(sums, sums)
    polynomial = characteristic(spark, scatter)
    roots = largest_roots(polynomial, min(components, d))
    matrix = scatter.tolist()

    def run(batches):
        for batch in batches:
            at = batch.column("id").to_pylist()
            found = [null_space(matrix, *roots[i]).tolist() if roots[i][0] else None for i in at]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.list_(pa.float64())))], ["id", "vectors"])

    found = {r.id: r.vectors for r in spark.range(0, len(roots), 1, len(roots)).mapInArrow(run, "id long, vectors array<array<double>>").collect()}
    values, vectors = [], []
    for i, (root, times) in enumerate(roots):
        values += [root] * times
        vectors += found[i] if root else [[0.0] * d] * times
    count, trace = min(components, d), sum(matrix[i][i] for i in range(d))
    return Whitening(n, sums.tolist(), matrix, polynomial, values[:count], np.array(vectors[:count]), [float(v / trace) if trace else None for v in values[:count]])


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """rows (of usable: embedding and any other columns) with deviation, deviation_wide and whitened.

    deviation is the sum over dimensions of (n * x - S) ** 2: exact in
    deviation_wide (decimal, null beyond 38 digits), and null as a long where
    it would not fit. whitened holds a number for each component, null for one
    of root zero.
    """
    n, sums, d = model.n, np.array(model.sums, object), len(model.sums)
    mean = np.array([s / n for s in model.sums])
    live = [k for k, root in enumerate(model.roots) if root]
    scale = np.array([float(model.roots[k] / n**2) ** -0.5 for k in live])
    weights = (model.vectors[live] * scale[:, None]).T if live else np.zeros((d, 0))
    count = len(model.roots)
    kept = rows.select(*[c for c in rows.columns if c not in ("deviation", "deviation_wide", "whitened")])

    def run(batches):
        for batch in batches:
            whole = _whole(batch.column("embedding"))
            most = n * int(np.abs(whole).max(initial=0)) + max(abs(s) for s in sums)
            if d * most * most < 1 << 62:
                deviation = ((n * whole - sums.astype(np.int64)) ** 2).sum(1).tolist()
            else:
                deviation = [int(x) for x in ((n * whole.astype(object) - sums) ** 2).sum(1)]
            values = (whole - mean) @ weights
            flat = np.full((len(whole), count), np.nan)
            flat[:, live] = values
            arrays = [
                pa.array([x if x < 1 << 63 else None for x in deviation], pa.int64()),
                pa.array([x if x < 10**38 else None for x in deviation], pa.decimal128(38, 0)),
                pa.ListArray.from_arrays(np.arange(len(whole) + 1, dtype=np.int32) * count, pa.array(flat.reshape(-1), mask=np.isnan(flat.reshape(-1)))),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, "deviation", "deviation_wide", "whitened"])

    schema = extended(kept, ("deviation", "long"), ("deviation_wide", "decimal(38,0)")).add("whitened", ArrayType(DoubleType()))
    return kept.mapInArrow(run, schema)


def identity_error(table: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the covariance of whitened (a column of table) less the identity, components of root zero left out; None if there are no others."""
    live = [k for k, root in enumerate(model.roots) if root]
    if not live:
        return None
    w = F.col("whitened")
    means = table.agg(*[F.avg(w[k]) for k in live]).first()
    off = {k: w[k] - F.lit(m) for k, m in zip(live, means, strict=True)}
    pairs = [(i, j) for i in live for j in live if i <= j]
    found = table.agg(*[F.sum(off[i] * off[j]) / model.n for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs, strict=True))


def op11_query(embeddings: DataFrame) -> DataFrame:
    """One row for each usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error and deviation_wide.

    Repeated rows and rows without vec_id count like all others. With d
    dimensions below eight there are d components. Components of root zero (of
    less than d + 1 different vectors, say) have a null as whitened; if all
    are, explained and identity_error are null too. No usable row gives no rows.
    """
    rows = usable(embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")))
    model = fit(rows)
    if model is None:
        none = [("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"), ("deviation_wide", "decimal(38,0)")]
        return rows.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in none]).limit(0)
    table = Scratch(embeddings.sparkSession, "whitening").save(whiten(rows, model).drop("embedding"), "whitened")
    error = identity_error(table, model)
    each = table.select("vec_id", "deviation", "deviation_wide", F.posexplode("whitened").alias("place", "whitened"))
    shares = F.array(*[F.lit(x).cast("double") for x in model.explained])
    return each.select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        shares[F.col("place")].alias("explained"), F.lit(error).cast("double").alias("identity_error"), "deviation_wide",
    )
