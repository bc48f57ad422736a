"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter matrix.

Every entry c becomes x = floor(1024 c) + 100000. M = n * sum(x x') - S S' holds whole numbers only and is n * n times the covariance; tasks sum it without
rounding. Its characteristic polynomial is found modulo enough primes, a prime to a task row, by reduction to Hessenberg form, and put together by
Chinese remainders. All of its roots are real, so the signs of the coefficients of p(x + a) change once for each root above a: roots are isolated and
counted with their multiplicity by bisection with whole numbers, to many more digits than a double has. Components come by inverse iteration
into the null space of M - e, in fixed point of the same precision, each at right angles to those before it.

Defined cases: rows whose vector is null or holds a null or non-finite entry are dropped, so are those of another length than most vectors have (the
greater length on a tie); rows that repeat count as often as they stand; components with an eigenvalue of 0 are left out, so constant
dimensions and fewer rows than components give fewer rows, and one vector or an empty table none; equal eigenvalues share their explained part, and
their components are any that are orthonormal. An entry too large for a long is an error, and so is a deviation. Other columns don't take part.

What reaches the driver has a size that depends on the dimension d alone: d * d sums, and d + 1 remainders for each of some d * log2(n * n * variance) / 31 primes.
"""

from __future__ import annotations

from functools import reduce
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .names import free
from .storage import small_batches, stored

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Bits behind the point in the roots and vectors, beside what the size of the matrix takes.
PRECISION = 256
#: Parts of 32 bits in which the sums of products travel; six hold sums of 2**60 products of longs.
LIMBS = 6


def _entries(vectors: pa.Array) -> np.ndarray:
    """floor(1024 c) of each entry, one row a vector; x without its shift, which no sum about the mean depends on."""
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(flat) and np.abs(flat).max() >= 2.0**62:
        raise OverflowError("an entry of an embedding is too large for a long")
    return flat.astype(np.int64).reshape(len(vectors), -1)


def _limbs(values: np.ndarray) -> np.ndarray:
    """Whole numbers as LIMBS parts of 32 bits, the last one signed."""
    out, rest = [], values
    for _ in range(LIMBS - 1):
        out.append((rest & 0xFFFFFFFF).astype(np.int64))
        rest = rest >> 32
    return np.stack([*out, rest.astype(np.int64)])


def _whole(limbs) -> int:
    return sum(int(v) << (32 * k) for k, v in enumerate(limbs))


def usable(embeddings: DataFrame, vec_col: str) -> tuple[DataFrame, int]:
    """The rows that take part, and their dimension."""
    v = F.col(f"`{vec_col}`")
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    rows = embeddings.filter(v.isNotNull() & F.forall(v, fine))
    sizes = rows.groupBy(F.size(v).alias("d")).count().agg(F.max_by("d", F.struct("count", "d")).alias("d")).first()
    d = sizes["d"] or 0
    return rows.filter(F.size(v) == d), d


def scatter(rows: DataFrame, vec_col: str, d: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums of floor(1024 c), and M, all exact."""
    at = np.triu_indices(d)

    def run(batches):
        n, sums, products = 0, np.zeros(d, object), np.zeros(len(at[0]), object)
        for batch in batches:
            x = _entries(batch.column(0))
            if not len(x):
                continue
            small = int(np.abs(x).max()) ** 2 * len(x) < 2**53
            # whole numbers below 2**53 are exact in doubles, so the fast product serves; else Python's own
            p = (x.astype(np.float64).T @ x.astype(np.float64)).astype(np.int64) if small else x.astype(object).T @ x.astype(object)
            n += len(x)
            sums += x.sum(0) if small else x.astype(object).sum(0)
            products += p[at]
        if n:
            values = np.concatenate([[n], sums, products]).astype(object)
            parts = _limbs(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), *[pa.array(p) for p in parts]], ["k", *[f"l{i}" for i in range(LIMBS)]])

    found = rows.select(F.col(f"`{vec_col}`").alias("v")).mapInArrow(run, "k int, " + ", ".join(f"l{i} long" for i in range(LIMBS)))
    total = found.groupBy("k").agg(*[F.sum(f"l{i}").alias(f"l{i}") for i in range(LIMBS)]).collect()
    values = [0] * (1 + d + len(at[0]))
    for r in total:
        values[r["k"]] = _whole(r[1:])
    n, sums = values[0], values[1 : d + 1]
    m = [[0] * d for _ in range(d)]
    for i, j, p in zip(*at, values[d + 1 :]):
        m[i][j] = m[j][i] = n * p - sums[i] * sums[j]
    return n, sums, m


def primes_below(limit: int, product: int) -> list[int]:
    """The largest primes below ``limit`` (at most 2**31) whose product is above ``product``."""
    small = [p for p in range(2, int(limit**0.5) + 1) if all(p % q for q in range(2, int(p**0.5) + 1))]
    out, have, high = [], 1, limit
    while have <= product:
        low = max(2, high - (1 << 16))
        sieve = np.ones(high - low, bool)
        for p in small:
            sieve[max(p * p, -(-low // p) * p) - low :: p] = False
        for p in reversed((np.flatnonzero(sieve) + low).tolist()):
            out.append(p)
            have *= p
            if have > product:
                break
        high = low
        if high <= 2 and have <= product:
            raise ValueError("there aren't enough primes")
    return out


def polynomial_mod(m: np.ndarray, p: int) -> np.ndarray:
    """Coefficients modulo the prime p < 2**31, constant term first, of det(x - m): similar steps to Hessenberg form, then its recursion by columns."""
    h, d = m % p, len(m)
    for k in range(d - 2):
        rows = np.flatnonzero(h[k + 1 :, k])
        if not len(rows):
            continue
        pivot = k + 1 + int(rows[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factor = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factor[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factor % p).sum(1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(d):
        new = np.zeros(d + 1, np.int64)
        new[1:] = polys[k, :-1]
        chain, weights = 1, np.zeros(k + 1, np.int64)
        for i in range(k, -1, -1):
            weights[i] = int(h[i, k]) * chain % p
            if i:
                chain = chain * int(h[i, i - 1]) % p
        polys[k + 1] = (new - (polys[: k + 1] * weights[:, None] % p).sum(0)) % p
    return polys[d]


def characteristic(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """The coefficients of det(x - m), constant term first, for symmetric m without negative eigenvalues; primes are dealt over the tasks."""
    d = len(m)
    trace = sum(m[i][i] for i in range(d))
    # a coefficient is a sum of products of k of d eigenvalues, so at most binomial(d, k) (trace / d)**k, below (1 + trace / d)**d
    primes = primes_below(2**31, 2 * (2 + trace // max(d, 1)) ** d)

    def run(batches):
        for batch in batches:
            own = batch.column(0).to_pylist()
            found = [polynomial_mod(np.array([[v % p for v in row] for row in m], np.int64), p) for p in own]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([f.tolist() for f in found], pa.list_(pa.int64()))], ["p", "c"])

    tasks = min(len(primes), 4 * spark.sparkContext.defaultParallelism)
    table = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks)
    found = {r.p: r.c for r in table.mapInArrow(run, "p long, c array<long>").collect()}
    whole = reduce(mul, primes)
    parts = [(p, whole // p, pow(whole // p % p, -1, p)) for p in primes]
    out = []
    for k in range(d + 1):
        value = sum(found[p][k] * inverse % p * rest for p, rest, inverse in parts) % whole
        out.append(value - whole if 2 * value > whole else value)
    return out


def changes(values) -> int:
    signs = [v > 0 for v in values if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def roots_above(poly: list[int], a: int) -> int:
    """How many roots lie above ``a``, each as often as it counts: the sign changes of p(x + a). Exact as all roots are real."""
    c = list(poly)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += a * c[j + 1]
    return changes(c)


def largest_roots(poly: list[int], most: int, bound: int, bits: int = PRECISION) -> list[int]:
    """The ``most`` largest positive roots, falling, times 2**bits and rounded down; a root that counts k times stands k times. ``bound``: no root lies above it."""
    d = len(poly) - 1
    whole = [c << (bits * (d - k)) for k, c in enumerate(poly)]  # its roots are 2**bits times as large
    high, counts = (bound << bits) + 1, {}

    def above(a: int) -> int:
        if a not in counts:
            counts[a] = roots_above(whole, a)
        return counts[a]

    def value(a: int) -> int:
        v = 0
        for c in reversed(whole):
            v = v * a + c
        return v

    out = []
    for k in range(1, min(most, above(0)) + 1):  # the k-th largest lies in (low, up]
        low, up = 0, high
        for a, n in counts.items():
            if n >= k:
                low = max(low, a)
            else:
                up = min(up, a)
        while up - low > 1 and (above(low) != k or above(up) != k - 1):
            middle = (low + up) // 2
            low, up = (middle, up) if above(middle) >= k else (low, middle)
        # alone now: the sign of the value tells the side, at a fraction of the work
        side = value(up) > 0
        if up - low > 1 and not value(up):
            low = up
        while up - low > 1:
            middle = (low + up) // 2
            v = value(middle)
            if not v:
                low = up = middle
            elif (v > 0) == side:
                up = middle
            else:
                low = middle
        out.append(low)
    return out


def _solved(m: np.ndarray, e: int, starts: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Unit vectors, in fixed point, of the null space of m - e (both times 2**bits): two steps of inverse iteration each, at right angles to those before."""
    d = len(m)
    a = m.copy()
    a[np.arange(d), np.arange(d)] -= e
    order, factors = np.arange(d), []
    for k in range(d):  # elimination with the largest pivot of the column
        pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        a[[k, pivot]], order[[k, pivot]] = a[[pivot, k]], order[[pivot, k]]
        factors.append((pivot, None))
        if not a[k, k]:
            a[k, k] = 1  # the least number there is: the matrix is singular as far as it can be told
        factor = np.array([(v << bits) // a[k, k] for v in a[k + 1 :, k]], object)
        factors[-1] = pivot, factor
        if len(factor):
            a[k + 1 :] = a[k + 1 :] - ((factor[:, None] * a[k][None, :]) >> bits)

    def solve(b: np.ndarray) -> np.ndarray:
        b = b.copy()
        for k, (pivot, factor) in enumerate(factors):
            b[[k, pivot]] = b[[pivot, k]]
            if len(factor):
                b[k + 1 :] = b[k + 1 :] - ((factor * b[k]) >> bits)
        for k in range(d - 1, -1, -1):
            b[k] = (b[k] << bits) // a[k, k]
            if k:
                b[:k] = b[:k] - ((a[:k, k] * b[k]) >> bits)
        return b

    def unit(v: np.ndarray) -> np.ndarray:
        v = v << bits if max(abs(x) for x in v) < 1 << bits else v
        length = _root(int((v * v).sum()))
        return np.array([(x << bits) // length for x in v], object)

    def upright(v: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
        for b in before:
            v = v - ((b * (int((v * b).sum()) >> bits)) >> bits)
        return v

    found: list[np.ndarray] = []
    for v in starts:
        for _ in range(2):
            v = unit(upright(unit(solve(unit(v))), found))
        found.append(v)
    return found


def _root(n: int) -> int:
    from math import isqrt

    return max(1, isqrt(n))


def components(m: list[list[int]], roots: list[int], bits: int = PRECISION) -> np.ndarray:
    """Unit eigenvectors (one a row) of ``m`` for ``roots``, falling, times 2**bits. Roots that agree in half of their bits are taken as one."""
    d = len(m)
    rng = np.random.default_rng(d)
    fixed = np.array([[v << bits for v in row] for row in m], object)
    out: list[np.ndarray] = []
    at = 0
    while at < len(roots):
        to = at + 1
        while to < len(roots) and (roots[at] - roots[to]) << (bits // 2) <= roots[at]:
            to += 1
        starts = [np.array([int(x) for x in rng.integers(-(2**62), 2**62, d)], object) << max(0, bits - 62) for _ in range(at, to)]
        for v in _solved(fixed, roots[at], starts, bits):
            out.append(np.array([_double(int(x), bits) for x in v]))
        at = to
    return np.array(out).reshape(len(roots), d)


def _double(x: int, bits: int) -> float:
    return x / (1 << bits)


def whitened(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """Per usable row and component: id, component, n, deviation, whitened, explained, identity_error."""
    spark = embeddings.sparkSession
    small_batches(spark)
    kind = embeddings.schema[id_col].dataType.simpleString()
    rows, d = usable(embeddings.select(id_col, vec_col), vec_col)
    n, sums, m = scatter(rows, vec_col, d) if d else (0, [], [])
    trace = sum(m[i][i] for i in range(d))
    roots = largest_roots(characteristic(spark, m), most, trace) if trace else []
    own = free("component", id_col), free("n", id_col), free("deviation", id_col), free("whitened", id_col), free("explained", id_col), free("identity_error", id_col)
    if not roots:
        return spark.createDataFrame([], f"`{id_col}` {kind}, `{own[0]}` int, `{own[1]}` long, `{own[2]}` long, `{own[3]}` double, `{own[4]}` double, `{own[5]}` double")
    vectors = components(m, roots)
    # e is root / n**2; the entries of n x - S are divided by n * sqrt(e), the root of the root
    lengths = np.array([(_root(r << PRECISION) / (1 << PRECISION)) for r in roots])
    explained = [r / (trace << PRECISION) for r in roots]
    least, greatest = min(sums), max(sums)

    def run(batches):
        for batch in batches:
            x = _entries(batch.column(1))
            if not len(x):
                continue
            size = n * int(np.abs(x).max()) + max(abs(least), abs(greatest))
            exact = size < 2**31 and size * size * d < 2**63
            y = n * (x if exact else x.astype(object)) - np.array(sums, np.int64 if exact else object)
            squares = (y * y).sum(1)
            if not exact and max(squares) >= 2**63:
                raise OverflowError("a deviation is too large for a long")
            z = y.astype(np.float64) @ vectors.T / lengths
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(squares.astype(np.int64)), pa.array(list(z), pa.list_(pa.float64()))], ["id", "deviation", "z"])

    placed = stored(rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").alias("v")).mapInArrow(run, f"id {kind}, deviation long, z array<double>"), "whitened")
    k = len(roots)
    means = placed.agg(*[F.avg(F.col("z")[i]).alias(f"m{i}") for i in range(k)]).first()
    centred = [F.col("z")[i] - F.lit(means[i]) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    covariance = placed.agg(*[F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(covariance, pairs))
    each = placed.select("id", "deviation", F.posexplode(F.arrays_zip(F.col("z").alias("z"), F.array(*[F.lit(e) for e in explained]).alias("e"))).alias("at", "pair"))
    return each.select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias(own[0]), F.lit(n).cast("long").alias(own[1]), F.col("deviation").alias(own[2]),
        F.col("pair")["z"].alias(own[3]), F.col("pair")["e"].alias(own[4]), F.lit(error).cast("double").alias(own[5]),
    )
