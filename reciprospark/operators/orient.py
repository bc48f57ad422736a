"""Indexing, orientation refinement, reduced cells and detector calibration.

Passes over peaks are Spark aggregates; what reaches the driver are numbers of each direction of the hemisphere (some 7,000), counts of pairs and triples of
candidates, or the normal equations of a least squares step (at most 15 x 15).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reciprospark.functions import geometry as geo
from reciprospark.functions.geometry import Geometry

from .lattice import dealt, matrices, scaled

STEP, BINS, TOP = 0.03, 512, 500
#: Triples that one pass over the scattering vectors counts.
TRIPLES = 2000
#: Lattices that are reduced at once: their combinations (665 each) stay in a core's cache.
LATTICES = 64
#: Pairs of combinations whose third ones are tried before the bound on the total is looked up again.
PAIRS = 1024


def hemisphere(step: float = STEP) -> np.ndarray:
    """Unit vectors over a hemisphere, about ``step`` radians apart."""
    out = []
    for k in range(int(math.pi / 2 / step) + 1):
        lat = k * step
        n = max(1, round(2 * math.pi * math.sin(lat) / step))
        if k * step > math.pi / 2 - step / 2:
            n = max(1, n // 2)
        a = np.arange(n) * (2 * math.pi if lat < math.pi / 2 - step / 2 else math.pi) / n
        out.append(np.stack([np.sin(lat) * np.cos(a), np.sin(lat) * np.sin(a), np.full(n, np.cos(lat))], 1))
    return np.concatenate(out)


def projection_histogram(qs: DataFrame, directions: DataFrame, bins: int = BINS) -> DataFrame:
    """(direction, bin, n): how many scattering vectors (qx, qy, qz) project to each bin of a direction (direction, tx, ty, tz); a few thousand directions."""
    q_max = 1.1 * (qs.agg(F.max(F.sqrt(F.col("qx") ** 2 + F.col("qy") ** 2 + F.col("qz") ** 2))).first()[0] or 1.0)
    rows = directions.select("direction", "tx", "ty", "tz").collect()
    names, axes = np.array([r[0] for r in rows]), np.array([r[1:] for r in rows], float).reshape(-1, 3)

    def project(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 1024):
                place = np.floor(np.abs(pdf[["qx", "qy", "qz"]].to_numpy(float)[lo : lo + 1024] @ axes.T) * (bins / q_max)).astype(np.int64)
                key, n = np.unique(place + np.arange(len(names)) * (bins + 1), return_counts=True)
                yield pd.DataFrame({"direction": names[key // (bins + 1)], "bin": key % (bins + 1), "n": n})

    return qs.select("qx", "qy", "qz").mapInPandas(project, "direction long, bin int, n long").groupBy("direction", "bin").agg(F.sum("n").alias("n"))


def tallied(qs: DataFrame, vectors: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all real-space vectors in one pass over the scattering vectors that each indexes: their number, the sum of q q^T and the sum of n q.

    Every batch sends one row per vector; a few hundred rows reach the driver.
    """
    v = np.asarray(vectors, float).reshape(-1, 3)
    names = [f"s{i}" for i in range(12)]

    def run(batches):
        for pdf in batches:
            q = pdf[["qx", "qy", "qz"]].to_numpy(float)
            n = np.zeros(len(v), np.int64)
            sums = np.zeros((len(v), 12))
            for k, d in enumerate(v):
                p = q @ d
                near = np.abs(p - np.rint(p)) <= tolerance
                own = q[near]
                n[k] = near.sum()
                sums[k, :9] = (own.T @ own).ravel()
                sums[k, 9:] = np.rint(p[near]) @ own
            yield pd.DataFrame({"k": np.arange(len(v)), "n": n, **{c: sums[:, i] for i, c in enumerate(names)}})

    got = qs.select("qx", "qy", "qz").mapInPandas(run, "k long, n long, " + ", ".join(f"{c} double" for c in names)).groupBy("k").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).collect()
    n, m, b = np.zeros(len(v), int), np.zeros((len(v), 3, 3)), np.zeros((len(v), 3))
    for r in got:
        n[r["k"]], m[r["k"]], b[r["k"]] = r["n"], np.array(r[2:11]).reshape(3, 3), np.array(r[11:14])
    return n, m, b


def index_count(qs: DataFrame, candidates: list[np.ndarray], tolerance: float) -> list[int]:
    """For each real-space vector the number of scattering vectors whose product with it is near a whole number."""
    return tallied(qs, np.array(candidates), tolerance)[0].tolist() if len(candidates) else []


def refined_vectors(qs: DataFrame, vectors: np.ndarray, tolerance: float) -> np.ndarray:
    """One least squares step of each vector: its products with the scattering vectors it indexes become whole numbers."""
    _, m, b = tallied(qs, vectors, tolerance)
    return np.array([np.linalg.lstsq(mk, bk, rcond=None)[0] for mk, bk in zip(m, b)]).reshape(-1, 3)


def joint_counts(qs: DataFrame, vectors: np.ndarray, sets: np.ndarray, tolerance: float, zeros: bool = False) -> np.ndarray:
    """For each set (a row of numbers of ``vectors``) the scattering vectors that all of it index, those that all of it put at 0 left out unless ``zeros``. One pass."""
    v, sets = np.asarray(vectors, float).reshape(-1, 3), np.asarray(sets, int)

    def run(batches):
        total = np.zeros(len(sets), np.int64)
        for pdf in batches:
            for lo in range(0, len(pdf), 1024):
                p = pdf[["qx", "qy", "qz"]].to_numpy(float)[lo : lo + 1024] @ v.T
                near, zero = np.abs(p - np.rint(p)) <= tolerance, np.round(p, 4) == 0
                all_near, all_zero = near[:, sets[:, 0]], zero[:, sets[:, 0]]
                for column in sets.T[1:]:
                    all_near, all_zero = all_near & near[:, column], all_zero & zero[:, column]
                total += (all_near if zeros else all_near & ~all_zero).sum(0)
        yield pd.DataFrame({"k": np.arange(len(sets)), "n": total})

    out = np.zeros(len(sets), np.int64)
    for r in qs.select("qx", "qy", "qz").mapInPandas(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r["k"]] = r["n"]
    return out


def best_triple(qs: DataFrame, vectors: np.ndarray, tolerance: float, least_volume: float) -> np.ndarray | None:
    """Of all triples of ``vectors`` in order the last that indexes over a fifth more scattering vectors than the one held before it; rows right-handed.

    A triple indexes no more than any pair in it, so triples whose pairs don't reach the bar are passed over; all others are counted, some in each pass.
    """
    n = len(vectors)
    if n < 3:
        return None
    pairs = np.array([(i, j) for i in range(n) for j in range(i + 1, n)])
    bound = np.zeros((n, n), np.int64)
    bound[pairs[:, 0], pairs[:, 1]] = joint_counts(qs, vectors, pairs, tolerance, zeros=True)

    def triples(bar: float, after: tuple[int, int, int]):
        for i in range(n):
            for j in range(i + 1, n):
                if bound[i, j] > bar:
                    for k in range(j + 1, n):
                        if (i, j, k) > after and min(bound[i, k], bound[j, k]) > bar and abs(np.linalg.det(vectors[[i, j, k]])) > least_volume:
                            yield i, j, k

    best, best_n, after = None, 0, (-1, -1, -1)
    while True:
        part = [t for t, _ in zip(triples(1.2 * best_n, after), range(TRIPLES))]
        if not part:
            break
        for t, c in zip(part, joint_counts(qs, vectors, np.array(part), tolerance)):
            if best is None or c > 1.2 * best_n:
                best, best_n = t, int(c)
        after = part[-1]
    if best is None:
        return None
    m = vectors[list(best)]
    return m if np.linalg.det(m) > 0 else m * [[1], [1], [-1]]


def height_threshold(heights: np.ndarray, top: int = TOP) -> float:
    """From which height on directions are kept: the least of the ``top`` highest, if that is at least half of the greatest; else the greatest of these below that half."""
    high = np.sort(heights)[::-1][:top]
    half = high[0] / 2
    return float(high[-1] if high[-1] >= half else high[high < half][0])


def first_period(power: np.ndarray, threshold: float) -> float:
    """The place, to a part of a bin, of the first local maximum above ``threshold`` behind the first local minimum below it; 0 where there is none."""
    inner = np.arange(1, len(power) - 1)
    low = inner[(power[inner] < power[inner - 1]) & (power[inner] < power[inner + 1]) & (power[inner] < threshold)]
    if not len(low):
        return 0.0
    high = inner[(power[inner] > power[inner - 1]) & (power[inner] > power[inner + 1]) & (power[inner] > threshold) & (inner > low[0])]
    if not len(high):
        return 0.0
    near = np.arange(max(0, high[0] - 2), min(len(power), high[0] + 3))
    return float((near * power[near]).sum() / power[near].sum())


def index_count_3d(qs: DataFrame, ub: np.ndarray, tolerance: float) -> int:
    """The number of scattering vectors with all of hkl within the tolerance of whole numbers, (0, 0, 0) left out."""
    inverse = np.linalg.inv(ub)
    near, zero = F.lit(True), F.lit(True)
    for row in inverse:
        p = sum(float(v) * F.col(c) for v, c in zip(row, ("qx", "qy", "qz")))
        near, zero = near & (F.abs(p - F.rint(p)) <= tolerance), zero & (F.round(p, 4) == 0)
    return int(qs.agg(F.sum(F.when(near & ~zero, 1).otherwise(0))).first()[0] or 0)


def dedupe_directions(vectors: list[tuple[np.ndarray, int]], length: float = 0.1, angle: float = 5.0) -> list[tuple[np.ndarray, int]]:
    """Of vectors alike in length (10 %) and direction (5 degrees, either sense) the one that indexes most peaks stays; by length."""
    kept: list[tuple[np.ndarray, int]] = []
    for d, n in sorted(vectors, key=lambda v: np.linalg.norm(v[0])):
        for i, (e, m) in enumerate(kept):
            a, b = np.linalg.norm(d), np.linalg.norm(e)
            turn = math.degrees(math.acos(max(-1, min(1, abs(d @ e) / (a * b)))))
            if abs(a - b) <= length * b and turn < angle:
                if n > m:
                    kept[i] = (d, n)
                break
        else:
            kept.append((d, n))
    return kept


def index_lattice(qs: DataFrame, min_d: float, max_d: float, tolerance: float = 0.12) -> np.ndarray | None:
    """UB from scattering vectors by the periods of their projections; none with fewer than four peaks or without three directions.

    All directions whose spectrum reaches the threshold are tried, and all triples of the vectors that stay; no list is cut.
    """
    spark = qs.sparkSession
    if qs.count() < 4:
        return None
    qs = qs.select("qx", "qy", "qz")
    around = hemisphere()
    table = spark.createDataFrame(pd.DataFrame({"direction": np.arange(len(around)), "tx": around[:, 0], "ty": around[:, 1], "tz": around[:, 2]}))
    q_max = 1.1 * qs.agg(F.max(F.sqrt(F.col("qx") ** 2 + F.col("qy") ** 2 + F.col("qz") ** 2))).first()[0]

    def spectrum(pdf: pd.DataFrame) -> np.ndarray:
        line = np.zeros(BINS)
        np.add.at(line, np.minimum(pdf["bin"].to_numpy(), BINS - 1), pdf["n"].to_numpy())
        return np.abs(np.fft.rfft(line))

    lines = projection_histogram(qs, table).cache()
    highest = lambda pdf: pd.DataFrame({"height": [float(spectrum(pdf)[5:].max())]})
    threshold = height_threshold(np.array([r[0] for r in lines.groupBy("direction").applyInPandas(highest, "height double").collect()]))

    def period(pdf: pd.DataFrame) -> pd.DataFrame:
        power = spectrum(pdf)
        place = first_period(power, threshold) if power[5:].max() >= threshold else 0.0
        return pd.DataFrame({"direction": [int(pdf["direction"].iloc[0])], "d": [place / q_max]})

    found = lines.groupBy("direction").applyInPandas(period, "direction long, d double").filter((F.col("d") > 0.8 * min_d) & (F.col("d") <= 1.2 * max_d)).orderBy("direction").collect()
    lines.unpersist()
    vectors = np.array([around[r["direction"]] * r["d"] for r in found]).reshape(-1, 3)
    if len(vectors) < 3:
        return None
    counts = tallied(qs, vectors, tolerance)[0]
    fine, most = vectors[counts >= 0.5 * counts.max()], 0
    for _ in range(5):
        fine = refined_vectors(qs, fine, tolerance)
        counts = tallied(qs, fine, tolerance)[0]
        most = max(most, int(counts.max()))
    length = np.linalg.norm(fine, axis=1)
    keep = (length >= 0.8 * min_d) & (length <= 1.2 * max_d) & (counts > 0.75 * most)
    kept = dedupe_directions([(v, int(c)) for v, c in zip(fine[keep], counts[keep])])
    best = best_triple(qs, np.array(sorted((v for v, _ in kept), key=np.linalg.norm)).reshape(-1, 3), tolerance, min_d**3 / 4)
    if best is None:
        return None
    for _ in range(4):
        best = refined_vectors(qs, best, tolerance)
    return np.linalg.inv(best)


def pair_hypotheses(peaks: np.ndarray, polar: np.ndarray, cell: tuple[float, ...], wavelength: float, tolerance: float = 1.0, ring: float = 0.2) -> tuple[list[tuple], np.ndarray]:
    """(numbers of two peaks and the reflections they may be, orientation of each such pair): two peaks fix an orientation once their reflections are known.

    A peak may be any reflection whose angle is within ``ring`` degrees of its own (``polar``); two must stand at the angle that the peaks have, within ``tolerance`` degrees.
    Pairs of peaks less than 10 degrees from a line fix nothing well and are left out.
    """
    b = geo.b_matrix(*cell)
    reach = [int(2 * math.sin(math.radians(polar.max() + ring) / 2) / wavelength * c) + 1 for c in cell[:3]]
    hkl = np.array([v for v in np.ndindex(*(2 * r + 1 for r in reach))]) - reach
    hkl = hkl[np.any(hkl != 0, axis=1)]
    v = hkl @ b.T
    size = np.linalg.norm(v, axis=1)
    angle = np.degrees(2 * np.arcsin(np.clip(size * wavelength / 2, 0, 1)))
    unit, own = v / size[:, None], peaks / np.linalg.norm(peaks, axis=1)[:, None]
    names, turns = [], []
    for i in range(len(peaks)):
        for j in range(i + 1, len(peaks)):
            between = math.degrees(math.acos(np.clip(own[i] @ own[j], -1, 1)))
            if not 10 < between < 170:
                continue
            first, second = (np.flatnonzero(np.abs(angle - polar[k]) <= ring) for k in (i, j))
            off = np.abs(np.degrees(np.arccos(np.clip(unit[first] @ unit[second].T, -1, 1))) - between)
            for a, c in zip(*np.nonzero(off < tolerance)):
                names.append((i, j, *map(int, hkl[first[a]]), *map(int, hkl[second[c]])))
                turns.append(geo.ub_from_two_peaks(b, hkl[first[a]], hkl[second[c]], peaks[i], peaks[j]))
    return names, np.array(turns).reshape(-1, 3, 3)


def orientation_votes(qs: DataFrame, cell: tuple[float, ...], wavelength: float, seeds: int = 6, tolerance: float = 1.0, ring: float = 0.2, near: float = 0.1) -> DataFrame:
    """(first, second, h1, k1, l1, h2, k2, l2, u array of 9, votes): each orientation that a pair of the ``seeds`` brightest peaks allows, and how many peaks (qx, qy, qz, polar, intensity) it indexes.

    Seeds and their possible reflections are a few dozen rows; all peaks vote on all orientations in one pass.
    """
    spark = qs.sparkSession
    top = qs.filter("qx IS NOT NULL AND qy IS NOT NULL AND qz IS NOT NULL AND polar > 0").orderBy(F.desc("intensity"), "qx", "qy", "qz").limit(seeds).select("qx", "qy", "qz", "polar").collect()
    names, turns = pair_hypotheses(np.array([r[:3] for r in top], float).reshape(-1, 3), np.array([r[3] for r in top], float), cell, wavelength, tolerance, ring) if len(top) > 1 else ([], np.zeros((0, 3, 3)))
    schema = "hypothesis int, first int, second int, h1 int, k1 int, l1 int, h2 int, k2 int, l2 int, u array<double>"
    table = spark.createDataFrame([(n, *name, u.ravel().tolist()) for n, (name, u) in enumerate(zip(names, turns))], schema)
    if not names:
        return table.withColumn("votes", F.lit(0).cast("long")).drop("hypothesis")
    inverse = np.linalg.inv(turns @ geo.b_matrix(*cell))

    def vote(batches):
        total = np.zeros(len(inverse), np.int64)
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                q = pdf[["qx", "qy", "qz"]].to_numpy(float)[lo : lo + 256]
                hkl = np.einsum("nij,qj->nqi", inverse, q)
                whole = np.rint(hkl)
                total += ((np.abs(hkl - whole) <= near).all(2) & (whole != 0).any(2)).sum(1)
        yield pd.DataFrame({"hypothesis": np.arange(len(total), dtype=np.int32), "votes": total})

    votes = qs.select("qx", "qy", "qz").mapInPandas(vote, "hypothesis int, votes long").groupBy("hypothesis").agg(F.sum("votes").alias("votes"))
    return table.join(F.broadcast(votes), "hypothesis").drop("hypothesis")


def best_orientation(votes: DataFrame) -> np.ndarray | None:
    """The orientation with most votes; of equals the one of the first peaks and the greatest reflections."""
    best = votes.orderBy(F.desc("votes"), "first", "second", *[F.desc(c) for c in ("h1", "k1", "l1", "h2", "k2", "l2")]).limit(1).collect()
    return np.array(best[0]["u"]).reshape(3, 3) if best else None


def least_squares(rows: DataFrame, start: np.ndarray, residuals: Callable[[np.ndarray], list[Column]], step: float = 1e-5, rounds: int = 20, tolerance: float = 1e-12) -> np.ndarray:
    """Damped least squares: each round sums J^T J and J^T r of finite differences in one aggregate; the small system is solved here."""
    x, damp = np.array(start, float), 1e-3
    cost = lambda p: float(rows.agg(F.sum(sum(r * r for r in residuals(p)))).first()[0] or 0.0)
    now = cost(x)
    for _ in range(rounds):
        base = residuals(x)
        cols = {}
        for i in range(len(x)):
            h = step * max(1.0, abs(x[i]))
            moved = x.copy()
            moved[i] += h
            for k, (a, b) in enumerate(zip(residuals(moved), base)):
                cols[f"j{i}_{k}"] = (a - b) / h
        wide = rows.select(*[c.alias(f"r{k}") for k, c in enumerate(base)], *[c.alias(n) for n, c in cols.items()])
        n_res = len(base)
        pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
        total = wide.agg(*[F.sum(sum(F.col(f"j{i}_{k}") * F.col(f"j{j}_{k}") for k in range(n_res))) for i, j in pairs], *[F.sum(sum(F.col(f"j{i}_{k}") * F.col(f"r{k}") for k in range(n_res))) for i in range(len(x))]).first()
        if total[0] is None:
            return x
        m = np.zeros((len(x), len(x)))
        for (i, j), v in zip(pairs, total[: len(pairs)]):
            m[i, j] = m[j, i] = v
        g = np.array(total[len(pairs) :], float)
        for _ in range(8):
            trial = x - np.linalg.lstsq(m + damp * np.diag(np.maximum(np.diag(m), 1e-12)), g, rcond=None)[0]
            after = cost(trial)
            if after <= now:
                break
            damp *= 10
        else:
            return x
        gain, x, now, damp = now - after, trial, after, damp / 10
        if gain <= tolerance * max(now, 1e-30):
            break
    return x


_FREE = {"cubic": (0,), "tetragonal": (0, 2), "orthorhombic": (0, 1, 2), "hexagonal": (0, 2), "rhombohedral": (0, 3), "monoclinic": (0, 1, 2, 4), "triclinic": (0, 1, 2, 3, 4, 5), "cell held": ()}


def refine_orientation(peaks: DataFrame, start: Geometry, symmetry: str, angles: tuple[str, ...] = ("chi", "omega", "theta"), tolerance: float = 0.2, rounds: int = 15) -> Geometry:
    """Cell (as its crystal system frees it) and goniometer angles or any other numbers of the geometry by name (distance, yaw, pitch, roll, xc, yc), then the matrix U,
    so that the hkl of peaks (x, y, z) come near whole numbers.

    Peaks within the tolerance of the start take part, with the indices they have there. The symmetry ``cell held`` frees no edge or angle.
    """
    from reciprospark.functions.scalars import constrain_cell

    at = [F.col(c) for c in "xyz"]
    hkl = geo.pixel_to_hkl(start, *at)
    fixed = peaks.select("x", "y", "z", *[F.rint(c).alias(n) for c, n in zip(hkl, ("rh", "rk", "rl"))], geo.hkl_diff(start, hkl).alias("off")).filter(F.col("off") <= tolerance)
    free = _FREE[symmetry]

    def of(x: np.ndarray) -> Geometry:
        cell = list(start.cell)
        for i, v in zip(free, x):
            cell[i] = float(v)
        return start.with_(cell=constrain_cell(symmetry, tuple(cell)) if free else start.cell, **{a: float(v) for a, v in zip(angles, x[len(free) :])})

    def off(g: Geometry) -> list[Column]:
        found = geo.gvec(g, *at)
        own = [sum(float(g.ub[i, j]) * F.col(c) for j, c in enumerate(("rh", "rk", "rl"))) for i in range(3)]
        return [a - b for a, b in zip(found, own)]

    x = least_squares(fixed, np.array([*(start.cell[i] for i in free), *(getattr(start, a) for a in angles)]), lambda p: off(of(p)), rounds=rounds)
    near = of(x)
    u = least_squares(fixed, np.asarray(near.u).ravel(), lambda p: off(near.with_(u=tuple(map(tuple, p.reshape(3, 3))))), rounds=rounds)
    return near.with_(u=tuple(tuple(map(float, r)) for r in u.reshape(3, 3)))


def refine_polar(peaks: DataFrame, start: Geometry, symmetry: str, rings: DataFrame, names: tuple[str, ...] = ("distance", "xc", "yc"), cell: bool = True, rounds: int = 15) -> Geometry:
    """Cell (as its crystal system frees it, or held) and geometry by name, so that the polar angles of peaks (x, y) come near those of their rings.

    ``rings``: (ring, ring_angle, h, k, l), one reflection per ring, a few hundred rows. Each peak is held to the ring that is nearest at the start.
    """
    from reciprospark.functions.scalars import constrain_cell

    from .lattice import assign_rings

    x, y = F.col("x"), F.col("y")
    near = assign_rings(peaks.select("x", "y", geo.polar(start, x, y).alias("polar")), rings).join(F.broadcast(rings.select("ring", "h", "k", "l")), "ring")
    free = _FREE[symmetry] if cell else ()

    def of(p: np.ndarray) -> Geometry:
        edges = list(start.cell)
        for i, v in zip(free, p):
            edges[i] = float(v)
        return start.with_(cell=constrain_cell(symmetry, tuple(edges)) if cell else start.cell, **{n: float(v) for n, v in zip(names, p[len(free) :])})

    def off(p: np.ndarray) -> list[Column]:
        g = of(p)
        return [geo.polar(g, x, y) - geo.two_theta_hkl(g.cell, g.wavelength, *(F.col(c) for c in "hkl"))]

    return of(least_squares(near, np.array([*(start.cell[i] for i in free), *(getattr(start, n) for n in names)]), off, rounds=rounds))


def refine_geometry(points: DataFrame, start: Geometry, names: tuple[str, ...] = ("distance", "xc", "yc"), rounds: int = 15) -> Geometry:
    """Distance and beam centre (and more by name) from ring points (x, y, ring_angle): their polar angles come near the rings'."""
    of = lambda p: start.with_(**{n: float(v) for n, v in zip(names, p)})
    polar = lambda g: [geo.polar(g, F.col("x"), F.col("y")) - F.col("ring_angle")]
    return of(least_squares(points, np.array([getattr(start, n) for n in names]), lambda p: polar(of(p)), rounds=rounds))


def ring_points(image: DataFrame, geometry: Geometry, rings: list[tuple[int, float]], width: float, step: float = 0.2) -> DataFrame:
    """(ring, sector, x, y, counts): for each ring angle and azimuth step the brightest pixel within ``width`` degrees of the ring; of equals the smallest (y, x)."""
    x, y = F.col("x"), F.col("y")
    near = F.array_compact(F.array(*[F.when(F.abs(F.col("polar") - a) <= width, F.struct(F.lit(r).alias("ring"), F.lit(float(a)).alias("ring_angle"))) for r, a in rings]))
    rows = image.withColumn("polar", geo.polar(geometry, x, y)).withColumn("sector", F.floor(F.radians(geo.azimuth(geometry, x, y) + 180) / step).cast("int"))
    rows = rows.select("x", "y", "counts", "sector", F.explode(near).alias("r")).select("x", "y", "counts", "sector", "r.*")
    best = F.max_by(F.struct("x", "y", "counts"), F.struct("counts", -F.col("y"), -F.col("x")))
    return rows.groupBy("ring", "ring_angle", "sector").agg(best.alias("p")).select("ring", "ring_angle", "sector", "p.*")


def _ranges(first: np.ndarray, last: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, number) for the numbers from ``first`` to below ``last`` of each place, in order, ``most`` at a time."""
    n = np.maximum(last - first, 0)
    ends = np.cumsum(n)
    start = first - (ends - n)
    for lo in range(0, int(n.sum()), most):
        flat = np.arange(lo, min(lo + most, ends[-1]))
        place = np.searchsorted(ends, flat, side="right")
        yield place, start[place] + flat


def _triples(n: np.ndarray, size: np.ndarray, most: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, i, j, k, total) of all triples of combinations ``n`` (rows x k x 3, by length ``size``) of determinant 1 or -1 with a total length of at most ``most``, in order.

    The lengths of independent combinations are at least those of the first three independent ones, one by one; sums that can't be met with these are passed over.
    Who reads the triples may lower ``most`` meanwhile.
    """
    rows = np.arange(len(n))
    cross = np.cross(n[:, :1], n)
    second = (cross != 0).any(2).argmax(1)
    third = ((n @ cross[rows, second][:, :, None])[:, :, 0] != 0).argmax(1)
    one, two, three = size[:, 0], size[rows, second], size[rows, third]
    # a little more than ``most``, for the sums are made in another order
    limit = lambda r: most[r] * (1 + 1e-9)
    within = lambda others: (size <= (limit(rows) - others)[:, None]).sum(1)
    last = within(one + three)
    for row, i in _ranges(np.zeros_like(rows), within(two + three)):
        for p, j in _ranges(i + 1, last[row]):
            for lo in range(0, len(p), PAIRS):
                r, first, then = row[p[lo : lo + PAIRS]], i[p[lo : lo + PAIRS]], j[lo : lo + PAIRS]
                own = np.flatnonzero(size[r, first] + size[r, then] + np.maximum(size[r, then], three[r]) <= limit(r))
                r, first, then = r[own], first[own], then[own]
                cross = np.cross(n[r, first], n[r, then])
                for q, k in _ranges(np.maximum(then + 1, third[r]), within(one + two)[r]):
                    total = size[r[q], first[q]] + size[r[q], then[q]] + size[r[q], k]
                    own = np.flatnonzero((total <= most[r[q]]) & (np.abs((cross[q] * n[r[q], k]).sum(1)) == 1))
                    yield r[q[own]], first[q[own]], then[q[own]], k[own], total[own]


def _first_total(n: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The total length of each row's first triple (i, j, k) of determinant 1 or -1; infinite without one."""
    total, open_ = np.full(len(n), np.inf), np.arange(len(n))
    for i, j in combinations(range(n.shape[1] - 1), 2):
        if not len(open_):
            break
        one = np.abs((n[open_, j + 1 :] @ np.cross(n[open_, i], n[open_, j])[:, :, None])[:, :, 0]) == 1
        met = one.any(1)
        r = open_[met]
        total[r] = size[r, i] + size[r, j] + size[r, j + 1 + one[met].argmax(1)]
        open_ = open_[~met]
    return total


def reduced_axes(axes: np.ndarray, reach: int = 5) -> np.ndarray:
    """The axes of the cells with the shortest edges that are combinations (up to ``reach``) of the given axes (rows x 3 x 3); of equals those with most angles off 90 degrees. NaN without a cell.

    All combinations count: triples are taken by the lengths of their vectors, from the first that gives the volume on, and none is left out whose total could be as short.
    """
    span = np.arange(-reach, reach + 1)
    n = np.stack(np.meshgrid(span, span, span, indexing="ij"), 3).reshape(-1, 3)[len(span) ** 3 // 2 + 1 :].astype(float)
    out = np.full(axes.shape, np.nan)
    axes, power = scaled(axes)
    v = n @ axes
    size = np.linalg.norm(v, axis=2)
    whole = np.flatnonzero(np.isfinite(size).all(1))
    if len(n) < 3 or not len(whole):
        return out
    order = np.argsort(size[whole], axis=1, kind="stable")
    size, sorted_n = np.take_along_axis(size[whole], order, 1), n[order]
    # a triple counts only if it is no longer than the best before by more than a thousandth
    most = _first_total(sorted_n, size) * 1.001
    key: dict[int, tuple] = {}
    for r, i, j, k, total in _triples(sorted_n, size, most):
        ijk = np.stack([i, j, k], 1)
        m = v[whole[r][:, None], order[r[:, None], ijk]]
        length = np.linalg.norm(m, axis=2)
        off = sum((np.abs((m[:, a] * m[:, b]).sum(1)) > 1e-6 * length[:, a] * length[:, b]).astype(int) for a, b in ((0, 1), (0, 2), (1, 2)))
        for place, (row, now, n_off) in enumerate(zip(r.tolist(), total.tolist(), off.tolist())):
            best = key.get(row)
            # the volume is that of the given cell where the combinations' determinant is 1
            if best is None or now < best[0] * 0.999 or (now <= best[0] * 1.001 and n_off > best[1]):
                key[row] = (now if best is None else min(now, best[0]), n_off)
                most[row], out[whole[row]] = key[row][0] * 1.001, m[place]
    out[whole] *= np.where(np.linalg.det(out[whole]) < 0, -1, 1)[:, None, None]
    return np.ldexp(out, power[:, None, None])


def reduced_cell(ub: np.ndarray, reach: int = 5) -> np.ndarray | None:
    """The UB of ``reduced_axes`` of a UB. None without a cell."""
    ub = np.asarray(ub, float)
    if not np.isfinite(ub).all() or np.linalg.cond(ub) > 1e12:
        return None
    found = reduced_axes(np.linalg.inv(ub)[None], reach)[0]
    return None if np.isnan(found).any() else np.linalg.inv(found)


def niggli_cells(ubs: DataFrame, reach: int = 5) -> DataFrame:
    """(id, a, b, c, alpha, beta, gamma) of the reduced cell of each row (id, ub array of 9); nulls where ``ub`` is null, singular or has no cell."""

    def run(batches):
        for pdf in batches:
            cells = np.full((len(pdf), 6), np.nan)
            places, found = matrices(pdf["ub"], 1e12)
            for lo in range(0, len(places), LATTICES):
                m, power = scaled(reduced_axes(np.linalg.inv(found[lo : lo + LATTICES]), reach))
                e = np.linalg.norm(m, axis=2)
                ang = [np.degrees(np.arccos(np.clip((m[:, p] * m[:, q]).sum(1) / (e[:, p] * e[:, q]), -1, 1))) for p, q in ((1, 2), (0, 2), (0, 1))]
                cells[places[lo : lo + LATTICES]] = np.concatenate([np.ldexp(e, power[:, None]), np.stack(ang, 1)], 1)
            yield pd.DataFrame({"id": pdf["id"], **dict(zip(("a", "b", "c", "alpha", "beta", "gamma"), cells.T))})

    return dealt(ubs.select("id", "ub")).mapInPandas(run, "id long, a double, b double, c double, alpha double, beta double, gamma double")
