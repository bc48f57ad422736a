"""Reflections, absences, equivalents and powder rings."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reciprospark.functions.geometry import b_matrix, d_spacing


def absent(h: Column, k: Column, l: Column, centring: str) -> Column:  # noqa: E741
    """Whether a lattice centring forbids a reflection."""
    odd = lambda v: F.pmod(v, F.lit(2)) != 0
    return {
        "A": odd(k + l), "B": odd(h + l), "C": odd(h + k), "I": odd(h + k + l), "F": odd(h + k) | odd(h + l) | odd(k + l),
        "R": F.pmod(-h + k + l, F.lit(3)) != 0, "P": F.lit(False),
    }[centring]


def _image(row: dict, h: Column, k: Column, l: Column) -> list[Column]:  # noqa: E741
    """h R for an operation's rotation."""
    return [row[f"r1{c}"] * h + row[f"r2{c}"] * k + row[f"r3{c}"] * l for c in (1, 2, 3)]


def absent_by_symmetry(h: Column, k: Column, l: Column, symops: list[dict]) -> Column:  # noqa: E741
    """Forbidden where an operation leaves hkl in place but shifts its phase by no whole turn. ``symops``: r11..r33, t1..t3, a few dozen rows."""
    tests = [F.lit(False)]
    for op in symops:
        i = _image(op, h, k, l)
        shift = h * op["t1"] + k * op["t2"] + l * op["t3"]
        tests.append((i[0] == h) & (i[1] == k) & (i[2] == l) & (F.abs(shift - F.rint(shift)) > 1e-6))
    return reduce(Column.__or__, tests)


def equivalents(h: Column, k: Column, l: Column, symops: list[dict], friedel: bool = True) -> Column:  # noqa: E741
    """The distinct images as an array of (h, k, l), descending; the first is the representative."""
    images = []
    for op in symops:
        i = _image(op, h, k, l)
        images.append(F.struct(*[c.cast("int").alias(n) for c, n in zip(i, "hkl")]))
        if friedel:
            images.append(F.struct(*[(-c).cast("int").alias(n) for c, n in zip(i, "hkl")]))
    return F.sort_array(F.array_distinct(F.array(*images)), asc=False)


def identity() -> list[dict]:
    return [{f"r{a}{b}": int(a == b) for a in (1, 2, 3) for b in (1, 2, 3)} | {"t1": 0.0, "t2": 0.0, "t3": 0.0}]


def miller_indices(spark: SparkSession, cell: tuple[float, ...], d_min: float, centring: str = "P", symops: list[dict] | None = None) -> DataFrame:
    """(h, k, l, d, multiplicity): one allowed reflection per class with d at least ``d_min``, by d descending."""
    symops = symops or identity()
    edge = [math.floor(e / d_min) + 1 for e in cell[:3]]
    axis = lambda m: F.explode(F.sequence(F.lit(-m), F.lit(m)))
    every = spark.range(-edge[0], edge[0] + 1).select(F.col("id").cast("int").alias("h")).withColumn("k", axis(edge[1])).withColumn("l", axis(edge[2])).filter("h <> 0 OR k <> 0 OR l <> 0")
    h, k, l = (F.col(c) for c in "hkl")  # noqa: E741
    ok = every.withColumn("d", d_spacing(cell, h, k, l)).filter((F.col("d") >= d_min) & ~absent(h, k, l, centring) & ~absent_by_symmetry(h, k, l, symops))
    first = ok.withColumn("all", equivalents(h, k, l, symops)).filter(F.col("all")[0] == F.struct("h", "k", "l"))
    return first.select("h", "k", "l", "d", F.size("all").alias("multiplicity")).orderBy(F.desc("d"), F.desc("h"), F.desc("k"), F.desc("l"))


def ring_table(reflections: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Reflections (lattice, two_theta, multiplicity, ...) with a ring number and the ring's angle.

    Walking up in angle, a reflection farther than the tolerance from the running, multiplicity-weighted
    mean of the ring opens the next one. A lattice's few hundred reflections are one group.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["two_theta", "h", "k", "l"]).reset_index(drop=True)
        rings, mean, weight = [], None, 0.0
        for angle, m in zip(pdf["two_theta"], pdf["multiplicity"]):
            if mean is None or angle - mean > tolerance:
                rings.append((rings[-1] + 1) if rings else 0)
                mean, weight = angle, float(m)
            else:
                rings.append(rings[-1])
                mean, weight = (mean * weight + angle * m) / (weight + m), weight + m
        pdf["ring"] = rings
        means = pdf.assign(w=pdf["two_theta"] * pdf["multiplicity"]).groupby("ring")[["w", "multiplicity"]].sum()
        pdf["ring_angle"] = pdf["ring"].map(means["w"] / means["multiplicity"])
        return pdf

    schema = f"{', '.join(f'`{n}` {t}' for n, t in reflections.dtypes)}, ring int, ring_angle double"
    return reflections.groupBy("lattice").applyInPandas(walk, schema)


def assign_rings(peaks: DataFrame, rings: DataFrame) -> DataFrame:
    """The ring nearest in angle for each peak (polar). ``rings``: (ring, ring_angle) of one lattice, a few hundred rows."""
    table = [(r["ring_angle"], r["ring"]) for r in rings.select("ring", "ring_angle").distinct().orderBy("ring").collect()]
    if not table:
        return peaks.withColumn("ring", F.lit(None).cast("int"))
    tries = F.array(*[F.struct(F.abs(F.col("polar") - a).alias("d"), F.lit(r).alias("ring")) for a, r in table])
    return peaks.withColumn("ring", F.array_min(tries)["ring"])


def match_pair_angles(pairs: DataFrame, primary: DataFrame, secondary: DataFrame, cell: tuple[float, ...], tolerance: float = 5.0) -> DataFrame:
    """For each observed angle (pair_id, angle) the two ring members whose angle is nearest, if nearer than the tolerance. Ring members are a few dozen rows."""
    b = b_matrix(*cell)
    first, second = ([np.array([r["h"], r["k"], r["l"]], float) for r in df.select("h", "k", "l").distinct().orderBy("h", "k", "l").collect()] for df in (primary, secondary))
    known = []
    for p in first:
        for q in second:
            u, v = b @ p, b @ q
            known.append((round(math.degrees(math.acos(max(-1.0, min(1.0, float(u @ v / (np.linalg.norm(u) * np.linalg.norm(v))))))), 3), *map(int, p), *map(int, q)))
    names = ["between", "ah", "ak", "al", "bh", "bk", "bl"]
    if not known:
        return pairs.select("pair_id", "angle", *[F.lit(None).cast("double" if n == "between" else "int").alias(n) for n in names]).filter("false")
    members = F.array(*[F.struct(F.abs(F.col("angle") - m[0]).alias("off"), *[F.lit(v).alias(n) for n, v in zip(names, m)]) for m in known])
    best = pairs.select("pair_id", "angle", F.array_min(members).alias("m")).filter(F.col("m.off") < tolerance)
    return best.select("pair_id", "angle", *[f"m.{n}" for n in names])


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of which each takes long, dealt to as many tasks as a shuffle has and at least one a core: a million of them can be one small file, which Spark reads in one task."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def matrices(ubs: pd.Series, most: float) -> tuple[np.ndarray, np.ndarray]:
    """The places of arrays of 9 numbers that are whole and finite and as matrices have a condition number of at most ``most``, and these matrices (k x 3 x 3)."""
    own = [(k, u) for k, ub in enumerate(ubs) if ub is not None and len(ub) == 9 and np.isfinite(u := np.asarray(ub, float)).all()]
    places, found = np.array([k for k, _ in own], int), np.array([u for _, u in own]).reshape(-1, 3, 3)
    good = np.flatnonzero(np.linalg.cond(found) <= most) if len(own) else places
    return places[good], found[good]


def scaled(axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrices (k x 3 x 3) without a power of two each, so that squares of their lengths neither overflow nor vanish, and the powers."""
    power = np.frexp(np.abs(axes).max((1, 2)))[1]
    return np.ldexp(axes, -power[:, None, None]), power
