"""Small rules of the data model as columns or numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest_step(value: Column) -> Column:
    """The value of 1, 2, 5 or 10 times a power of ten that is nearest to a positive number."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(value)))
    tries = F.array(*[F.struct(F.abs(power * k - value).alias("d"), (power * k).alias("v")) for k in (1.0, 2.0, 5.0, 10.0)])
    return F.array_min(tries)["v"]


def scan_label(prefix: str, value: Column, units: str = "K") -> Column:
    """A scan value as part of a file name: ``m`` for a minus, ``p`` for the point, then the units."""
    text = F.regexp_replace(F.regexp_replace(F.abs(value).cast("string"), r"\.0$", ""), r"\.", "p")
    return F.concat(F.lit(prefix), F.when(value < 0, "m").otherwise(""), text, F.lit(units))


def coerce_setting(value: Column) -> Column:
    """A setting as (kind, text): none, bool, int, float or str, by how it is written."""
    kind = (
        F.when(value.isNull() | value.isin("None", ""), "none")
        .when(value.isin("True", "False"), "bool")
        .when(value.rlike(r"^[+-]?\d+$"), "int")
        .when(value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), "float")
        .otherwise("str")
    )
    return F.struct(kind.alias("kind"), F.when(kind != "none", value).alias("text"))


def fix_epoch(time: Column) -> Column:
    """A start time counted from 1990 instead of 1970, as ISO text."""
    return F.date_format(time + F.expr("INTERVAL 20 YEARS"), "yyyy-MM-dd'T'HH:mm:ss")


def frame_transmission(shutter: Column) -> Column:
    return 1 - shutter


def title(name: Column, formula: Column, temperature: Column, units: str, task: str) -> Column:
    """Formula or name, temperature with units, and the task without its prefix and with spaces."""
    clean = task.removeprefix("nx").replace("_", " ")
    return F.concat_ws(" ", F.coalesce(formula, name), F.concat(temperature.cast("string"), F.lit(units)), F.lit(clean))


def constrain_cell(symmetry: str, cell: tuple[float, ...]) -> tuple[float, ...]:
    """The cell with the equal edges and fixed angles of its crystal system."""
    a, b, c, al, be, ga = cell
    return {
        "cubic": (a, a, a, 90.0, 90.0, 90.0), "tetragonal": (a, a, c, 90.0, 90.0, 90.0), "orthorhombic": (a, b, c, 90.0, 90.0, 90.0),
        "hexagonal": (a, a, c, 90.0, 90.0, 120.0), "rhombohedral": (a, a, a, al, al, al), "monoclinic": (a, b, c, 90.0, be, 90.0), "triclinic": (a, b, c, al, be, ga),
    }[symmetry]


def guess_symmetry(cell: tuple[float, ...], tolerance: float = 1e-3) -> str:
    a, b, c, al, be, ga = cell
    same = lambda *v: max(v) - min(v) <= tolerance
    if same(al, be, ga, 90.0):
        return "cubic" if same(a, b, c) else "tetragonal" if same(a, b) else "orthorhombic"
    if same(al, be, 90.0) and same(ga, 120.0) and same(a, b):
        return "hexagonal"
    if same(a, b, c) and same(al, be, ga):
        return "rhombohedral"
    return "monoclinic" if same(al, ga, 90.0) else "triclinic"


def default_grid(q_max: float, reciprocal: tuple[float, float, float]) -> list[tuple[float, float, int]]:
    """Per axis (stop, step, points): stop is 0.8 q_max in reciprocal units, rounded, then up to an even number; about 1000 steps of a round size."""
    out = []
    for length in reciprocal:
        stop = 2 * math.ceil(round(0.8 * q_max / length) / 2)
        wish = 2 * stop / 1000
        power = 10.0 ** math.floor(math.log10(wish)) if wish > 0 else 1.0
        step = min((power * k for k in (1.0, 2.0, 5.0, 10.0)), key=lambda s: (abs(s - wish), s))
        out.append((float(stop), step, round(2 * stop / step) + 1))
    return out
