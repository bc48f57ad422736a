"""Diffractometer geometry as column expressions.

Matrices that are the same for a whole entry are numbers, made once by numpy; only terms that depend on the
pixel or the frame are columns. Conventions: angles in degrees, lengths in mm, wavelength in angstrom, reciprocal
lengths without 2 pi, Busing-Levy B matrix, scattering vector g from pixel (x, y) and frame z with
phi = phi0 + phi_step * z.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rotmat(axis: str, degrees: float | None) -> np.ndarray:
    """Right-handed rotation about x, y or z; the identity for null or zero."""
    if not degrees:
        return np.eye(3)
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    i, j = {"x": (1, 2), "y": (2, 0), "z": (0, 1)}[axis]
    m = np.eye(3)
    m[i, i] = m[j, j] = c
    m[i, j], m[j, i] = -s, s
    return m


def orientation_matrix(text) -> np.ndarray:
    """The 3 x 3 matrix of a signed axis string such as ``-y +z -x``; a matrix passes through."""
    if not isinstance(text, str):
        return np.asarray(text, float).reshape(3, 3)
    parts = text.split()
    axes = [p.lstrip("+-") for p in parts]
    if len(parts) != 3 or sorted(axes) != ["x", "y", "z"] or any(len(p) - len(a) > 1 for p, a in zip(parts, axes)):
        raise ValueError(f"not an orientation: {text!r}")
    m = np.zeros((3, 3))
    for row, (part, axis) in enumerate(zip(parts, axes)):
        m[row, "xyz".index(axis)] = -1.0 if part[0] == "-" else 1.0
    return m


def b_matrix(a: float, b: float, c: float, alpha: float, beta: float, gamma: float) -> np.ndarray:
    """Busing-Levy B: columns of reciprocal axes, norm(B h) = 1/d."""
    g = metric(a, b, c, alpha, beta, gamma)
    inverse = np.linalg.inv(g)
    ra, rb, rc = np.sqrt(np.diag(inverse))
    cos_g, cos_b = inverse[0, 1] / (ra * rb), inverse[0, 2] / (ra * rc)
    sin_g, sin_b = math.sqrt(1 - cos_g**2), math.sqrt(1 - cos_b**2)
    return np.array([[ra, rb * cos_g, rc * cos_b], [0, rb * sin_g, -rc * sin_b * math.cos(math.radians(alpha))], [0, 0, 1 / c]])


def metric(a: float, b: float, c: float, alpha: float, beta: float, gamma: float) -> np.ndarray:
    ca, cb, cg = (math.cos(math.radians(x)) for x in (alpha, beta, gamma))
    return np.array([[a * a, a * b * cg, a * c * cb], [a * b * cg, b * b, b * c * ca], [a * c * cb, b * c * ca, c * c]])


def recip_cell(a: float, b: float, c: float, alpha: float, beta: float, gamma: float) -> tuple[float, ...]:
    """(a*, b*, c*, alpha*, beta*, gamma*); the lengths carry 2 pi."""
    inverse = np.linalg.inv(metric(a, b, c, alpha, beta, gamma))
    lengths = np.sqrt(np.diag(inverse))
    angle = lambda i, j: math.degrees(math.acos(inverse[i, j] / (lengths[i] * lengths[j])))
    return (*(2 * math.pi * lengths), angle(1, 2), angle(0, 2), angle(0, 1))


def unitarity(u: np.ndarray) -> np.ndarray:
    return np.asarray(u) @ np.asarray(u).T


def ub_from_two_peaks(b: np.ndarray, h1, h2, g1, g2) -> np.ndarray:
    """U from two indexed scattering vectors: the first fixed exactly, the second in its plane with it."""
    frame = lambda p, q: np.stack([p / np.linalg.norm(p), np.cross(np.cross(p, q), p) / np.linalg.norm(np.cross(np.cross(p, q), p)), np.cross(p, q) / np.linalg.norm(np.cross(p, q))], 1)
    return frame(np.asarray(g1, float), np.asarray(g2, float)) @ frame(b @ np.asarray(h1, float), b @ np.asarray(h2, float)).T


@dataclass(frozen=True)
class Geometry:
    """One entry's geometry; ``orientation`` takes detector axes to laboratory axes (x along the beam)."""

    wavelength: float = 0.2
    distance: float = 500.0
    pixel_size: float = 0.172
    xc: float = 0.0
    yc: float = 0.0
    yaw: float = 0.0
    pitch: float = 0.0
    roll: float = 0.0
    theta: float = 0.0
    omega: float = 0.0
    chi: float = 0.0
    phi: float = -5.0
    phi_step: float = 0.1
    xs: float = 0.0
    ys: float = 0.0
    zs: float = 0.0
    nx: int = 1475
    ny: int = 1679
    orientation: str = "-y +z -x"
    cell: tuple[float, ...] = (4.0, 4.0, 4.0, 90.0, 90.0, 90.0)
    u: tuple[tuple[float, ...], ...] | None = field(default=((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)))

    def with_(self, **changes) -> "Geometry":
        return replace(self, **changes)

    @property
    def b(self) -> np.ndarray:
        return b_matrix(*self.cell)

    @property
    def ub(self) -> np.ndarray:
        return np.asarray(self.u) @ self.b

    @property
    def detector(self) -> np.ndarray:
        """Inverse of the detector's tilt Rx(roll) Ry(pitch) Rz(yaw)."""
        return np.linalg.inv(rotmat("x", self.roll) @ rotmat("y", self.pitch) @ rotmat("z", self.yaw))

    def gonio(self, phi: float = 0.0) -> np.ndarray:
        """Ry(theta) Rz(omega) Rx(chi) Rz(phi)."""
        return rotmat("y", self.theta) @ rotmat("z", self.omega) @ rotmat("x", self.chi) @ rotmat("z", phi)


def _row(m: np.ndarray, k: int, v: list[Column]) -> Column:
    terms = [float(m[k, j]) * v[j] for j in range(3) if m[k, j] != 0]
    return sum(terms[1:], terms[0]) if terms else F.lit(0.0)


def _times(m: np.ndarray, v: list[Column]) -> list[Column]:
    return [_row(m, k, v) for k in range(3)]


def ray(geo: Geometry, x: Column, y: Column) -> list[Column]:
    """The detector point of a pixel in laboratory axes, from the sample's centre."""
    inv_o = np.linalg.inv(orientation_matrix(geo.orientation))
    flat = [geo.pixel_size * (x - geo.xc), geo.pixel_size * (y - geo.yc), F.lit(0.0)]
    point = _times(geo.detector @ inv_o, flat)
    return [point[0] + geo.distance, point[1], point[2]]


def gvec(geo: Geometry, x: Column, y: Column, z: Column) -> list[Column]:
    """The scattering vector of a pixel and frame in crystal axes (three columns)."""
    p = ray(geo, x, y)
    phi = F.radians(F.lit(float(geo.phi)) + geo.phi_step * z)
    base = geo.gonio()  # G(phi) = base Rz(phi)
    s = [geo.xs, geo.ys, geo.zs]
    if any(s):
        turned = [F.cos(phi) * s[0] - F.sin(phi) * s[1], F.sin(phi) * s[0] + F.cos(phi) * s[1], F.lit(float(s[2]))]
        p = [a - b for a, b in zip(p, _times(base, turned))]
    norm = F.sqrt(p[0] * p[0] + p[1] * p[1] + p[2] * p[2]) * geo.wavelength
    g = [p[0] / norm - 1.0 / geo.wavelength, p[1] / norm, p[2] / norm]
    g = _times(base.T, g)
    return [F.cos(phi) * g[0] + F.sin(phi) * g[1], -F.sin(phi) * g[0] + F.cos(phi) * g[1], g[2]]


def _ray_of(geo: Geometry, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``ray`` of whole arrays, three rows."""
    flat = np.stack([geo.pixel_size * (x - geo.xc), geo.pixel_size * (y - geo.yc), np.zeros(len(x))])
    point = geo.detector @ np.linalg.inv(orientation_matrix(geo.orientation)) @ flat
    point[0] += geo.distance
    return point


def gvec_of(geo: Geometry, x: np.ndarray, y: np.ndarray, frame: float) -> np.ndarray:
    """``gvec`` of the pixels of one frame as arrays, three rows."""
    p, phi = _ray_of(geo, x, y), geo.phi + geo.phi_step * frame
    full = geo.gonio(phi)
    p = p - (full @ np.array([geo.xs, geo.ys, geo.zs], float))[:, None]
    g = p / (np.sqrt((p * p).sum(0)) * geo.wavelength)
    g[0] -= 1.0 / geo.wavelength
    return full.T @ g


def polarization_of(geo: Geometry, x: np.ndarray, y: np.ndarray, degree: float = 1.0) -> np.ndarray:
    """``polarization`` of whole arrays."""
    p = _ray_of(geo, x, y)
    square = (p * p).sum(0)
    return 1.0 - degree * p[1] * p[1] / square - (1.0 - degree) / 2 * (1.0 - p[0] * p[0] / square)


def pixel_to_hkl(geo: Geometry, x: Column, y: Column, z: Column) -> list[Column]:
    """Fractional h, k, l; zeros without an orientation."""
    if geo.u is None:
        return [F.lit(0.0)] * 3
    return _times(np.linalg.inv(geo.ub), gvec(geo, x, y, z))


def hkl_to_pixels(reflections: DataFrame, geo: Geometry) -> DataFrame:
    """``reflections`` (h, k, l, ...) with x, y, z: the up to two frames and pixels where each meets the Ewald sphere, in closed form.

    z is held in one turn: below 25 frames it moves up by a turn. Reflections that never meet the sphere have no row.
    """
    own = reflections.columns
    base, turn = geo.gonio(), abs(360.0 / geo.phi_step)
    g = base.T @ np.array([1.0 / geo.wavelength, 0.0, 0.0])
    v = _times(geo.ub, [F.col(c).cast("double") for c in "hkl"])
    rows = reflections.select(*own, *[c.alias(f"_v{i}") for i, c in enumerate(v)])
    v = [F.col(f"_v{i}") for i in range(3)]
    a, b = float(g[0]) * v[0] + float(g[1]) * v[1], float(g[1]) * v[0] - float(g[0]) * v[1]
    c = -(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]) / 2 - float(g[2]) * v[2]
    rows = rows.select(*own, *v, F.atan2(b, a).alias("_mid"), F.try_divide(c, F.sqrt(a * a + b * b)).alias("_c"))
    rows = rows.select(*own, *v, F.explode(F.filter(F.transform(F.array(F.lit(1.0), F.lit(-1.0)), lambda side: F.col("_mid") + side * F.acos("_c")), lambda p: ~F.isnan(p) & p.isNotNull())).alias("_phi"))
    phi = F.col("_phi")
    k_out = _times(base, [F.cos(phi) * v[0] - F.sin(phi) * v[1], F.sin(phi) * v[0] + F.cos(phi) * v[1], v[2]])
    k_out = [k_out[0] + 1.0 / geo.wavelength, k_out[1], k_out[2]]
    # back to detector axes; the detector is where the third coordinate is 0
    back = orientation_matrix(geo.orientation) @ np.linalg.inv(geo.detector)
    rows = rows.select(*own, phi, *[_row(back, i, k_out).alias(f"_d{i}") for i in range(3)])
    origin = back @ np.array([geo.distance, 0.0, 0.0])
    scale = float(origin[2]) / F.col("_d2")
    z = F.pmod((F.degrees(phi) - geo.phi) / geo.phi_step, F.lit(turn))
    return rows.select(
        *own,
        ((scale * F.col("_d0") - float(origin[0])) / geo.pixel_size + geo.xc).alias("x"),
        ((scale * F.col("_d1") - float(origin[1])) / geo.pixel_size + geo.yc).alias("y"),
        F.when(z < 25, z + turn).otherwise(z).alias("z"),
    )


def unique_roots(roots: Column, digits: int = 4) -> Column:
    """The distinct numbers of an array of roots to so many decimals, rising; nulls and what is no number left out."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(roots, lambda r: r.isNotNull() & ~F.isnan(r)), lambda r: F.round(r, digits) + 0.0)))


def on_detector(geo: Geometry, x: Column, y: Column, z: Column, frames: int = 3648) -> Column:
    return (x > 0) & (x < geo.nx) & (y > 0) & (y < geo.ny) & (z > 0) & (z < frames)


def radius_px(geo: Geometry, x: Column, y: Column) -> Column:
    return F.sqrt((x - geo.xc) * (x - geo.xc) + (y - geo.yc) * (y - geo.yc))


def polar(geo: Geometry, x: Column, y: Column) -> Column:
    """Scattering angle in degrees; tilts don't change the distance from the beam centre that it uses."""
    return F.degrees(F.atan(radius_px(geo, x, y) * (geo.pixel_size / geo.distance)))


def azimuth(geo: Geometry, x: Column, y: Column) -> Column:
    p = _times(np.linalg.inv(orientation_matrix(geo.orientation)), [geo.pixel_size * (x - geo.xc), geo.pixel_size * (y - geo.yc), F.lit(0.0)])
    return F.degrees(F.atan2(-p[1], p[2]))


def polarization(geo: Geometry, x: Column, y: Column, degree: float = 1.0) -> Column:
    """The part of a horizontally polarised beam scattered towards a pixel."""
    p = ray(geo, x, y)
    square = p[0] * p[0] + p[1] * p[1] + p[2] * p[2]
    return 1.0 - degree * p[1] * p[1] / square - (1.0 - degree) / 2 * (1.0 - p[0] * p[0] / square)


def two_theta_max(geo: Geometry) -> float:
    """The angle of the farthest detector corner in degrees."""
    far = max(math.hypot(x - geo.xc, y - geo.yc) for x in (0, geo.nx - 1) for y in (0, geo.ny - 1))
    return math.degrees(math.atan(far * geo.pixel_size / geo.distance))


def q_max(geo: Geometry) -> float:
    return 4 * math.pi / geo.wavelength * math.sin(math.radians(two_theta_max(geo)) / 2)


def auto_q(geo: Geometry) -> tuple[float, float] | None:
    """(qmin, qmax) of the peak annulus; none without a beam centre."""
    if geo.xc is None or geo.yc is None:
        return None
    scale = max(geo.yc, geo.ny - 1 - geo.yc) * 2 * math.pi * geo.pixel_size / (geo.wavelength * geo.distance)
    return 0.3 * scale, 0.95 * scale


def photon_energy(wavelength: Column) -> Column:
    """keV from angstrom."""
    return F.lit(12.398419740639717) / wavelength


def d_spacing(cell: tuple[float, ...], h: Column, k: Column, l: Column) -> Column:  # noqa: E741
    return 1.0 / norm_b(cell, h, k, l)


def norm_b(cell: tuple[float, ...], h: Column, k: Column, l: Column) -> Column:  # noqa: E741
    v = _times(b_matrix(*cell), [h, k, l])
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def two_theta_hkl(cell: tuple[float, ...], wavelength: float, h: Column, k: Column, l: Column) -> Column:  # noqa: E741
    return F.degrees(2 * F.asin(norm_b(cell, h, k, l) * (wavelength / 2)))


def hkl_diff(geo: Geometry, hkl: list[Column]) -> Column:
    """norm(B (hkl - nearest integers)), in 1/angstrom without 2 pi."""
    return norm_b(geo.cell, *[c - F.rint(c) for c in hkl])


def angle_diff(geo: Geometry, polar_deg: Column, hkl: list[Column]) -> Column:
    return F.abs(polar_deg - two_theta_hkl(geo.cell, geo.wavelength, *[F.rint(c) for c in hkl]))


def angle_between(a: list[Column], b: list[Column]) -> Column:
    """Degrees between two vectors, to three decimals."""
    dot = sum((p * q for p, q in zip(a[1:], b[1:])), a[0] * b[0])
    size = lambda v: F.sqrt(sum((p * p for p in v[1:]), v[0] * v[0]))
    return F.round(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (size(a) * size(b)))))), 3)
