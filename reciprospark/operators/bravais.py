"""Conventional cells of a reduced cell: for each crystal system and centring the setting that comes nearest to its rules.

There is no table of forms. Whole-number combinations of the reduced axes give candidate cells; a system's rules on edges and angles give a
candidate's error, and the lattice points inside it its centring. The best candidate of each system and centring is a form.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import permutations, product
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lattice import dealt, matrices, scaled

#: Greatest factor of a combination, and volume of a cell in reduced cells.
REACH, LARGEST = 3, 4
#: Vectors that are longer than the longest reduced axis by more than this factor are in no conventional cell.
LONGEST = 3.5
#: Candidates that miss a system's rules by more are left out: a part of an edge, or radians.
COARSE = 0.05

#: Which edges are equal and which angles (alpha, beta, gamma) are fixed; from the highest symmetry down.
SYSTEMS = {
    "cubic": (((0, 1), (1, 2)), (90, 90, 90)),
    "hexagonal": (((0, 1),), (90, 90, 120)),
    "rhombohedral": (((0, 1),), (90, 90, 120)),
    "tetragonal": (((0, 1),), (90, 90, 90)),
    "orthorhombic": ((), (90, 90, 90)),
    "monoclinic": ((), (90, None, 90)),
    "triclinic": ((), (None, None, None)),
}
#: Lattice points inside a cell by centring, in sixths.
POINTS = {"P": (), "A": ((0, 3, 3),), "B": ((3, 0, 3),), "C": ((3, 3, 0),), "I": ((3, 3, 3),), "F": ((0, 3, 3), (3, 0, 3), (3, 3, 0)), "R": ((4, 2, 2), (2, 4, 4))}
#: Centrings of each system; a monoclinic I cell has a C setting, an orthorhombic A or B cell too.
CENTRINGS = {"cubic": "PIF", "hexagonal": "P", "rhombohedral": "R", "tetragonal": "PI", "orthorhombic": "PCIF", "monoclinic": "PC", "triclinic": "P"}
FORMS = [(system, c) for system in SYSTEMS for c in CENTRINGS[system]]
CODES = {name: code for code, name in enumerate(POINTS, 1)}
#: Lattices that are searched at once: their cosines (some 145 x 145 each) stay in a core's cache.
LATTICES = 16


class _Table(NamedTuple):
    """Whole-number combinations and the cells they make, whatever the lattice. Of a vector and its negative ``half`` holds the one above 0; ``places`` has their places among all.

    ``kind[a, b, c]`` is the centring (one more than its place in POINTS, 0 for none) of the cell of three of ``half``; signs of axes change none but R, which ``obverse`` gives
    by the signs of b and c (0 for plus, 1 for minus). ``bits`` and ``obverse_bits`` are the same by pair (a, b), as bits of the axes c.
    """

    half: np.ndarray
    places: np.ndarray
    kind: np.ndarray
    bits: np.ndarray
    primitive_bits: np.ndarray
    obverse_bits: np.ndarray


def _packed(held: np.ndarray) -> np.ndarray:
    """The last axis as bits of 64-bit words."""
    room = np.zeros((*held.shape[:-1], -(-held.shape[-1] // 64) * 64), bool)
    room[..., : held.shape[-1]] = held
    return np.packbits(room, axis=-1, bitorder="little").view("<u8")


@cache
def _table() -> _Table:
    """A place in a cell is a lattice point if it is a whole number of reduced axes; a cell has as many points as its volume, of at most ``LARGEST``."""
    n = np.array(list(np.ndindex(*(2 * REACH + 1,) * 3))) - REACH
    n = n[np.gcd.reduce(n, axis=1) == 1]
    above = np.flatnonzero([tuple(x) > (0, 0, 0) for x in n.tolist()])
    half = n[above]
    volume = np.abs(np.cross(half[:, None], half[None]).reshape(-1, 3) @ half.T).reshape((len(half),) * 3)
    kind, obverse = np.zeros(volume.shape, np.uint8), np.zeros((2, 2, *volume.shape), bool)
    for code, (name, points) in enumerate(POINTS.items(), 1):
        if len(points) >= LARGEST:
            continue
        at = np.nonzero(volume == len(points) + 1)
        a, b, c = (half[x] for x in at)
        within = lambda s, t: np.all([((p[0] * a + s * p[1] * b + t * p[2] * c) % 6 == 0).all(1) for p in points], axis=0) if points else np.ones(len(a), bool)
        if name == "R":
            for (i, s), (j, t) in product(enumerate((1, -1)), repeat=2):
                obverse[(i, j, *at)] = within(s, t)
        else:
            kind[at] = np.where(within(1, 1), code, kind[at])
    used = [CODES[c] for c in "PCIF"]
    return _Table(half, np.stack([above, len(n) - 1 - above]), kind, _packed(np.isin(kind, used)), _packed(kind == CODES["P"]), _packed(obverse))


def _fit(m: np.ndarray, edges: tuple, angles: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The error of cells (k x 3 x 3) against a system's rules, and their edges and angles: relative differences of edges and radians, root mean square."""
    size = np.linalg.norm(m, axis=2)
    at = lambda i, j: np.arccos(np.clip((m[:, i] * m[:, j]).sum(1) / (size[:, i] * size[:, j]), -1, 1))
    found = np.stack([at(1, 2), at(0, 2), at(0, 1)], 1)
    off = [(size[:, i] - size[:, j]) / np.maximum(size[:, i], size[:, j]) for i, j in edges] + [found[:, k] - math.radians(a) for k, a in enumerate(angles) if a is not None]
    error = np.sqrt(np.mean(np.square(off), axis=0)) if off else np.zeros(len(m))
    return error, np.concatenate([size, np.degrees(found)], 1)


def _places(held: np.ndarray) -> tuple[np.ndarray, ...]:
    """``np.nonzero``, which is fast for one dimension only."""
    return np.unravel_index(np.flatnonzero(held), held.shape)


def _cells(words: np.ndarray, *pairs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Columns of pairs and the third axis, for each bit of the pairs' words."""
    some = np.flatnonzero(words.any(1))
    pair, c = _places(np.unpackbits(words[some].view(np.uint8), axis=1, bitorder="little").view(bool))
    return *(x[some[pair]] for x in pairs), c


def _candidates(axes: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Candidates (row, group, error, a, b, c, sign of b, sign of c) for reduced axes (rows x 3 x 3), one of those that differ by signs only; group counts FORMS, signs are 0 for plus and 1 for minus.

    Of equal candidates the first by length and place counts, and a negative vector stands before its positive; so axes are negative where a system leaves their signs open.
    """
    t = _table()
    v = t.half @ axes
    size = np.linalg.norm(v, axis=2)
    kept = size <= LONGEST * np.linalg.norm(axes, axis=2).max(1)[:, None]
    unit = v / size[:, :, None]
    cos = unit @ unit.transpose(0, 2, 1)
    steep = np.abs(cos)
    both = kept[:, :, None] & kept[:, None]
    square = (steep <= math.sin(2 * COARSE)) & both
    bits = _packed(square)
    off = lambda r, i, j: np.square(np.arcsin(cos[r, i, j]))
    apart = lambda r, i, j: np.abs(size[r, i] - size[r, j]) / np.maximum(size[r, i], size[r, j])

    def of(system, centring, chosen, error, *rest):
        own = np.flatnonzero(chosen & (error <= COARSE))
        yield tuple(x[own] for x in (rest[0], np.full(len(error), FORMS.index((system, centring))), error, *rest[1:]))

    r, a, b = _places(square)
    r, a, b, c = _cells(bits[r, b] & t.bits[a, b], r, a, b)
    kind = t.kind[a, b, c]
    ab, bc, ones = off(r, a, b), off(r, b, c), np.ones(len(r), np.int8)
    for x in CENTRINGS["monoclinic"]:
        yield from of("monoclinic", x, kind == CODES[x], np.sqrt((ab + bc) / 2), r, a, b, c, ones, (cos[r, a, c] >= -math.sin(1e-6)).astype(np.int8))
    own = np.flatnonzero(square[r, a, c])
    r, a, b, c, kind, ones = (x[own] for x in (r, a, b, c, kind, ones))
    right, first, second = ab[own] + bc[own] + off(r, a, c), apart(r, a, b), apart(r, b, c)
    alike = first <= 2 * COARSE
    for system, fits, error in (("orthorhombic", True, np.sqrt(right / 3)), ("tetragonal", alike, np.sqrt((right + first**2) / 4)), ("cubic", alike & (second <= 2 * COARSE), np.sqrt((right + first**2 + second**2) / 5))):
        for x in CENTRINGS[system]:
            yield from of(system, x, fits & (kind == CODES[x]), error, r, a, b, c, ones, ones)

    r, a, b = _places((steep >= math.cos(math.pi / 3 + 2 * COARSE)) & (steep <= math.cos(math.pi / 3 - 2 * COARSE)) & both)
    own = np.flatnonzero(apart(r, a, b) <= 2 * COARSE)
    r, a, b = r[own], a[own], b[own]
    s, near = (cos[r, a, b] > 0).astype(np.int8), bits[r, a] & bits[r, b]
    for system, centring, words, sign in (("hexagonal", "P", t.primitive_bits[a, b], 1), ("rhombohedral", "R", t.obverse_bits[s, 0, a, b], 0), ("rhombohedral", "R", t.obverse_bits[s, 1, a, b], 1)):
        q, i, j, sj, k = _cells(near & words, r, a, b, s)
        error = np.sqrt((np.square(np.arccos(steep[q, i, j]) - math.pi / 3) + off(q, i, k) + off(q, j, k) + apart(q, i, j) ** 2) / 4)
        yield from of(system, centring, True, error, q, i, j, k, sj, np.full(len(q), sign, np.int8))


def _best(axes: np.ndarray) -> list[tuple[int, str, str, float, np.ndarray, np.ndarray]]:
    """(row, system, centring, error, cell, transform) for reduced axes (rows x 3 x 3), by row and form."""
    t = _table()
    axes, power = scaled(axes)
    size = np.linalg.norm(t.half @ axes, axis=2)
    r, group, error, a, b, c, s, u = (np.concatenate(x) for x in zip(*_candidates(axes)))
    key, own = r * len(FORMS) + group, np.arange(len(r))
    for value in (error.round(6), np.ldexp(size[r, a] + size[r, b] + size[r, c], power[r]).round(6)):
        least = np.full(len(axes) * len(FORMS), np.inf)
        np.minimum.at(least, key[own], value[own])
        own = own[value[own] == least[key[own]]]
    r, a, b, c, s, u, key = (x[own] for x in (r, a, b, c, s, u, key))
    order = np.lexsort((t.places[u, c], size[r, c], t.places[s, b], size[r, b], t.places[0, a], size[r, a], key))
    order = order[np.unique(key[order], return_index=True)[1]]
    r, a, b, c, s, u, key = (x[order] for x in (r, a, b, c, s, u, key))
    m = np.stack([t.half[a], t.half[b] * (1 - 2 * s[:, None].astype(int)), t.half[c] * (1 - 2 * u[:, None].astype(int))], 1)
    # every lattice has its reduced cell as triclinic form
    every = np.arange(len(axes))
    m = np.concatenate([m, np.broadcast_to(np.eye(3, dtype=int), (len(axes), 3, 3))])
    r, key = np.concatenate([r, every]), np.concatenate([key, every * len(FORMS) + FORMS.index(("triclinic", "P"))])
    m = m * np.sign(np.rint(np.linalg.det(m) * np.sign(np.linalg.det(axes))[r])).astype(int)[:, None, None]
    error, cell = np.zeros(len(m)), np.zeros((len(m), 6))
    for k, (system, _) in enumerate(FORMS):
        own = np.flatnonzero(key % len(FORMS) == k)
        if len(own):
            error[own], cell[own] = _fit(m[own] @ axes[r[own]], *SYSTEMS[system])
    cell[:, :3] = np.ldexp(cell[:, :3], power[r][:, None])
    return [(int(r[k]), *FORMS[key[k] % len(FORMS)], float(error[k]), cell[k], m[k]) for k in np.argsort(key).tolist()]


def forms(ub: np.ndarray) -> list[tuple[str, str, float, np.ndarray, np.ndarray]]:
    """(system, centring, error, cell, transform) of the best cell of each system and centring for the UB of a reduced cell. ``transform`` takes reduced axes to the cell's."""
    return [found[1:] for found in _best(np.linalg.inv(ub)[None])]


def lattice_forms(ubs: DataFrame) -> DataFrame:
    """(id, cell_type, centring, error, a, b, c, alpha, beta, gamma, transform) for each row (id, ub array of 9) of reduced cells; no row where ``ub`` is null or singular."""
    schema = "id long, cell_type string, centring string, error double, a double, b double, c double, alpha double, beta double, gamma double, transform array<int>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            places, found = matrices(pdf["ub"], 1e12)
            ids, rows = pdf["id"].iloc[places].tolist(), []
            for lo in range(0, len(ids), LATTICES):
                rows += [(ids[lo + r], s, c, e, *cell.tolist(), m.ravel().tolist()) for r, s, c, e, cell, m in _best(np.linalg.inv(found[lo : lo + LATTICES]))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return dealt(ubs.select("id", "ub")).mapInPandas(run, schema)


def best_cells(found: DataFrame, most: float | Column = 0.01) -> DataFrame:
    """Of ``lattice_forms``' rows the one of highest symmetry for each id with an error of at most ``most``; of equals the least error."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SYSTEMS]), F.col("cell_type"))
    row = F.struct(*[F.col(c) for c in found.columns])
    best = found.filter(F.col("error") <= most).groupBy("id").agg(F.min_by(row, F.struct(rank.alias("rank"), "error", "centring")).alias("r"))
    return best.select("r.*")


def settings_of(m: np.ndarray) -> list[np.ndarray]:
    """The right-handed settings of a cell: permutations of its axes, with the sign of all changed where that needs it."""
    out = [m[list(p)] for p in permutations(range(3))]
    return [s if np.linalg.det(s) > 0 else -s for s in out]
