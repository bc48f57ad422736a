"""Frames in bands: (scan?, entry, frame, y0, ny, nx, counts), where counts holds ny rows of nx pixels from row y0 on, null where a pixel wasn't read.

A band is a few ten thousand numbers in one row, so a full frame is some twenty-five rows in place of millions. Kernels add up, mask, or
put pixels into voxels where bands are read; only sums reach a shuffle. All give what their counterparts on long frames give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reciprospark.functions.geometry import Geometry, gvec_of, polarization_of

from .masks import box_mean, fill_gaps
from .volume import Grid

#: Rows of a band.
HEIGHT = 64
#: Numbers that a task holds before it passes its sums on.
HELD = 1 << 24
#: Pixels that are put into voxels at once.
AT_ONCE = 1 << 20


def _keys(bands: DataFrame) -> list[str]:
    return [c for c in ("scan", "entry") if c in bands.columns]


def _types(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def _field(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _arrays(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(counts, which of them were read) of each band; a null or negative count is 0."""
    offsets, values = column.offsets.to_numpy(), column.values
    read = values.is_valid().to_numpy(zero_copy_only=False)
    counts = np.maximum(values.fill_null(0).to_numpy(zero_copy_only=False), 0)
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield counts[lo:hi], read[lo:hi]


def _listed(arrays: list[np.ndarray], kind: pa.DataType, read: list[np.ndarray] | None = None) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(offsets, pa.array(values, mask=None if read is None else ~np.concatenate(read)).cast(kind))


def to_bands(frames: DataFrame, ny: int, nx: int, height: int = HEIGHT) -> DataFrame:
    """Long frames (scan?, entry, frame, y, x, counts) as bands. Pixels outside the detector are dropped, rows of one pixel added up; a band without any row is left out."""
    keys = [*_keys(frames), "frame", "y0"]
    inside = frames.filter(F.col("y").between(0, ny - 1) & F.col("x").between(0, nx - 1)).withColumn("y0", (F.floor(F.col("y") / height) * height).cast("int"))
    place = ((F.col("y") - F.col("y0")) * nx + F.col("x")).cast("int")
    held = inside.groupBy(*keys).agg(F.collect_list(F.struct(place.alias("p"), F.col("counts").cast("long").alias("c"))).alias("own"))
    listed = held.select(*keys, F.col("own.p").alias("p"), F.col("own.c").alias("c"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            y0 = _field(batch, "y0").to_numpy()
            rows = np.minimum(height, ny - y0).astype(np.int32)
            values, read = [], []
            for n, p, c in zip(rows, _field(batch, "p"), _field(batch, "c")):
                p, c = p.values.to_numpy(), c.values.to_numpy(zero_copy_only=False)
                own, there = np.zeros(n * nx, np.int64), np.zeros(n * nx, bool)
                np.add.at(own, p, c)
                there[p] = True
                values.append(own)
                read.append(there)
            yield pa.RecordBatch.from_arrays([*[_field(batch, k) for k in keys], pa.array(rows), pa.array(np.full(len(rows), nx, np.int32)), _listed(values, pa.int32(), read)], [*keys, "ny", "nx", "counts"])

    return listed.mapInArrow(run, f"{_types(listed, keys)}, ny int, nx int, counts array<int>")


def to_frames(bands: DataFrame) -> DataFrame:
    """Bands as long frames, without the pixels that weren't read."""
    rows = bands.select(*[c for c in (*_keys(bands), "frame") if c in bands.columns], "y0", "nx", F.posexplode("counts").alias("p", "v")).filter("v IS NOT NULL")
    return rows.select(*[c for c in (*_keys(bands), "frame") if c in bands.columns], (F.col("y0") + F.floor(F.col("p") / F.col("nx"))).cast("int").alias("y"), (F.col("p") % F.col("nx")).cast("int").alias("x"), F.col("v").cast("long").alias("counts"))


def mask_bits(pixel_mask: DataFrame | None, ny: int, nx: int) -> bytes | None:
    """A pixel mask (y, x) as one bit a pixel: at most one detector image, a few hundred kilobytes."""
    if pixel_mask is None:
        return None
    bits = np.zeros((ny, nx), bool)
    inside = pixel_mask.filter(F.col("y").between(0, ny - 1) & F.col("x").between(0, nx - 1))
    rows = inside.groupBy("y").agg(F.collect_set("x").alias("x")).toArrow()
    for y, x in zip(rows["y"].to_pylist(), rows["x"].to_pylist()):
        bits[y, x] = True
    return np.packbits(bits).tobytes()


def _unpacked(bits: bytes | None, ny: int, nx: int) -> np.ndarray:
    return np.zeros((ny, nx), bool) if bits is None else np.unpackbits(np.frombuffer(bits, np.uint8), count=ny * nx).reshape(ny, nx).astype(bool)


def summed_data(bands: DataFrame) -> DataFrame:
    """Counts per pixel over all frames, as bands of longs without a frame. Each task adds up its own bands first."""
    keys = [*_keys(bands), "y0", "ny", "nx"]
    schema = f"{_types(bands, keys)}, counts array<long>"

    def emitted(sums: dict) -> pa.RecordBatch:
        columns = list(zip(*sums))
        kinds = [held[k] for k in keys]
        return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(columns, kinds)], _listed([s[0] for s in sums.values()], pa.int64(), [s[1] for s in sums.values()])], [*keys, "counts"])

    held: dict = {}

    def added(sorted_: bool):
        def run(batches):
            sums: dict = {}
            for batch in batches:
                held.update({k: _field(batch, k).type for k in keys})
                for key, (counts, read) in zip(zip(*(_field(batch, k).to_pylist() for k in keys)), _arrays(_field(batch, "counts"))):
                    if key in sums:
                        sums[key][0].__iadd__(counts)
                        sums[key][1].__ior__(read)
                        continue
                    if sums and (sorted_ or len(sums) * len(counts) > HELD):
                        yield emitted(sums)
                        sums = {}
                    sums[key] = counts.astype(np.int64), read.copy()
            if sums:
                yield emitted(sums)

        return run

    partial = bands.select(*keys, "counts").mapInArrow(added(False), schema)
    return partial.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(added(True), schema)


def summed_frames(bands: DataFrame, bits: bytes | None = None, shape: tuple[int, int] = (0, 0)) -> DataFrame:
    """Counts per frame, without the pixels of ``bits`` (``mask_bits`` of a detector of ``shape``). A frame of which no pixel is left has no row."""
    keys = [*_keys(bands), "frame"]

    def run(batches):
        live = ~_unpacked(bits, *shape)
        for batch in batches:
            sums, left = [], []
            for y0, ny, (counts, read) in zip(_field(batch, "y0").to_pylist(), _field(batch, "ny").to_pylist(), _arrays(_field(batch, "counts"))):
                own = live[y0 : y0 + ny].ravel() if bits else True
                sums.append(int(counts.sum(where=own)))
                left.append(bool((read & own).any()))
            yield pa.RecordBatch.from_arrays([*[_field(batch, k) for k in keys], pa.array(sums, pa.int64()), pa.array(left, pa.bool_())], [*keys, "counts", "left"])

    rows = bands.select(*keys, "y0", "ny", "counts").mapInArrow(run, f"{_types(bands, keys)}, counts long, left boolean")
    return rows.filter("left").groupBy(*keys).agg(F.sum("counts").alias("counts"))


def frame_diff(bands: DataFrame) -> DataFrame:
    """The next frame's counts less a frame's own, as bands of longs; a frame without a next one has no row, a pixel that either lacks is null."""
    after = F.expr(f"lead(struct(frame, counts)) OVER (PARTITION BY {', '.join([*_keys(bands), 'y0'])} ORDER BY frame)")
    rows = bands.withColumn("after", after).filter("after.frame = frame + 1")
    return rows.withColumn("counts", F.zip_with("counts", "after.counts", lambda a, b: (b - a).cast("long"))).drop("after")


def bragg_mask(bands: DataFrame, ny: int, nx: int, t1: float = 2.0, h1: int = 11, t2: float = 0.8, h2: int = 51, bits: bytes | None = None, slab: int = 10) -> DataFrame:
    """(scan?, entry, frame, y0, ny, nx, mask): bands of one bit a pixel, set near a Bragg peak; bands without any are left out. As ``masks.bragg_mask``, whose rules hold.

    A task holds one slab of frames and a halo of one frame on each side, as numbers, not as rows of pixels.
    """
    keys = _keys(bands)
    span = bands.groupBy(*keys).agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    slabs = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor((F.col("frame") - F.col("lo") + d) / slab)))
    dealt = bands.join(F.broadcast(span), keys).select(*keys, "frame", "y0", "ny", "counts", "lo", "hi", F.explode(slabs).alias("slab")).filter("slab >= 0")
    schema = f"{_types(bands, keys)}, frame long, y0 int, ny int, nx int, mask binary"

    def run(table: pa.Table) -> pa.Table:
        dead = _unpacked(bits, ny, nx)
        (lo, hi, number), images, cuts = (table.column(c)[0].as_py() for c in ("lo", "hi", "slab")), {}, set()
        for batch in table.to_batches():
            for f, y0, n, (counts, _) in zip(*(_field(batch, c).to_pylist() for c in ("frame", "y0", "ny")), _arrays(_field(batch, "counts"))):
                images.setdefault(f, np.zeros((ny, nx)))[y0 : y0 + n] = counts.reshape(n, nx)
                cuts.add((y0, n))
        none, steps, out = np.zeros((ny, nx)), {}, []

        def step(f):
            if f not in steps:
                near = np.abs(box_mean(images.get(f + 1, none) - images.get(f, none), h1)) >= t1
                steps[f] = box_mean(fill_gaps(near.astype(float), dead), h2) > t2
            return steps[f]

        for f in range(lo + number * slab, min(lo + (number + 1) * slab, hi + 1)):
            both = np.zeros((ny, nx), bool)
            for s in (f - 1, f):
                if lo <= s < hi:
                    both |= step(s)
            out += [(f, y0, n, np.packbits(both[y0 : y0 + n]).tobytes()) for y0, n in sorted(cuts) if both[y0 : y0 + n].any()]
        columns = list(zip(*out)) or [(), (), (), ()]
        own = [pa.array([table.column(k)[0].as_py()] * len(out), table.column(k).type) for k in keys]
        rest = [pa.array(c, t) for c, t in zip((*columns[:3], [nx] * len(out), columns[3]), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))]
        return pa.table([*own, *rest], names=[*keys, "frame", "y0", "ny", "nx", "mask"])

    return dealt.groupBy(*keys, "slab").applyInArrow(run, schema)


def mask_rows(mask: DataFrame) -> DataFrame:
    """The set pixels (scan?, entry, frame, y, x) of ``bragg_mask``'s bands."""
    keys = [*_keys(mask), "frame"]

    def run(batches):
        for batch in batches:
            at, y, x = [], [], []
            for i, (y0, n, nx, bits) in enumerate(zip(*(_field(batch, c).to_pylist() for c in ("y0", "ny", "nx", "mask")))):
                own_y, own_x = np.nonzero(_unpacked(bits, n, nx))
                at.append(np.full(len(own_y), i))
                y.append(own_y + y0)
                x.append(own_x)
            if at:
                take = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays([*[_field(batch, k).take(take) for k in keys], pa.array(np.concatenate(y).astype(np.int32)), pa.array(np.concatenate(x).astype(np.int32))], [*keys, "y", "x"])

    return mask.mapInArrow(run, f"{_types(mask, keys)}, y int, x int")


def hkl_histogram(bands: DataFrame, geo: Geometry, grid: Grid, weights: DataFrame | None = None, bits: bytes | None = None, mask: DataFrame | None = None, corrected: bool = False) -> DataFrame:
    """As ``volume.hkl_histogram``, on bands. ``bits``: ``mask_bits`` of the detector; ``mask``: bands of ``bragg_mask``. Pixels are put into voxels and added up where they are read."""
    keys = ["entry"]
    rows = bands.select("entry", "frame", "y0", "ny", "nx", "counts")
    if weights is not None:
        rows = rows.join(weights.filter("weight > 0").select("entry", "frame", "weight"), ["entry", "frame"])
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    if mask is not None:
        rows = rows.join(mask.select("entry", "frame", "y0", "mask"), ["entry", "frame", "y0"], "left")
    else:
        rows = rows.withColumn("mask", F.lit(None).cast("binary"))
    u = None if geo.u is None else np.linalg.inv(geo.ub)
    n = grid.n

    def voxels(y, x, frame):
        hkl = u @ gvec_of(geo, x, y, frame) if u is not None else np.zeros((3, len(x)))
        at = [np.floor((v - o) * s + 0.5).astype(np.int64) for v, o, s in zip(hkl, (grid.h0, grid.k0, grid.l0), grid.steps)]
        inside = np.logical_and.reduce([(a >= 0) & (a < m) for a, m in zip(at, n)])
        return (at[2] * n[1] + at[1]) * n[0] + at[0], inside

    def run(batches):
        live = ~_unpacked(bits, geo.ny, geo.nx)
        for batch in batches:
            found: dict = {}
            size = 0
            for entry, frame, y0, ny, nx, weight, own, (counts, read) in zip(*(_field(batch, c).to_pylist() for c in ("entry", "frame", "y0", "ny", "nx", "weight", "mask")), _arrays(_field(batch, "counts"))):
                taken = read.reshape(ny, nx)
                if bits:
                    taken = taken & live[y0 : y0 + ny, :nx]
                if own is not None:
                    taken = taken & ~_unpacked(own, ny, nx)
                y, x = np.nonzero(taken)
                place, inside = voxels(y + y0, x, frame)
                w = weight * polarization_of(geo, x, y + y0) if corrected else np.full(len(x), weight)
                found.setdefault(entry, []).append((place[inside], counts.reshape(ny, nx)[y, x][inside], w[inside]))
                size += len(x)
                if size > AT_ONCE:
                    yield from added(found, batch)
                    found, size = {}, 0
            yield from added(found, batch)

    def added(found, batch):
        for entry, parts in found.items():
            place, counts, w = (np.concatenate(p) for p in zip(*parts))
            own, which = np.unique(place, return_inverse=True)
            index = [own // (n[0] * n[1]), own // n[0] % n[1], own % n[0]]
            sums = [np.bincount(which, v, len(own)) for v in (counts, w)]
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array([entry] * len(own), _field(batch, "entry").type), *[pa.array(i.astype(np.int32)) for i in index], *[pa.array(s) for s in sums]], ["entry", "il", "ik", "ih", "v", "n"])

    placed = rows.mapInArrow(run, f"{_types(bands, keys)}, il int, ik int, ih int, v double, n double")
    return placed.groupBy("entry", "il", "ik", "ih").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
