"""Pairs of sets that can be similar enough, found without pairing all sets that have something in common.

Sets come as (num, c, set): only pairs of different ``c`` (component so far) matter. A member (column) that no two components have is a sure miss of each
set, and a set with more misses than its size allows goes. Members that the same sets have stand together as one of their joint weight.
What is left is put in one order, rare members first. Two similar sets have a first common member in this order, a second, and so on, and
neither can miss more on the way than its size allows: each set is in the group of each such first member, and of two
similar sets both are in one group. A group whose pairs would cost more than doing so is divided by the next common member, and again, as long as its parts have far
fewer pairs; groups that are left give their pairs, unless the sizes or what lies behind the last common member leave no room.
All conditions follow from sizes alone, so no pair is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import mixed
from .storage import Scratch
from .workers import lean

#: A group is divided if it has more pairs than this many times the records that its parts would have, and stays so if their pairs are fewer than its own over this.
WORTH = 2
#: Divisions after which a group gives its pairs whatever its size.
MOST_LEVELS = 12

RECORD = "of long, g long, num long, c long, n long, at int, spent long, got long, rest long, kids long"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
_NAMES = [c.split()[0] for c in RECORD.split(", ")]


def incidence(sets: DataFrame, percent: int, scratch: Scratch, rounds: int = 2) -> DataFrame:
    """(num, c, n, keys, weights): the members that sets of several components have, rare ones first, of the sets that have enough of them."""
    rows = sets.select("num", "c", F.size("set").cast("long").alias("n"), F.explode("set").alias("token"))
    for again in reversed(range(rounds)):
        tokens = rows.groupBy("token").agg(F.count("*").alias("freq"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.bit_xor(F.xxhash64("num")).alias("x"), F.bit_xor(F.xxhash64("num", F.lit(1))).alias("y")).filter("lo <> hi")
        joint = rows.join(tokens.select("token", "freq", F.xxhash64("freq", "x", "y").alias("key")), "token")
        if again:
            enough = joint.groupBy("num").agg(F.count("*").alias("w"), F.first("n").alias("n")).filter(100 * F.col("w") >= percent * F.col("n")).select("num")
            rows = scratch.stored(rows.join(enough, "num", "left_semi"), "overlap-members")
        else:
            weighed = joint.groupBy("num", "c", "n", "freq", "key").agg(F.count("*").alias("w"))
            own = weighed.groupBy("num", "c", "n").agg(F.sort_array(F.collect_list(F.struct("freq", "key", "w"))).alias("m"), F.sum("w").alias("w")).filter(100 * F.col("w") >= percent * F.col("n"))
            rows = own.select("num", "c", "n", F.col("m.key").alias("keys"), F.col("m.w").alias("weights"))
    return scratch.stored(rows, "overlap-rows")


def _bound(n: int, percent: int) -> int:
    """The least intersection of a set of ``n`` with any similar set."""
    return -(-percent * n // 100)


def _children(g: np.uint64, num: int, c: int, n: int, keys: np.ndarray, weights: np.ndarray, at: int, spent: int, got: int, percent: int):
    """The records of the groups that divide the one of ``g``, whose last common member stands ``at``."""
    total = np.concatenate([[0], np.cumsum(weights)])
    slack = int(total[-1]) - _bound(n, percent)
    before = total[at + 1 : -1] - total[at + 1]  # missed between the last common member and each further one
    k = int(np.searchsorted(before, slack - spent, "right"))
    which = np.arange(at + 1, at + 1 + k)
    missed = spent + before[:k]
    after = np.searchsorted(total, total[which + 1] + (slack - missed), "right")  # one past the last place that a further common member may have
    kids = np.minimum(after - which - 1, len(keys) - 1 - which) + (after > len(keys))
    with np.errstate(over="ignore"):
        group = mixed(keys[which].view(np.uint64) + g * np.uint64(0x9E3779B97F4A7C15))
    out = [np.full(k, g.view(np.int64)), group.view(np.int64), np.full(k, num), np.full(k, c), np.full(k, n), which.astype(np.int32), missed, got + weights[which], total[-1] - total[which + 1], kids]
    if at >= 0 and spent + int(total[-1] - total[at + 1]) <= slack:  # nothing else in common
        with np.errstate(over="ignore"):
            end = mixed(np.array([g + np.uint64(0xD6E8FEB86659FD93)]))
        last = [[g.view(np.int64)], end.view(np.int64), [num], [c], [n], np.array([len(keys)], np.int32), [spent], [got], [0], [0]]
        out = [np.concatenate([a, b]) for a, b in zip(out, last)]
    return out


def _emitted(found: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(k.to_pandas_dtype()), k) for c, k in zip(zip(*found), _KINDS)], _NAMES)


def records(rows: DataFrame, percent: int) -> DataFrame:
    """The first groups of each set of ``incidence``. spent: weight missed so far; got: weight in common; rest: weight behind the last common member; kids: groups on division."""

    def run(batches):
        for batch in batches:
            found, size = [], 0
            for num, c, n, keys, weights in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), batch.column(4)):
                found.append(_children(np.uint64(0), num, c, n, keys.values.to_numpy(zero_copy_only=False), weights.values.to_numpy(zero_copy_only=False), -1, 0, 0, percent))
                size += len(found[-1][0])
                if size > 100_000:
                    yield _emitted(found)
                    found, size = [], 0
            if found:
                yield _emitted(found)

    return rows.mapInArrow(lean(run), RECORD)


def _divided(found: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            out, size = [], 0
            scalars = zip(*(batch.column(k).to_pylist() for k in range(7)))
            for (g, num, c, n, at, spent, got), keys, weights in zip(scalars, batch.column(7), batch.column(8)):
                out.append(_children(np.int64(g).view(np.uint64), num, c, n, keys.values.to_numpy(zero_copy_only=False), weights.values.to_numpy(zero_copy_only=False), at, spent, got, percent))
                size += len(out[-1][0])
                if size > 100_000:
                    yield _emitted(out)
                    out, size = [], 0
            if out:
                yield _emitted(out)

    return found.select("g", "num", "c", "n", "at", "spent", "got").join(rows.select("num", "keys", "weights"), "num").select("g", "num", "c", "n", "at", "spent", "got", "keys", "weights").mapInArrow(lean(run), RECORD)


def _groups(level: DataFrame, scratch: Scratch) -> DataFrame:
    """(of, g, cross, kids) of the groups of records that hold several components; cross: pairs of different ones."""
    by = level.groupBy("of", "g", "c").agg(F.count("*").cast("double").alias("k"), F.sum("kids").alias("kids"))
    sums = by.groupBy("of", "g").agg(F.sum("k").alias("size"), F.sum(F.col("k") * F.col("k")).alias("square"), F.sum("kids").alias("kids"))
    return scratch.stored(sums.filter("square < size * size").select("of", "g", ((F.col("size") * F.col("size") - F.col("square")) / 2).alias("cross"), "kids"), "overlap-groups")


def pairs(rows: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(u, v), u > v: every two sets of ``incidence`` of different components that are similar, and few others."""
    level, out = scratch.stored(records(rows, percent), "overlap-records"), None
    groups = _groups(level, scratch)
    for _ in range(MOST_LEVELS):
        large = groups.filter((F.col("kids") > 0) & (F.col("cross") > WORTH * F.col("kids"))).select("g", "cross")
        if not large.take(1):
            break
        parts = scratch.stored(_divided(level.join(large.select("g"), "g", "left_semi"), rows, percent), "overlap-records")
        within = _groups(parts, scratch)
        left = within.groupBy("of").agg(F.sum("cross").alias("left"))
        worth = large.join(left, F.col("g") == F.col("of"), "left").filter(WORTH * F.coalesce("left", F.lit(0.0)) < F.col("cross"))
        worth = scratch.stored(worth.select("g"), "overlap-divided")
        met = _met(level.join(groups.join(worth, "g", "left_anti").select("g"), "g", "left_semi"), percent)
        out = met if out is None else out.unionByName(met)
        groups = scratch.stored(within.join(worth.select(F.col("g").alias("of")), "of", "left_semi"), "overlap-groups")
        level = parts
    met = _met(level.join(groups.select("g"), "g", "left_semi"), percent)
    return (met if out is None else out.unionByName(met)).distinct()


def _met(level: DataFrame, percent: int) -> DataFrame:
    side = lambda s: level.select("g", *[F.col(x).alias(f"{x}_{s}") for x in ("num", "n", "c", "got", "rest")])
    sizes = (100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a"))
    room = (100 + percent) * (F.col("got_a") + F.least("rest_a", "rest_b")) >= percent * (F.col("n_a") + F.col("n_b"))
    met = side("a").join(side("b"), "g").filter((F.col("num_a") > F.col("num_b")) & (F.col("c_a") != F.col("c_b")) & sizes & room)
    return met.select(F.col("num_a").alias("u"), F.col("num_b").alias("v"))


def product(met: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of ``met`` that are similar: entries of the product of the incidence matrix with its transpose, a block of pairs at a time.

    The weights of the members that both rows of a block have are summed by pair; pairs whose sizes or sums are below the bound are dropped.
    """
    side = lambda s: rows.select(F.col("num").alias(s), *[F.col(x).alias(f"{x}_{s}") for x in ("n", "keys", "weights")])
    sizes = (100 * F.col("n_u") >= percent * F.col("n_v")) & (100 * F.col("n_v") >= percent * F.col("n_u"))
    both = met.join(side("u"), "u").join(side("v"), "v").filter(sizes)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            u, v = (_entries_of(batch.column(k), batch.column(k + 1)) for k in (4, 6))
            at, key, weight = (np.concatenate(x) for x in zip(u, v))
            order = np.lexsort((key, at))
            at, key, weight = at[order], key[order], weight[order]
            twice = np.flatnonzero((at[1:] == at[:-1]) & (key[1:] == key[:-1]))
            common = np.bincount(at[twice], weight[twice], batch.num_rows)
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            yield batch.select(["u", "v"]).filter(pa.array((100 + percent) * common >= percent * n))

    return both.select("u", "v", "n_u", "n_v", "keys_u", "weights_u", "keys_v", "weights_v").mapInArrow(lean(run), "u long, v long")


def _entries_of(keys: pa.Array, weights: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, weight) of the entries of a block's rows."""
    sizes = np.diff(keys.offsets.to_numpy())
    return np.repeat(np.arange(len(keys)), sizes), keys.flatten().to_numpy(), weights.flatten().to_numpy()
