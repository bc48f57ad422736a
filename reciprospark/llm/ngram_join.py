"""N-gram Jaccard join: a blocked sparse product of the document by n-gram matrix with its transpose, exact.

Rows of the matrix are the distinct sets of 4-word shingles (A-Z folded, words ``[^\\x20\\x09-\\x0D]+``; with fewer words the whole sequence is one);
documents with equal sets are one row. Sizes bound what two similar rows can miss, and every step keeps all that the bounds allow:

1. A part of the columns, chosen by their hash, decides which rows go on: one that misses more in these columns than its size allows has no partner.
2. Columns with one row go, and rows with too little left (``overlap.incidence``); columns that the same rows have become one with a weight.
3. Each row meets the hub of the groups of its first columns, a block of products at a time; components of these links are taken.
4. Rows of different components meet in groups of common first columns (``overlap.pairs``), the overlap counts of these pairs are accumulated
   (``overlap.product``), and components are taken of all links.

Pairs inside a component can't change the result, so they aren't formed. Defined cases: as in ``minhash``: null, empty and blank texts have an empty set and
link with nothing; rows that repeat an id are one document; rows with a null id don't link and get a null component; ids may be of any type
that has an order; an empty table gives an empty table; other columns don't take part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from . import minhash, overlap
from .components import components
from .names import free
from .storage import Scratch, small_batches, stored

SHINGLE = 4
#: Sets below the size are judged by that part of the columns in step 1; larger ones by the last. Falling, so that a set shows all columns by which a larger partner is judged.
PARTS = ((60, 1.0), (300, 0.4), (None, 0.2))


def _part(n: int) -> np.uint64:
    """Columns whose hash is at most this judge sets of ``n``."""
    return np.uint64(min(2**64 - 1, int(next(f for most, f in PARTS if most is None or n < most) * 2**64)))


def sketches(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, print, h, judged, shown, own) of every row: 64 bits of the print, the number of columns that judge the set, the columns that it shows, and how many of these (the first) judge it."""

    def run(batches):
        for batch in batches:
            for part in bw.text_slices(batch.column(1)):
                sets = minhash.shingle_sets(part, SHINGLE)
                prints = [minhash.print_of(s) for s in sets]
                shown = [s[: int(np.searchsorted(s, _part(len(s)), "right"))] for s in sets]
                judged = [int(np.searchsorted(s, _part(100 * len(s) // percent + 1), "right")) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(prints, pa.binary()),
                        pa.array([None if p is None else int.from_bytes(p[:8], "little", signed=True) for p in prints], pa.int64()),
                        pa.array(judged, pa.int32()),
                        pa.array([s.view(np.int64) for s in shown], pa.list_(pa.int64())),
                    ],
                    ["id", "n_shingles", "print", "h", "judged", "shown"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_shingles long, print binary, h long, judged int, shown array<long>")


def _shown(batches):
    """(token, h, own) of the shown columns, once for each set of a task as far as it can remember them."""
    seen: set[int] = set()
    for batch in batches:
        if len(seen) > 1_000_000:
            seen.clear()
        at = []
        for i, h in enumerate(batch.column(0).to_pylist()):
            if h not in seen:
                seen.add(h)
                at.append(i)
        own = batch.take(pa.array(at, pa.int64()))
        tokens = own.column(2)
        sizes = np.diff(tokens.offsets.to_numpy())
        first = np.arange(len(tokens.flatten())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        yield pa.RecordBatch.from_arrays([tokens.flatten(), pa.array(np.repeat(own.column(0).to_numpy(), sizes)), pa.array(first < np.repeat(own.column(1).to_numpy(), sizes))], ["token", "h", "own"])


def _shared(batches):
    """(h, n): how many of the columns that judge a set others show too. Rows come sorted by column and set."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t, h, own = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
        told = held is not None and held[3]
        if held is not None:
            t, h, own = np.append(held[0], t), np.append(held[1], h), np.append(held[2], own)
        new = np.append(True, (t[1:] != t[:-1]) | (h[1:] != h[:-1]))
        t, h, own = t[new], h[new], own[new]
        start = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        size = np.diff(np.append(start, len(t)))
        several = size > 1
        several[0] |= told
        shared = np.repeat(several, size)
        held = t[-1], h[-1], own[-1], bool(several[-1])
        shared &= own
        shared[0] &= not told
        found, n = np.unique(h[shared], return_counts=True)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["h", "n"])


def links_within(sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(u, v): links between ``sets`` (num, set) whose components are those of all links."""
    rows = overlap.incidence(sets.withColumn("c", F.col("num")), percent, scratch)
    buckets = overlap.records(rows, percent).select("num", F.col("g").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = scratch.stored(buckets.join(shared, "key"), "ngram-buckets")
    links, label = minhash.hub_links(buckets, lambda pairs: overlap.product(pairs, rows, percent), scratch)
    apart = sets.join(label.select(F.col("u").alias("num"), F.col("v").alias("c")), "num", "left").withColumn("c", F.coalesce("c", "num"))
    left = overlap.incidence(apart, percent, scratch)
    # overlaps are counted over all columns that several rows have, those inside a component too
    return links.unionByName(scratch.stored(overlap.product(scratch.stored(overlap.pairs(left, percent, scratch), "ngram-pairs"), rows, percent), "ngram-links"))


def join(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id (the least id reachable by links, its own included)."""
    small_batches(docs.sparkSession)
    scratch = Scratch()
    sketched = stored(sketches(docs, percent, id_col, text_col), "ngram-sketches")
    linkable = sketched.filter("print IS NOT NULL AND id IS NOT NULL")
    nodes = linkable.groupBy("print").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("h").alias("h"), F.first("judged").alias("judged"))
    nodes = scratch.stored(nodes.withColumn("num", F.monotonically_increasing_id()), "ngram-nodes")
    again = minhash.of_repeated_ids(linkable, nodes, scratch)
    shown = linkable.select("h", "judged", "shown").mapInArrow(_shown, "token long, h long, own boolean")
    shared = shown.repartition("token").sortWithinPartitions("token", "h").mapInArrow(_shared, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    missed = F.col("judged") - F.coalesce("n", F.lit(0))
    wanted = nodes.join(shared, "h", "left").filter(100 * missed <= (100 - percent) * F.col("n_shingles")).select("num", "print", "node")
    wanted = scratch.stored(wanted, "ngram-wanted")
    sets = scratch.stored(minhash.full_sets(docs, wanted, id_col, text_col, SHINGLE), "ngram-sets")
    found = minhash.classes(sketched, nodes, links_within(sets, percent, scratch).unionByName(again), scratch)
    names = [free(n, id_col) for n in ("n_shingles", "component_id")]
    return found.select(F.col("id").alias(id_col), F.col("n_shingles").alias(names[0]), F.col("component").alias(names[1]))
