"""MinHash near-duplicates: universal hash minima, banding, signature verification, components.

A text's set holds the hashes of its 5-word shingles (A-Z folded, words ``[^\\x20\\x09-\\x0D]+``); with fewer words the whole
sequence is one. Texts with equal sets are one node from the start. Each set has 126 minima of universal
hashes in bands whose length follows the asked similarity (``layout``: 21 bands of 6 at 85 percent, 25 of 5 at 80); texts
that share a band are candidates. A candidate is dropped if its signatures agree in far too few places, and linked if
the full sets do: 100 * intersection >= percent * union.

Not all pairs of a bucket are formed. First every text meets the hub of its fullest bucket and components are taken, then it meets the hubs of its other buckets. Texts of buckets that still hold several components are open. Two open texts are only compared if the
first shingles that they have in common, rare ones first, leave room for enough more (``overlap.pairs``): a condition that every link
meets, and that texts which have only a common template between them don't. So no link is lost whatever the size of a bucket;
pairs inside a component can't change the result.

Defined cases: null, empty and blank texts have an empty set and are linked with nothing; rows that repeat an id are
one document, linked with whatever any of their texts is linked with; rows with a null id are left out of linking and get a null
component; ids may be of any type that has an order; an empty table gives an empty table; other columns don't take part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from . import overlap
from .components import components
from .names import free
from .storage import Scratch, small_batches, stored
from .workers import lean

SHINGLE = 5
MINIMA = 126
#: At most this part of the pairs of exactly the asked similarity share no band.
MISSED = 5e-5
#: Pairs whose signatures agree in a smaller part than the asked similarity less this (six standard deviations) are dropped.
SLACK = 0.20

_draw = np.random.default_rng(20210607)
_A = _draw.integers(1, 2**63, (MINIMA, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _draw.integers(0, 2**63, (MINIMA, 1), dtype=np.uint64)


def layout(percent: int) -> tuple[int, int]:
    """(bands, rows): the longest bands of the minima that miss no more than ``MISSED`` of the pairs at the asked similarity."""
    rows = 1
    while (1 - (percent / 100) ** (rows + 1)) ** (MINIMA // (rows + 1)) <= MISSED:
        rows += 1
    return MINIMA // rows, rows


def shingle_sets(part: bw.Slice, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of the slice."""
    starts, ends, bounds = bw.word_spans(part)
    words = bw.span_hashes(bw.folded(part.data), starts, ends)
    n = len(words)
    rolled = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        if len(rolled):
            rolled = bw.mixed(rolled * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(rolled)])
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo >= size:
            out.append(np.unique(rolled[lo : hi - size + 1]))
        elif hi > lo:
            h = np.array([hi - lo], np.uint64)
            for w in words[lo:hi]:
                h = bw.mixed(h * np.uint64(0xA0761D6478BD642F) + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minima of multiply-and-shift hashes of a set, as unsigned 32-bit integers."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[None, lo : lo + 2048] * _A + _B).min(1))
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(signs: np.ndarray, percent: int) -> np.ndarray:
    """The keys of the bands of signatures (one a row)."""
    bands, n_rows = layout(percent)
    rows = signs[:, : bands * n_rows].reshape(len(signs), bands, n_rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), rows.shape[:2]).copy()
    for r in range(n_rows):
        h = bw.mixed(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, r])
    return h.view(np.int64)


def print_of(hashes: np.ndarray) -> bytes | None:
    """128 bits that name a set; null for the empty one."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def sketches(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, print of the set, signature, keys of its bands) of every row."""

    def run(batches):
        for batch in batches:
            for part in bw.text_slices(batch.column(1)):
                sets = shingle_sets(part)
                signs = [signature(s) if len(s) else None for s in sets]
                full = [k for k, s in enumerate(signs) if s is not None]
                keys: list = [None] * len(sets)
                if full:
                    for k, row in zip(full, band_keys(np.stack([signs[k] for k in full]), percent)):
                        keys[k] = row
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([print_of(s) for s in sets], pa.binary()),
                        pa.array([None if s is None else s.view(np.int32) for s in signs], pa.list_(pa.int32())),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    ["id", "n_shingles", "print", "sign", "bands"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), f"id {kind}, n_shingles long, print binary, sign array<int>, bands array<long>")


def _few(rows: DataFrame, id_col: str, most: int) -> bool:
    """Whether ids, of a type of at most 8 bytes, are no more than ``most``. Others are left to Spark, which goes by the size of the stored table."""
    return rows.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") and rows.count() <= most


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int = SHINGLE) -> DataFrame:
    """(num, set array<long>) of the nodes ``wanted`` (num, print, node). A node's text is read from a row of the id ``node``."""

    def run(batches):
        for batch in batches:
            for part in bw.text_slices(batch.column(0)):
                sets = shingle_sets(part, size)
                yield pa.RecordBatch.from_arrays([pa.array([print_of(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["print", "set"])

    ids = wanted.select(F.col("node").alias("id")).distinct()
    if _few(wanted, "node", 500_000):  # 32 bytes each
        ids, wanted = F.broadcast(ids), F.broadcast(wanted)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(ids, "id", "left_semi").select("text")
    return rows.mapInArrow(lean(run), "print binary, set array<long>").join(wanted.select("num", "print"), "print").select("num", "set").dropDuplicates(["num"])


def _links(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that are links: signatures first, then full sets. A set meets a pair once on either side."""
    side = lambda s: nodes.select(F.col("num").alias(s), F.col("sign").alias(f"sign_{s}"), F.col("n_shingles").alias(f"n_{s}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    agree = F.size(F.filter(F.zip_with("sign_u", "sign_v", lambda a, b: a == b), lambda x: x))
    near = both.filter((100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")) & (agree >= int((percent / 100 - SLACK) * MINIMA))).select("u", "v")
    full = near.join(sets.select(F.col("num").alias("u"), F.col("set").alias("set_u")), "u").join(sets.select(F.col("num").alias("v"), F.col("set").alias("set_v")), "v")
    common = F.size(F.array_intersect("set_u", "set_v"))
    return full.filter(100 * common >= percent * (F.size("set_u") + F.size("set_v") - common)).select("u", "v")


def hub_links(buckets: DataFrame, verified, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(links, components of the first of them) between texts and the hubs of their ``buckets`` (num, key, size); ``verified`` keeps the pairs (u, v) that are links.

    The hub of a bucket is the text that stands with most others over all its buckets.
    """
    weight = buckets.groupBy("num").agg(F.sum("size").alias("weight"))
    weighed = scratch.stored(buckets.join(weight, "num"), "hubs-weighed")
    hubs = weighed.groupBy("key").agg(F.min_by("num", F.struct(-F.col("weight"), F.col("num"))).alias("hub"))
    met = weighed.join(hubs, "key").filter("num <> hub").select("num", "hub", "size").groupBy("num", "hub").agg(F.count("*").alias("common"), F.max("size").alias("size"))
    met = scratch.stored(met, "hubs-met")
    pair = F.greatest("num", "hub").alias("u"), F.least("num", "hub").alias("v")
    best = met.groupBy("num").agg(F.max_by("hub", F.struct("common", "size", -F.col("hub"))).alias("hub")).select(*pair).distinct()
    links = scratch.stored(verified(best), "hubs-links")
    label = components(links)
    # every other hub of a text, where it isn't in the text's component by now
    other = _apart(met.select(*pair).distinct().join(best, ["u", "v"], "left_anti"), label)
    return links.unionByName(scratch.stored(verified(other), "hubs-links")), label


def _judged(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, component, kept) of every row."""
    small_batches(docs.sparkSession)
    scratch = Scratch()
    sketched = stored(sketches(docs, percent, id_col, text_col), "minhash-sketches")
    linkable = sketched.filter("print IS NOT NULL AND id IS NOT NULL")
    # equal sets are one node, with a number of its own
    grouped = linkable.groupBy("print").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sign").alias("sign"), F.first("bands").alias("bands"))
    nodes = scratch.stored(grouped.withColumn("num", F.monotonically_increasing_id()), "minhash-nodes")
    again = of_repeated_ids(linkable, nodes, scratch)

    rows = nodes.select("num", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = scratch.stored(rows.join(shared, "key"), "minhash-buckets")
    if not buckets.take(1):
        return classes(sketched, nodes, again, scratch)
    wanted = buckets.select("num").distinct()
    small = scratch.stored(nodes.join(wanted, "num", "left_semi").select("num", "print", "node", "n_shingles", "sign"), "minhash-wanted")
    sets = scratch.stored(full_sets(docs, small.select("num", "print", "node"), id_col, text_col), "minhash-sets")
    links, label = hub_links(buckets, lambda pairs: _links(pairs, small, sets, percent), scratch)

    # what is left: texts of buckets that hold several components
    in_bucket = buckets.select("key", "num").join(label.select(F.col("u").alias("num"), F.col("v").alias("c")), "num", "left").select("key", "num", F.coalesce("c", "num").alias("c"))
    in_bucket = scratch.stored(in_bucket, "minhash-open")
    mixed = in_bucket.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most")).filter("least <> most").select("key")
    open_ = in_bucket.join(mixed, "key", "left_semi").select("num", "c").distinct()
    open_ = scratch.stored(sets.join(open_, "num"), "minhash-open")
    pairs = overlap.pairs(overlap.incidence(open_, percent, scratch), percent, scratch)
    links = links.unionByName(scratch.stored(_links(scratch.stored(pairs, "minhash-pairs"), small, sets, percent), "minhash-links"))
    return classes(sketched, nodes, links.unionByName(again), scratch)


def of_repeated_ids(linkable: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (u, v) between the nodes of each id that has several texts."""
    repeated = linkable.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    repeated = scratch.stored(repeated, "minhash-repeated")
    if not repeated.take(1):
        return nodes.sparkSession.createDataFrame([], "u long, v long")
    own = linkable.select("id", "print").join(repeated, "id", "left_semi").distinct().join(nodes.select("print", "num"), "print")
    least = own.groupBy("id").agg(F.min("num").alias("v"))
    return scratch.stored(own.join(least, "id").filter("num <> v").select(F.col("num").alias("u"), "v").distinct(), "minhash-same")


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs (u, v) whose ends lie in different components."""
    cu, cv = label.select("u", F.col("v").alias("cu")), label.select(F.col("u").alias("v"), F.col("v").alias("cv"))
    joined = pairs.join(cu, "u", "left").join(cv, "v", "left")
    return joined.filter(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v")


def classes(sketched: DataFrame, nodes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, n_shingles, component, kept) of every row of ``sketched``; clears ``scratch``."""
    label = components(links)
    # (num, root) of the nodes that are linked, roots with themselves; a component's least id is the least of its nodes'
    linked = label.select(F.col("u").alias("num"), F.col("v").alias("root")).unionByName(label.select(F.col("v").alias("num"), F.col("v").alias("root")).distinct())
    linked = scratch.stored(linked.join(nodes.select("num", "print", "node"), "num"), "minhash-linked")
    least = linked.groupBy("root").agg(F.min("node").alias("least"))
    by_link = linked.join(least, "root").select("print", "least")
    copied = nodes.filter("copies > 1").select("print", F.col("node").alias("least")).join(by_link.select("print"), "print", "left_anti")
    by_print = stored(by_link.unionByName(copied), "minhash-classes")
    scratch.clear()
    full = sketched.filter("print IS NOT NULL").select("id", "n_shingles", "print").join(by_print, "print", "left").select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).alias("component"))
    empty = sketched.filter("print IS NULL").select("id", "n_shingles", F.col("id").alias("component"))
    return full.unionByName(empty).withColumn("kept", F.col("id").isNull() | (F.col("component") == F.col("id")))


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id (the least id reachable, its own included) and kept (it is that id). A name that the id has gets an underscore."""
    names = [free(n, id_col) for n in ("n_shingles", "component_id", "kept")]
    return _judged(docs, percent, id_col, text_col).select(*[F.col(c).alias(n) for c, n in zip(("id", "n_shingles", "component", "kept"), (id_col, *names))])


def drop_copies(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one of each group, with their own columns.

    Of rows that repeat an id one stays, that with the least text. Rows with a null id or an empty text and an id of their own stay.
    """
    found = stored(_judged(docs, percent, id_col, text_col).select("id", "kept"), "minhash-kept")
    own, other = F.col(f"`{id_col}`"), free("other_id", *docs.columns)
    gone = stored(found.filter(~F.col("kept")).select(F.col("id").alias(other)).distinct(), "minhash-gone")
    if _few(gone, other, 2_000_000):  # 16 MB
        gone = F.broadcast(gone)
    kept = docs.join(gone, own == F.col(other), "left_anti")
    repeated = stored(found.filter(F.col("id").isNotNull()).groupBy(F.col("id").alias(other)).agg(F.count("*").alias("n")).filter("n > 1").select(other), "minhash-repeated")
    if not repeated.take(1):
        return kept
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = kept.join(repeated, own == F.col(other), "left_semi").groupBy(own.alias("key")).agg(F.min_by(whole, F.struct(F.col(f"`{text_col}`"), F.to_json(whole))).alias("row"))
    return kept.join(repeated, own == F.col(other), "left_anti").unionByName(once.select("row.*"))
