"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network.

Tokens are runs of letters, runs of digits, and single other marks. A token's index vector is sparse and comes from its hash;
its word vector is the sum of the index vectors of its neighbours over the whole corpus, added up
exactly in integers by Spark. A document pools its tokens' vectors (mean, spread, product of
neighbours). A network with one hidden layer is fitted on a bounded sample of labelled rows, and a temperature
fitted on rows held back makes its outputs probabilities.

Defined cases: null and empty texts pool to zeros and score as such; texts of any length are pooled whole; labels that are null or absent leave
a row unlabelled; of several labels of one id the greatest counts; of rows that share a labelled id each is learnt from; without both classes every text
scores 0.5; repeated rows are scored each by itself; an empty table gives an empty table; other columns, whatever their names, don't take part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .names import free
from .storage import small_batches

#: Word vectors: hash buckets, dimensions, nonzero entries of an index vector, neighbours on either side.
BUCKETS = 1 << 14
DIMENSIONS = 32
NONZERO = 4
REACH = 2
HIDDEN = 24
EPOCHS = 60
#: At most so many labelled rows are fitted on, the first in the order of a hash of the id.
SAMPLE = 8000
HELD_BACK = 5

_CLASS = np.full(256, 3, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = 1
_CLASS[[*range(ord("0"), ord("9") + 1)]] = 2

_draw = np.random.default_rng(99)
_PLACES = np.stack([_draw.permutation(DIMENSIONS)[:NONZERO] for _ in range(BUCKETS)])
_SIGNS = _draw.choice(np.array([-1, 1]), (BUCKETS, NONZERO))


def tokens(part: bw.Slice) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every token of the slice, and each text's first token (one more number closes the list)."""
    kind = _CLASS[part.data]
    start = kind != 0
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 3)
    edge = part.starts[part.starts < part.ends]
    start[edge] = kind[edge] != 0
    first = np.flatnonzero(start)
    stop = np.flatnonzero(np.append(kind[1:] != kind[:-1], True) | (kind == 3)) + 1 if len(kind) else np.zeros(0, int)
    stop = np.union1d(stop, part.ends[part.starts < part.ends])
    ends = stop[np.searchsorted(stop, first, "right")] if len(first) else first
    return (bw.span_hashes(part.data, first, ends) >> np.uint64(50)).astype(np.int64), np.searchsorted(first, np.append(part.starts, len(part.data)))


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """BUCKETS x DIMENSIONS of unit length (or zero). Each task sends one row per bucket that it met; Spark sums them."""
    small_batches(docs.sparkSession)
    names = [f"v{d}" for d in range(DIMENSIONS)]

    def partial(batches):
        sums = np.zeros(BUCKETS * DIMENSIONS, np.int64)
        for batch in batches:
            for part in bw.text_slices(batch.column(0)):
                ids, bounds = tokens(part)
                owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                for step in range(1, REACH + 1):
                    same = owner[step:] == owner[:-step]
                    left, right = ids[:-step][same], ids[step:][same]
                    for word, near in ((left, right), (right, left)):
                        for k in range(NONZERO):
                            cell = word * DIMENSIONS + _PLACES[near, k]
                            up = _SIGNS[near, k] > 0
                            sums += np.bincount(cell[up], minlength=len(sums))
                            sums -= np.bincount(cell[~up], minlength=len(sums))
        table = sums.reshape(BUCKETS, DIMENSIONS)
        met = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(met), *[pa.array(table[met, d]) for d in range(DIMENSIONS)]], ["bucket", *names])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(partial, "bucket long, " + ", ".join(f"{n} long" for n in names))
    total = rows.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    table = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    table[total["bucket"].to_numpy()] = np.stack([total[n].to_numpy() for n in names], 1)
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)


def pooled(part: bw.Slice, vectors: np.ndarray) -> np.ndarray:
    """Texts x 3 * DIMENSIONS: mean, standard deviation and neighbour product of each text's word vectors."""
    ids, bounds = tokens(part)
    n = len(bounds) - 1
    out = np.zeros((n, 3 * DIMENSIONS), np.float32)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if not len(full):
        return out
    at, size = bounds[:-1][full], np.diff(bounds)[full][:, None]
    v = vectors[ids]
    mean = np.add.reduceat(v, at, axis=0) / size
    square = np.add.reduceat(v * v, at, axis=0) / size
    pair = np.zeros_like(v)
    pair[:-1] = v[:-1] * v[1:]
    pair[bounds[1:][full] - 1] = 0
    out[full] = np.concatenate([mean, np.sqrt(np.maximum(square - mean * mean, 0)), np.add.reduceat(pair, at, axis=0) / size], 1)
    return out


class Network:
    """A hidden tanh layer and a logistic output over standardised inputs; ``temperature`` divides the output."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.temperature, self.constant = 1.0, None
        if len(y) == 0 or len(set(y.tolist())) < 2:
            self.constant = 0.5
            return
        held = np.arange(len(y)) % HELD_BACK == 0
        if len(set(y[~held].tolist())) < 2:
            held[:] = False
        self.middle, self.scale = x[~held].mean(0), np.maximum(x[~held].std(0), 1e-4)
        self.w1 = rng.standard_normal((x.shape[1], HIDDEN)).astype(np.float32) / np.sqrt(x.shape[1])
        self.b1, self.w2, self.b2 = np.zeros(HIDDEN, np.float32), (rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN)).astype(np.float32), np.zeros(1, np.float32)
        parts = [self.w1, self.b1, self.w2, self.b2]
        m, s, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
        rows = np.flatnonzero(~held)
        for _ in range(EPOCHS):
            rng.shuffle(rows)
            for lo in range(0, len(rows), 64):
                pick = rows[lo : lo + 64]
                z = np.clip((x[pick] - self.middle) / self.scale, -8, 8)
                h = np.tanh(z @ self.w1 + self.b1)
                e = (1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -30, 30))) - y[pick]) / len(pick)
                back = np.outer(e, self.w2) * (1 - h * h)
                step += 1
                for p, g, a, b in zip(parts, (z.T @ back + 1e-4 * self.w1, back.sum(0), h.T @ e + 1e-4 * self.w2, e.sum(keepdims=True)), m, s):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= 0.003 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        if held.any() and len(set(y[held].tolist())) == 2:
            z = self.logits(x[held])
            tries = np.exp(np.linspace(-2, 3, 101))
            loss = [np.mean(np.logaddexp(0, np.where(y[held] == 1, -1, 1) * z / t)) for t in tries]
            self.temperature = float(tries[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.middle) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(np.float64) / self.temperature, -40, 40)))


def fitted(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, trains, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """The network from at most SAMPLE labelled rows; only their pooled vectors reach the driver."""
    y = F.col(label_col).cast("int")
    given = labels.filter(trains(F.col(id_col)) & y.isin(0, 1)).groupBy(F.col(id_col).alias("labelled_id")).agg(F.max(y).alias("label"))
    picked = given.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(SAMPLE)
    sample = docs.select(F.col(id_col).alias("labelled_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "labelled_id")

    def run(batches):
        for batch in batches:
            for part in bw.text_slices(batch.column(2)):
                x = pooled(part, vectors)
                own = batch.slice(part.first, len(x))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "label", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = sample.select("labelled_id", "label", "text").mapInArrow(run, f"id {kind}, label int, x binary").collect()
    rows.sort(key=lambda r: (r["id"], r["x"]))
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows]) if rows else np.zeros((0, 3 * DIMENSIONS), np.float32)
    return Network(x, np.array([r["label"] for r in rows], int))


def scores(docs: DataFrame, vectors: np.ndarray, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row, ``score`` the probability of label 1 (``score_`` beside an id column of that name)."""

    def run(batches):
        for batch in batches:
            found = [network.predict(pooled(part, vectors)) for part in bw.text_slices(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double").select(F.col("id").alias(id_col), F.col("score").alias(free("score", id_col)))
