"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly in numpy.

A word (a run of letters, digits and bytes beyond ASCII) is the bag of its byte n-grams (3 to 6 bytes, A-Z folded, with its borders). Each
n-gram has an embedding by hash; the word's mean embedding goes into a two-class softmax. Embeddings and softmax are fitted
together by Adagrad on the words of a bounded sample of labelled rows, each word weighted by the parts of the toxic and of the
clean texts that hold it, so an unseen spelling scores through the n-grams it shares. An n-gram of few texts counts less. For two classes
the fitted model is one number per n-gram hash and a bias.

A few words make a long text toxic, so a text isn't averaged as a whole: a logistic layer over its distinct words' log-odds (the three
greatest, and the sums above four heights) is fitted on rows that the words' fit has not seen, each third of the sample in turn, weighted to the labels' true shares, and makes
the scores probabilities; the model is the mean of the three fits.

Defined cases: null and empty texts have no word and score the model's prior; labels that are null or
absent leave a row unlabelled; of several labels of one id the greatest counts; of rows that share a labelled id each is learnt from; without both classes every text scores 0;
repeated rows are scored each by itself, and a word counts once in a text of any length; an empty table gives an empty table; other columns, whatever their names, don't take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .chunks import places_of
from .names import free
from .storage import small_batches, stored
from .workers import lean, release

SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 17
DIMENSIONS = 8
EPOCHS = 4
#: Words of a step.
BATCH = 2048
#: Words whose n-grams are summed at once, for memory.
WORDS_AT_ONCE = 1 << 16
#: An n-gram of c texts of the sample counts c / (c + RARE).
RARE = 1.0
RATE = 0.3
#: At most so many labelled rows of each class are fitted on, the first in the order of a hash of the id.
SAMPLE_PER_CLASS = 2000
#: The words are fitted without each of so many parts of the sample in turn; the logistic layer learns from what each fit makes of the part it hasn't seen.
FOLDS = 3
#: Parts of the clean texts' words that lie below the heights, and below the floor: lower words count as the floor.
HEIGHTS = (0.99, 0.997, 0.999, 0.9997)
FLOOR = 0.95
SMOOTHING = 1e-3

_SPICE = np.random.default_rng(7).integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = False


@dataclass
class Model:
    """``numbers``: the log-odds that each n-gram hash has; ``layer``: middle, scale and weight of each feature and the shift. Without a layer all scores are 0."""

    numbers: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    bias: float = 0.0
    heights: np.ndarray = field(default_factory=lambda: np.zeros(len(HEIGHTS) + 1))
    layer: np.ndarray | None = None

    def packed(self) -> bytes:
        return np.concatenate([[self.bias], self.heights, self.layer.ravel(), self.numbers]).astype(np.float64).tobytes() if self.layer is not None else b""

    @staticmethod
    def unpacked(raw: bytes) -> "Model":
        if not raw:
            return Model()
        x, n = np.frombuffer(raw, np.float64), len(HEIGHTS) + 1
        return Model(x[-BUCKETS:].astype(np.float32), float(x[0]), x[1 : 1 + n], x[1 + n : -BUCKETS].reshape(3, -1))


def ngram_hashes(part: bw.Slice, sizes: tuple[int, ...] = SIZES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: the hash bucket of the n-gram at each byte, and whether one stands there.

    An n-gram lies in one text and has bytes between words at its first or last byte only; these hash alike.
    """
    n = len(part.data)
    space = _BETWEEN[part.data]
    codes = bw._BYTE_CODE[np.where(space, np.uint8(32), bw.folded(part.data))]
    spaces = np.zeros(n + 1, np.int32)
    np.cumsum(space, out=spaces[1:])
    text_end = np.repeat(part.ends, part.ends - part.starts)
    at = np.arange(n)
    h = np.zeros(n, np.uint64)
    done = 0
    for size in sizes:
        for k in range(done, min(size, n)):
            h[: n - k] += codes[k:] * _SPICE[k]
        done = size
        if size > n:
            yield np.zeros(n, np.int64), np.zeros(n, bool)
            continue
        ok = at + size <= text_end
        ok[: n - size + 1] &= spaces[size - 1 : n] == spaces[1 : n - size + 2]
        ok[n - size + 1 :] = False
        yield ((h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 17)).astype(np.int64), ok


def words_of(part: bw.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each word, the number of its text, and the word that each byte's n-grams count for: bytes between words go with the next one of the text."""
    first, ends, bounds = bw.word_spans(part, _BETWEEN)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    starts = np.zeros(len(part.data) + 1, np.int64)
    starts[ends] = 1
    word = np.cumsum(starts)[:-1]
    of_text = np.repeat(np.arange(len(bounds) - 1), part.ends - part.starts)
    word = np.clip(word, bounds[of_text], np.maximum(bounds[of_text + 1] - 1, bounds[of_text]))
    return bw.span_hashes(bw.folded(part.data), first, ends), text, np.minimum(word, max(0, len(first) - 1))


def bags(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(per text its distinct words, n-gram buckets of all words one after another, number of n-grams of each word)."""
    own, known = [], np.zeros(0, np.uint64)
    flat, size = [], []
    for part in bw.text_slices(pa.array(texts, pa.string())):
        name, text, word = words_of(part)
        unique, at, which = np.unique(name, return_index=True, return_inverse=True)
        new = ~np.isin(unique, known)
        known = np.concatenate([known, unique[new]])
        rank = np.full(len(name) + 1, -1)
        rank[at[new]] = np.arange(new.sum())
        found = [(rank[word[ok]], h[ok]) for h, ok in ngram_hashes(part)] if len(name) else []
        owner = np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)])
        bucket = np.concatenate([f[1] for f in found] or [np.zeros(0, np.int64)])
        order = np.argsort(owner, kind="stable")[(owner < 0).sum() :]
        flat.append(bucket[order].astype(np.int32))
        size.append(np.bincount(owner[order], minlength=int(new.sum())))
        # a text lies in one slice: the distinct words of its texts are found here, and no list of all words stays
        order = np.argsort(known)
        place = order[np.searchsorted(known, unique, sorter=order)][which] if len(unique) else np.zeros(0, np.int64)
        pairs = np.unique(text * max(1, len(known)) + place)
        cuts = np.searchsorted(pairs, np.arange(1, len(part.starts)) * max(1, len(known)))
        own += [p % max(1, len(known)) for p in np.split(pairs, cuts)]
    return own, np.concatenate(flat or [np.zeros(0, np.int32)]), np.concatenate(size or [np.zeros(0, np.int64)])


def descend(flat: np.ndarray, size: np.ndarray, shares: np.ndarray, part_of: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Adagrad on the cross-entropy of words weighted by ``shares`` (words x 2); gives the numbers of the n-grams and the bias. ``part_of``: how much each n-gram counts."""
    table = (rng.standard_normal((BUCKETS, DIMENSIONS)) * 0.01).astype(np.float32)
    soft, bias = (rng.standard_normal((DIMENSIONS, 2)) * 0.5).astype(np.float32), np.zeros(2, np.float32)
    grown_t, grown_s, grown_b = (np.full(x.shape, 1e-10, np.float32) for x in (table, soft, bias))
    at = np.cumsum(size) - size
    rows = np.flatnonzero((shares.sum(1) > 0) & (size > 0))
    for _ in range(EPOCHS):
        rng.shuffle(rows)
        for lo in range(0, len(rows), BATCH):
            pick = rows[lo : lo + BATCH]
            n = size[pick]
            ids, bag = flat[places_of(at[pick], n)], np.repeat(np.arange(len(pick)), n)
            w = (part_of[ids] / n[bag]).astype(np.float32)
            used, place = np.unique(ids, return_inverse=True)
            part = table[used]
            mean = np.stack([np.bincount(bag, part[place, d] * w, len(pick)) for d in range(DIMENSIONS)], 1).astype(np.float32)
            z = mean @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p * shares[pick].sum(1, keepdims=True) - shares[pick]).astype(np.float32) * np.float32(len(rows) / 2 / len(pick))
            back = g @ soft.T
            grad = np.stack([np.bincount(place, back[bag, d] * w, len(used)) for d in range(DIMENSIONS)], 1).astype(np.float32)
            grown_t[used] += grad * grad
            table[used] = part - RATE * grad / np.sqrt(grown_t[used])
            gs, gb = mean.T @ g, g.sum(0)
            grown_s += gs * gs
            grown_b += gb * gb
            soft -= 0.1 * gs / np.sqrt(grown_s)
            bias -= 0.1 * gb / np.sqrt(grown_b)
    return (table @ (soft[:, 1] - soft[:, 0]) * part_of).astype(np.float32), float(bias[1] - bias[0])


def features(z: np.ndarray, name: np.ndarray, text: np.ndarray, n_texts: int, heights: np.ndarray) -> np.ndarray:
    """Texts x features from all words' log-odds ``z``, their hashes and texts: sums of the distinct words above the heights, the three greatest."""
    high = np.flatnonzero(z > heights[0])
    high = high[np.lexsort((name[high], -z[high], text[high]))]
    if len(high):  # equal words have equal log-odds, so copies stand side by side
        high = high[np.append(True, (np.diff(text[high]) > 0) | (np.diff(name[high]) != 0))]
    own, value = text[high], z[high]
    sums = [np.log1p(np.bincount(own, np.maximum(value - h, 0), n_texts)) for h in heights[1:]]
    top = np.full((n_texts, 3), heights[0])
    rank = np.arange(len(own)) - np.searchsorted(own, own)
    top[own[rank < 3], rank[rank < 3]] = value[rank < 3]
    return np.concatenate([np.stack(sums, 1), top], 1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A weighted logistic fit by Newton steps on standardised features: middles, scales, and weights, with the shift in a last column."""
    middle, scale = np.append(x.mean(0), 0.0), np.append(x.std(0) + 1e-6, 1.0)
    own = (np.concatenate([x, np.ones((len(x), 1))], 1) - middle) / scale
    w, b = weight / weight.sum(), np.zeros(own.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(own @ b, -30, 30)))
        grad = own.T @ (w * (p - y)) + SMOOTHING * np.append(b[:-1], 0.0)
        hess = (own * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ own + SMOOTHING * np.eye(len(b))
        step = np.linalg.solve(hess, grad)
        b = b - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return np.stack([middle, scale, b])


def fit(texts: list[str | None], labels: np.ndarray, weight_of_1: float, weight_of_0: float, seed: int = 11) -> Model:
    """The model of a sample. ``weight_of_1`` and ``weight_of_0``: rows of the whole labelled table that one row of the sample stands for."""
    if not (labels == 1).any() or not (labels == 0).any():
        return Model()
    own, flat, size = bags(texts)
    release()
    if not len(flat):
        return Model()
    at, fold = np.cumsum(size) - size, np.arange(len(labels)) % FOLDS
    if any(len(set(labels[(fold == f) == side])) < 2 for f in range(FOLDS) for side in (False, True)):
        fold[:] = 0  # too few rows to hold any back
    in_fold = np.zeros((FOLDS, BUCKETS))  # texts that hold each n-gram
    for o, f in zip(own, fold):
        in_fold[f, np.unique(flat[places_of(at[o], size[o])])] += 1
    x, parts = np.zeros((len(labels), len(HEIGHTS) + 3)), []
    for f in range(fold.max() + 1):
        learns = fold != f if fold.any() else fold == f
        counts, in_texts = np.zeros((len(size), 2)), in_fold[np.unique(fold[learns])].sum(0)
        for i in np.flatnonzero(learns):
            counts[own[i], labels[i]] += 1
        numbers, bias = descend(flat, size, counts / np.maximum(counts.sum(0), 1), in_texts / (in_texts + RARE), np.random.default_rng(seed + f))
        z = np.zeros(len(size))
        for lo in range(0, len(size), WORDS_AT_ONCE):
            n = size[lo : lo + WORDS_AT_ONCE]
            z[lo : lo + WORDS_AT_ONCE] = np.bincount(np.repeat(np.arange(len(n)), n), numbers[flat[at[lo] : at[lo] + n.sum()]], len(n)) / np.maximum(n, 1) + bias
        clean = np.repeat(z, counts[:, 0].astype(int))
        heights = np.quantile(clean if len(clean) else z, [FLOOR, *HEIGHTS])
        back = np.flatnonzero(fold == f)
        mine = [own[i] for i in back]
        x[back] = features(np.concatenate([z[o] for o in mine]), np.concatenate(mine), np.repeat(np.arange(len(mine)), [len(o) for o in mine]), len(mine), heights)
        parts.append((numbers, bias, heights))
    numbers, bias, heights = (np.mean([p[k] for p in parts], 0) for k in range(3))
    return Model(numbers.astype(np.float32), float(bias), heights, logistic(x, labels, np.where(labels == 1, weight_of_1, weight_of_0)))


def fitted(docs: DataFrame, labels: DataFrame, trains, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model from labelled rows of ``docs``. ``trains(id column)`` tells which labels may be learnt from.

    The sample of at most 2 * SAMPLE_PER_CLASS ids is fitted in one task, which Spark runs again if it is lost.
    """
    small_batches(docs.sparkSession)
    y = F.col(label_col).cast("int")
    given = labels.filter(trains(F.col(id_col)) & y.isin(0, 1)).groupBy(F.col(id_col).alias("labelled_id")).agg(F.max(y).alias("label"))
    given = stored(given.join(docs.select(F.col(id_col).alias("labelled_id")), "labelled_id", "left_semi"), "toxic-labels")
    counts = {r["label"]: r["count"] for r in given.groupBy("label").count().collect()}
    order = F.xxhash64("labelled_id")
    parts = [given.filter(F.col("label") == c).orderBy(order, "labelled_id").limit(SAMPLE_PER_CLASS) for c in (0, 1)]
    # only the sample's texts move: its ids are few, and go to where the texts are read
    sample = docs.select(F.col(id_col).alias("labelled_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(parts[0].unionByName(parts[1])), "labelled_id")
    weights = [counts.get(c, 0) / max(1, min(counts.get(c, 0), SAMPLE_PER_CLASS)) for c in (0, 1)]

    def train(batches):
        rows = [r for b in batches for r in zip(b["labelled_id"].to_pylist(), b["text"].to_pylist(), b["label"].to_pylist())]
        rows.sort(key=lambda r: (r[0], r[1] or ""))
        model = fit([r[1] for r in rows], np.array([r[2] for r in rows], int), weights[1], weights[0])
        yield pa.RecordBatch.from_arrays([pa.array([model.packed()], pa.binary())], ["model"])

    got = sample.select("labelled_id", "text", "label").repartition(1).mapInArrow(lean(train), "model binary").collect()
    return Model.unpacked(bytes(got[0]["model"])) if got else Model()


def judged(part: bw.Slice, model: Model) -> np.ndarray:
    """The probability of label 1 of each text of the slice."""
    n_texts = len(part.starts)
    if model.layer is None:
        return np.zeros(n_texts)
    name, text, word = words_of(part)
    total, count = np.zeros(len(name)), np.zeros(len(name))
    for h, ok in ngram_hashes(part) if len(name) else ():
        own = word[ok]
        total += np.bincount(own, model.numbers[h[ok]], len(name))
        count += np.bincount(own, minlength=len(name))
    x = features(total / np.maximum(count, 1) + model.bias, name, text, n_texts, model.heights)
    middle, scale, weight = model.layer
    z = (np.concatenate([x, np.ones((n_texts, 1))], 1) - middle) / scale @ weight
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row, ``score`` the probability of label 1 (``score_`` beside an id column of that name)."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in bw.text_slices(batch.column(1)):
                found = judged(part, model)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(found)), pa.array(found, pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), f"id {kind}, score double")
    return rows.select(F.col("id").alias(id_col), F.col("score").alias(free("score", id_col)))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their own columns; judged where they are read."""
    small_batches(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for part in bw.text_slices(batch.column(place)):
                found = judged(part, model)
                keep[part.first : part.first + len(found)] = found < threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(lean(run), docs.schema)
