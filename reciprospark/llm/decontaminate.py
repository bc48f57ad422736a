"""Benchmark decontamination: a BM25 inverted index of test items, queried by every training passage.

Test items (question and answer) go into an index of BM25 impacts, each divided by its item's score against itself, so that
one threshold fits all. Training texts are cut into half-overlapping passages long enough that any item lies whole in one. A passage's
distinct indexed terms are its query. Passages whose term-wise upper bounds, then block-wise upper bounds, stay below the
threshold are passed over in bulk; for the others block-max WAND retrieves every item at or above the threshold.
A retrieved item is a leak if the text around the passage holds enough of the 5-word shingles of the question and of the answer.

The index holds only what the items' words need and is built from at most ``ITEMS_AT_ONCE`` items and ``WORDS_AT_ONCE`` words
at a time (a bound on what is sent to the executors; an item of more words is alone in its index); more items take more
passes over the texts, each written before the next. Document frequencies, mean length and passage length are those of all
items, so results don't depend on the number of passes.

Defined cases: null and empty texts have no passage; items that are null or have no word are left out; with a null or empty
answer the question alone counts, and the reverse; a part of fewer than five words counts as one shingle; repeated texts are judged each by itself; empty tables on either
side give no leaks; other columns don't take part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .names import free
from .storage import dropped, small_batches, stored
from .workers import lean

K1, B = 1.2, 0.75
#: Part of an item's own BM25 score from which it is retrieved.
THRESHOLD = 0.6
#: Parts of the shingles of question and answer that make a leak.
QUESTION_OVERLAP, ANSWER_OVERLAP = 0.8, 0.5
SHINGLE = 5
#: Words of half a passage; longer where an item is longer.
STRIDE = 64
#: Items of a block of the index.
BLOCK = 8
ITEMS_AT_ONCE = 20_000
#: At most some 60 bytes of index each.
WORDS_AT_ONCE = 1_000_000
#: Bytes of items that the driver asks for at once.
FETCHED = 16_000_000

_WORD = np.zeros(256, bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def question_and_answer(text: str | None) -> tuple[str, str]:
    """An item without a separate answer: its last sentence counts as the answer, or the last quarter of a single sentence."""
    parts = _SENTENCE.split((text or "").strip())
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = parts[0].split()
    cut = len(words) - max(1, len(words) // 4) if len(words) > 1 else len(words)
    return " ".join(words[:cut]), " ".join(words[cut:])


def words_of(part: bw.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (letters, digits and all beyond ASCII; A-Z folded) and each text's first (one more number closes the list)."""
    inside = _WORD[part.data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = part.starts < part.ends
    first[part.starts[full]] = inside[part.starts[full]]
    last[part.ends[full] - 1] = inside[part.ends[full] - 1]
    starts = np.flatnonzero(first)
    return bw.span_hashes(bw.folded(part.data), starts, np.flatnonzero(last) + 1), np.searchsorted(starts, np.append(part.starts, len(part.data)))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    h = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        if len(h):
            h = bw.mixed(h * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(h)])
    return h


def _runs(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The whole numbers from each ``lo`` to below its ``hi``, one run after another."""
    n = hi - lo
    return np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())


@dataclass
class Statistics:
    """Of all items that have words: their number, mean and greatest number of words; ``df(terms)`` gives the numbers of items that hold the sorted terms."""

    n: int
    mean: float
    longest: int
    df: Callable[[np.ndarray], np.ndarray]


def hashed(question: str | None, answer: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of an item's two parts."""
    q, a = (words_of(next(bw.text_slices(pa.array([x or ""], pa.string()))))[0] for x in (question, answer))
    return q, a


@dataclass
class Index:
    """Impacts by term: items ``item[at[t]:at[t + 1]]`` with ``impact``; greatest impacts ``top`` by term.

    Blocks that hold term t: ``block[block_at[t]:block_at[t + 1]]``, each with its greatest impact ``block_top``; the postings of
    such an entry e are those from ``entry_at[e]`` to ``entry_at[e + 1]``.
    """

    item_ids: list
    parts: list[tuple[np.ndarray, np.ndarray]]
    stride: int
    terms: np.ndarray
    at: np.ndarray
    item: np.ndarray
    impact: np.ndarray
    top: np.ndarray
    block_at: np.ndarray
    block: np.ndarray
    block_top: np.ndarray
    entry_at: np.ndarray

    @staticmethod
    def of(items: list[tuple]) -> "Index | None":
        """From (item id, question, answer) rows, which are all there are."""
        rows = [(item_id, parts) for item_id, question, answer in items for parts in [hashed(question, answer)] if len(parts[0]) + len(parts[1])]
        return Index.of_words([r[0] for r in rows], [r[1] for r in rows]) if rows else None

    @staticmethod
    def of_words(ids: list, parts: list[tuple[np.ndarray, np.ndarray]], statistics: Statistics | None = None) -> "Index":
        """From the word hashes of items; without ``statistics`` these are all items."""
        bags = [np.unique(np.concatenate(p), return_counts=True) for p in parts]
        terms, df = np.unique(np.concatenate([b[0] for b in bags]), return_counts=True)
        sizes = np.array([b[1].sum() for b in bags])
        n, mean, longest = len(ids), sizes.mean(), int(sizes.max())
        if statistics is not None:
            n, mean, longest, df = statistics.n, statistics.mean, statistics.longest, statistics.df(terms)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        rows = []
        for k, (t, tf) in enumerate(bags):
            place = np.searchsorted(terms, t)
            score = idf[place] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[k] / mean))
            rows.append((place, np.full(len(t), k, np.int32), score / score.sum()))
        place, item, impact = (np.concatenate(c) for c in zip(*rows))
        order = np.lexsort((item, place))
        place, item, impact = place[order], item[order], impact[order]
        block = item // BLOCK
        first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (block[1:] != block[:-1])))
        block_top = np.maximum.reduceat(np.nextafter(impact.astype(np.float32), np.float32(2)), first)
        block_at = np.searchsorted(place[first], np.arange(len(terms) + 1))
        top = np.maximum.reduceat(block_top, block_at[:-1])
        return Index(ids, parts, max(STRIDE, longest), terms, np.searchsorted(place, np.arange(len(terms) + 1)), item, impact, top, block_at, block[first], block_top, np.append(first, len(item)))

    def wand(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """Every (item, score) at or above the threshold for a set of terms, by block-max WAND.

        Blocks whose summed maxima stay below the threshold are skipped as a whole; in the others the lists, cut to the block, are
        moved from pivot to pivot, with the block's maxima as bounds.
        """
        found = []
        entry = _runs(self.block_at[terms], self.block_at[terms + 1])
        block = self.block[entry]
        held = np.bincount(block, self.block_top[entry])[block] >= threshold
        if not held.any():
            return found
        entry, block = entry[held], block[held]
        order = np.argsort(block, kind="stable")
        entry, block = entry[order], block[order]
        lo, hi = self.entry_at[entry], self.entry_at[entry + 1]
        own = _runs(lo, hi)
        # as Python lists, which single look-ups are faster on
        item, impact = self.item[own].tolist(), self.impact[own].tolist()
        ends = np.cumsum(hi - lo)
        spans = list(zip((ends - hi + lo).tolist(), ends.tolist(), self.block_top[entry].tolist()))
        cuts = np.flatnonzero(np.diff(block)) + 1
        for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(spans)]):
            lists = [list(c) for c in spans[first:last]]
            while lists:
                lists.sort(key=lambda c: item[c[0]])
                bound, pivot = 0.0, -1
                for k, c in enumerate(lists):
                    bound += c[2]
                    if bound >= threshold:
                        pivot = k
                        break
                if pivot < 0:
                    break
                doc = item[lists[pivot][0]]
                while pivot + 1 < len(lists) and item[lists[pivot + 1][0]] == doc:
                    pivot += 1
                target = doc
                if item[lists[0][0]] == doc:
                    score = math.fsum(impact[c[0]] for c in lists[: pivot + 1])
                    if score >= threshold:
                        found.append((doc, score))
                    target = doc + 1
                for c in lists[: pivot + 1]:
                    while c[0] < c[1] and item[c[0]] < target:
                        c[0] += 1
                lists = [c for c in lists if c[0] < c[1]]
        return found

    def overlaps(self, k: int, words: np.ndarray) -> tuple[float, float]:
        """The parts of the shingles of item ``k``'s question and answer that ``words`` hold; an absent part counts as held."""
        out = []
        for own in self.parts[k]:
            size = min(SHINGLE, len(own))
            out.append(float(np.isin(np.unique(shingles(own, size)), shingles(words, size)).mean()) if size else 1.0)
        return out[0], out[1]

    def leaks(self, part: bw.Slice, threshold: float, question: float, answer: float) -> list[tuple]:
        """(text, item, score, question overlap, answer overlap) of the slice, the best passage of each text and item."""
        words, bounds = words_of(part)
        slot = (words >> np.uint64(44)).astype(np.int64)
        known = self._slots()[slot]
        at = np.flatnonzero(known)
        term = np.searchsorted(self.terms, words[at])
        term[term == len(self.terms)] = 0
        good = self.terms[term] == words[at]
        at, term = at[good], term[good]
        if not len(at):
            return []
        text = np.searchsorted(bounds, at, "right") - 1
        n_words = np.diff(bounds)
        n_pass = np.maximum(1, -(-n_words // self.stride) - 1)
        firsts = np.concatenate([[0], np.cumsum(n_pass)])
        half = (at - bounds[text]) // self.stride
        keys = [((firsts[text] + p) * len(self.terms) + term)[(p >= 0) & (p < n_pass[text])] for p in (half - 1, half)]
        key = np.unique(np.concatenate(keys))
        passage, term = key // len(self.terms), key % len(self.terms)
        # upper bounds by term, then by block, over all passages at once
        bound = np.bincount(passage, self.top[term], firsts[-1])
        keep = bound[passage] >= threshold
        passage, term = passage[keep], term[keep]
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        if not len(passage):
            return []
        cuts = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(passage)]):
            for k, score in self.wand(term[lo:hi], threshold):
                t = int(np.searchsorted(firsts, passage[lo], "right")) - 1
                start = bounds[t] + (passage[lo] - firsts[t]) * self.stride
                around = words[max(bounds[t], start - self.stride) : min(bounds[t + 1], start + 3 * self.stride)]
                q, a = self.overlaps(k, around)
                if q >= question and a >= answer:
                    best[t, k] = max(best.get((t, k), (0.0, 0.0, 0.0)), (score, q, a))
        return [(part.first + t, k, *found) for (t, k), found in best.items()]

    def _slots(self) -> np.ndarray:
        if not hasattr(self, "_table"):
            self._table = np.zeros(1 << 20, bool)
            self._table[(self.terms >> np.uint64(44)).astype(np.int64)] = True
        return self._table


def statistics_of(items: DataFrame, parts_of: Callable) -> Statistics:
    """The statistics of all items, counted by Spark. ``items``: the columns ``parts_of`` takes, after the id."""

    def run(batches):
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns[1:]]):
                words = np.concatenate(hashed(*parts_of(*row)))
                if len(words):
                    terms = np.unique(words)
                    yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array([len(words)] + [None] * (len(terms) - 1), pa.int64())], ["term", "size"])

    # an item's number of words stands beside its first term
    counted = stored(items.mapInArrow(run, "term long, size long").groupBy("term").agg(F.count("*").alias("df"), F.count("size").alias("n"), F.sum("size").alias("total"), F.max("size").alias("longest")), "item-terms")
    n, total, longest = counted.agg(F.sum("n"), F.sum("total"), F.max("longest")).first()

    def df(terms: np.ndarray) -> np.ndarray:
        own = items.sparkSession.createDataFrame(pa.table({"term": terms.view(np.int64)}))
        found = counted.select("term", "df").join(own, "term").toArrow()
        at, out = found["term"].to_numpy().view(np.uint64), np.zeros(len(terms), np.int64)
        out[np.searchsorted(terms, at)] = found["df"].to_numpy()
        return out

    return Statistics(n, total / n, longest, df)


def indexes(items: DataFrame, id_col: str = "item_id", text_col: str | None = "text", question_col: str | None = None, answer_col: str | None = None):
    """(``Index``, whether it is the only one) after another, within the bounds; from question and answer columns, or from a text column that is cut in two."""
    columns = [F.col(question_col), F.col(answer_col)] if question_col else [F.col(text_col)]
    parts_of = (lambda q, a: (q, a)) if question_col else question_and_answer
    own = items.select(F.col(id_col).alias("id"), *[c.cast("string").alias(f"part_{k}") for k, c in enumerate(columns)])
    n_bytes = own.agg(F.sum(sum(F.coalesce(F.octet_length(f"part_{k}"), F.lit(0)) for k in range(len(columns))))).first()[0] or 0
    ids, parts, n_words, statistics = [], [], 0, None
    for row in own.repartition(max(1, -(-n_bytes // FETCHED))).toLocalIterator():
        p = hashed(*parts_of(*row[1:]))
        size = len(p[0]) + len(p[1])
        if not size:
            continue
        if ids and (len(ids) >= ITEMS_AT_ONCE or n_words + size > WORDS_AT_ONCE):
            statistics = statistics or statistics_of(own, parts_of)
            yield Index.of_words(ids, parts, statistics), False
            ids, parts, n_words = [], [], 0
        ids.append(row[0])
        parts.append(p)
        n_words += size
    if ids:
        yield Index.of_words(ids, parts, statistics), statistics is None


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION_OVERLAP, answer: float = ANSWER_OVERLAP, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", **columns) -> DataFrame:
    """(doc id, item id, score, question_overlap, answer_overlap) of every leak; a name that is taken gets an underscore. ``columns``: as for ``indexes``."""
    small_batches(docs.sparkSession)
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id_col].dataType.simpleString()
    schema = f"doc {kind}, item {item_kind}, score double, question_overlap double, answer_overlap double"
    found = None
    for index, only in indexes(items, item_id_col, **columns):

        def run(batches, index=index):
            for batch in batches:
                rows = [r for part in bw.text_slices(batch.column(1)) for r in index.leaks(part, threshold, question, answer)]
                if rows:
                    text, item, *numbers = zip(*rows)
                    numbers = [pa.array(np.round(n, 6), pa.float64()) for n in numbers]
                    ids = pa.array([index.item_ids[k] for k in item])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), ids, *numbers], ["doc", "item", "score", "question_overlap", "answer_overlap"])

        own = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(lean(run), schema)
        own = own if only else stored(own, "leaks")
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    item_name = free(item_id_col, id_col)
    return found.select(F.col("doc").alias(id_col), F.col("item").alias(item_name), *[F.col(c).alias(free(c, id_col, item_name)) for c in ("score", "question_overlap", "answer_overlap")])


def drop_leaking(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION_OVERLAP, answer: float = ANSWER_OVERLAP, text_col: str = "text", item_id_col: str = "item_id", **columns) -> DataFrame:
    """The rows of ``docs`` whose text leaks no item, with their own columns; judged where they are read, without a join."""
    small_batches(docs.sparkSession)
    place, before = docs.columns.index(text_col), None
    for index, only in indexes(items, item_id_col, **columns):

        def run(batches, index=index):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for part in bw.text_slices(batch.column(place)):
                    keep[[r[0] for r in index.leaks(part, threshold, question, answer)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(lean(run), docs.schema)
        if not only:
            docs = stored(docs, "without-leaks")
            if before is not None:
                dropped(before)
            before = docs
    return docs
