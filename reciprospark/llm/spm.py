"""SentencePiece BPE encoding by a prefix table, and decoding.

For every prefix of a string the encoding ends in exactly one piece. An automaton over the vocabulary reports
the pieces that end at each place; of these, the last piece of the prefix is the one that is compatible with the last
piece of what stands before it, that is, the two pieces encoded together give themselves. Ids are then
read off the table backwards. A character outside the vocabulary merges with nothing: it parts the string and becomes
its bytes' pieces.

No merge joins two characters that stand side by side in no piece, so a text falls into chunks at such places, which encode
independently. All chunks of a slice of texts are looked up at once in a bounded table (``chunks``) of those that a worker has met; the
prefix table encodes the others. Decoding puts together the pieces' bytes; what the library treats apart (control and unknown ids, byte pieces
that aren't UTF-8) it decodes itself.

Defined cases: null counts as an empty text, which has no ids and decodes to an empty text; repeated rows
are encoded each by itself; texts of any length are encoded whole; an empty table gives an empty table; other columns, whatever their names, don't take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .chunks import ChunkTable, per_text, places_of
from .names import free
from .storage import small_batches
from .workers import held, lean

MARK = "▁"
#: Entries of a worker's table of piece pairs (some 40 MB); a full one starts anew.
KEPT_PAIRS = 400_000


class PrefixTable:
    """Encoder for one model file."""

    def __init__(self, path: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.score = {i: sp.get_score(i) for i in plain}
        self.id_of = {sp.id_to_piece(i): i for i in plain}
        self.piece = {i: p for p, i in self.id_of.items()}
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.known = {p for p in self.id_of if len(p) == 1}
        if n > 1 << 16:
            raise ValueError("more pieces than the keys of pairs have room for")
        self.size = [len(self.piece.get(i, "")) for i in range(n)]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for piece, i in self.id_of.items():
            if self._merged(piece) == [i]:
                self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        # [a, b]: some piece has a byte b after a byte a, or b goes on with a character
        self.joined = np.zeros((256, 256), bool)
        self.joined[:, 0x80:0xC0] = True
        for piece in self.id_of:
            raw = np.frombuffer(piece.encode(), np.uint8)
            self.joined[raw[:-1], raw[1:]] = True
        shown = [b""] * n
        for i, p in self.piece.items():
            shown[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_id):
            shown[i] = bytes([b])
        self.marked = np.array([self.piece.get(i, "").startswith(MARK) for i in range(n)])
        self.apart = np.ones(n, bool)
        self.apart[[*self.piece, *self.byte_id]] = False
        self.shown, self.shown_n = np.frombuffer(b"".join(shown), np.uint8), np.array([len(x) for x in shown])
        self.shown_at = np.cumsum(self.shown_n) - self.shown_n
        self.table = ChunkTable(self._learn)

    def _merged(self, text: str) -> list[int | None]:
        """Plain BPE of a short string: the best-scored adjacent pair first, the leftmost of equals. Used on pieces and pairs of pieces only."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id_of.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if best is None:
                return [self.id_of.get(p) for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether two pieces that are encoded together give themselves."""
        key = left << 16 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._merged(self.piece[left] + self.piece[right]) == [left, right]
        return found

    def _known_run(self, text: str) -> list[int]:
        """Ids of a string all of whose characters are pieces."""
        last = [-1] * len(text)  # last[k]: the last piece of the prefix that ends with character k
        pairs, size_of = self.pairs, self.size
        for end, i in self.automaton.iter(text):
            if last[end] >= 0:  # only one piece can be it
                continue
            start = end - size_of[i]
            if start >= 0:
                before = last[start]
                fits = pairs.get(before << 16 | i)
                if fits is None:
                    fits = self.compatible(before, i)
                if not fits:
                    continue
            last[end] = i
        ids, k = [], len(text) - 1
        while k >= 0:
            i = last[k]
            ids.append(i)
            k -= size_of[i]
        return ids[::-1]

    def chunk_ids(self, chunk: str) -> list[int]:
        known, ids, run = self.known, [], []
        for c in chunk:
            if c in known:
                run.append(c)
                continue
            if run:
                ids += self._known_run("".join(run))
                run = []
            ids += [self.byte_id[b] for b in c.encode()]
        return ids + self._known_run("".join(run)) if run else ids

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        raw = data.tobytes()
        found = [self.chunk_ids(raw[a:b].decode()) for a, b in zip(starts.tolist(), ends.tolist())]
        yield np.arange(len(found)), np.array([i for ids in found for i in ids], np.int32), np.array([len(ids) for ids in found], np.int64)

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of whole texts one after another, number of ids of each)."""
        parts = []
        for part in bw.text_slices(pa.array([self.library.normalize(t) if t else "" for t in texts], pa.string())):
            data, full = part.data, part.starts < part.ends
            start = np.zeros(len(data), bool)
            start[1:] = ~self.joined[data[:-1], data[1:]]
            start[part.starts[full]] = True
            starts = np.flatnonzero(start)
            ids, n = self.table.ids(data, starts, np.append(starts[1:], len(data))[: len(starts)])
            parts.append((ids, per_text(n, starts, np.append(part.starts, len(data)))))
        return (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))

    def encode(self, text: str | None) -> np.ndarray:
        return next(iter(self.ids([text])))

    def decode(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 of the texts one after another, number of bytes of each) of the ids of texts one after another."""
        size = self.shown_n[ids]
        raw = self.shown[places_of(self.shown_at[ids], size)]
        n_bytes = per_text(size, np.arange(len(ids)), np.append(0, np.cumsum(n)))
        ends = np.cumsum(n_bytes)
        # the mark before a text's first word isn't a space of the text
        full = np.flatnonzero(n)
        first = (ends - n_bytes)[full[self.marked[ids[(np.cumsum(n) - n)[full]]]]]
        keep = np.ones(len(raw), bool)
        keep[first] = False
        own = np.searchsorted(ends, first, "right")
        n_bytes[own] -= 1
        raw = raw[keep]
        odd = self._odd(raw, n_bytes) | (np.add.reduceat(np.append(self.apart[ids], False), np.cumsum(n) - n) * (n > 0) > 0 if len(n) else np.zeros(0, bool))
        if not odd.any():
            return raw, n_bytes
        texts = [raw[e - k : e] for e, k in zip(np.cumsum(n_bytes).tolist(), n_bytes.tolist())]
        for t in np.flatnonzero(odd):
            at = int(n[:t].sum())
            texts[t] = np.frombuffer(self.library.decode(ids[at : at + n[t]].tolist()).encode(), np.uint8)
        return np.concatenate(texts), np.array([len(t) for t in texts])

    def _odd(self, raw: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
        """Which of texts aren't UTF-8."""
        odd = np.zeros(len(n_bytes), bool)
        try:
            raw.tobytes().decode()
        except UnicodeDecodeError:
            for t, (end, k) in enumerate(zip(np.cumsum(n_bytes).tolist(), n_bytes.tolist())):
                try:
                    raw[end - k : end].tobytes().decode()
                except UnicodeDecodeError:
                    odd[t] = True
        # a text may also begin with the rest of a character that the one before leaves open
        first = (np.cumsum(n_bytes) - n_bytes)[n_bytes > 0]
        odd[n_bytes > 0] |= (raw[first] & 0xC0) == 0x80
        return odd


def _key(path: str) -> tuple[str, str]:
    return "sentencepiece", path


def opened(path: str) -> PrefixTable:
    """The encoder of a model file, held by a worker process while it has tasks of this operator."""
    return held(_key(path), lambda: PrefixTable(path))


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every row; a name that the id has gets an underscore. ``model_path`` must be readable on every executor."""
    small_batches(docs.sparkSession)

    def run(batches):
        model = opened(model_path)
        offsets = lambda n: pa.py_buffer(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        for batch in batches:
            for part in bw.text_slices(batch.column(1)):
                n_texts = len(part.starts)
                ids, n = model.ids(batch.column(1).slice(part.first, n_texts).to_pylist())
                raw, n_bytes = model.decode(ids, n)
                lists = pa.ListArray.from_buffers(pa.list_(pa.int32()), n_texts, [None, offsets(n)], children=[pa.array(ids, pa.int32())])
                decoded = pa.Array.from_buffers(pa.string(), n_texts, [None, offsets(n_bytes), pa.py_buffer(np.ascontiguousarray(raw))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, n_texts), lists, decoded], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(lean(run, _key(model_path)), f"id {kind}, ids array<int>, decoded string")
    return found.select(F.col("id").alias(id_col), *[F.col(c).alias(free(c, id_col)) for c in ("ids", "decoded")])


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of ``encode_decode``'s rows."""
    ids, decoded = (F.col(free(c, id_col)) for c in ("ids", "decoded"))
    return encoded.select(
        F.col(f"`{id_col}`"),
        F.size(ids).cast("long").alias(free("n_tokens", id_col)),
        F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256).alias(free("ids_sha256", id_col)),
        F.sha2(decoded.cast("binary"), 256).alias(free("decoded_sha256", id_col)),
    )
