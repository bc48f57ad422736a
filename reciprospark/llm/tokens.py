"""Token ids of whole texts by the ``tokenizers`` library, each distinct chunk of text encoded once per worker.

Under a byte-level pre-tokenizer no token spans the border between a character and white space after it, so a text falls into
chunks (white space, then other characters, cut again between a letter and a mark or digit after it) whose ids don't depend on what stands around. The chunks of many texts are looked up at once
in a bounded table (``chunks``); unknown ones are encoded in one call. For other kinds of tokenizer files, and for texts that hold
the string of a special token, the library gets the whole text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import bytewords as bw
from .chunks import ChunkTable, per_text, places_of

#: The characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

_ONE = np.zeros(256, bool)
_ONE[[ord(c) for c in WHITE_SPACE if ord(c) < 128]] = True
_LONGER = [np.frombuffer(c.encode(), np.uint8) for c in WHITE_SPACE if ord(c) >= 128]
_LEAD = np.zeros(256, bool)
_LEAD[[c[0] for c in _LONGER]] = True
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_MARK[0x21:0x7F] = ~_LETTER[0x21:0x7F]
_open: dict[str, "ChunkEncoder"] = {}


def white_space(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to white space."""
    space = _ONE[data]
    lead = np.flatnonzero(_LEAD[data])
    if len(lead):
        after = np.append(data, np.zeros(2, np.uint8))
        for c in _LONGER:
            at = lead[np.logical_and.reduce([after[lead + k] == b for k, b in enumerate(c)])]
            for k in range(len(c)):
                space[at + k] = True
    return space


class ChunkEncoder:
    """Encoder for one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.chunked = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and not spec.get("normalizer") and not spec.get("truncation")
        added = self.library.get_added_tokens_decoder()
        self.special = [t.content.encode() for t in added.values() if t.content]
        size = self.library.get_vocab_size()
        self.max_id = size - 1
        self.n_bytes = np.array([len(self.library.id_to_token(i) or "") for i in range(size)])
        self.table = ChunkTable(self._learn)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The ids of chunks, thousands in a call of the library where their borders are sure to be kept.

        Chunks with white space at their front alone can stand one after another; those without any at either end are parted by line ends.
        """
        space = white_space(data)
        front, back = space[starts], space[ends - 1]
        lone = back if self.chunked else np.ones(len(starts), bool)
        for kind, gap in ((front & ~lone, 0), (~front & ~lone, 1)):
            group = np.flatnonzero(kind)
            for lo in range(0, len(group), 20_000):
                own = group[lo : lo + 20_000]
                n = ends[own] - starts[own] + gap
                stops = np.cumsum(n)
                raw = np.full(stops[-1], 10, np.uint8)
                raw[places_of(stops - n, n - gap)] = data[places_of(starts[own], n - gap)]
                ids = np.array(self._whole([raw.tobytes().decode()])[0], np.int32)
                last = np.cumsum(self.n_bytes[ids])
                cuts = np.searchsorted(last, stops - gap)  # the last token of each chunk
                if not np.array_equal(last[cuts], stops - gap) or gap and not np.array_equal(last[cuts + 1], stops):
                    lone[own] = True  # a token spans two chunks: this file isn't as assumed
                    continue
                first = np.append(0, cuts[:-1] + 1 + gap)
                size = cuts + 1 - first
                yield own, ids[places_of(first, size)], size
        own = np.flatnonzero(lone)
        found = self._whole([data[starts[k] : ends[k]].tobytes().decode() for k in own])
        yield own, np.array([i for ids in found for i in ids], np.int32), np.array([len(ids) for ids in found], np.int64)

    def _chunks(self, part: bw.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the slice's chunks, and which of them are whole texts with a special token."""
        data, full = part.data, part.starts < part.ends
        start = np.zeros(len(data), bool)
        if self.chunked:
            space = white_space(data)
            start[1:] = (space[1:] & ~space[:-1]) | (_LETTER[data[:-1]] & _MARK[data[1:]])
        raw, whole = data.tobytes(), set()
        for s in self.special if self.chunked else ():
            at = raw.find(s)
            while at >= 0:
                whole.add(int(np.searchsorted(part.ends, at, "right")))
                at = raw.find(s, at + 1)
        for t in whole:
            start[part.starts[t] : part.ends[t]] = False
        start[part.starts[full]] = True
        starts = np.flatnonzero(start)
        alone = np.isin(starts, part.starts[sorted(whole)]) if self.chunked else np.ones(len(starts), bool)
        return starts, np.append(starts[1:], len(data))[: len(starts)], alone

    def ids(self, part: bw.Slice) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of the slice one after another, number of ids of each text)."""
        starts, ends, alone = self._chunks(part)
        ids, n = self.table.ids(part.data, starts, ends, alone)
        return ids, per_text(n, starts, np.append(part.starts, len(part.data)))

    def counts(self, part: bw.Slice) -> np.ndarray:
        """The number of ids of each text of the slice."""
        starts, ends, alone = self._chunks(part)
        return per_text(self.table.found(part.data, starts, ends, alone)[1], starts, np.append(part.starts, len(part.data)))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each whole text; null counts as empty."""
        out: list[list[int]] = []
        for part in bw.text_slices(pa.array(texts, pa.string())):
            ids, n = self.ids(part)
            out += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        return out


def opened(path: str) -> ChunkEncoder:
    """The encoder of a file, made once per worker process."""
    if path not in _open:
        _open[path] = ChunkEncoder(path)
    return _open[path]
