"""Fast exact encoding with the tokenizers library.

For the two pre-tokenisers used here no token ever reaches across a change from a character that is surely
not white space to a blank, tab or line end, so a text's ids are those of its pieces in order. Pieces repeat:
each worker keeps the ids of pieces by a 64-bit hash in sorted arrays, looks up all pieces of a megabyte of
text at once, and has the library encode each unseen piece once. Memory is bounded whatever a text's length.
tests/llm/test_tokens.py compares all of this with encode().
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

from quillmark.llm.textvec import STEP_BYTES, span_hashes, steps, take_rows

#: Pieces, and ids of pieces, that a worker keeps before it starts anew.
KEEP_PIECES, KEEP_IDS = 1_500_000, 1 << 23


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: at each text's start, and at blanks, tabs and line ends after what is no white space."""
    n = len(data)
    here = (data == 0x20) | (data == 0x09) | (data == 0x0A) | (data == 0x0D)
    b = [np.concatenate([np.zeros(k, np.uint8), data[: n - k]]) if n >= k else np.zeros(n, np.uint8) for k in (1, 2, 3, 4)]
    # code points that start with the bytes E1 to E3 may be white space; they only make a longer piece
    two = ((b[1] > 0xC2) & (b[1] < 0xE0)) | ((b[1] == 0xC2) & (b[0] != 0x85) & (b[0] != 0xA0))
    more = (b[1] >= 0x80) & (b[1] < 0xC0) & (((b[2] >= 0xE4) & (b[2] < 0xF0)) | (b[3] >= 0xF0))
    cut = here & (((b[0] > 0x20) & (b[0] < 0x80)) | ((b[0] >= 0x80) & (two | more)))
    at = offsets[:-1]
    cut[at[at < offsets[1:]]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of texts by one tokenizer file, as the library gives them without special tokens around a text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task per core already
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._added = [t.content.encode().lower() for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    @property
    def vocab_size(self) -> int:
        return self._tokenizer.get_vocab_size()

    def _forget(self) -> None:
        self._pool, self._used = np.empty(1 << 16, np.uint32), 0
        # hash, start and length in the pool; the second set is small and takes what is new
        self._tables = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)) for _ in range(2)]

    def _add(self, hashes: np.ndarray, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum()))
        if self._used + len(flat) > len(self._pool):
            self._pool = np.concatenate([self._pool[: self._used], np.empty(max(len(self._pool), len(flat)), np.uint32)])
        self._pool[self._used : self._used + len(flat)] = flat
        starts = self._used + np.concatenate([[0], np.cumsum(lengths[:-1], dtype=np.int64)]) if len(ids) else np.empty(0, np.int64)
        self._used += len(flat)
        self._tables[1] = _merged(self._tables[1], (hashes, starts.astype(np.int64), lengths))
        if len(self._tables[1][0]) > 50_000 + len(self._tables[0][0]) // 8:
            self._tables = [_merged(*self._tables), tuple(x[:0] for x in self._tables[1])]
        return starts, lengths

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the offsets of each text's."""
        begin = piece_starts(data, offsets)
        if not len(begin):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        end = np.append(begin[1:], len(data))
        unique, first, back = np.unique(span_hashes(data, begin, end), return_index=True, return_inverse=True)
        start, length = np.full(len(unique), -1, np.int64), np.zeros(len(unique), np.int64)
        for h, s, k in self._tables:
            if len(h):
                at = np.minimum(np.searchsorted(h, unique), len(h) - 1)
                hit = h[at] == unique
                start[hit], length[hit] = s[at[hit]], k[at[hit]]
        new = np.flatnonzero(start < 0)
        if len(new):
            raw = data.tobytes()
            pieces = [raw[a:b].decode("utf-8", "replace") for a, b in zip(begin[first[new]].tolist(), end[first[new]].tolist(), strict=True)]
            ids: list[list[int]] = []
            for a in range(0, len(pieces), 2048):
                ids += [e.ids for e in self._tokenizer.encode_batch_fast(pieces[a : a + 2048], add_special_tokens=False)]
            start[new], length[new] = self._add(unique[new], ids)
        size = length[back]
        total = np.concatenate([[0], np.cumsum(size)])
        out = self._pool[np.repeat(start[back] - total[:-1], size) + np.arange(total[-1])]
        rows = total[np.searchsorted(begin, offsets, side="left")]
        if len(self._tables[0][0]) > KEEP_PIECES or self._used > KEEP_IDS:
            self._forget()
        return out, rows

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """The texts that may hold an added token; the search is over all texts in a row at once."""
        raw, found = data.tobytes().lower(), set()
        for token in self._added:
            at = raw.find(token)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, side="right")) - 1
                if at + len(token) <= offsets[row + 1]:
                    found.add(row)
                    at = raw.find(token, int(offsets[row + 1]))
                else:
                    at = raw.find(token, at + 1)
        return sorted(found)

    def _long(self, data: np.ndarray) -> np.ndarray:
        """Ids of one text, in parts of about a megabyte that begin with a piece."""
        out, a, size = [], 0, STEP_BYTES
        while a < len(data):
            part = data[a : a + size]
            last = int(piece_starts(part, np.array([0, len(part)]))[-1]) if a + size < len(data) else len(part)
            if last:
                out.append(self.encode_bytes(part[:last], np.array([0, last]))[0])
                a, size = a + last, STEP_BYTES
            else:
                size *= 2  # a piece longer than that
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Row ranges [a, b) of about a megabyte with their ids and id offsets."""
        for a, b in steps(offsets):
            own, cut = take_rows(data, offsets, a, b)
            whole = self._whole(own, cut)
            begin = 0
            for end in [*whole, b - a]:
                if end > begin:
                    part = take_rows(own, cut, begin, end)
                    if end - begin == 1 and len(part[0]) > 2 * STEP_BYTES:
                        ids = self._long(part[0])
                        yield a + begin, a + end, ids, np.array([0, len(ids)])
                    else:
                        yield (a + begin, a + end, *self.encode_bytes(*part))
                if end < b - a:
                    text = own[cut[end] : cut[end + 1]].tobytes().decode("utf-8", "replace")
                    ids = np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                    yield a + end, a + end + 1, ids, np.array([0, len(ids)])
                begin = end + 1

    def encode(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        return np.concatenate([np.empty(0, np.uint32), *(ids for _, _, ids, _ in self.encode_rows(raw, np.array([0, len(raw)])))])


def _merged(a: tuple, b: tuple) -> tuple:
    both = [np.concatenate(x) for x in zip(a, b, strict=True)]
    order = np.argsort(both[0], kind="stable")
    return tuple(x[order] for x in both)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
