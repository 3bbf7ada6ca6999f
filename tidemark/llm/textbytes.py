"""Vectorised byte-level views of Arrow text columns: words, lines and span hashes of whole texts.

Rows are taken in slices of bounded byte size, so a batch never needs more than a few times SLICE_BYTES
(or one text, where a single text is longer) of working memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        factor = np.full(max(n, SLICE_BYTES + 1), _BASE if which == "up" else _INVERSE, np.uint64)
        factor[0] = 1
        have = _powers[which] = np.cumprod(factor, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit hash over all its bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Texts:
    """A slice of rows: bytes of all texts, offsets of each (null texts are empty), and the rows' place in the batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, row: int, valid: np.ndarray):
        self.data, self.offsets, self.row, self.valid = data, offsets, row, valid
        self.n = len(offsets) - 1

    def lowered(self) -> Texts:
        return Texts(LOWER[self.data], self.offsets, self.row, self.valid)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words in data, and per row the index of its first word (one more at the end)."""
        word = ~IS_SPACE[self.data]
        return self._runs(word)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the parts between line feeds; an empty text has one empty line."""
        cuts = np.flatnonzero(self.data == 10)
        row_of_cut = np.searchsorted(self.offsets, cuts, side="right") - 1
        starts = np.sort(np.concatenate([self.offsets[:-1], cuts + 1]), kind="stable")
        ends = np.sort(np.concatenate([self.offsets[1:], cuts]), kind="stable")
        first = np.arange(self.n + 1) + np.concatenate([[0], np.cumsum(np.bincount(row_of_cut, minlength=self.n))])
        return starts, ends, first

    def _runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        edges = self.offsets[:-1]
        before[edges[edges < len(inside)]] = False
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:]
        edges = self.offsets[1:]
        after[edges[edges > 0] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span's bytes, equal for equal bytes wherever they stand."""
        n = len(self.data)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power("up", n), out=prefix[1:], dtype=np.uint64)
        spans = (prefix[ends] - prefix[starts]) * _power("down", n + 1)[starts]
        return mix(spans + (ends - starts).astype(np.uint64))


def slices(column: pa.Array | pa.ChunkedArray, limit: int | None = None) -> Iterator[Texts]:
    """The rows of a text column in slices of about SLICE_BYTES."""
    limit = limit or SLICE_BYTES
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield Texts(raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at, valid[at:to])
        at = to
