"""Hashes of the words of whole texts, straight from Arrow's bytes; for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at once; longer texts go in pieces cut at white space.
PIECE = 1 << 19
# Odd multipliers and the constants of the splitmix64 finaliser.
STEP = 0x9E3779B97F4A7C15 | 1
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
PLACES = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX_1)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX_2)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, PIECE)
        for name, base in (("up", STEP), ("down", pow(STEP, -1, 1 << 64))):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _POWERS[name] = np.multiply.accumulate(table)
    return _POWERS["up"], _POWERS["down"]


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its rows' offsets; null is empty."""
    column = pc.fill_null(column, "")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def _hash_piece(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of a piece; cuts: where texts begin."""
    space = _SPACE[data]
    before, after = np.empty_like(space), np.empty_like(space)
    before[1:], after[:-1] = space[:-1], space[1:]
    before[0] = after[-1] = True
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    before[inner] = True
    after[inner - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_LOWER[data] + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts]), starts, ends


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Groups of rows: (first row, last row + 1, 64-bit hashes of their lower-cased words, each row's offsets into them)."""
    row, n = 0, len(offsets) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        begin, end = int(offsets[row]), int(offsets[last])
        if end - begin <= PIECE:
            piece = data[begin:end]
            if not len(piece):
                yield row, last, np.zeros(0, np.uint64), np.zeros(last - row + 1, np.int64)
            else:
                local = offsets[row : last + 1] - begin
                hashes, starts, _ = _hash_piece(piece, local)
                yield row, last, hashes, np.searchsorted(starts, local, "left")
        else:
            parts = []
            while begin < end:
                to = min(end, begin + PIECE)
                while to < end and not _SPACE[data[to]]:
                    gap = np.flatnonzero(_SPACE[data[to : to + PIECE]])
                    to = min(end, to + (int(gap[0]) if len(gap) else PIECE))
                parts.append(_hash_piece(data[begin:to], np.zeros(0, np.int64))[0])
                begin = to
            hashes = np.concatenate(parts)
            yield row, last, hashes, np.array([0, len(hashes)], dtype=np.int64)
        row = last


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k words in a row; of fewer words, one of the whole sequence."""
    if not len(words):
        return np.zeros(0, np.int64)
    if len(words) < k:
        parts = np.append(words * np.array(PLACES[: len(words)], np.uint64), np.uint64(len(words) * STEP % (1 << 64)))
        h = np.array([parts.sum(dtype=np.uint64)])
    else:
        h = np.zeros(len(words) - k + 1, np.uint64)
        for i in range(k):
            h += words[i : len(h) + i] * np.uint64(PLACES[i])
    h = np.sort(mixed(h).view(np.int64))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]
