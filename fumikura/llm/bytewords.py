"""Words of many texts at once, as 64-bit hashes, straight from Arrow buffers.

A word is a run of bytes of one class; ASCII letters are lower-cased first.
The hash of a word is a polynomial over random byte values modulo 2**64,
taken from prefix sums, then mixed.  It depends on the bytes alone, so every
task, machine and run gives the same value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MASK = (1 << 64) - 1
_RADIX = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BACK = pow(_RADIX, -1, 1 << 64)
#: Bytes summed at a time; two tables of as many numbers stay in every worker.
_STEP = 1 << 16

#: Bytes treated at a time; a longer text is taken in pieces that end between words.
PIECE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        out = np.cumprod(out, dtype=np.uint64)
    return out


_UP, _DOWN = _powers(_RADIX, _STEP), _powers(_BACK, _STEP)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_VALUE = _BYTE[_LOWER]

#: Bytes that part words: ASCII white space, or everything ASCII but digits and letters.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x80] = True
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    NOT_ALNUM[_a:_b + 1] = False


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null text is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4))
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets.astype(np.int64)


def word_hashes(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of one piece of bytes."""
    inside = ~breaks[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    out = np.empty(len(starts), np.uint64)
    # Blocks of at most _STEP bytes that end with a word; one longer word is summed by itself.
    first = 0
    while first < len(starts):
        base = starts[first]
        last = int(np.searchsorted(ends, base + _STEP, "right"))
        if last <= first:
            out[first] = _long_word(data[base:ends[first]])
            first += 1
            continue
        piece = data[base:ends[last - 1]]
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_VALUE[piece] * _UP[:len(piece)], out=total[1:])
        s, e = starts[first:last] - base, ends[first:last] - base
        out[first:last] = (total[e] - total[s]) * _DOWN[s] + (e - s).astype(np.uint64)
        first = last
    return mix(out), starts, ends


def _long_word(word: np.ndarray) -> int:
    total, factor = 0, 1
    for at in range(0, len(word), _STEP):
        part = word[at:at + _STEP]
        total = (total + int(np.sum(_VALUE[part] * _UP[:len(part)], dtype=np.uint64)) * factor) & _MASK
        factor = factor * pow(_RADIX, _STEP, 1 << 64) & _MASK
    return (total + len(word)) & _MASK


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that what is made of a batch stays small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def document_words(column: pa.Array, breaks: np.ndarray = SPACES) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of every text of a column, small texts hashed together."""
    data, offsets = text_buffer(column)
    row, n = 0, len(column)
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        base = offsets[row]
        piece = data[base:offsets[last]]
        if last == row + 1:
            yield row, _whole(piece, breaks)
        else:
            # A break before every text keeps words of two texts apart.
            sizes = np.diff(offsets[row:last + 1])
            spot = np.arange(len(piece)) + np.repeat(np.arange(last - row), sizes)
            spaced = np.full(len(piece) + last - row, 0x20, np.uint8)
            spaced[spot] = piece
            hashes, starts, _ = word_hashes(spaced, breaks)
            cuts = np.searchsorted(starts, offsets[row:last + 1] - base + np.arange(last - row + 1))
            for i in range(last - row):
                yield row + i, hashes[cuts[i]:cuts[i + 1]]
        row = last


def _whole(data: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Word hashes of one text of any length, in pieces that end at a break."""
    parts, at = [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data):
            gaps = np.flatnonzero(breaks[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end = min(end + PIECE, len(data))
        parts.append(word_hashes(data[at:end], breaks)[0])
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes, ascending, of all runs of ``size`` words; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(_RADIX) + words[i:i + n])
    return np.unique(out)
