"""Vectorised word kernels over Arrow string columns: whole batches of texts as one byte buffer.

A word is a run of bytes other than space and \\x09-\\x0D; in UTF-8 these bytes never belong to a longer character, so bytes
and characters agree on the words. Texts are worked off in pieces that end between words, so memory follows `PIECE`, not the
longest text (a single word longer than a piece is taken whole).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
#: An odd multiplier: its powers and their inverses exist modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII but letters and digits.
_NOT_LETTER = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept, as pieces are of about one size."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        factors = np.full(max(n, PIECE + 4096), base, np.uint64)
        factors[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[base] = np.multiply.accumulate(factors)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 row offsets; null is empty."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count or column.type != pa.large_string() else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start = int(offsets[0]) if len(offsets) else 0
    return values[start : int(offsets[-1])], offsets - start


def lower_ascii(values: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[values]


def _pieces(values: np.ndarray, piece: int) -> Iterator[tuple[int, int]]:
    """Ranges of about `piece` bytes that end just after a white space byte, or at the end."""
    start, n = 0, len(values)
    while start < n:
        end = start + piece
        while end < n and not _SPACE[values[end - 1]]:
            gap = np.flatnonzero(_SPACE[values[end : end + piece]])
            end = end + int(gap[0]) + 1 if len(gap) else min(n, end + piece)
        yield start, min(end, n)
        start = min(end, n)


def _spans(values: np.ndarray, offsets: np.ndarray, separators: np.ndarray, piece: int) -> Iterator[tuple]:
    """Per piece: prefix sums of its letters, starts and ends of its words, their rows, and the inverse powers at the starts."""
    for lo, hi in _pieces(values, piece):
        part = values[lo:hi]
        inside = ~separators[part]
        # A text that ends without a separator must not run into the next one.
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cuts = offsets[np.searchsorted(offsets, lo, "left") : np.searchsorted(offsets, hi, "left")] - lo
        begins[cuts] = inside[cuts]
        starts = np.flatnonzero(begins)
        if not len(starts):
            continue
        stops = inside.copy()
        stops[:-1] &= ~inside[1:] | begins[1:]
        ends = np.flatnonzero(stops) + 1
        with np.errstate(over="ignore"):
            letters = (part.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, len(part))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters, dtype=np.uint64)])
        owner = np.searchsorted(offsets[:-1], starts + lo, "right") - 1
        yield total, starts, ends, owner, _power_table(_INVERSE, len(part) + 1)[starts]


def word_hashes(column: pa.Array, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (A-Z as a-z) of every text, in order, and the n+1 offsets of the rows' words."""
    values, offsets = string_bytes(column)
    counts = np.zeros(len(column), np.int64)
    parts: list[np.ndarray] = []
    for total, starts, ends, owner, inverse in _spans(lower_ascii(values), offsets, _SPACE, piece):
        with np.errstate(over="ignore"):
            parts.append(mix64((total[ends] - total[starts]) * inverse))
        counts += np.bincount(owner, minlength=len(counts))
    found = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), found


def affix_hashes(column: pa.Array, prefixes: tuple[int, ...], piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of letter runs and of the first bytes of longer ones, the rows they belong to, and the letter runs of each row."""
    values, offsets = string_bytes(column)
    counts = np.zeros(len(column), np.int64)
    hashes: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    for total, starts, ends, owner, inverse in _spans(values, offsets, _NOT_LETTER, piece):
        with np.errstate(over="ignore"):
            hashes.append(mix64((total[ends] - total[starts]) * inverse))
            rows.append(owner)
            for n in prefixes:
                longer = ends - starts > n
                at = starts[longer]
                hashes.append(mix64((total[at + n] - total[at]) * inverse[longer] + np.uint64(n)))
                rows.append(owner[longer])
        counts += np.bincount(owner, minlength=len(counts))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), counts
    return np.concatenate(hashes), np.concatenate(rows), counts


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of `n` words of one text; of the whole text, if it has fewer (none without words)."""
    if not len(hashes):
        return hashes
    n_here = min(n, len(hashes))
    with np.errstate(over="ignore"):
        out = np.full(len(hashes) - n_here + 1, np.uint64(n_here), np.uint64)
        for i in range(n_here):
            out = mix64(out * np.uint64(_BASE) + hashes[i : len(hashes) - n_here + 1 + i])
    return out


def distinct_shingles(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Per text, the sorted distinct hashes of its word n-grams."""
    hashes, offsets = word_hashes(column)
    for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
        yield np.unique(shingle_hashes(hashes[lo:hi], n))
