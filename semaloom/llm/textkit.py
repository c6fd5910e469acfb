"""Vectorised word hashing over Arrow string columns: no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that part words.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_SEP = np.zeros(256, bool)
_SEP[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C2B  # 3 mod 8, so that differences of powers keep their high bits
_BACK = pow(_STEP, -1, 1 << 64)
_POWERS = {"forth": np.ones(1, np.uint64), "back": np.ones(1, np.uint64)}


def _powers(which: str, base: int, n: int) -> np.ndarray:
    if len(_POWERS[which]) < n:
        size = 1 << (n - 1).bit_length()
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        _POWERS[which] = np.multiply.accumulate(steps)
    return _POWERS[which]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (in place on a copy)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pieces(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of about ``most`` bytes; null is empty."""
    if pa.types.is_string(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    buffer = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, buffer[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, word starts, word ends, number of words before each document and in all).

    Equal words have equal hashes; different ones differ but for a chance of about 2**-60.
    """
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    sep = _SEP[raw]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    edge[1:n] = sep[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    edge[inner] = True
    starts = np.flatnonzero(~sep & edge[:n])
    edge[1:n] = sep[1:]
    edge[inner] = True
    ends = np.flatnonzero(~sep & edge[1:]) + 1
    counts = np.searchsorted(starts, offsets)
    terms = _TABLE[_LOWER[raw]] if lower else _TABLE[raw]
    terms *= _powers("forth", _STEP, n)[:n]
    np.cumsum(terms, out=terms)
    sums = terms[ends - 1]
    sums[starts > 0] -= terms[starts[starts > 0] - 1]
    sums *= _powers("back", _BACK, n)[starts]
    return mix(sums), starts, ends, counts


def word_counts(column: pa.Array) -> np.ndarray:
    """Number of words of each text; null has none."""
    out = np.zeros(len(column), np.int64)
    for first, last, raw, offsets in pieces(column):
        sep = _SEP[raw]
        edge = np.empty(len(raw), bool)
        edge[:1] = True
        edge[1:] = sep[:-1]
        edge[offsets[:-1][offsets[:-1] < len(raw)]] = True
        out[first:last] = np.diff(np.searchsorted(np.flatnonzero(edge & ~sep), offsets))
    return out


_SPREAD = np.random.default_rng(7).integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; run i starts at word i."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = hashes[: len(hashes) - n + 1] * _SPREAD[0]
    for j in range(1, n):
        out = out + hashes[j : len(hashes) - n + 1 + j] * _SPREAD[j]
    return mix(out)


def sequence_hash(hashes: np.ndarray, salt: int = 0) -> int:
    """Hash of a whole run of words of any length."""
    powers = _powers("forth", _STEP, len(hashes) + 1)[: len(hashes)]
    total = int((hashes * powers).sum(dtype=np.uint64)) if len(hashes) else 0
    value = np.array([(total + len(hashes) * 0x632BE59BD9B4E019 + salt) & 0xFFFFFFFFFFFFFFFF], np.uint64)
    return int(mix(value)[0])
