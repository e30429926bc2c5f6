"""Array kernels over the bytes of whole texts: words, their hashes, n-gram sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
KEPT_POWERS = 1 << 20  # longer tables are made for the slice that needs them
U64 = np.uint64
_BASE = pow(0x9E3779B97F4A7C15, 1, 1 << 64) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _geometric(base: int, n: int) -> np.ndarray:
    out, known = np.ones(n, U64), 1
    while known < n:
        step = U64(pow(base, known, 1 << 64))
        take = min(known, n - known)
        out[known : known + take] = out[:take] * step
        known += take
    return out


def power_tables(n: int) -> list[np.ndarray]:
    """At least n powers of an odd base modulo 2**64, and of its inverse."""
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        made = [_geometric(_BASE, n), _geometric(_INVERSE, n)]
        if n > KEPT_POWERS:
            return made
        _powers[:] = made
    return _powers


def sliced(batches: Iterator[pa.RecordBatch], text: int, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows with about limit bytes of text: the rows, the bytes and the rows' offsets into them."""
    for batch in batches:
        column = pc.fill_null(batch.column(text).cast(pa.large_binary()), b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            to = min(to, len(column))
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


#: What stands between terms: every ASCII character but letters, digits and the apostrophe.
_NO_TERM = np.array([not (chr(c).isalnum() or c == 39 or c >= 128) for c in range(256)])


def words(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes not in outside of each row, and the rows' offsets into them."""
    n = len(data)
    full = np.ones(n + 2, bool)
    full[0] = full[-1] = False
    full[1:-1] = ~outside[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(full[1:-1] & (~full[:-2] | cut[:-1]))
    ends = np.flatnonzero(full[1:-1] & (~full[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return _LOWER[data]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, equal for equal bytes wherever they stand."""
    up, down = power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of each row (letters, digits, apostrophes; A-Z lower-cased), and the rows' offsets."""
    low = lowered(data)
    starts, ends, at = words(low, offsets, _NO_TERM)
    return span_hashes(low, starts, ends), at


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the values of each row; zero for rows without any."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0)
    return out


def packed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a bounded list of texts, and the texts' offsets into them."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]).astype(np.int64)


def terms_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """terms() of a bounded list of texts, a slice at a time."""
    found, counts, held, size = [np.zeros(0, U64)], [np.zeros(1, np.int64)], [], 0
    for i, t in enumerate(texts):
        held.append(t)
        size += len(t or "")
        if size >= SLICE_BYTES or i == len(texts) - 1:
            h, at = terms(*packed(held))
            found.append(h)
            counts.append(np.diff(at))
            held, size = [], 0
    return np.concatenate(found), np.cumsum(np.concatenate(counts))
