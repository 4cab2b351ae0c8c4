"""Vectorised kernels over Arrow string buffers: words, their hashes and windows of them.

All kernels work on UTF-8 bytes. Separator classes hold ASCII characters only, so cutting at
bytes is the same as cutting at characters.
"""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes handled at once; working arrays take about 40 times as much.
SEGMENT = 1 << 20


def give_back() -> None:
    """Returns freed memory to the system. Python workers outlive their tasks and would keep what a task once needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def plain_memory() -> None:
    """Arrow's buffers come from the C library: its own pools keep what batches once needed, in every worker."""
    pa.set_memory_pool(pa.system_memory_pool())


def trimmed(run: Callable) -> Callable:
    """A task function that gives freed memory back at its end; the number of its arguments stays, as Spark looks at it."""
    if inspect.isgeneratorfunction(run):

        def stream(batches):
            plain_memory()
            try:
                yield from run(batches)
            finally:
                give_back()

        return stream

    def one(table):
        plain_memory()
        out = run(table)
        give_back()
        return out

    def two(left, right):
        plain_memory()
        out = run(left, right)
        give_back()
        return out

    return one if len(inspect.signature(run).parameters) == 1 else two


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(30))
        x = x * U(0xBF58476D1CE4E5B9)
        x ^= x >> U(27)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(31)
    return x


#: Bytes that must lie behind the last span, so that eight can be read from any place.
_SPARE = np.zeros(8, np.uint8)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
#: Eight-byte lanes of a span that are worked off span by span at once; longer spans' further lanes are laid out in one row.
_LANES = 8
FIRST, SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place, as integers; the data is followed by zeros."""
    full = np.concatenate([data, _SPARE])
    return np.ndarray(len(data) + 1, "<u8", full, strides=(1,))


def _lane(j: np.ndarray | int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.asarray(j, U) * U(0xBF58476D1CE4E5B9) + U(seed))


def _hashed(eights: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Lanes of eight bytes are each mixed with a key of their place, summed and mixed with the length: no structure of the bytes carries over."""
    n = ends - starts
    with np.errstate(over="ignore"):
        h = mix((eights[starts] & _MASKS[np.minimum(n, 8)]) ^ _lane(0, seed))
        some = np.flatnonzero(n > 8)
        for j in range(1, _LANES):
            if not len(some):
                break
            h[some] += mix((eights[starts[some] + 8 * j] & _MASKS[np.minimum(n[some] - 8 * j, 8)]) ^ _lane(j, seed))
            some = some[n[some] > 8 * (j + 1)]
        for i in some.tolist():
            at = np.arange(starts[i] + 8 * _LANES, ends[i], 8)
            h[i] += mix((eights[at] & _MASKS[np.minimum(ends[i] - at, 8)]) ^ _lane(np.arange(_LANES, _LANES + len(at)), seed)).sum(dtype=U)
        return mix(h + n.astype(U) * U(0xD1B54A32D192ED03))


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = FIRST) -> np.ndarray:
    """Hash of the bytes of each span, case kept."""
    return _hashed(_eights(data), starts, ends, seed)


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, others: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether each span of ``data`` has the bytes of its counterpart in ``other``."""
    n, a, b = ends - starts, _eights(data), _eights(other)
    same = n == other_ends - others
    some = np.flatnonzero(same)
    for j in range(_LANES):
        if not len(some):
            return same
        mask = _MASKS[np.minimum(n[some] - 8 * j, 8)]
        ok = (a[starts[some] + 8 * j] & mask) == (b[others[some] + 8 * j] & mask)
        same[some[~ok]] = False
        some = some[ok & (n[some] > 8 * (j + 1))]
    for i in some.tolist():
        same[i] = np.array_equal(data[starts[i] : ends[i]], other[others[i] : other_ends[i]])
    return same


_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _lower[data]


#: Words are runs of anything but ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Words are runs of ASCII letters and digits and of all non-ASCII characters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True


@dataclass
class Words:
    """Words of several texts: hashes of the lower-cased words, byte spans, for each text the range of its words, and if asked for a second, independent hash."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    second: np.ndarray | None = None


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offs, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACED, second: bool = False) -> Words:
    """Words of texts that lie one after the other in ``data``. Long input is worked off in segments cut at separators."""
    n = len(data)
    hs, gs, ss, es = [], [], [], []
    at = 0
    while at < n:
        end = min(n, at + SEGMENT)
        if end < n:
            # cut where a text starts or a separator stands; a longer word widens the segment
            k = np.searchsorted(offsets, end, "right") - 1
            if offsets[k] > at:
                end = int(offsets[k])
            else:
                seps = np.flatnonzero(~kind[data[at:end]])
                if len(seps):
                    end = at + int(seps[-1]) + 1
                else:
                    stop = int(offsets[k + 1])
                    while end < stop and kind[data[end]]:
                        end += 1
        d = data[at:end]
        isw = kind[d]
        lo, hi = np.searchsorted(offsets, at, "left"), np.searchsorted(offsets, end, "left")
        cuts = offsets[lo:hi] - at
        prev = np.empty(len(d) + 1, bool)
        prev[0] = False
        prev[1:] = isw
        before = prev[:-1].copy()
        before[cuts] = False
        s = np.flatnonzero(isw & ~before)
        after = np.empty(len(d), bool)
        after[:-1] = isw[1:]
        after[-1] = False
        after[cuts[cuts > 0] - 1] = False
        e = np.flatnonzero(isw & ~after) + 1
        eights = _eights(_lower[d])
        hs.append(_hashed(eights, s, e, FIRST))
        if second:
            gs.append(_hashed(eights, s, e, SECOND))
        ss.append(s + at)
        es.append(e + at)
        at = end
    if not hs:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, U), z, z, np.zeros(len(offsets), np.int64), np.zeros(0, U) if second else None)
    starts = np.concatenate(ss)
    return Words(np.concatenate(hs), starts, np.concatenate(es), np.searchsorted(starts, offsets, "left"), np.concatenate(gs) if second else None)


_MULT = [0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x9FB21C651E98DF25, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive entries of ``h`` (one text or a run of texts; windows over a border are the caller's)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        acc = np.full(n, U(size) * U(0x2545F4914F6CDD1D), U)
        for k in range(size):
            acc += mix(h[k : k + n] * U(_MULT[k % 8] + 2 * (k // 8)))
    return mix(acc)


def batches_of(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``most`` bytes; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    _, offsets = strings(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def gathered(batches: Iterator[pa.RecordBatch], column: str, chunk: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``chunk`` text bytes, from smaller or larger ones."""
    held, size = [], 0

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for whole in batches:
        for b in batches_of(whole, column, chunk // 8):
            own = b.column(column).nbytes
            if held and size + own > chunk:
                yield joined()
                held, size = [], 0
            held.append(b)
            size += own
    if held:
        yield joined()


def packed(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpacked(blob: bytes, dtype) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    if not n:
        return np.zeros(0, dtype)
    raw = np.frombuffer(pa.decompress(blob[8:], decompressed_size=n, codec="zstd", asbytes=True), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).reshape(-1)
