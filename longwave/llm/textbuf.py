"""Vectorised text primitives over Arrow string buffers.

A batch of texts is handled as one byte array plus offsets, cut into slices of a bounded number of
bytes, so that no Python string is made per row or per word.  A single text longer than the bound
gets a slice of its own: texts are always processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_TABLE = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: ASCII A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def plainly(docs: DataFrame, kept: list[str], **more: Column) -> DataFrame:
    """The kept columns of docs as c0, c1, ..., then others: names that functions over batches look up safely, whatever docs calls its own."""
    return docs.select(*(F.col(f"`{c.replace('`', '``')}`").alias(f"c{k}") for k, c in enumerate(kept)), *(v.alias(k) for k, v in more.items()))


def class_table(is_member) -> np.ndarray:
    """A 256-entry boolean table of a byte predicate."""
    return np.array([bool(is_member(b)) for b in range(256)])


#: Bytes of words that are delimited by ASCII white space only.
NOT_SPACE = class_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)


def slices(column, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) of a string column; null texts have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    n = len(column)
    if not n:
        return
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1))
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(buf: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of member bytes; no run crosses a text."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    w = member[buf]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    full = offsets[1:] > offsets[:-1]
    begin, end = offsets[:-1][full], offsets[1:][full] - 1
    first[begin], last[end] = w[begin], w[end]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, "right") - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > _POW.get("n", (0,))[0]:
        size = max(n, SLICE_BYTES + 1)
        up = np.full(size, _ODD, np.uint64)
        down = np.full(size, pow(_ODD, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POW["n"], _POW["p"] = (size,), (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return _POW["p"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift-multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from one prefix sum over the buffer."""
    up, down = _powers(len(buf) + 1)
    prefix = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLE[buf] * up[: len(buf)], out=prefix[1:])
    length = (end - start).astype(np.uint64)
    return mix((prefix[end] - prefix[start]) * down[start] + length * np.uint64(0xD6E8FEB86659FD93))


def chained(parts: list[np.ndarray]) -> np.ndarray:
    """The hash of a sequence of hashes, element by element."""
    out = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + part + np.uint64(0x632BE59BD9B4E019))
    return out


def sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums by group of doubles."""
    return np.bincount(group, weights=values, minlength=n)[:n]
