"""Which 64-bit keys of a corpus are there more than once, and joins with what a few of them share.

Nearly all keys of a corpus are unique, and shuffling them all only to count them would cost more than the texts.  Instead,
each task sends sorted, packed 32-bit fingerprints by slice of the key space; a slice's fingerprints that come at
least twice mark cells of a bitmap of fixed size.  A bitmap may let through more than it must, never less:
what passes is counted exactly afterwards, and then few rows are left.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longwave.llm.durable import members, membership

#: Cells of the bitmap, as a power of two.
CELL_BITS = 26
#: About so many keys go into one slice of the key space, and at most so many are packed at a time.
SLICE_KEYS = 1 << 22
#: A key with more than one part in so many of all rows is dealt to several tasks.
PARTS = 1000


def packed(keys: np.ndarray, slice_bits: int) -> Iterator[tuple[int, bytes]]:
    """The keys' slices and, packed, the 32 bits that follow in each; what is there more than twice, twice."""
    keys = np.sort(keys.view(np.uint64)) >> np.uint64(32 - slice_bits)
    keep = np.ones(len(keys), bool)
    keep[2:] = keys[2:] != keys[:-2]
    keys = keys[keep]
    cut = np.searchsorted(keys >> np.uint64(32), np.arange((1 << slice_bits) + 1, dtype=np.uint64))
    low = keys.astype(np.uint32)
    for k in np.flatnonzero(np.diff(cut)).tolist():
        steps = np.diff(low[cut[k] : cut[k + 1]], prepend=np.uint32(0))
        yield k, steps.view(np.uint8).reshape(-1, 4).T.tobytes()  # by planes, of which the upper ones compress well


def unpacked(blob: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view(np.uint32)[:, 0]
    return np.cumsum(steps, dtype=np.uint32)


def repeated(docs: DataFrame, keys: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], expected: float) -> np.ndarray:
    """A bitmap for :func:`may_repeat`; keys makes arrays of keys from batches of docs, about ``expected`` in all."""
    slice_bits = min(20, max(4, math.ceil(math.log2(max(1.0, expected / SLICE_KEYS)))))

    def pack(batches):
        held, count = [], 0

        def out():
            made = list(packed(np.concatenate(held), slice_bits)) if count else []
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.int32()), pa.array([b for _, b in made], pa.binary())], ["slice", "packed"])

        for key in keys(batches):
            held.append(key)
            count += len(key)
            if count >= SLICE_KEYS:
                yield from out()
                held, count = [], 0
        yield from out()

    def twice(table: pa.Table) -> pa.Table:
        found = np.sort(np.concatenate([unpacked(b.as_buffer()) for b in table["packed"]]))
        cells = np.unique(found[1:][found[1:] == found[:-1]]).astype(np.int64) + (table["slice"][0].as_py() << 32)
        return pa.table({"cell": pa.array(np.unique(cells >> (32 + slice_bits - CELL_BITS)))})

    return membership(docs.mapInArrow(pack, "slice int, packed binary").groupBy("slice").applyInArrow(twice, "cell long"), "cell", CELL_BITS)


def may_repeat(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return members(bitmap, (keys.view(np.uint64) >> np.uint64(64 - CELL_BITS)).view(np.int64))


def join_counted(rows: DataFrame, found: DataFrame, keys: Sequence[str], count: str, spread: Column) -> DataFrame:
    """rows joined with found (a row per key, with the number of rows it will meet), very common keys dealt to several tasks.

    Keys with more than one part in ``PARTS`` of the counted rows are fewer than ``PARTS``, so that a broadcast of them alone
    is small whatever the data; spread deals a key's rows.
    """
    total = found.agg(F.sum(count)).first()[0] or 0
    shares = F.greatest(F.lit(1), F.ceil(F.col(count) * (PARTS / max(1, total))).cast("int"))
    common = found.where(F.col(count) * PARTS > total).select(*keys, shares.alias("__shares"))
    dealt = rows.join(F.broadcast(common), list(keys), "left").withColumn("__share", F.coalesce(F.pmod(F.xxhash64(spread), F.col("__shares")), F.lit(0)).cast("int")).drop("__shares")
    copied = found.withColumn("__share", F.explode(F.sequence(F.lit(0), shares - 1)))
    return dealt.join(copied, [*keys, "__share"]).drop("__share")
