"""Near duplicates by SuperMinHash signatures: banding, exact verification, connected components.

* Signature: each element of a set draws, from its own hash, a random permutation of the slots and a number for each of its ranks.  At rank j it
  bids j plus that number for its j-th slot; the lowest bid of all elements makes the slot's value.  The ranks of one element are a permutation,
  which spreads its bids evenly and lowers the variance against independent hashes.  A set stops as soon as no slot is empty: later
  ranks bid more.  Large sets stop after one or two ranks.
* Bands: sets that agree in a band of ROWS slots share a key.  With 32 bands of 4, a pair of Jaccard 0.8 shares none with a probability of 5e-8.
* What shares a key is verified on full sets and grouped as in :mod:`longwave.llm.jaccard`: each member of a bucket against its pivot, then in bounded cells
  until all that can link is connected or compared; equal sets count once; links are merged by rounds of stars (a union-find in parallel).

Defined results: null or empty texts and texts without words have an empty set and link with nothing (n_shingles 0, component_id the own doc_id, kept).
Repeated rows are copies of each other, and are kept or not alike; rows that share a doc_id but not a text are separate sets.  Rows without id are not kept if they
link with a row that has one (component_id is its), else their component_id is null and they are kept.  Texts are read whole.  Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longwave.llm import jaccard
from longwave.llm import textbuf as tb

BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
#: Bits of the random number below a rank.
_BELOW = 40
_EMPTY = np.uint64(2**64 - 1)
_RANK, _BAND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Ranks for which an element's permutation is looked up among its few exchanges so far; after them it is written out.
_FEW = 8

ORACLE_SQL = jaccard.oracle_sql(words=4, num=80, den=100, more=", doc_id = component_id AS kept")


def _draw(hashes: np.ndarray, rank: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """The element's number for this rank, and with which place, rank or later, its permutation exchanges place ``rank``."""
    x = tb.mix(hashes + np.uint64((rank + 1) * _RANK & (2**64 - 1)))
    return x >> np.uint64(64 - _BELOW), rank + ((x & np.uint64(0xFFFFFF)) * np.uint64(slots - rank) >> np.uint64(24)).astype(np.int64)


def _held_at(place: np.ndarray | int, exchanged: list[np.ndarray], moved: list[np.ndarray], n: int) -> np.ndarray:
    """What the permutations hold at a place after the exchanges so far: what the last exchange with it has put there."""
    out = np.broadcast_to(place, n).copy()
    for k, v in zip(exchanged, moved, strict=True):
        at = k == place
        out[at] = v[at]
    return out


def signatures(hashes: np.ndarray, cut: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash values, a row for each set of distinct hashes (empty sets: all empty)."""
    sets = len(cut) - 1
    out = np.full(sets * slots, _EMPTY, np.uint64)
    of, live = np.repeat(np.arange(sets), np.diff(cut)), hashes
    exchanged: list[np.ndarray] = []
    moved: list[np.ndarray] = []
    order = None
    for rank in range(slots):
        if not len(live):
            break
        number, place = _draw(live, rank, slots)
        if rank < _FEW:
            slot, here = _held_at(place, exchanged, moved, len(live)), _held_at(rank, exchanged, moved, len(live))
            exchanged.append(place)
            moved.append(here)
        else:
            if order is None:
                order = np.tile(np.arange(slots, dtype=np.uint16), (len(live), 1))
                each = np.arange(len(live))
                for t, k in enumerate(exchanged):
                    order[each, k], order[:, t] = order[:, t].copy(), order[each, k].copy()
            each = np.arange(len(live))
            slot = order[each, place].astype(np.int64)
            order[each, place] = order[:, rank]
        at = of * slots + slot
        # A slot that has a value keeps it: its rank was lower.
        free = out[at] >= np.uint64(rank << _BELOW)
        np.minimum.at(out, at[free], number[free] + np.uint64(rank << _BELOW))
        if rank < slots - 1:
            open_sets = (out.reshape(sets, slots) == _EMPTY).any(axis=1)
            keep = open_sets[of]
            if not keep.all():
                of, live = of[keep], live[keep]
                exchanged, moved = [x[keep] for x in exchanged], [x[keep] for x in moved]
                order = None if order is None else order[keep]
    return out.reshape(sets, slots)


def band_keys(hashes: np.ndarray, cut: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the sets ``of``, one for each band, and the numbers of their sets."""
    size = np.diff(cut)[of]
    if not len(of):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = np.concatenate(([0], np.cumsum(size)))
    take = np.arange(own[-1]) + np.repeat(cut[of] - own[:-1], size)
    drawn = signatures(hashes[take], own)
    keys = [tb.mix(tb.chained([drawn[:, b * ROWS + r] for r in range(ROWS)]) + np.uint64((b + 1) * _BAND & (2**64 - 1))) for b in range(BANDS)]
    return np.stack(keys, axis=1).reshape(-1).view(np.int64), np.repeat(of, BANDS)


def _scheme(sized: DataFrame, num: int, den: int):
    return band_keys, float(BANDS * sized.where("node IS NOT NULL").agg(F.approx_count_distinct("node")).first()[0])


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept (whether it is its component's smallest id)."""
    found = jaccard.near_duplicates(docs, words, num, den, scheme=_scheme)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
