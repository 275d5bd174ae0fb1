"""Near duplicates by Jaccard similarity of word n-gram sets, exactly, by partitioning the universe.

Words are runs of bytes other than ASCII white space, with A-Z lower-cased; a text's set holds the 64-bit
hashes of its distinct shingles of ``words`` words (a text of fewer words: of the whole sequence).

* Size bands: two sets that link are in one band or in neighbouring ones.  A band fixes the most
  elements H by which two linking sets, the larger in this band, can differ.
* The hash universe is cut into segments.  A segment has level 1 (sets agree in it: one key, the hash of
  the segment's subset) or level 2 (they differ in at most one element: the key of the subset and those of
  its one-deletion neighbourhood).  If the levels add up to more than H, linking sets share a key.
* Allocation: how many segments of each level a band has is the cheapest of several choices by keys to
  write plus unrelated sets met, which grow with the band's number of sets (counted over all documents).
* Keys that one set alone has are told apart by 32-bit fingerprints of a key's slice of the key space, packed,
  sorted and counted; only keys whose fingerprint repeats are written out.  Keys that exactly the same sets
  share make one group.
* Pairs of a group are first tested on parity sketches, a few bits per element: sets differ in at least as
  many elements as their sketches in bits, so that a pair whose sketches differ too much cannot link.
  What passes is verified on whole texts, in bins of bounded size.
* Every member of a group is first tested against the group's pivot (the set that meets most others in its groups), and verified against
  the nearest of its pivots, then against those others that it is not connected with yet.  Groups that the links found
  connect are done.  In what is left, members that are not connected are tested in cells of two blocks of
  a bounded number of sketches.  A cell gives back the few most similar pairs of each component that pass and are
  not tried yet, more in every round, until no cell keeps any back; so families that links connect early cost little, and no
  pair that can link is left out unless it is connected already.  Links make the components.

Sets that are equal (by a 64-bit digest) are one node from the start, so that copies are never paired.

Defined results: null or empty texts and texts without words have an empty set and link with nothing
(n_shingles 0, component_id the own doc_id).  Repeated rows are copies of each other.  Rows that share a
doc_id but not a text are separate sets.  Null ids do not count as a component's smallest id.  Texts are
read whole.  Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longwave.llm import textbuf as tb
from longwave.llm.durable import components, discard, durable, may_hold, members, membership
from longwave.llm.repeats import join_counted, may_repeat, repeated

#: The share of elements that unrelated sets of a band are taken to have in common, for costs only.
SHARED = 0.01
#: Cells (as powers of two) of the bitmaps that keep unneeded sets and rows from being shuffled.
NODE_BITS, ROW_BITS = 24, 24
#: A block of a group has about so many sets; a cell holds two blocks.
CELL_SETS = 2048
#: Bits of a sketch per element, at least.
SKETCH = 4
#: Pairs that a component tries at a time in the largest groups alone, and then in the first round of all.
FIRST_TRIED, LEAST_TRIED = 8, 32
#: A bin of texts to verify has about so many shingles, besides those of one more pivot and block.
BIN_ELEMENTS = 1 << 20

#: From shingle hashes, where sets begin in them, and the numbers of sets to work on: keys, and the numbers of their sets.
Keys = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]

_PAIRS = "key long, i int, j int, a long, b long, na long, nb long, more long"
_SEGMENT, _BAND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class Band(NamedTuple):
    low: int
    top: int
    ones: int  # segments of level 1; the segments of level 2 come first
    twos: int
    spare: int  # a set keeps silent about empty segments of up to so many levels


def _difference(top: int, num: int, den: int) -> int:
    return 2 * top * (den - num) // (den + num)


def band_edges(longest: int, num: int, den: int) -> list[tuple[int, int]]:
    """(smallest, largest) sizes of the bands, up to one band over the longest set's."""
    out, low = [], 1
    while not out or out[-1][0] <= longest:
        top = max(low, -(-low * den // num) - 1)
        out.append((low, top))
        low = top + 1
    return out


def allocate(low: int, top: int, below: int, sets: int, num: int, den: int) -> Band:
    """The cheapest numbers of segments for pairs whose larger set has low to top elements."""
    most = _difference(top, num, den)
    if most == 0 or sets < 2:
        return Band(low, top, 0, 0, 0)
    best: tuple[float, Band] | None = None
    for share in (0.0, 0.25, 0.5, 0.75, 1.0):
        spare = 1
        for _ in range(3):
            need = most + 1 + spare * (2 if share else 1)
            twos = math.ceil(share * need / 2)
            ones = max(0, need - 2 * twos)
            width = below / (ones + twos)
            spare = 1 + math.ceil(1.5 * (ones + 2 * twos) * math.exp(-width))
        need = most + 1 + spare * (2 if share else 1)
        twos = math.ceil(share * need / 2)
        ones = max(0, need - 2 * twos)
        width = (low + top) / 2 / (ones + twos)
        # Unrelated sets meet where they have a common element and no others (or, at level 2, one other).
        apart, some = 2 * width * (1 - SHARED), -math.expm1(-width * SHARED)
        met = sets * some * math.exp(-apart) * (ones + twos * (1 + apart))
        cost = ones + twos * (1 + width) + met
        if best is None or cost < best[0]:
            best = (cost, Band(low, top, ones, twos, spare))
    return best[1]


def _distinct(bands: list[tuple[int, int, int]]) -> int:
    """How many sets bands of (estimate, smallest, largest node) hold: estimated, but exact in whether there are two."""
    if not bands or min(b[1] for b in bands) == max(b[2] for b in bands):
        return len(bands[:1])
    return max(2, sum(b[0] for b in bands))


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and where each text's begin."""
    n = len(offsets) - 1
    lowered = tb.LOWER[buf]
    start, end, doc = tb.spans(lowered, offsets, tb.NOT_SPACE)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    word = tb.span_hashes(lowered, start, end)
    count = np.bincount(doc, minlength=n)
    hashes, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(word) >= words:
        inside = doc[words - 1 :] == doc[: len(doc) - words + 1]
        hashes = tb.chained([word[k : len(word) - words + 1 + k][inside] for k in range(words)])
        owner = doc[: len(doc) - words + 1][inside]
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        first = np.searchsorted(doc, short)
        whole = [tb.chained([word[f + k : f + k + 1] for k in range(count[d])] + [np.array([count[d]], np.uint64)])[0] for d, f in zip(short, first, strict=True)]
        hashes, owner = np.append(hashes, np.array(whole, np.uint64)), np.append(owner, short)
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    cut = np.searchsorted(owner, np.arange(n + 1))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        hashes[a:b].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], np.searchsorted(owner[fresh], np.arange(n + 1))


def _group_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else np.zeros(0, np.uint64)


def nodes_of(hashes: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A digest of each set (0 for empty ones, which have no node)."""
    size = np.diff(cut)
    full = np.flatnonzero(size)
    out = np.zeros(len(size), np.int64)
    out[full] = tb.mix(_group_sums(tb.mix(hashes), cut[:-1][full]) ^ (size[full].astype(np.uint64) * np.uint64(_BAND))).view(np.int64)
    return out


def keys_of(hashes: np.ndarray, cut: np.ndarray, of: np.ndarray, plan: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the sets ``of``, in the scheme of their own band and of the next: keys, set numbers."""
    size = np.diff(cut)
    keys, owners = [], []
    marked = tb.mix(hashes)
    own = np.searchsorted(plan["low"], size, "right") - 1
    for step in (0, 1):
        band = np.minimum(own + step, len(plan["low"]) - 1)
        use = of[(plan["ones"][band[of]] + plan["twos"][band[of]] > 0)]
        if not len(use):
            continue
        take = np.concatenate([np.arange(cut[d], cut[d + 1]) for d in use])
        who = np.repeat(np.arange(len(use)), size[use])
        ones, twos = plan["ones"][band[use]], plan["twos"][band[use]]
        total = ones + twos
        segment = ((hashes[take] >> np.uint64(32)) * total[who].astype(np.uint64)) >> np.uint64(32)
        fresh = np.ones(len(take), bool)
        fresh[1:] = (segment[1:] != segment[:-1]) | (who[1:] != who[:-1])
        first = np.flatnonzero(fresh)
        run = np.cumsum(fresh) - 1
        sums = _group_sums(marked[take], first)
        run_who, run_segment = who[first], segment[first]
        place = lambda s, w: tb.mix(s.astype(np.uint64) * np.uint64(_SEGMENT) + band[use][w].astype(np.uint64) * np.uint64(_BAND))
        run_place = place(run_segment, run_who)
        keys.append(tb.mix(sums + run_place))
        owners.append(use[run_who])
        double = run_segment < twos[run_who].astype(np.uint64)
        pick = np.flatnonzero(double[run])
        if len(pick):
            keys.append(tb.mix(sums[run[pick]] - marked[take][pick] + run_place[run[pick]]))
            owners.append(use[who[pick]])
        seen_twos = np.bincount(run_who[double], minlength=len(use))
        seen_ones = np.bincount(run_who[~double], minlength=len(use))
        void = 2 * (twos - seen_twos) + ones - seen_ones
        for w in np.flatnonzero(void > plan["spare"][band[use]]):
            missing = np.setdiff1d(np.arange(total[w], dtype=np.uint64), run_segment[run_who == w])
            keys.append(tb.mix(place(missing, np.full(len(missing), w))))
            owners.append(np.full(len(missing), use[w]))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys).view(np.int64), np.concatenate(owners)


def _sets(batches: Iterator[pa.RecordBatch], words: int):
    for batch in batches:
        for lo, hi, buf, offsets in tb.slices(batch.column("text")):
            hashes, cut = shingle_sets(buf, offsets, words)
            yield batch, lo, hi, hashes, cut, nodes_of(hashes, cut)


def sketches_of(hashes: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches: 64-bit words, one set after another, and where each set's begin.

    A set of n elements has the least power of two of words with SKETCH n bits or more (an empty set: none); a bit is the parity of
    the number of elements that fall on it.  Halves of a sketch combined by XOR are the sketch of half the size.
    """
    size = np.diff(cut)
    words = np.where(size > 0, 1 << np.ceil(np.log2(np.maximum(1, -(-SKETCH * size // 64)))).astype(np.int64), 0)
    place = np.concatenate(([0], np.cumsum(words)))
    bit = (hashes & np.repeat((words * 64 - 1).astype(np.uint64), size)).astype(np.int64) + 64 * np.repeat(place[:-1], size)
    odd = (np.bincount(bit, minlength=64 * int(place[-1])) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64), place


def _first_of_copies(node: np.ndarray, size: np.ndarray, rows: np.ndarray, firsts: np.ndarray, seen: set[int]) -> np.ndarray:
    """Numbers of the non-empty sets to work on: of copies, that whose row the bitmap ``firsts`` holds, once in a task."""
    out = []
    for k in np.flatnonzero((size > 0) & members(firsts, rows)).tolist():
        x = int(node[k])
        if x not in seen:
            seen.add(x)
            out.append(k)
    return np.array(out, np.int64)


def _describe(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for batch, lo, hi, hashes, cut, node in _sets(batches, words):
            size = np.diff(cut)
            sketch, place = sketches_of(hashes, cut)
            lists = pa.ListArray.from_arrays(place.astype(np.int32), pa.array(sketch))
            columns = [*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "row")), pa.array(size), pa.array(node, mask=size == 0), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n", "node", "sketch"])

    return docs.mapInArrow(run, "doc_id long, row long, n long, node long, sketch array<long>")


def _keys_by_set(docs: DataFrame, words: int, make: Keys, firsts: np.ndarray):
    """A function from batches of docs to (keys, owners, nodes), each set once, but for copies that bitmaps do not tell apart."""
    shared = docs.sparkSession.sparkContext.broadcast(firsts)

    def keys(batches):
        firsts = shared.value
        seen: set[int] = set()
        for batch, lo, hi, hashes, cut, node in _sets(batches, words):
            rows = np.asarray(batch.column("row").slice(lo, hi - lo))
            yield *make(hashes, cut, _first_of_copies(node, np.diff(cut), rows, firsts, seen)), node

    return keys


def _shared_keys(docs: DataFrame, keys, wanted: np.ndarray) -> DataFrame:
    """(key, node) for the keys that the bitmap may hold."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        for key, owner, node in keys(batches):
            keep = may_repeat(shared.value, key)
            key, owner = key[keep], owner[keep]
            for k in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(key[k : k + (1 << 16)]), pa.array(node[owner[k : k + (1 << 16)]])], ["key", "node"])

    return docs.mapInArrow(run, "key long, node long").distinct()


def _can_link(na, nb, differ, num: int, den: int):
    """Whether sets of na and nb elements that differ in at least ``differ`` can link (numbers, arrays or columns)."""
    return (na + nb - differ) * (den + num) >= (na + nb) * (2 * num)


def _differ(x: Column, y: Column, halvings: int) -> Column:
    """In how many bits two sketches differ; the larger is halved, at most so many times, until they are of one size."""

    def halved(s: Column, other: Column) -> Column:
        half = (F.size(s) / 2).cast("int")
        folded = F.zip_with(F.slice(s, F.lit(1), half), F.slice(s, half + 1, half), lambda a, b: a.bitwiseXOR(b))
        return F.when(F.size(s) > F.size(other), folded).otherwise(s)

    for _ in range(halvings):
        x, y = halved(x, y), halved(y, x)
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda t, v: t + v)


def _folded(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sketches as rows of a matrix, all halved to the smallest size among them."""
    least = int(size.min())
    out = np.zeros((len(size), least), np.uint64)
    for words in np.unique(size).tolist():
        rows = np.flatnonzero(size == words)
        whole = flat[begin[rows][:, None] + np.arange(words)]
        out[rows] = np.bitwise_xor.reduce(whole.reshape(len(rows), words // least, least), axis=1)
    return out


def _cells(num: int, den: int, most: int):
    """Of the pairs within cells whose sketches let them link, which are neither connected nor tried, the ``most`` closest of each component."""

    def run(table: pa.Table, tried: pa.Table) -> pa.Table:
        order = np.lexsort([np.asarray(table[c]) for c in ("node", "j", "i", "key")])
        key, i, j, node, root, n = (np.asarray(table[c])[order] for c in ("key", "i", "j", "node", "root", "n"))
        lists = table["sketch"].combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        size = np.asarray(lists.value_lengths()).astype(np.int64)
        flat, begin = np.asarray(lists.flatten()).view(np.uint64), (np.cumsum(size) - size)[order]
        size = size[order]
        known = {}
        for *cell, x, y in zip(*(tried[c].to_pylist() for c in ("key", "i", "j", "a", "b")), strict=True):
            known.setdefault(tuple(cell), []).append((x, y))
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        edges = np.append(np.flatnonzero(fresh[: len(key)]), len(key))
        found = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if (root[a:b] == root[a]).all():
                continue
            rows, own, size_of = _folded(flat, begin[a:b], size[a:b]), root[a:b], n[a:b]
            past = known.get((int(key[a]), int(i[a]), int(j[a])), [])
            place = np.searchsorted(node[a:b], np.array(past, np.int64).reshape(-1, 2))
            codes = np.concatenate((place[:, 0] * (b - a) + place[:, 1], place[:, 1] * (b - a) + place[:, 0]))
            step, best, more = max(1, (1 << 21) // (len(rows) * rows.shape[1])), np.zeros((3, 0)), False
            for k in range(0, b - a, step):
                differ = np.bitwise_count(rows[k : k + step, None, :] ^ rows[None, :, :]).sum(axis=2, dtype=np.int64)
                both = size_of[k : k + step, None] + size_of[None, :]
                x, y = np.nonzero(_can_link(size_of[k : k + step, None], size_of[None, :], differ, num, den) & (own[k : k + step, None] != own[None, :]))
                if len(codes) and len(x):
                    left = ~np.isin((k + x) * (b - a) + y, codes)
                    x, y = x[left], y[left]
                best = np.concatenate((best, np.stack([k + x, y, differ[x, y] / both[x, y]])), axis=1)
                # The closest pairs of each component, seen from it.
                ranked = np.lexsort((best[1], best[0], best[2], own[best[0].astype(np.int64)]))
                best = best[:, ranked]
                of = own[best[0].astype(np.int64)]
                kept = np.arange(len(of)) - np.searchsorted(of, of) < most
                best, more = best[:, kept], more or not kept.all()
            x, y = best[:2].astype(np.int64)
            x, y = np.minimum(x, y), np.maximum(x, y)
            pairs = np.unique(np.stack([x, y]), axis=1)
            x, y = pairs + a
            found.append(np.stack([key[x], i[x], j[x], node[x], node[y], n[x], n[y], np.full(len(x), int(more))]))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((8, 0), np.int64)
        columns = [pa.array(c) for c in pairs]
        return pa.table([columns[0], columns[1].cast(pa.int32()), columns[2].cast(pa.int32()), *columns[3:]], names=["key", "i", "j", "a", "b", "na", "nb", "more"])

    return run


def _texts(docs: DataFrame, words: int, wanted: np.ndarray, firsts: np.ndarray) -> DataFrame:
    """(node, text) of the sets that the bitmap may hold."""
    shared = docs.sparkSession.sparkContext.broadcast((wanted, firsts))

    def run(batches):
        wanted, firsts = shared.value
        seen: set[int] = set()
        for batch, lo, hi, _, cut, node in _sets(batches, words):
            rows = np.asarray(batch.column("row").slice(lo, hi - lo))
            keep = _first_of_copies(node, np.where(members(wanted, node), np.diff(cut), 0), rows, firsts, seen)
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array(node[keep]), batch.column("text").take(pa.array(keep + lo))], ["node", "text"])

    return docs.mapInArrow(run, "node long, text string").dropDuplicates(["node"])


def _links_of(words: int, num: int, den: int):
    """The pairs of a bin that link: rows (a, node, text), where the row of a's own text has node a."""

    def run(table: pa.Table) -> pa.Table:
        a, node = np.asarray(table["a"]), np.asarray(table["node"])
        sets: list[np.ndarray] = []
        for _, _, buf, offsets in tb.slices(table["text"]):
            hashes, cut = shingle_sets(buf, offsets, words)
            sets += [hashes[x:y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        own = {int(node[k]): sets[k] for k in np.flatnonzero(a == node).tolist()}
        linked = []
        for k in np.flatnonzero(a != node).tolist():
            x, y = own[int(a[k])], sets[k]
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            if int((y[at] == x).sum()) * (den + num) >= num * (len(x) + len(y)):
                linked.append(k)
        return pa.table({"a": pa.array(a[linked]), "b": pa.array(node[linked])})

    return run


class _Texts:
    """The texts of sets by node; each is looked up among the documents once, and written once, however often it is asked for."""

    def __init__(self, docs: DataFrame, words: int, firsts: np.ndarray):
        self.docs, self.words, self.firsts, self.known = docs, words, firsts, []

    def _all(self) -> DataFrame:
        return functools.reduce(DataFrame.unionAll, self.known)

    def of(self, nodes: DataFrame) -> DataFrame:
        """(node, text) of at least these distinct nodes."""
        missing = durable(nodes.join(self._all().select("node"), "node", "left_anti") if self.known else nodes)
        wanted = membership(missing, "node", NODE_BITS)
        discard(missing)
        if wanted.any() or not self.known:
            more = _texts(self.docs, self.words, wanted, self.firsts)
            # The bitmap lets others through, some of which are known.
            self.known.append(durable(more.join(self._all().select("node"), "node", "left_anti") if self.known else more))
        return self._all()


def _verified(texts: _Texts, pairs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The (a, b) of pairs (a, b, na, nb) that link, as a durable table; each pair is compared on whole texts."""
    pairs = durable(pairs)
    involved = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    weights = pairs.groupBy("a").agg(F.max("na").alias("na"), F.sum("nb").alias("weight"))
    blocks = durable(weights.select("a", "na", "weight", F.ceil(F.col("weight") / BIN_ELEMENTS).cast("int").alias("blocks")))
    bins = 1 + int((blocks.agg(F.sum(F.col("na") * F.col("blocks") + F.col("weight"))).first()[0] or 0) // BIN_ELEMENTS)
    binned = lambda df: df.select("node", "a", F.pmod(F.xxhash64("a", "block"), F.lit(bins)).alias("bin"))
    others = pairs.join(blocks.select("a", "blocks"), "a").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"))
    pivots = blocks.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"))
    dealt = texts.of(involved).join(binned(others).unionAll(binned(pivots)), "node")
    links = durable(dealt.groupBy("bin").applyInArrow(_links_of(words, num, den), "a long, b long"))
    discard(pairs, blocks)
    return links


def _plan(sized: DataFrame, num: int, den: int) -> tuple[dict[str, np.ndarray], float]:
    """The allocation by band, and about how many keys it makes."""
    longest = sized.agg(F.max("n")).first()[0] or 0
    edges = band_edges(longest, num, den)
    lows = F.array(*(F.lit(low) for low, _ in edges))
    band_of = F.size(F.filter(lows, lambda x: x <= F.col("n"))).alias("band")
    counts = sized.where("n > 0").select("node", "n", band_of).groupBy("band").agg(
        F.approx_count_distinct("node").alias("count"), F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("rows"), F.sum("n").alias("elements")
    ).collect()
    found = {r["band"]: (r["count"], r["least"], r["most"]) for r in counts}
    near = [[found[x] for x in (k, k + 1) if x in found] for k in range(len(edges))]
    bands = [allocate(low, top, edges[max(k - 1, 0)][0], _distinct(near[k]), num, den) for k, (low, top) in enumerate(edges)]
    plan = {"low": np.array([b.low for b in bands]), "ones": np.array([b.ones for b in bands]), "twos": np.array([b.twos for b in bands]), "spare": np.array([b.spare for b in bands])}
    schemes = [(r, bands[k]) for r in counts for k in (r["band"] - 1, min(r["band"], len(bands) - 1))]
    return plan, sum(r["rows"] * (b.ones + b.twos) + r["elements"] * b.twos / max(1, b.ones + b.twos) for r, b in schemes)


def _groups(docs: DataFrame, keys, expected: float) -> DataFrame | None:
    """(key, node, pivot, held) for one key of each different collection of sets that share a key; None if there are none."""
    wanted = repeated(docs, lambda batches: (key for key, _, _ in keys(batches)), expected)
    if not wanted.any():
        return None
    # From here on, rows are in proportion to the documents that share a key with another set.
    rows = durable(_shared_keys(docs, keys, wanted))
    by_key = rows.groupBy("key").agg(
        F.count("*").alias("held"), F.min("node").alias("least"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")
    )
    kept = durable(by_key.where("held > 1").groupBy("held", "least", "x", "y").agg(F.min("key").alias("key")).select("key", "held"))
    groups = durable(join_counted(rows, kept, ["key"], "held", F.col("node")).select("key", "node", "held"))
    discard(rows, kept)
    # The pivot is the set that meets most others: of a family that was made from one text, most likely that text.
    met = groups.groupBy("node").agg(F.sum("held").alias("met"))
    pivots = groups.join(met, "node").groupBy("key").agg(F.max_by("node", F.struct("met", "node")).alias("pivot"), F.first("held").alias("held"))
    pivots = durable(pivots)
    with_pivots = durable(join_counted(groups.select("key", "node"), pivots, ["key"], "held", F.col("node")).select("key", "node", "pivot", "held"))
    discard(groups, pivots)
    return with_pivots


def universe_partition(sized: DataFrame, num: int, den: int) -> tuple[Keys, float]:
    """The keys of the sets by segments of the universe, and about how many there will be."""
    plan, expected = _plan(sized, num, den)
    return lambda hashes, cut, of: keys_of(hashes, cut, of, plan), expected


def _roots(docs: DataFrame, sized: DataFrame, words: int, num: int, den: int, scheme) -> DataFrame | None:
    """(node, root) of the sets that link with another, as a durable table; None if no two sets share a key."""
    make, expected = scheme(sized, num, den)
    firsts = membership(sized.where("node IS NOT NULL").groupBy("node").agg(F.min("row").alias("row")), "row", ROW_BITS)
    groups = _groups(docs, _keys_by_set(docs, words, make, firsts), expected)
    if groups is None:
        return None
    # Only the sketches of sets in groups are shuffled.
    grouped = durable(groups.select("node").distinct())
    near_groups = sized.where(may_hold(docs.sparkSession, membership(grouped, "node", NODE_BITS), F.col("node")))
    sets = durable(near_groups.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")).join(grouped, "node", "left_semi"))
    discard(grouped)
    named = lambda side: sets.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"sketch{side}"))
    # A member of a group and its pivot.
    pairs = groups.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    pivots = durable(pairs.groupBy("a").agg(F.count("*").alias("times")).join(named("a"), "a"))
    met = join_counted(pairs.join(named("b"), "b"), pivots, ["a"], "times", F.col("b"))
    differ = _differ(F.col("sketcha"), F.col("sketchb"), 1 + math.ceil(2 * math.log2(den / num)))
    near = durable(met.select("a", "b", "na", "nb", differ.alias("differ")).where(_can_link(F.col("na"), F.col("nb"), F.col("differ"), num, den)))
    discard(pivots)
    nearest = near.groupBy("b").agg(F.min_by(F.struct("a", "na", "nb"), F.struct("differ", "a")).alias("p")).select("p.a", "b", "p.na", "p.nb")
    texts = _Texts(docs, words, firsts)
    links = _verified(texts, nearest, words, num, den)
    roots = components(links)

    def with_more(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The links, and the components they make, with those of further pairs."""
        further = _verified(texts, pairs, words, num, den)
        if further.isEmpty():
            discard(further)
            return links, roots
        both = durable(links.unionAll(further))
        discard(links, further, roots)
        return both, components(both)

    # Pivots that passed but were not the nearest.
    root_of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root{side}"))
    passed = near.join(nearest.select("a", "b"), ["a", "b"], "left_anti").join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    passed = durable(passed.where(F.coalesce("roota", "a") != F.coalesce("rootb", "b")).select("a", "b", "na", "nb"))
    # Members other than pivots: all that are not connected yet, in cells.
    left = durable(groups.where("held > 2 AND node <> pivot").select("key", "node", "held"))
    tried = durable(docs.sparkSession.createDataFrame([], "key long, i int, j int, a long, b long"))
    most, first, told = LEAST_TRIED, True, None
    while True:
        placed = left.select("key", "node", "held").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("top")).where("low < top").select("key")
        if told is not None:
            # Cells that had nothing have nothing later either.
            mixed = mixed.join(told, "key", "left_semi")
        rest = durable(placed.join(mixed, "key", "left_semi").select("key", "node", "held", "root"))
        discard(told)
        if first:
            # The largest group of each member first: what links there need not be found again in many groups alike.
            largest = rest.groupBy("node").agg(F.max_by("key", F.struct("held", "key")).alias("key")).select("key").distinct()
            # Groups that the links have connected are done for good.
            open_groups, rest = rest, durable(rest.join(largest, "key", "left_semi"))
        bins = 1 + (rest.agg(F.sum(F.ceil(F.col("held") / CELL_SETS))).first()[0] or 0) // CELL_SETS
        dealt = lambda df: df.withColumn("bin", F.pmod(F.xxhash64("key", "i", "j"), F.lit(bins)))  # noqa: B023, E731
        blocks = rest.withColumn("blocks", F.ceil(F.col("held") / CELL_SETS).cast("int"))
        blocks = blocks.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        cells = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = cells.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "root").join(sets, "node")
        both = dealt(cells).groupBy("bin").cogroup(dealt(tried).groupBy("bin"))
        found = durable(both.applyInArrow(_cells(num, den, FIRST_TRIED if first else most), _PAIRS))
        pairs = found.select("a", "b", "na", "nb")
        more = durable((pairs.unionAll(passed) if first else pairs).distinct())
        if not more.isEmpty():
            links, roots = with_more(more)
        if not first and found.where("more > 0").isEmpty():
            # No cell has kept a pair back.
            discard(rest, found, more)
            break
        tried_now = durable(tried.unionAll(found.select(*tried.columns)))
        discard(left, more, tried)
        if first:
            left, told = open_groups, None
            discard(rest)
        else:
            left, told, most = rest, durable(found.select("key").distinct()), most * 64
        discard(found)
        tried, first = tried_now, False
    discard(groups, sets, near, passed, links, left, tried, *texts.known)
    return roots


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, scheme: Callable[[DataFrame, int, int], tuple[Keys, float]] = universe_partition) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Two documents link if den * |common| >= num * |union|; a component is what links connect.  ``scheme`` makes the keys of which
    linking sets share one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.col("doc_id").cast("long")).alias("row"))
    sized = durable(_describe(docs, words))
    roots = _roots(docs, sized, words, num, den, scheme)
    classes = sized.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    if roots is not None:
        placed = classes.join(roots, "node", "left").select("node", "least", "copies", F.coalesce("root", "node").alias("root"))
        smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
        placed, smallest = durable(placed), durable(smallest)
        classes = join_counted(placed, smallest, ["root"], "members", F.col("node")).select("node", "copies", "component_id")
    else:
        classes = classes.withColumnRenamed("least", "component_id")
    classes = durable(classes)
    if roots is not None:
        discard(roots, placed, smallest)
    # A row of its own for each copy: classes of very many copies are dealt to several tasks.
    found = join_counted(sized.where("node is not null").select("doc_id", "n", "node"), classes, ["node"], "copies", F.col("doc_id")).select("doc_id", "n", "component_id")
    found = durable(found.unionAll(sized.where("node is null").select("doc_id", "n", F.lit(None).cast("long"))))
    discard(sized, classes)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def oracle_sql(words: int, num: int, den: int, more: str = "") -> str:
    """The same by brute force in SQL: every two sets that share a shingle are compared."""
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + {words - 1}], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {words - 1}, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN c u ON u.doc_id = x JOIN c v ON v.doc_id = y WHERE {den} * k >= {num} * (u.n + v.n - k)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM c UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, n_shingles, component_id{more} FROM (
  SELECT w.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, coalesce(component_id, w.doc_id) AS component_id
  FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN least ON least.x = w.doc_id
)
"""
