"""SentencePiece encoding by sampling, and decoding.

A text, with one blank put before it, is a lattice: nodes are byte positions, edges are the vocabulary's
pieces that stand there, and single-byte pieces where a character is no piece of its own.  Forward
filtering sums the weights of all paths to each node; backward sampling then draws one path from the end,
each edge with its exact conditional probability.  The random numbers follow from the row's key, the
seed and the place, so a row's segmentation is the same in every run, partitioning and order.

No piece of the supported vocabularies has a blank after another character, or a line feed; so the
lattice falls apart at those places into units whose weights multiply.  Units that are equal share one
forward pass; all units of a slice are filtered and sampled together, vectorised.

Edge weights are ``exp(alpha * score)``.  In a merge-ranked vocabulary (BPE), whose scores are negative
ranks, the logarithm of a Zipf law, -log(1 + rank), takes their place; byte pieces count as the last rank.

Defined results: a null text has null pieces and decodes to null; an empty one has no pieces and decodes
to the empty text.  Decoding gives the bytes of the text back, whatever they are: U+2581, which stands for
the blank in vocabularies, is encoded by bytes when a text itself holds it.  Rows of equal key and text get
equal pieces.  Texts are read whole.  Columns named like the result are replaced, others carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longwave.llm import textbuf as tb

#: Bytes of text that are sampled at once: their tables take some 200 bytes for each.
SLICE_BYTES = 1 << 18
BLANK = "▁"


class Vocabulary(NamedTuple):
    """What executors need of a model: a trie of piece bytes, log weights, and the bytes of every id."""

    step: np.ndarray  # (inner nodes + 1) x byte classes: the next node, -1 for none
    row_of: np.ndarray  # node -> row of step
    byte_class: np.ndarray
    piece_at: np.ndarray  # node -> id, -1 for none
    byte_piece: np.ndarray  # byte -> id
    weight: np.ndarray  # id -> log weight
    text: np.ndarray  # bytes of all ids, one after another
    text_at: np.ndarray
    longest: int


def load(model_file: str) -> Vocabulary:
    """Read a SentencePiece model with byte pieces, on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.get_piece_size()
    pieces: dict[bytes, int] = {}
    byte_piece = np.full(256, -1, np.int32)
    score, content = np.zeros(n), [b""] * n
    for i in range(n):
        if model.is_byte(i):
            value = int(model.id_to_piece(i)[1:-1], 16)
            byte_piece[value], content[i] = i, bytes([value])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            name = model.id_to_piece(i)
            content[i] = name.replace(BLANK, " ").encode()
            pieces.setdefault(content[i], i)
            score[i] = model.get_score(i)
            if BLANK in name.lstrip(BLANK) or "\n" in name:
                raise ValueError(f"piece {name!r} spans a place where units are cut")
    if (byte_piece < 0).any():
        raise ValueError("the vocabulary has no piece for some byte")
    normal = np.array(sorted(pieces.values()))
    ranked = np.all(score[normal] == np.round(score[normal])) and score[normal].min() < -100
    weight = -np.log1p(np.minimum(-score, n)) if ranked else score.copy()
    weight[byte_piece] = -np.log1p(n) if ranked else score[normal].min()
    byte_class = np.zeros(256, np.int64)
    used = sorted({b for p in pieces for b in p})
    byte_class[used] = np.arange(1, len(used) + 1)
    children: list[dict[int, int]] = [{}]
    piece_at = [-1]
    for content_bytes, i in pieces.items():
        at = 0
        for b in content_bytes:
            after = children[at].get(b)
            if after is None:
                after = children[at][b] = len(children)
                children.append({})
                piece_at.append(-1)
            at = after
        piece_at[at] = i
    inner = [k for k, c in enumerate(children) if c]
    row_of = np.full(len(children), len(inner), np.int32)
    row_of[inner] = np.arange(len(inner))
    step = np.full((len(inner) + 1, len(used) + 1), -1, np.int32)
    for r, k in enumerate(inner):
        for b, after in children[k].items():
            step[r, byte_class[b]] = after
    return Vocabulary(
        step, row_of, byte_class, np.array(piece_at, np.int32), byte_piece, weight, np.frombuffer(b"".join(content), np.uint8),
        np.concatenate([[0], np.cumsum([len(c) for c in content])]).astype(np.int64), max(map(len, pieces)),
    )


def _edges(buf: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pieces that stand in the units: start, end, id."""
    stop = np.repeat(offsets[1:], np.diff(offsets))
    classes = v.byte_class[buf]
    at = np.arange(len(buf))
    node = np.zeros(len(buf), np.int64)
    lead = (buf & 0xC0) != 0x80
    following = np.append(np.flatnonzero(lead), len(buf))
    width = np.zeros(len(buf), np.int64)
    width[following[:-1]] = np.diff(following)
    own = np.zeros(len(buf), bool)  # characters that are pieces
    at = at[lead]
    node = node[lead]
    found = []
    for depth in range(1, v.longest + 1):
        node = v.step[v.row_of[node], classes[at + depth - 1]]
        alive = node >= 0
        at, node = at[alive], node[alive]
        ends = v.piece_at[node]
        hit = ends >= 0
        start = at[hit]
        found.append((start, start + depth, ends[hit]))
        own[start[width[start] == depth]] = True
        more = at + depth < stop[at]
        at, node = at[more], node[more]
        if not len(at):
            break
    lone = np.flatnonzero(lead & ~own)
    if len(lone):
        single = np.repeat(lone, width[lone]) + np.arange(int(width[lone].sum())) - np.repeat(np.cumsum(width[lone]) - width[lone], width[lone])
        found.append((single, single + 1, v.byte_piece[buf[single]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Lattices(NamedTuple):
    """Sampling tables of distinct units: the edges into each node, with cumulated probabilities."""

    start: np.ndarray
    piece: np.ndarray
    running: np.ndarray  # probability of the edge and those before it into its node
    first: np.ndarray  # node -> its first edge


def _order(values: np.ndarray) -> np.ndarray:
    """A stable order; narrow values are sorted by radix."""
    narrow = values.astype(np.uint16) if len(values) and values.max() < 1 << 16 else values
    return np.argsort(narrow, kind="stable")


def filter_forward(buf: np.ndarray, offsets: np.ndarray, v: Vocabulary, alpha: float) -> Lattices:
    """Log sums of path weights by node, for all units side by side, and the tables to sample from."""
    start, end, piece = _edges(buf, offsets, v)
    # Node of a position: units do not share nodes, so that a unit's end is not the next one's start.
    unit = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    # By end node, longer pieces first.
    rank = (end + unit[start]) * 64 + np.maximum(63 - (end - start), 0)
    bits = int(len(start)).bit_length()
    if bits + int(rank.max(initial=0)).bit_length() < 63:
        packed = (rank << bits) | np.arange(len(start))
        packed.sort()
        by_node = packed & ((1 << bits) - 1)
    else:
        by_node = np.argsort(rank, kind="stable")
    start, end, piece = start[by_node], end[by_node], piece[by_node]
    tail, head = start + unit[start], end + unit[start]
    weight = alpha * v.weight[piece]
    depth = end - offsets[:-1][unit[start]]
    order = _order(depth)
    cut = np.concatenate([[0], np.cumsum(np.bincount(depth))])
    log = np.zeros(len(buf) + len(offsets))
    chance = np.empty(len(start))
    fresh = np.concatenate(([True], head[1:] != head[:-1]))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if a == b:
            continue
        here = order[a:b]
        new = fresh[here]
        value = log[tail[here]] + weight[here]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        top = np.maximum.reduceat(value, first)
        raised = np.exp(value - top[group])
        total = np.add.reduceat(raised, first)
        log[head[here[first]]] = top + np.log(total)
        chance[here] = raised / total[group]
    first = np.flatnonzero(fresh)
    running = np.cumsum(chance)
    running -= np.repeat(running[first] - chance[first], np.diff(np.append(first, len(head))))
    running[np.append(first[1:], len(head)) - 1] = 2.0  # whatever rounding has left over
    first_of = np.full(len(log), -1, np.int64)
    first_of[head[first]] = first
    return Lattices(start, piece, running, first_of)


def sample_slice(buf: np.ndarray, offsets: np.ndarray, key: np.ndarray, v: Vocabulary, alpha: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of a slice of texts, one text after another, and where each text's begin."""
    n, length = len(offsets) - 1, np.diff(offsets)
    grown = length + (length > 0)
    begin = np.concatenate([[0], np.cumsum(grown)])
    own = np.repeat(np.arange(n), length)
    full = np.full(int(begin[-1]), 32, np.uint8)
    full[np.arange(len(buf)) + begin[own] - offsets[own] + 1] = buf
    if not len(full):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int32)
    cut = np.zeros(len(full), bool)
    cut[1:] = ((full[1:] == 32) & (full[:-1] != 32)) | (full[1:] == 10) | (full[:-1] == 10)
    cut[begin[:-1][grown > 0]] = True
    first = np.flatnonzero(cut)
    stop = np.append(first[1:], len(full))
    owner = np.searchsorted(begin, first, "right") - 1
    # Equal units are filtered once.
    _, chosen, kind = np.unique(tb.span_hashes(full, first, stop), return_index=True, return_inverse=True)
    size = (stop - first)[chosen]
    unit_offsets = np.concatenate([[0], np.cumsum(size)])
    distinct = full[np.repeat(first[chosen], size) + np.arange(int(unit_offsets[-1])) - np.repeat(unit_offsets[:-1], size)]
    tables = filter_forward(distinct, unit_offsets, v, alpha)
    unit_first = np.searchsorted(owner, np.arange(n))
    stream = tb.mix(key.view(np.uint64)[owner] + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    stream += (np.arange(len(first)) - unit_first[owner]).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    active = _order(kind)  # equal units side by side, for the caches' sake
    at, base = unit_offsets[1:][kind[active]], unit_offsets[:-1][kind[active]]
    shift, salt = kind[active], stream[active]
    drawn, steps = [], np.zeros(len(first), np.int64)
    turn = 0
    while len(active):
        u = (tb.mix(salt + np.uint64((turn * 0x8CB92BA72F3D8DD7) & (1 << 64) - 1)) >> np.uint64(12)).astype(np.float64) / float(1 << 52)
        edge = tables.first[at + shift]
        seek = np.flatnonzero(tables.running[edge] <= u)
        while len(seek):
            edge[seek] += 1
            seek = seek[tables.running[edge[seek]] <= u[seek]]
        drawn.append((active, tables.piece[edge]))
        at = tables.start[edge]
        steps[active] += 1
        on = np.flatnonzero(at > base)
        active, at, base, shift, salt = active[on], at[on], base[on], shift[on], salt[on]
        turn += 1
    place = np.concatenate([[0], np.cumsum(steps)])
    out = np.empty(int(place[-1]), np.int32)
    for k, (who, piece) in enumerate(drawn):
        out[place[who + 1] - 1 - k] = piece
    return out, place[np.append(unit_first, len(first))].astype(np.int32)


def decode_slice(ids: np.ndarray, cut: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts whose piece ids stand between the cuts."""
    size = np.diff(v.text_at)[ids]
    end = np.concatenate([[0], np.cumsum(size)])
    out = v.text[np.repeat(v.text_at[ids], size) + np.arange(int(end[-1])) - np.repeat(end[:-1], size)]
    offsets = end[cut]
    # The blank before each text goes.
    drop = offsets[:-1][np.diff(offsets) > 0]
    keep = np.ones(len(out), bool)
    keep[drop] = False
    return out[keep], offsets - np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])


def encode(docs: DataFrame, vocabulary: Vocabulary, key: Column, alpha: float = 1.0, seed: int = 0, into: str = "pieces", proof: str | None = None) -> DataFrame:
    """Add the sampled piece ids of column text, drawn for ``key``, as array<int>.

    With ``proof``, also a boolean of that name: whether the ids, decoded, give the text's very bytes.
    The proof is made beside the ids, so that they need not travel to another worker.
    """
    kept = [c for c in docs.columns if c not in (into, proof)]
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    plain = tb.plainly(docs, kept, key=F.xxhash64(key))
    at = kept.index("text")
    schema = T.StructType(plain.schema.fields[:-1]).add("made", T.ArrayType(T.IntegerType(), False))
    schema = schema.add("proof", T.BooleanType()) if proof else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, keys = batch.column(at), np.asarray(batch.columns[-1])
            void = np.asarray(text.is_null())
            for lo, hi, buf, offsets in tb.slices(text, SLICE_BYTES):
                ids, cut = sample_slice(buf, offsets, keys[lo:hi], shared.value, alpha, seed)
                made = [pa.ListArray.from_arrays(pa.array(cut, mask=np.append(void[lo:hi], False)), pa.array(ids))]
                if proof:
                    raw, back = decode_slice(ids, cut.astype(np.int64), shared.value)
                    same = np.diff(back) == np.diff(offsets)
                    if len(raw) == len(buf) and same.all():
                        wrong = np.concatenate([[0], np.cumsum(raw != buf)])
                        same = wrong[offsets[1:]] == wrong[offsets[:-1]]
                    else:
                        same = np.array([np.array_equal(raw[a:b], buf[c:d]) for a, b, c, d in zip(back[:-1], back[1:], offsets[:-1], offsets[1:], strict=True)])
                    made.append(pa.array(same))
                yield pa.RecordBatch.from_arrays([*(x.slice(lo, hi - lo) for x in batch.columns[:-1]), *made], names=schema.names)

    return plain.mapInArrow(run, schema).toDF(*kept, into, *([proof] if proof else []))


def decode(docs: DataFrame, vocabulary: Vocabulary, column: str = "pieces", into: str = "decoded") -> DataFrame:
    """Add the text that the piece ids of ``column`` stand for."""
    kept = [c for c in docs.columns if c != into]
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    plain, at = tb.plainly(docs, kept), kept.index(column)
    schema = T.StructType(list(plain.schema.fields)).add("made", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                lists = part.column(at)
                void = np.asarray(lists.is_null())
                size = np.where(void, 0, np.asarray(lists.value_lengths().fill_null(0)))
                raw, offsets = decode_slice(np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(size)]).astype(np.int64), shared.value)
                valid = pa.py_buffer(np.packbits(~void, bitorder="little").tobytes())
                made = pa.StringArray.from_buffers(len(part), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes()), valid)
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=schema.names)

    return plain.mapInArrow(run, schema).toDF(*kept, into)
