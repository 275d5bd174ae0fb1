"""Recursive filters over signals in chunks, run in parallel.

A filter's state moves by an affine map: state' = A state + (what the input adds).  Maps compose, so that chunks need not wait for each other: each is filtered from rest, its end
state is what the chunk adds; a scan over a file's chunks (a few numbers each) gives every chunk the state it begins with, and the
filter runs again from there.  Within a chunk, blocks of about the square root of its length take the place of chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

STATES = "file string, chunk long, state array<double>"


class Section(NamedTuple):
    """A second-order section: b0 + b1 z^-1 + b2 z^-2 over 1 + a1 z^-1 + a2 z^-2."""

    b0: float
    b1: float
    b2: float
    a1: float
    a2: float


def _run(section: Section, x: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sample by sample along the last axis, for all rows at once: output and the state after it."""
    out = np.empty_like(x)
    for k in range(x.shape[-1]):
        v = x[..., k]
        y = section.b0 * v + first
        first, second = section.b1 * v - section.a1 * y + second, section.b2 * v - section.a2 * y
        out[..., k] = y
    return out, first, second


def filtered(section: Section, x: np.ndarray, state: Sequence[float] = (0.0, 0.0)) -> tuple[np.ndarray, tuple[float, float]]:
    """The output of one section over x (a vector) and the state after it."""
    x = np.asarray(x, float)
    size = max(1, int(len(x) ** 0.5))
    count = len(x) // size
    blocks, e1, e2 = _run(section, x[: count * size].reshape(count, size), np.zeros(count), np.zeros(count))
    # What a state gives without any input: from (1, 0) and from (0, 1).
    free, t1, t2 = _run(section, np.zeros((2, size)), np.array([1.0, 0.0]), np.array([0.0, 1.0]))
    starts = np.empty((count, 2))
    s1, s2 = map(float, state)
    for k in range(count):
        starts[k] = s1, s2
        s1, s2 = t1[0] * s1 + t1[1] * s2 + e1[k], t2[0] * s1 + t2[1] * s2 + e2[k]
    rest, s1, s2 = _run(section, x[None, count * size :], np.array([s1]), np.array([s2]))
    return np.concatenate(((blocks + starts @ free).ravel(), rest[0])), (float(s1[0]), float(s2[0]))


def cascade(sections: Sequence[Section], x: np.ndarray, state: Sequence[float] | None = None) -> tuple[np.ndarray, list[float]]:
    """Sections one after another; state has two numbers for each."""
    after: list[float] = []
    for k, section in enumerate(sections):
        x, own = filtered(section, x, (0.0, 0.0) if state is None else state[2 * k : 2 * k + 2])
        after += own
    return x, after


def cascade_bank(sections: Sequence[Section], x: np.ndarray) -> np.ndarray:
    """Sections one after another over the rows of x, from rest; a section's numbers may differ by row, as columns (rows, 1)."""
    x = np.asarray(x, float)
    rows, n = x.shape
    size = max(1, int(n**0.5))
    count = n // size
    for section in sections:
        wide = Section(*(np.broadcast_to(np.asarray(v, float), (rows, 1)) for v in section))
        blocks, e1, e2 = _run(wide, x[:, : count * size].reshape(rows, count, size), np.zeros((rows, count)), np.zeros((rows, count)))
        each = Section(*(v[:, 0] for v in wide))
        free, t1, t2 = _run(each, np.zeros((2, rows, size)), np.array([[1.0], [0.0]]), np.array([[0.0], [1.0]]))
        starts, s1, s2 = np.empty((2, rows, count)), np.zeros(rows), np.zeros(rows)
        for k in range(count):
            starts[0, :, k], starts[1, :, k] = s1, s2
            s1, s2 = t1[0] * s1 + t1[1] * s2 + e1[:, k], t2[0] * s1 + t2[1] * s2 + e2[:, k]
        blocks = blocks + starts[0, :, :, None] * free[0, :, None, :] + starts[1, :, :, None] * free[1, :, None, :]
        rest, _, _ = _run(each, x[:, count * size :], s1, s2)
        x = np.concatenate((blocks.reshape(rows, count * size), rest), axis=1)
    return x


def step_matrix(sections: Sequence[Section]) -> np.ndarray:
    """A: how one sample of silence moves the state of a cascade."""
    size = 2 * len(sections)
    columns = [cascade(sections, np.zeros(1), row)[1] for row in np.eye(size)]
    return np.array(columns).T


def chunk_states(chunks: DataFrame, sections: Sequence[Section], channels: Callable[[dict], list[np.ndarray]] | None = None, columns: Sequence[str] = ("x",)) -> DataFrame:
    """(file, chunk, state): with what state the cascade enters each chunk, for each channel one after another.

    ``chunks`` are without halo; ``channels`` makes a chunk's signals from its ``columns``.
    """
    signals = channels or (lambda row: [np.asarray(row["x"], float)])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                held = signals({c: batch.column(c)[k].as_py() for c in columns})
                rows.append([v for x in held for v in cascade(sections, x)[1]])
            n = pa.array([r["n"] for r in batch.select(["n"]).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("chunk"), n, pa.array(rows, pa.list_(pa.float64()))], ["file", "chunk", "n", "state"])

    def scan(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        step, size, powers = step_matrix(sections), 2 * len(sections), {}
        state, out = None, []
        for n, added in zip(table["n"].to_pylist(), table["state"].to_pylist(), strict=True):
            added = np.array(added).reshape(-1, size)
            state = np.zeros_like(added) if state is None else state
            out.append(state.ravel())
            if n not in powers:
                powers[n] = np.linalg.matrix_power(step, n).T
            state = state @ powers[n] + added
        return pa.table({"file": table["file"], "chunk": table["chunk"], "state": pa.array(out, pa.list_(pa.float64()))})

    # A file has one short row for each of its chunks here.
    return chunks.select("file", "chunk", "n", *columns).mapInArrow(ends, "file string, chunk long, n long, state array<double>").groupBy("file").applyInArrow(scan, STATES)
