"""Blocks of rows whose keys are numbered within the block.

A block's rows hold small numbers instead of keys. A row for each number and its key meets what all
blocks say of the key; then rows and numbers of a block come together again, so that neither rows
nor keys are ever exploded over the whole corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipewright.llm.words import draws, mix

BLOCK_BYTES = 12 << 20  # of the texts of a block, about; a longer text is a block of its own
BATCH_BYTES = 4 << 20  # of the batches that blocks are put together from
SLAB_BYTES = 1 << 20  # that are hashed at a time


def text_blocks(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES
) -> Iterator[tuple[int, dict[str, pa.Array]]]:
    """Numbered blocks of whole rows, as one array a column. A task that runs again numbers them
    alike."""

    def together(held: list[pa.RecordBatch]) -> dict[str, pa.Array]:
        # A copy, so that what the rows were cut from can go.
        arrays = {n: pa.concat_arrays([b.column(n) for b in held]) for n in held[0].schema.names}
        held.clear()
        return arrays

    number, held, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        for piece in _pieces(batch, column, limit):
            # What `nbytes` says of a slice counts its own values only.
            if held and size + piece.column(column).nbytes > limit:
                yield number, together(held)
                number, size = number + 1, 0
            held.append(piece)
            size += piece.column(column).nbytes
    if held:
        yield number, together(held)


def _pieces(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // (limit // 4 or 1))) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def span_hashes(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes between each two neighbouring edges."""
    out, first, n = [np.zeros(0, np.uint64)], 0, len(edges) - 1
    steps = draws(256, 11)
    while first < n:
        last = int(np.searchsorted(edges, edges[first] + SLAB_BYTES, "right")) - 1
        last = min(max(first + 1, last), n)
        own = edges[first : last + 1]
        lengths = np.diff(own)
        heads = own[:-1] - own[0]
        places = np.arange(own[-1] - own[0]) - np.repeat(heads, lengths)
        letters = steps[data[own[0] : own[-1]]] * draws(int(lengths.max()), 23)[places]
        sums = np.add.reduceat(letters, heads)
        out.append(mix(sums + lengths.astype(np.uint64) * steps[0]))
        first = last
    return np.concatenate(out)


def numbered_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, ascending, the place where each was met first, and each key's number: what
    `np.unique` gives, in half of its memory."""
    order = np.argsort(keys, kind="stable")
    fresh = np.ones(len(keys), bool)
    for a in range(0, len(keys), SLAB_BYTES):
        own = keys[order[max(a - 1, 0) : a + SLAB_BYTES]]
        fresh[max(a, 1) : a + SLAB_BYTES] = own[1:] != own[:-1]
    first = order[fresh]
    code = np.empty(len(keys), np.int32)
    code[order] = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
    return keys[first], first, code


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i], ..., starts[i] + lengths[i] - 1 of every i, one after the other."""
    heads = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - heads, lengths)


def sums_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of `counts` values; 0 for an empty one."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def id_kind(df: DataFrame, column: str) -> tuple[str, pa.DataType]:
    """The type an identifier travels with: text or a whole number."""
    text = dict(df.dtypes)[column] == "string"
    return ("string", pa.string()) if text else ("long", pa.int64())


def residue(id_col: str, modulus: int) -> Column:
    """The CRC-32 of an id's text modulo a number; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def nullable_batch(groups: list[dict[str, pa.Array]], schema: pa.Schema) -> pa.RecordBatch:
    """Rows of several kinds in one batch: what a kind does not have is null."""
    columns = []
    for field in schema:
        parts = []
        for group in groups:
            n = len(next(iter(group.values())))
            own = group.get(field.name)
            parts.append(pa.nulls(n, field.type) if own is None else own.cast(field.type))
        columns.append(pa.concat_arrays(parts))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def with_values(
    rows: DataFrame,
    values: DataFrame,
    work: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
) -> DataFrame:
    """`work(rows, values)` of each block: one shuffle brings both together."""
    # Both come from one scan; a new name tells the columns apart.
    values = values.withColumnRenamed("block", "of_block")
    return rows.groupBy("block").cogroup(values.groupBy("of_block")).applyInArrow(work, schema)
