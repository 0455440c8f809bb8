"""Hash postings in packed blocks: what map tasks find is sorted into hash ranges and moves as few large binary rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import mix

#: Postings that a map task gathers before it hands out its blocks (8 bytes each).
FLUSH = 2_000_000
PACKED = "range int, block binary"


def packed(found: Iterator[tuple[int, int, np.ndarray]], ranges: int) -> Iterator[pa.RecordBatch]:
    """Blocks of (owner, size, hashes) triples by hash range: owners, sizes and counts once a row, then bare hashes."""
    owners: list[int] = []
    sizes: list[int] = []
    hashes: list[np.ndarray] = []
    held = 0
    for owner, size, own in found:
        owners.append(owner)
        sizes.append(size)
        hashes.append(own)
        held += len(own)
        if held >= FLUSH:
            yield _blocks(owners, sizes, hashes, ranges)
            owners, sizes, hashes, held = [], [], [], 0
    if held:
        yield _blocks(owners, sizes, hashes, ranges)


def _blocks(owners: list[int], sizes: list[int], hashes: list[np.ndarray], ranges: int) -> pa.RecordBatch:
    counts = np.array([len(x) for x in hashes])
    flat, row = np.concatenate(hashes), np.repeat(np.arange(len(counts)), counts)
    return _dealt(_range_of(flat, ranges), flat, row, np.array(owners, np.int64), np.array(sizes, np.uint32))


def owner_blocks(hashes: np.ndarray, owners: np.ndarray, ranges: int) -> pa.Table:
    """Blocks of postings dealt by their owners, the way back from hash ranges to documents."""
    names, row = np.unique(owners, return_inverse=True)
    order = np.argsort(row, kind="stable")
    to = _range_of(mix(names.view(np.uint64)), ranges)[row[order]]
    return pa.Table.from_batches([_dealt(to, hashes[order], row[order], names, np.zeros(len(names), np.uint32))])


def _range_of(values: np.ndarray, ranges: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.uint16 if ranges <= 1 << 16 else np.int64)


def _dealt(to: np.ndarray, flat: np.ndarray, row: np.ndarray, owner: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(to, kind="stable")
    flat, row, to = flat[order], row[order], to[order]
    cuts = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, int)
    names, blobs = [], []
    for a, b in zip(cuts, [*cuts[1:], len(to)], strict=bool(len(to))):
        rows, n = np.unique(row[a:b], return_counts=True)
        head = np.array([len(rows)], np.int64)
        blobs.append(b"".join(x.tobytes() for x in (head, owner[rows], size[rows], n.astype(np.uint32), flat[a:b])))
        names.append(int(to[a]))
    return pa.record_batch({"range": pa.array(names, pa.int32()), "block": pa.array(blobs, pa.binary())})


def unpacked(blocks: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, owner, size) of every posting in the blocks."""
    parts = []
    for block in blocks:
        raw = block.as_buffer()
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        owner = np.frombuffer(raw, np.int64, n, 8)
        size = np.frombuffer(raw, np.uint32, n, 8 + 8 * n)
        count = np.frombuffer(raw, np.uint32, n, 8 + 12 * n)
        parts.append((np.frombuffer(raw, np.uint8, -1, 8 + 16 * n).view(np.uint64), np.repeat(owner, count), np.repeat(size, count)))
    hashes, owners, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
    return hashes, owners, sizes


def by_range(blocks: DataFrame, reduce: Callable[[np.ndarray, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """reduce(hash, owner, size) for all postings of each hash range. A range is one part in shuffle-partitions of all."""

    def reduced(table: pa.Table) -> pa.Table:
        return reduce(*unpacked(table.column("block")))

    return blocks.groupBy("range").applyInArrow(reduced, schema)


def binary_rows(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary column that holds values[cuts[i]:cuts[i + 1]] in row i."""
    at = pa.array((cuts * values.itemsize).astype(np.int64)).buffers()[1]
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, at, pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())
