"""Embedding near-dedup: an exact range join of angles between stored blocks of vectors, ordered by cells around pivots."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .components import components
from .storage import ready, saved

THRESHOLD = 0.9
#: Vectors per pivot, and pivots at most: the pivots are in every task. The more there are, the fewer pairs of two cells can be close.
PER_PIVOT, MOST_PIVOTS = 1536, 4096
#: Vectors at most that the axes of the first product come from.
SAMPLE = 1024
#: A cell's members are dealt out in blocks of about so many; blocks are compared two at a time.
BLOCK = 2048
#: Blocks are stored in books of so many bytes at most, and in so many books at least where there are as many blocks.
BOOK_BYTES, LEAST_BOOKS = 6 << 20, 32
#: What goes to a Python worker at once where books are compared: two books are a row, however large.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20)
#: Far above the error of a single precision product of unit vectors; closer ones are computed again in double precision.
NEAR = 1e-4
#: Slack for rounding where the triangle inequality decides, in radians, and where single precision products do.
SLACK, SINGLE_SLACK = 1e-6, 1e-4
#: Vectors of one block that are multiplied with the other block at once, and the share of close pairs from which all their products are taken.
TILE, DENSE = 256, 0.005
#: Bytes of a vector's digest.
DIGEST = 16


def _unit(rows: np.ndarray) -> np.ndarray:
    """The rows as unit vectors in double precision."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _usable(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) of the rows of (vec_id, v) that can link, by length; equal vectors have equal bytes."""
    column = batch.column("v")
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    lengths = np.where(batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False), lengths, 0)
    for dim in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == dim)
        rows = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim) + 0.0
        fine = np.isfinite(rows).all(1) & (rows != 0).any(1)
        if fine.any():
            yield at[fine], rows[fine]


def _bytes(rows: np.ndarray) -> list[bytes]:
    raw, width = rows.tobytes(), rows.shape[1] * rows.itemsize
    return [raw[i : i + width] for i in range(0, len(raw), width)]


def _digests(vectors: list[bytes]) -> list[bytes]:
    return [blake2b(v, digest_size=DIGEST).digest() for v in vectors]


def _numbers(digests: list[bytes]) -> np.ndarray:
    """Eight bytes of each digest as a number."""
    return np.frombuffer(b"".join(digests), np.uint64)[:: DIGEST // 8]


def _spanning(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids with the same components as the given ones, at most one for each id."""
    ids, at = np.unique(np.concatenate((left, right)), return_inverse=True)
    a, b = at[: len(left)], at[len(left) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(ids))
    return ids[own], ids[label[own]]


class _Turn:
    """An orthogonal turn that brings the axes along which a sample is long to the front, and how many of these go into the first product.

    Of two unit vectors, the product is at most that of their first axes plus that of the lengths of what is left. The sample
    decides only where the first product ends, so that it costs little and leaves few pairs to compute in full.
    """

    def __init__(self, sample: np.ndarray, threshold: float):
        dim = sample.shape[1]
        lengths, axes = np.linalg.eigh(sample[::2].T @ sample[::2])
        self.axes = axes[:, np.argsort(-lengths)]
        turned, best = sample[1::2] @ self.axes, math.inf  # on others than those that the axes fit
        self.first = dim
        for k in sorted({*range(8, min(dim, 128), 4), *range(128, dim, 32), dim}):
            rest = np.sqrt(np.einsum("ij,ij->i", turned[:, k:], turned[:, k:]))
            left = np.count_nonzero(turned[:, :k] @ turned[:, :k].T + np.outer(rest, rest) >= threshold - NEAR)
            cost = 0.5 + 0.025 * k + 1000 * (left - len(turned)) / max(1, len(turned) * (len(turned) - 1))  # nanoseconds for a pair
            if k < dim and cost < best or k == dim and cost < 0.9 * best:
                self.first, best = k, cost

    def heads(self, units: np.ndarray) -> np.ndarray:
        turned = units @ self.axes
        rest = np.sqrt(np.einsum("ij,ij->i", turned[:, self.first :], turned[:, self.first :]))
        return np.concatenate((turned[:, : self.first], rest[:, None]), 1).astype(np.float32)


class _Block:
    """A stored block, as a task compares it."""

    def __init__(self, rows: np.ndarray, cids: np.ndarray, copies: np.ndarray, turn: _Turn):
        self.rows, self.cids, self.copies = rows, cids, copies
        units = _unit(rows)
        self.units, self.heads = units.astype(np.float32), turn.heads(units)


class _Book:
    """A stored book: its blocks, the cell and radius of each, and the bounds of each to all pivots."""

    def __init__(self, row: dict, side: str, kind: type, pivots: np.ndarray, turn: _Turn):
        of = lambda column, kind: np.frombuffer(row[f"{side}_{column}"], kind)
        blocks = row[f"{side}_blocks"]
        self.number, self.all_pivots = row[f"{side}_book"], pivots
        self.cells, self.radius = np.array([x["cell"] for x in blocks]), np.array([x["radius"] for x in blocks])
        self.pivots = pivots[self.cells].astype(np.float32)
        self.ends = np.cumsum([x["n"] for x in blocks])
        self.cids, copies, rows = of("cids", np.int64).copy(), of("many", np.int64).copy(), of("vs", kind).reshape(-1, row["a_dim"]).copy()  # views keep their batch
        self.least, self.gap = of("bounds", np.float64).reshape(len(blocks), 2, -1).swapaxes(0, 1).copy()
        self.blocks = [_Block(rows[end - x["n"] : end], self.cids[end - x["n"] : end], copies[end - x["n"] : end], turn) for x, end in zip(blocks, self.ends, strict=True)]

    def near(self, other: _Book, threshold: float) -> np.ndarray:
        """For each block of this book and each of the other, whether vectors of them may be linked."""
        reach, chord = math.acos(threshold) + SLACK, math.sqrt(2 - 2 * threshold) + SLACK
        there = lambda a, b: b.least[:, a.cells].T <= a.radius[:, None] + reach + SLACK
        return there(self, other) & there(other, self).T & (self.gap[:, other.cells] + other.gap[:, self.cells].T <= chord)

    def past(self, other: _Book) -> list[np.ndarray]:
        """For each block, how much closer in cosine its vectors are to its pivot than to the pivot of each of the other's blocks."""
        return [(block.units @ pivot)[:, None] - block.units @ other.pivots.T for block, pivot in zip(self.blocks, self.pivots, strict=True)]

    def pairs(self, other: _Book, threshold: float) -> Iterator[tuple[int, int, _Order]]:
        """The blocks of both that may hold links, and which of their vectors may be linked."""
        past, past_other, chord = self.past(other), other.past(self), math.sqrt(2 - 2 * threshold)
        for p, q in zip(*np.nonzero(self.near(other, threshold)), strict=True):
            if self is not other or p <= q:
                apart = float(np.linalg.norm(self.all_pivots[self.cells[p]] - self.all_pivots[other.cells[q]]))
                yield p, q, _Order(past[p][:, q], past_other[q][:, p], chord * apart + SINGLE_SLACK)


class _Order:
    """The vectors of two blocks by how far they lie on their own pivot's side of the plane halfway between the two pivots.

    Two unit vectors are at least as far apart as their places along the line through the pivots. These are known as products
    with the difference of the pivots: a's and b's add up to that distance, times the pivots', and beyond most there is no link.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, most: float):
        self.a, self.b = np.argsort(a), np.argsort(b)
        self.past_a, self.past_b, self.most = a[self.a], b[self.b], most

    def ends(self, starts: range) -> np.ndarray:
        """How many of b's first vectors may be linked to a's vectors from each start on."""
        return np.searchsorted(self.past_b, self.most - self.past_a[list(starts)], "right")


def _sure(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of left have a cosine of threshold or more with the row of right at the same place."""
    found = [np.einsum("ij,ij->i", _unit(left[at : at + 8192]), _unit(right[at : at + 8192])) >= threshold for at in range(0, len(left), 8192)]
    return np.concatenate(found) if found else np.zeros(0, bool)


class _Space:
    """Room for the products of a tile, used again for each."""

    def __init__(self) -> None:
        self.room = np.zeros(0, np.float32)

    def close(self, heads: np.ndarray, others: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Places of pairs of heads and others whose product is least or more; most rows have none and are only asked for their largest product."""
        shape = len(heads), len(others)
        if len(self.room) < shape[0] * shape[1]:
            self.room = np.zeros(shape[0] * shape[1], np.float32)
        products = np.matmul(heads, others.T, out=self.room[: shape[0] * shape[1]].reshape(shape))
        some = np.flatnonzero(products.max(1) >= np.float32(least))
        x, y = np.divmod(np.flatnonzero(products[some] >= np.float32(least)), shape[1])
        return some[x], y


def _links(a: _Block, b: _Block, order: _Order, threshold: float, space: _Space) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Links of a with b, in parts: counted for a's and for b's vectors, and pairs of ids that span the linked ones. a and b may be the same."""
    starts = range(0, len(a.cids), TILE)
    ends = order.ends(starts)
    if not ends.any():
        return
    a_heads, b_heads = a.heads.take(order.a, 0), b.heads.take(order.b[: ends.max()], 0)
    few: list[tuple[np.ndarray, np.ndarray]] = []
    for at, end in zip(starts, ends, strict=True):
        if not end:
            break
        rows, columns = order.a[at : at + TILE], order.b[:end]
        x, y = space.close(a_heads[at : at + TILE], b_heads[:end], threshold - NEAR)
        if len(x) < DENSE * len(rows) * len(columns):
            few.append((rows[x], columns[y]))
        else:
            cosine = a.units[rows] @ b.units[columns].T
            linked = cosine >= threshold
            x, y = np.nonzero(np.abs(cosine - np.float32(threshold)) <= NEAR)
            linked[x, y] = _sure(a.rows[rows[x]], b.rows[columns[y]], threshold)
            if a is b:
                linked &= rows[:, None] != columns
            counts = np.zeros(len(a.cids)), np.zeros(len(b.cids))
            counts[0][rows], counts[1][columns] = linked.astype(np.float64) @ b.copies[columns], a.copies[rows] @ linked.astype(np.float64)
            # Each vector with the first one that it is linked to; then links between what that has not joined.
            has_x, has_y = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
            x, y = np.concatenate((has_x, linked[:, has_y].argmax(0))), np.concatenate((linked[has_x].argmax(1), has_y))
            group = np.arange(len(rows) + len(columns))
            low, high = _spanning(x, len(rows) + y)
            group[low] = high
            more_x, more_y = np.nonzero(linked & (group[: len(rows), None] != group[None, len(rows) :]))
            x, y = rows[np.concatenate((x, more_x))], columns[np.concatenate((y, more_y))]
            yield *(c.astype(np.int64) for c in counts), *_spanning(a.cids[x], b.cids[y])
    if few:
        x, y = (np.concatenate(places) for places in zip(*few, strict=True))
        if a is b:
            x, y = x[x != y], y[x != y]
        good = _sure(a.rows[x], b.rows[y], threshold)
        x, y = x[good], y[good]
        if len(x):
            counts = np.bincount(x, b.copies[y], len(a.cids)), np.bincount(y, a.copies[x], len(b.cids))
            yield *(c.astype(np.int64) for c in counts), *_spanning(a.cids[x], b.cids[y])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding); threshold is a cosine above 0.

    Every pair of rows with a cosine of threshold or more, in double precision, is a link, whatever else the rows hold. Each
    distinct vector has its home with the nearest pivot; the members of a cell are dealt by digest into blocks of about BLOCK.
    Blocks are stored in books, a row each, with the radius of each block around its pivot, its least angles to all pivots
    and how far it keeps from the planes halfway to them. Tasks read the stored books two at a time, without a shuffle, so
    that nothing on disk grows faster than the table. Books and blocks that these bounds keep apart are not compared. Of two
    blocks, vectors meet only if their distance along the line through the two pivots is within the join's: the closer the
    pivots are to their members, the fewer do. A comparison multiplies the first axes of a turned space and the lengths of the
    rest, which bounds the cosine from above, and computes what is left in full. Links are counted, not listed; what leaves a
    task is a count and one spanning pair at most per vector. Equal vectors are compared once, however many there are. Pivots
    and axes come from few vectors chosen by digest and only steer the work.

    Vectors that are null, zero, empty, or hold null or non-finite components, and rows with a null vec_id, link with nothing:
    n_links 0, component_id their own vec_id. Vectors of unlike length never link. Repeated rows count as vectors of their own.
    In space without clusters cells overlap and the join compares a share of all pairs; it stays exact.
    """
    ready(vectors.sparkSession)
    spark, reach, chord = vectors.sparkSession, math.acos(threshold) + SLACK, math.sqrt(2 - 2 * threshold) + SLACK
    single = isinstance(getattr(vectors.select("embedding").schema[0].dataType, "elementType", None), FloatType)
    kind, width = (np.float32, 4) if single else (np.float64, 8)
    v = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))

    wanted = 2 * MOST_PIVOTS
    bound = min(2**64 - 1, wanted * 2**64 // max(wanted, rows.count()))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The vectors whose digests are below the bound, the least one of each length in any case, and how many there are."""
        counts, found = {}, {}
        for batch in batches:
            for _, usable in _usable(batch):
                dim = usable.shape[1]
                counts[dim] = counts.get(dim, 0) + len(usable)
                raw = _bytes(usable)
                numbers = _numbers(_digests(raw))
                own = found.setdefault(dim, {})
                own.update((raw[i], int(numbers[i])) for i in np.flatnonzero(numbers < bound))
                if not own:
                    least = int(numbers.argmin())
                    own[raw[least]] = int(numbers[least])
        for dim, own in found.items():
            yield pa.record_batch({
                "dim": pa.array([dim] * len(own), pa.int32()), "n": pa.array([counts[dim]] + [0] * (len(own) - 1), pa.int64()),
                "number": pa.array([f"{x:020d}" for x in own.values()], pa.string()), "v": pa.array(list(own), pa.binary()),
            })

    sizes: dict[int, int] = {}
    samples: dict[int, dict[str, bytes]] = {}
    for r in rows.mapInArrow(drawn, "dim int, n long, number string, v binary").collect():
        sizes[r["dim"]] = sizes.get(r["dim"], 0) + r["n"]
        samples.setdefault(r["dim"], {})[r["number"]] = bytes(r["v"])
    pivots: dict[int, np.ndarray] = {}
    turns: dict[int, _Turn] = {}
    for dim, found in samples.items():
        sample = _unit(np.frombuffer(b"".join(found[x] for x in sorted(found)[:MOST_PIVOTS]), kind).reshape(-1, dim))
        pivots[dim] = sample[: max(1, min(MOST_PIVOTS, sizes[dim] // PER_PIVOT))]
        turns[dim] = _Turn(sample[:SAMPLE], threshold)
    shared = spark.sparkContext.broadcast((pivots, turns))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, usable in _usable(batch):
                cells = (_unit(usable) @ shared.value[0][usable.shape[1]].T).argmax(1)
                yield pa.record_batch({"dim": pa.array(np.full(len(cells), usable.shape[1], np.int32)), "cell": pa.array(cells.astype(np.int32)), "number": pa.array(_numbers(_digests(_bytes(usable))).view(np.int64))})

    members = rows.mapInArrow(homes, "dim int, cell int, number long").groupBy("dim", "cell").agg(F.approx_count_distinct("number").alias("n"))
    members = {(r["dim"], r["cell"]): r["n"] for r in members.collect()}  # a row per pivot
    many = {dim: np.array([max(1, -(-members.get((dim, cell), 0) // BLOCK)) for cell in range(len(chosen))], np.int64) for dim, chosen in pivots.items()}
    blocks, total = {}, 0  # by dim the first number of each cell's blocks, how many they are, the number of the first book and the blocks of a book
    for dim, n in many.items():
        of_book = max(1, min(BOOK_BYTES // (BLOCK * dim * width), sum(int(x.sum()) for x in many.values()) // LEAST_BOOKS))
        blocks[dim] = np.cumsum(n) - n, n, total, of_book
        total += -(-int(n.sum()) // of_book)
    dealt = spark.sparkContext.broadcast(blocks)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each distinct vector of a batch once, with the block it belongs to."""
        for batch in batches:
            for at, usable in _usable(batch):
                ids, raw = batch.column("vec_id").to_numpy()[at], _bytes(usable)
                order = np.argsort(ids, kind="stable")
                first: dict[bytes, int] = {}
                of = np.array([first.setdefault(raw[i], i) for i in order])
                once, copies = np.unique(of, return_counts=True)
                dim = usable.shape[1]
                cells = (_unit(usable[once]) @ shared.value[0][dim].T).argmax(1)
                start, n, book, of_book = dealt.value[dim]
                raw = [raw[i] for i in once]
                block = start[cells] + (_numbers(_digests(raw)) % n[cells].astype(np.uint64)).astype(np.int64)
                yield pa.record_batch({
                    "book": pa.array(book + block // of_book), "dim": pa.array(np.full(len(once), dim, np.int32)), "cell": pa.array(cells.astype(np.int32)), "block": pa.array(block),
                    "cid": pa.array(ids[once]), "copies": pa.array(copies.astype(np.int64)), "v": pa.array(raw, pa.binary()),
                })

    def stored(table: pa.Table) -> pa.Table:
        """A book as one row: its blocks one after the other, bounds for the angles between the vectors of each and the pivots, and the least of these."""
        table = table.sort_by("block").combine_chunks()
        book, dim = table.column("book")[0].as_py(), table.column("dim")[0].as_py()
        raw, number, cells = table.column("v").to_pylist(), table.column("block").to_numpy(), table.column("cell").to_numpy()
        ends = np.append(np.flatnonzero(np.diff(number)) + 1, len(raw))
        blocks, bounds = [], []
        for start, end in zip(np.append(0, ends[:-1]), ends, strict=True):
            pivots, cell = shared.value[0][dim], int(cells[start])
            cosines = _unit(np.frombuffer(b"".join(raw[start:end]), kind).reshape(-1, dim)) @ pivots.T
            own = cosines[:, cell]
            blocks.append({"cell": cell, "radius": float(_angle(own.min())), "n": int(end - start)})
            gap, apart = (own[:, None] - cosines).min(0), np.linalg.norm(pivots - pivots[cell], axis=1)
            bounds.append((_angle(cosines.max(0)), np.where(apart > SLACK, gap / np.maximum(apart, SLACK), 0.0)))
        bounds = np.array(bounds)
        long = lambda c: table.column(c).to_numpy().astype(np.int64).tobytes()
        return pa.table({
            "book": pa.array([book], pa.int64()), "dim": pa.array([dim], pa.int32()),
            "blocks": pa.array([blocks], pa.list_(pa.struct({"cell": pa.int32(), "radius": pa.float64(), "n": pa.int32()}))),
            "least": pa.array([bounds[:, 0].min(0)], pa.list_(pa.float64())), "gap": pa.array([bounds[:, 1].min(0)], pa.list_(pa.float64())),
            **{c: pa.array([x], pa.binary()) for c, x in (("bounds", bounds.tobytes()), ("cids", long("cid")), ("many", long("copies")), ("digests", b"".join(_digests(raw))), ("vs", b"".join(raw)))},
        })

    classes = rows.mapInArrow(placed, "book long, dim int, cell int, block long, cid long, copies long, v binary").repartition("book")
    classes = classes.groupBy("book", "dim", "cell", "block", "v").agg(F.min("cid").alias("cid"), F.sum("copies").alias("copies"))
    classes = classes.groupBy("book", "dim").applyInArrow(stored, "book long, dim int, blocks array<struct<cell: int, radius: double, n: int>>, least array<double>, gap array<double>, bounds binary, cids binary, many binary, digests binary, vs binary")
    books = saved(classes, "books", maxRecordsPerFile=4, compression="none")

    left, right = (books.select(*(F.col(c).alias(f"{side}_{c}") for c in books.columns)) for side in ("a", "b"))
    # Of (a, b) and (b, a) one is compared, so that every book comes first equally often.
    ahead = (F.col("b_book") - F.col("a_book") + total) % F.lit(max(1, total))
    turns_up = (2 * ahead < total) | ((2 * ahead == total) & (F.col("a_book") < F.col("b_book")))

    def there(x: str, y: str) -> Column:
        """Whether vectors of book y may be within reach of a block of book x."""
        least, gap = F.col(f"{y}_least"), F.col(f"{y}_gap")
        return F.exists(f"{x}_blocks", lambda k: (least[k["cell"]] <= k["radius"] + F.lit(reach + SLACK)) & (gap[k["cell"]] <= F.lit(chord + SINGLE_SLACK)))

    pairs = left.join(right.hint("shuffle_replicate_nl"), (F.col("a_dim") == F.col("b_dim")) & turns_up & there("a", "b") & there("b", "a"))
    pairs = pairs.select("a_dim", *(f"{side}_{c}" for side in ("a", "b") for c in ("book", "blocks", "bounds", "cids", "many", "vs")))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links between the blocks of two books, counted for both; of a block with itself, once for each vector."""
        counts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        spans, held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        a, space = None, _Space()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                row = {c: x.as_buffer() if isinstance(x, (pa.BinaryScalar, pa.LargeBinaryScalar)) else x.as_py() for c, x in row.items()}
                of_dim = kind, *(x[row["a_dim"]] for x in shared.value)
                if a is None or a.number != row["a_book"]:
                    a = _Book(row, "a", *of_dim)
                b = a if row["b_book"] == row["a_book"] else _Book(row, "b", *of_dim)
                for p, q, order in a.pairs(b, threshold):
                    for of_a, of_b, low, high in _links(a.blocks[p], b.blocks[q], order, threshold, space):
                        for book, k, n in ((a, p, of_a), (b, q, of_b))[: 1 + (a is not b or p != q)]:
                            sums = counts.setdefault(book.number, (book.cids, np.zeros(len(book.cids), np.int64)))[1]
                            sums[book.ends[k] - len(n) : book.ends[k]] += n
                        spans.append((low, high))
                        held += len(low)
                if held > 1_000_000:
                    spans = [_spanning(*(np.concatenate(x) for x in zip(*spans, strict=True)))]
                    held = len(spans[0][0]) // 2
            batch = row = b = None  # before the next one comes
        none = lambda n: pa.nulls(n, pa.int64())
        for cids, n in counts.values():
            at = np.flatnonzero(n)
            yield pa.record_batch({"cid": pa.array(cids[at]), "n": pa.array(n[at]), "a": none(len(at)), "b": none(len(at))})
        low, high = _spanning(*(np.concatenate(x) for x in zip(*spans, strict=True)))
        yield pa.record_batch({"cid": none(len(low)), "n": none(len(low)), "a": pa.array(low), "b": pa.array(high)})

    before = spark.conf.get(BATCH_SETTING, None)
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)  # for this job only: rows are large here
    try:
        found = saved(pairs.mapInArrow(compared, "cid long, n long, a long, b long"), "found")
    finally:
        spark.conf.set(BATCH_SETTING, before) if before is not None else spark.conf.unset(BATCH_SETTING)
    counts = found.where("cid is not null").groupBy("cid").agg(F.sum("n").alias("n"))
    groups = components(found.where("a is not null").select("a", "b")).withColumnRenamed("id", "cid")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cids, copies, digests in zip(*(batch.column(c) for c in ("cids", "many", "digests")), strict=True):
                key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(DIGEST), len(digests.as_buffer()) // DIGEST, [None, digests.as_buffer()])
                yield pa.record_batch({"key": key.cast(pa.binary()), "cid": pa.array(np.frombuffer(cids.as_buffer(), np.int64)), "copies": pa.array(np.frombuffer(copies.as_buffer(), np.int64))})

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every row with the digest of its vector, or where it links with nothing with a shorter key that no vector has."""
        for batch in batches:
            keys = [b"%d" % (i % 1024) for i in range(batch.num_rows)]
            for at, usable in _usable(batch):
                for i, key in zip(at, _digests(_bytes(usable)), strict=True):
                    keys[i] = key
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "key": pa.array(keys, pa.binary())})

    known = books.select("cids", "many", "digests").mapInArrow(listed, "key binary, cid long, copies long").join(counts, "cid", "left").join(groups, "cid", "left")
    known = known.where("copies > 1 or n is not null")
    known = known.groupBy("key").agg(F.max(F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.min(F.coalesce("component", "cid")).alias("component_id"))
    both = rows.mapInArrow(keyed, "vec_id long, key binary").join(known, "key", "left")
    both = both.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
