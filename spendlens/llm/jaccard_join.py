"""N-gram Jaccard join by count-vector R-trees: exact links between shingle sets, grouped into components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .postings import PACKED, binary_rows, by_range, packed
from .storage import ready, saved, small
from .words import blocks, mix, runs, word_hashes

SHINGLE = 5
#: Similarity as a fraction: two sets link when DEN * intersection >= NUM * union.
NUM, DEN = 75, 100
#: The most frequent shingles that are ordered by frequency; a list of so many 16-byte entries reaches driver and tasks.
FREQUENT = 1 << 17
#: Sets among which a map task counts shingles at a time, and how often one must be met there to be reported.
COUNTED, SEEN = 8192, 3
#: Entries of a leaf, and members of a cell that one task joins; larger cells are dealt out in pairs of such blocks.
LEAF, CELL = 16, 4096


def needed(total: np.ndarray) -> np.ndarray:
    """The least overlap of two sets with so many elements together: NUM / (NUM + DEN) of it, rounded up."""
    return -(-total * NUM // (NUM + DEN))


# --- shingle sets and count vectors ------------------------------------------------------------------------------------


def shingle_sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit shingles) for each row with words; fewer than k words are one shingle."""
    for first, end, raw, offsets in blocks(batch.column("text")):
        hashes, _, _, starts = word_hashes(raw, offsets, lower=True)
        shingles = runs(hashes, k)
        for row in range(first, end):
            a, b = int(starts[row - first]), int(starts[row - first + 1])
            if b - a >= k:
                yield row, np.unique(shingles[a : b - k + 1])
            elif b > a:
                yield row, runs(hashes[a:b], b - a)


def set_id(shingles: np.ndarray) -> int:
    total = mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(mix(np.array([total + np.uint64(len(shingles))]))[0].astype(np.int64))


def count_vector(shingles: np.ndarray) -> np.ndarray:
    """Bytes that describe a set: 16-bit counts of its shingles by hash group, then the parities of counts in 16 times as many
    finer groups, a bit each. There are an eighth to a quarter as many groups as shingles, a power of two, so that sets of
    different size can be compared: groups of the longer description are added up, and parities with them."""
    groups = 8
    while groups * 8 <= len(shingles):
        groups *= 2
    mixed = mix(shingles)
    counts = np.bincount((mixed & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    fine = np.bincount(((mixed >> np.uint64(24)) & np.uint64(16 * groups - 1)).astype(np.int64), minlength=16 * groups) & 1
    return np.concatenate((counts.astype("<u2").view(np.uint8), np.packbits(fine.astype(np.uint8), bitorder="little")))


def described(vectors: list[bytes], groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, parities) of sets with descriptions of equal length, brought to so many groups."""
    rows = np.stack([np.frombuffer(v, np.uint8) for v in vectors])
    half = rows.shape[1] // 2
    counts = np.ascontiguousarray(rows[:, :half]).view("<u2").reshape(len(rows), -1, groups).sum(1, dtype=np.uint32)
    return counts, np.bitwise_xor.reduce(rows[:, half:].reshape(len(rows), -1, 2 * groups), axis=1)


def far_apart(left: np.ndarray, right: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether more parities differ than linked sets with so many elements together have unshared elements."""
    return np.bitwise_count(left ^ right).sum(1, dtype=np.int64) > total - 2 * needed(total)


def seen_often(held: dict[int, np.ndarray]) -> np.ndarray:
    """(shingle, count) of those in at least SEEN of the sets, which are let go: sorted in one array, without others of its size."""
    if not held:
        return np.zeros((0, 2), np.uint64)
    values = np.concatenate(list(held.values()))
    held.clear()
    values.sort()
    first = np.zeros(len(values), bool)  # of a run of SEEN or more
    if len(values) >= SEEN:
        np.equal(values[SEEN - 1 :], values[: len(values) - SEEN + 1], out=first[: len(values) - SEEN + 1])
        first[1:] &= values[1:] != values[:-1]
    first = np.flatnonzero(first)
    often = values[first]
    return np.stack((often, (np.searchsorted(values, often, "right") - first).astype(np.uint64)), 1)


def summary(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, sid, vector) per document and, in rows of their own, (frequent): shingles often met in a task's sets."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def frequent() -> pa.RecordBatch:
            rows = seen_often(held)
            return record([None], [None], [None], [None], [rows.tobytes()])

        def record(ids: list, n: list, sids: list, vectors: list, often: list) -> pa.RecordBatch:
            return pa.record_batch({
                "doc_id": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64()), "sid": pa.array(sids, pa.int64()),
                "vector": pa.array(vectors, pa.binary()), "frequent": pa.array(often, pa.binary()),
            })

        size = 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            n, sids, vectors = [0] * len(ids), [None] * len(ids), [None] * len(ids)
            for row, own in shingle_sets(batch, k):
                sid = set_id(own)
                n[row], sids[row], vectors[row] = len(own), sid, count_vector(own).tobytes()
                if sid not in held:
                    held[sid] = own
                    size += len(own)
                if len(held) >= COUNTED or size > 5_000_000:
                    yield frequent()
                    size = 0
            yield record(ids, n, sids, vectors, [None] * len(ids))
        yield frequent()

    return docs.select("doc_id", "text").mapInArrow(summed, "doc_id long, n long, sid long, vector binary, frequent binary")


def frequent_shingles(summaries: DataFrame) -> np.ndarray:
    """Hashes of at most FREQUENT shingles that tasks met often, rarest first. It only steers the order of prefixes."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                rows = np.frombuffer(block, np.int64).reshape(-1, 2)
                yield pa.record_batch({"h": pa.array(rows[:, 0]), "n": pa.array(rows[:, 1])})

    rows = summaries.where("frequent is not null").select("frequent").mapInArrow(opened, "h long, n long")
    top = rows.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas()
    return top["h"].to_numpy(np.int64)[::-1].view(np.uint64)


# --- cells: sets that share a shingle of their prefixes ---------------------------------------------------------------


def prefix(shingles: np.ndarray, often: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles in an order common to all sets: by hash, the frequent ones last, rarest first. Sets that link
    share one of them, since a set with none of its first n - needed + 1 in another has too few left to share."""
    n = len(shingles)
    most = n - -(-n * NUM // DEN) + 1
    at = np.minimum(np.searchsorted(often, shingles), max(len(often) - 1, 0))
    common = often[at] == shingles if len(often) else np.zeros(n, bool)
    light = shingles[~common][:most]
    if len(light) == most or not common.any():
        return light
    heavy = shingles[common][np.argsort(rank[at[common]], kind="stable")]
    return np.concatenate((light, heavy[: most - len(light)]))


def _cells(hashes: np.ndarray, sids: np.ndarray, sizes: np.ndarray) -> pa.Table:
    """(cell, sids, sizes): distinct lists of two sets or more that share a shingle, in the order of their sizes."""
    order = np.lexsort((sids, sizes, hashes))
    hashes, sids, sizes = hashes[order], sids[order], sizes[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (sids[1:] != sids[:-1])
    hashes, sids, sizes = hashes[fresh], sids[fresh], sizes[fresh]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, int)
    length = np.diff(np.append(first, len(hashes)))
    take = np.repeat(length > 1, length)
    sids, sizes, length = sids[take], sizes[take], length[length > 1]
    cuts = np.append(0, np.cumsum(length)).astype(np.int64)
    names = np.add.reduceat(mix(sids.view(np.uint64)), cuts[:-1]) if len(length) else np.zeros(0, np.uint64)
    table = pa.table({"cell": pa.array(names.view(np.int64)), "sids": binary_rows(sids, cuts), "sizes": binary_rows(sizes, cuts)})
    return table.take(pa.array(np.unique(names, return_index=True)[1]))


def candidate_cells(docs: DataFrame, k: int, often: np.ndarray) -> DataFrame:
    ranges = ready(docs.sparkSession)
    order = np.argsort(often)
    shared = docs.sparkSession.sparkContext.broadcast((often[order], order))

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, rank = shared.value

        def found() -> Iterator[tuple[int, int, np.ndarray]]:
            for batch in batches:
                seen = set()  # of copies in a batch one is enough
                for _, own in shingle_sets(batch, k):
                    sid = set_id(own)
                    if sid not in seen:
                        seen.add(sid)
                        yield sid, len(own), prefix(own, often, rank)

        yield from packed(found(), ranges)

    cells = by_range(docs.select("text").where("text is not null").mapInArrow(posted, PACKED), _cells, "cell long, sids binary, sizes binary")
    return saved(cells, "cells")


def chain_links(cells: DataFrame) -> DataFrame:
    """(a, b): in each cell, sets against the first one that is large enough for them; at most one pair per member."""

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[int, int]] = set()
            for sids, sizes in zip(batch.column("sids").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
                at, ids = 0, np.frombuffer(sids, np.int64).tolist()
                n = np.frombuffer(sizes, np.uint32).tolist()
                for i in range(1, len(ids)):
                    if NUM * n[i] > DEN * n[at]:
                        at = i
                    else:
                        seen.add((ids[at], ids[i]))
            pairs = np.array(list(seen), np.int64).reshape(-1, 2)
            yield pa.record_batch({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    pairs = cells.select("sids", "sizes").mapInArrow(chained, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# --- the R-tree --------------------------------------------------------------------------------------------------------


class Tree:
    """A packed R-tree over count vectors of one length: entries in the order of size and first coordinates, a node for each
    LEAF of the level below, described by the coordinate maxima and the least size under it."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray) -> None:
        self.order = np.lexsort((*vectors[:, :3].T[::-1], sizes))
        self.levels = [(vectors[self.order], sizes[self.order])]
        while len(self.levels[-1][1]) > 1:
            tops, least = self.levels[-1]
            cuts = np.arange(0, len(least), LEAF)
            self.levels.append((np.maximum.reduceat(tops, cuts), np.minimum.reduceat(least, cuts)))

    def pairs(self, other: Tree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of entries whose summed coordinate minima reach the overlap they need. A pair of nodes is left as soon as the
        minima of its maxima can't reach what its smallest sets need."""
        open_pairs = [(len(self.levels) - 1, len(other.levels) - 1, 0, 0)]
        while open_pairs:
            up, over, i, j = open_pairs.pop()
            left, right = self._below(up, i), other._below(over, j)
            (a, n), (b, m) = self.levels[max(up - 1, 0)], other.levels[max(over - 1, 0)]
            common = np.minimum(a[left, None], b[None, right]).sum(2, dtype=np.int64)
            x, y = np.nonzero(common >= needed(n[left, None].astype(np.int64) + m[None, right].astype(np.int64)))
            if up <= 1 and over <= 1:
                if len(x):
                    yield self.order[left][x], other.order[right][y]
            else:
                open_pairs += [(max(up - 1, 0), max(over - 1, 0), p, q) for p, q in zip(left[x].tolist(), right[y].tolist(), strict=True)]

    def _below(self, level: int, node: int) -> np.ndarray:
        """A node's children; at the lowest level the entry itself."""
        if level == 0:
            return np.array([node])
        return np.arange(node * LEAF, min((node + 1) * LEAF, len(self.levels[level - 1][1])))


def tree_join(sids: np.ndarray, sizes: np.ndarray, vectors: list[bytes], parts: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sids of different parts, one of each side if there are two, that the tree and then the parities let through."""
    lengths = np.array([len(v) // 4 for v in vectors])  # of groups
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    kinds = np.unique(lengths)
    one = len(np.unique(sides)) == 1
    for i, short in enumerate(kinds):
        for long in kinds[i:]:
            for s, t in ((0, 0),) if one else ((0, 1), (1, 0)):
                a = np.flatnonzero((lengths == short) & (one | (sides == s)))
                b = np.flatnonzero((lengths == long) & (one | (sides == t)))
                if not len(a) or not len(b) or (short == long and s > t):
                    continue
                if sizes[b].min() * NUM > DEN * sizes[a].max() or sizes[a].min() * NUM > DEN * sizes[b].max():
                    continue
                (ca, fa), (cb, fb) = (described([vectors[x] for x in rows], int(short)) for rows in (a, b))
                for x, y in Tree(ca, sizes[a]).pairs(Tree(cb, sizes[b])):
                    p, q = a[x], b[y]
                    fine = (parts[p] != parts[q]) & ((sids[p] < sids[q]) | (not one or short != long))  # a tree with itself meets twice
                    fine[fine] = ~far_apart(fa[x[fine]], fb[y[fine]], (sizes[p[fine]] + sizes[q[fine]]).astype(np.int64))
                    left.append(np.minimum(sids[p], sids[q])[fine])
                    right.append(np.maximum(sids[p], sids[q])[fine])
    return np.concatenate(left), np.concatenate(right)


def rest_links(cells: DataFrame, sets: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b) for what chains left open: in cells whose members are not yet one component, the pairs that an R-tree join of
    their count vectors lets through. Cells beyond CELL members are cut into blocks, and pairs of blocks joined apart."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, sids in zip(batch.column("cell").to_pylist(), batch.column("sids").to_pylist(), strict=True):
                ids = np.frombuffer(sids, np.int64)
                yield pa.record_batch({"cell": pa.array(np.full(len(ids), cell)), "sid": pa.array(ids), "many": pa.array(np.full(len(ids), -(-len(ids) // CELL), np.int32))})

    parts = groups.select(F.col("id").alias("sid"), F.col("component").alias("part"))
    members = cells.dropDuplicates(["cell"]).select("cell", "sids").mapInArrow(listed, "cell long, sid long, many int")
    members = saved(members.join(parts, "sid", "left").select("cell", "sid", "many", F.coalesce("part", "sid").alias("part")), "members")
    open_cells = members.groupBy("cell").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x != y").select("cell")
    members = members.join(open_cells, "cell", "left_semi").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("many")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    members = members.select(
        "cell", "sid", "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
    )
    members = members.join(sets.select("sid", "n", "vector"), "sid")

    def joined(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        get = lambda c: table.column(c).to_numpy()
        a, b = tree_join(get("sid"), get("n"), table.column("vector").to_pylist(), get("part"), get("side"))
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        cuts = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, int)
        return pa.table({"a": pa.array(a[cuts]), "bs": binary_rows(b, np.append(cuts, len(b)).astype(np.int64))})

    def merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        b = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("bs")]))
        return pa.table({"a": pa.array(np.full(len(b), key[0].as_py())), "b": pa.array(b)})

    # A pair may pass in many cells; a set's partners travel as one value per cell and become pairs once.
    partners = members.groupBy("cell", "i", "j").applyInArrow(joined, "a long, bs binary")
    return partners.groupBy("a").applyInArrow(merged, "a long, b long")


# --- exact check and result -------------------------------------------------------------------------------------------


def possible_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of those pairs of sids that counts and parities let through."""
    one = pairs.join(sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("vector").alias("va")), "a")
    both = one.join(sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("vector").alias("vb")), "b")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {c: batch.column(c).to_pylist() for c in ("na", "nb", "va", "vb")}
            fine = []
            for n, m, v, w in zip(*get.values(), strict=True):
                groups, total = min(len(v), len(w)) // 4, np.array([n + m])
                (x, p), (y, q) = described([v], groups), described([w], groups)
                fine.append(bool(np.minimum(x, y).sum(dtype=np.int64) >= needed(total)[0]) and not far_apart(p, q, total)[0])
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(fine, pa.bool_()))

    return both.select("a", "b", "na", "nb", "va", "vb").mapInArrow(bounded, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, k: int, bound: bool) -> DataFrame:
    """(a, b) of those pairs of sids that link: their descriptions first (bound), then the shingles themselves."""
    possible = saved(possible_links(pairs, sets) if bound else pairs, "possible")
    wanted = possible.select(F.col("a").alias("sid")).union(possible.select("b")).distinct()
    chosen = saved(sets.join(wanted, "sid", "left_semi").select("doc_id", "sid"), "chosen")
    texts = docs.join(small(chosen.select("doc_id")), "doc_id", "left_semi").select("text")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, blobs = [], []
            for _, own in shingle_sets(batch, k):
                ids.append(set_id(own))
                blobs.append(own.tobytes())
            yield pa.record_batch({"sid": pa.array(ids, pa.int64()), "shingles": pa.array(blobs, pa.binary())})

    shingles = saved(texts.mapInArrow(listed, "sid long, shingles binary").dropDuplicates(["sid"]), "shingles")
    full = possible.join(shingles.select(F.col("sid").alias("a"), F.col("shingles").alias("sa")), "a")
    full = full.join(shingles.select(F.col("sid").alias("b"), F.col("shingles").alias("sb")), "b")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = []
            for s, t in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                fine.append(DEN * common >= NUM * (len(x) + len(y) - common))
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(fine, pa.bool_()))

    return saved(full.select("a", "b", "sa", "sb").mapInArrow(compared, "a long, b long"), "links")


def jaccard_groups(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text).

    Documents link when their sets of k-word shingles have a Jaccard similarity of NUM / DEN or more; component_id is the
    smallest doc_id that links reach. Equal sets are joined once. Sets that share a shingle of their prefixes form cells, and
    every linked pair meets in one. In a cell, members are first checked against a few others, which joins groups of near
    copies with one pair each; where several components are left, an R-tree over the members' count vectors finds the pairs
    between them that can still link, and their shingles decide. No pair is emitted inside a component.

    Null and empty texts have no shingles and are alone. Rows with a null doc_id link with nothing and have a null component.
    Rows of one doc_id count each by its own text. An empty table gives no rows.
    Shingles are compared by 64-bit hashes.
    """
    ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    summaries = saved(summary(docs, k), "summaries")
    often = frequent_shingles(summaries)
    of_doc = summaries.where("frequent is null").select("doc_id", "n", "sid", "vector")
    sets = of_doc.where("sid is not null and doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("vector").alias("vector"))
    sets = saved(sets, "sets")
    docs = docs.where("doc_id is not null")
    cells = candidate_cells(docs, k, often)
    links = verified(chain_links(cells), sets, docs, k, True)
    groups = components(links)
    more = verified(rest_links(cells, sets, groups), sets, docs, k, False)
    groups = saved(components(links.union(more)), "groups")
    least = groups.select(F.col("id").alias("sid"), "component").join(sets.select("sid", "doc_id"), "sid")
    least = least.groupBy("component").agg(F.min("doc_id").alias("least"))
    smallest: Column = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "first", "doc_id"))
    named = groups.join(least, "component").select(F.col("id").alias("sid"), "least")
    named = sets.select("sid", F.col("doc_id").alias("first")).join(named, "sid", "left")
    return of_doc.select("doc_id", "n", "sid").join(named, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), smallest.alias("component_id"))
