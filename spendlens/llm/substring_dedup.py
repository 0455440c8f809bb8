"""Substring dedup by relative Lempel-Ziv parsing: each document against all documents with smaller ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .postings import PACKED, binary_rows, by_range, owner_blocks, packed
from .storage import BROADCAST_IDS, ready, saved
from .words import blocks, runs, word_hashes

WINDOW = 13
#: Words of an anchor. A window's anchor is the one of its word runs of this length with the least hash.
ANCHOR = 5


def _documents(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    """(batch, row, words, hash and anchor of each window) for each document."""
    anchor = min(ANCHOR, window)
    for batch in batches:
        for first, end, raw, offsets in blocks(batch.column("text")):
            hashes, _, _, starts = word_hashes(raw, offsets, lower=False)
            windows, least = runs(hashes, window), runs(hashes, anchor)
            width, reach = 1, window - anchor + 1
            while width < reach and len(least):  # the least of 1, 2, 4, ... neighbours, then of all
                step = min(width, reach - width)
                least = np.minimum(least[:-step], least[step:])
                width += step
            for row in range(first, end):
                a, b = int(starts[row - first]), int(starts[row - first + 1])
                n = max(0, b - a - window + 1)
                yield batch, row, b - a, windows[a : a + n], least[a : a + n]


def _shared_postings(hashes: np.ndarray, owners: np.ndarray, keep_first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Postings whose hash other documents have too; keep_first: its first document's too, else only those after it."""
    order = np.lexsort((owners, hashes))
    hashes, owners = hashes[order], owners[order]
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    run = np.cumsum(new) - 1
    later = owners > owners[np.flatnonzero(new)][run]
    take = np.bincount(run, later)[run] > 0 if keep_first else later
    return hashes[take], owners[take]


def _by_document(hashes: np.ndarray, owners: np.ndarray) -> pa.Table:
    order = np.argsort(owners, kind="stable")
    hashes, owners = hashes[order], owners[order]
    cuts = np.flatnonzero(np.append(True, owners[1:] != owners[:-1])) if len(owners) else np.zeros(0, int)
    at = np.append(cuts, len(owners)).astype(np.int64)
    return pa.table({"doc_id": pa.array(owners[cuts]), "found": binary_rows(hashes, at)})


def _shared(postings: DataFrame, keep_first: bool, ranges: int, name: str) -> DataFrame:
    """(doc_id, found): the hashes that each document shares. Both ways, to hash ranges and back to documents, postings move
    as blocks; what one document gets back is a part of its own windows."""
    back = by_range(postings, lambda h, owner, _: owner_blocks(*_shared_postings(h, owner, keep_first), ranges), PACKED)
    return saved(by_range(back, lambda h, owner, _: _by_document(h, owner), "doc_id long, found binary"), name)


def _joined(docs: DataFrame, found: DataFrame, every: bool) -> DataFrame:
    """docs with their lists. Few documents are picked before their texts are shuffled; the others never move."""
    if found.count() > BROADCAST_IDS:
        return docs.join(found, "doc_id", "left" if every else "inner")
    ids = F.broadcast(found.select("doc_id"))
    rows = docs.join(ids, "doc_id", "left_semi").join(found, "doc_id").select("doc_id", "text", "found")
    if not every:
        return rows
    alone = docs.join(ids, "doc_id", "left_anti").select("doc_id", "text", F.lit(None).cast("binary").alias("found"))
    return rows.unionByName(alone)


def factors(hit: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Greedy factors (first word, words) from the windows that the reference holds.

    From a window that is held, the factor is extended as long as the next one is; where it ends, the windows over its
    boundary have been looked up like all others, so a factor of `window` words that begins inside it is found as well.
    """
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 1)
    first, last = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]
    return [(int(a), int(b - a) + window) for a, b in zip(first, last, strict=True)]


def duplicate_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, factors) for every row of docs (doc_id, text).

    The reference of a document is every document with a smaller id; a factor is a run of its words whose every `window`
    words stand in the reference, in whatever documents. kept is the text without them, its words joined by one blank.

    The reference is indexed in hash ranges, in two steps, so that what moves stays below the size of the texts. First
    only anchors are posted, about one word run in five; equal windows have equal anchors, so a window whose anchor no
    other document has is unique. Then the windows of shared anchors are posted and looked up. Copies of one text by the
    thousand give as many postings as they have windows, never pairs. Windows are compared by 64-bit hashes.

    Null and empty texts, and texts shorter than a window, keep all words. A null doc_id is compared with nothing; rows of
    one doc_id don't count against each other and are each parsed. An empty table gives an empty result.
    """
    ranges = ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def post_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ((batch.column("doc_id")[row].as_py(), np.unique(anchor)) for batch, row, _, _, anchor in _documents(batches, window) if len(anchor))
        yield from packed(((doc, 0, own) for doc, own in ids), ranges)

    def of_list(batch: pa.RecordBatch, row: int) -> np.ndarray:
        got = batch.column("found")[row].as_py()
        return np.frombuffer(got, np.uint64) if got else np.zeros(0, np.uint64)

    def post_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[int, int, np.ndarray]]:
            for batch, row, _, hashes, anchor in _documents(batches, window):
                own = np.unique(hashes[np.isin(anchor, of_list(batch, row))])
                if len(own):
                    yield batch.column("doc_id")[row].as_py(), 0, own

        yield from packed(found(), ranges)

    known = docs.where("doc_id is not null")
    anchors = _shared(known.mapInArrow(post_anchors, PACKED), True, ranges, "anchors")
    shared = _shared(_joined(known, anchors, False).mapInArrow(post_windows, PACKED), False, ranges, "windows")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept", "factors")}
        for batch, row, n, hashes, _ in _documents(batches, window):
            words = (batch.column("text")[row].as_py() or "").encode().split()
            spans = factors(np.isin(hashes, of_list(batch, row)), window)
            removed = np.zeros(n, bool)
            for first, length in spans:
                removed[first : first + length] = True
            if spans:
                words = [w for w, gone in zip(words, removed.tolist(), strict=True) if not gone]
            for k, v in zip(out, (batch.column("doc_id")[row].as_py(), n, int(removed.sum()), b" ".join(words).decode(), [{"first": a, "words": b} for a, b in spans]), strict=True):
                out[k].append(v)
            if len(out["doc_id"]) == 1000:
                yield pa.RecordBatch.from_pydict(out, schema)
                out = {k: [] for k in out}
        yield pa.RecordBatch.from_pydict(out, schema)

    span = pa.struct([("first", pa.int64()), ("words", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("factors", pa.list_(span))])
    rows = _joined(docs, shared, True).select("doc_id", "text", "found")
    return rows.mapInArrow(parsed, "doc_id long, n_words long, n_removed long, kept string, factors array<struct<first: long, words: long>>")
