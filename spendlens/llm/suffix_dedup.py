"""Suffix-array dedup of bytes: a suffix sort finds every 200-byte string that starts twice.

Suffixes are sorted by their bytes, eight at a time from the first on, all groups at once in NumPy: a round orders the
suffixes that are still tied by their next eight bytes, and one that ties with no other any more is done. What is tied
after 200 bytes is equal in every byte, so a hash collision never removes a byte.

The sort is split so that no task sees more than its share. Every 200-byte window of a text has one anchor, the
32-byte string of least hash inside it (the leftmost on ties), and equal windows have equal anchors at the same
place. Anchors are counted over the whole table; only those that occur twice or more bring the bytes around them (the
windows they anchor) to one group, contexts of identical bytes are merged first, and each group's suffixes are sorted
on their own. Windows in a context that occurs twice are duplicates at once; of the others only those whose window
hash recurs in the group enter the sort (equal windows have equal hashes), and the sort decides by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import ready, saved
from .words import _ODD, _ODD_INVERSE, _RANDOM, blocks, mix, powers

#: Fixed value: bytes of a string that counts as repeated.
LENGTH = 200
#: Bytes of an anchor; a window holds LENGTH - ANCHOR + 1 of them.
ANCHOR = 32
#: Rows of contexts sorted at a time in a task (a group is never cut).
SORT_ROWS = 5_000
_CHUNK = 1 << 23
_LOW = np.uint64((1 << 24) - 1)


def _prefix(raw: np.ndarray) -> np.ndarray:
    sums = _RANDOM[raw] * powers(_ODD, len(raw) + 1)[: len(raw)]
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(sums, dtype=np.uint64)))


def _hash(prefix: np.ndarray, start: np.ndarray, n) -> np.ndarray:
    """Polynomial hash of the n bytes from each start (n may be an array)."""
    return (prefix[start + n] - prefix[start]) * powers(_ODD_INVERSE, len(prefix))[start]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[s:s + w]) for every s, in three passes over x (prefix and suffix minima of blocks of w)."""
    pad = (-len(x)) % w
    blocks_ = np.concatenate((x, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, w)
    before = np.minimum.accumulate(blocks_, axis=1).ravel()
    after = np.minimum.accumulate(blocks_[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: len(x) - w + 1], before[w - 1 : len(x)])


def anchors_of(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """Of a block of texts: (anchor hash, row, anchor byte, first and last window start it anchors), bytes of the row."""
    reach = length - anchor + 1
    n = len(raw)
    if n < length:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, none
    prefix = _prefix(raw)
    starts = np.arange(n - anchor + 1)
    keys = mix(_hash(prefix, starts, anchor))
    least = np.empty(n - length + 1, np.int64)
    for c0 in range(0, n - length + 1, _CHUNK):  # positions within a chunk fit 24 bits: ties go to the leftmost
        part = keys[c0 : c0 + _CHUNK + reach - 1]
        local = (part & ~_LOW) | np.arange(len(part), dtype=np.uint64)
        found = _sliding_min(local, reach)
        least[c0 : c0 + len(found)] = (found & _LOW).astype(np.int64) + c0
    windows = np.arange(n - length + 1)
    row = np.searchsorted(offsets, windows, "right") - 1
    valid = windows + length <= offsets[row + 1]
    windows, least, row = windows[valid], least[valid], row[valid]
    if not len(windows):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, none
    new = np.concatenate(([True], (least[1:] != least[:-1]) | (row[1:] != row[:-1])))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(windows)])) - 1
    at = least[first]
    r = row[first]
    base = offsets[r]
    return keys[at], r, at - base, windows[first] - base, windows[last] - base


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for row, _, raw, offsets in blocks(batch.column(1)):
            h, r, _, lo, hi = anchors_of(raw, offsets)
            yield pa.record_batch({
                "h": pa.array(h.view(np.int64)), "row": pa.array(ids[row + r]),
                "lo": pa.array(lo, pa.int32()), "hi": pa.array(hi, pa.int32()),
            })


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the windows each anchor of a row anchors, from its first window start to the end of its last window, and
    their sha256, which stands for them where only equality counts."""
    for batch in batches:
        h, ctx, row, lo = [], [], [], []
        for r, text, found in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(),
                                  batch.column("found").to_pylist()):
            data = (text or "").encode()
            for f in found:
                h.append(f["h"])
                ctx.append(data[f["lo"] : f["hi"] + LENGTH])
                row.append(r)
                lo.append(f["lo"])
        names = [hashlib.sha256(c).digest() for c in ctx]
        yield pa.record_batch({"h": pa.array(h, pa.int64()), "name": pa.array(names, pa.binary()), "ctx": pa.array(ctx, pa.binary()),
                               "row": pa.array(row, pa.int64()), "lo": pa.array(lo, pa.int32())})


def _ranked(buf: np.ndarray, suffixes: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): suffixes in the order of (group, first `length` bytes), and which of them differ from the one before.
    Stable. The bytes are read as big-endian words at any place of buf; the last word may lap over the one before."""
    size = min(length, 8)
    words = np.ndarray((len(buf) - size + 1,), f">u{size}" if size in (1, 2, 4, 8) else f"S{size}", buf, strides=(1,))
    of = group[suffixes]
    by = np.argsort(of, kind="stable")
    order, of = suffixes[by], of[by]
    new = np.ones(len(order), bool)
    new[1:] = of[1:] != of[:-1]
    for at in dict.fromkeys([*range(0, length - size + 1, size), length - size]):
        tied = ~new
        tied[:-1] |= ~new[1:]
        open_ = np.flatnonzero(tied)
        if not len(open_):
            break
        word = words[order[open_] + at]
        word = word if size not in (1, 2, 4, 8) else word.astype(np.uint64)
        head = new[open_]
        differs = np.zeros(len(open_), bool)
        differs[1:] = (word[1:] != word[:-1]) & ~head[1:]
        if not differs.any():
            continue
        cls = np.cumsum(head) - 1
        split = np.flatnonzero((np.bincount(cls, differs) > 0)[cls])  # members of ties that end here
        by = split[np.lexsort((word[split], cls[split]))]
        order[open_[split]] = order[open_[by]]
        word, part = word[by], cls[split]
        new[open_[split[1:]]] |= (word[1:] != word[:-1]) & (part[1:] == part[:-1])
    return order, new


def suffix_sort(buf: np.ndarray, suffixes: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """suffixes (byte starts in buf, each with `length` bytes after it) in the order of (group, bytes). Stable. group is
    indexed by byte start."""
    return _ranked(buf, suffixes, group, length)[0]


def _runs(offsets: np.ndarray) -> list[dict]:
    if not len(offsets):
        return []
    cut = np.flatnonzero(np.diff(offsets) != 1)
    firsts = np.concatenate(([0], cut + 1))
    lasts = np.concatenate((cut, [len(offsets) - 1]))
    return [{"a": int(offsets[f]), "b": int(offsets[t])} for f, t in zip(firsts, lasts)]


def _judge(h: np.ndarray, ctx: list[bytes], mult: np.ndarray, length: int = LENGTH) -> list[list[dict]]:
    """Runs of window offsets of each context that are duplicated; h sorted, so that groups are contiguous."""
    sizes = np.array([len(c) for c in ctx], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    group = np.concatenate(([0], np.cumsum(h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    distinct = np.bincount(group)[group] if len(h) else group
    buf = np.frombuffer(b"".join(ctx) + bytes(length), np.uint8)
    count = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(ctx)), count)
    suffix = starts[owner] + (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count))
    dup = mult[owner] >= 2
    sort = np.flatnonzero(distinct[owner] >= 2)
    if len(sort):
        # Only suffixes whose window hash another window of the group shares, some of them in a context seen once,
        # can gain from the sort: equal windows have equal hashes, so the others are settled already.
        prefix = _prefix(buf)
        wh, g = _hash(prefix, suffix[sort], length), group[owner[sort]]
        once = mult[owner[sort]] < 2
        o = np.lexsort((wh, g))
        new = np.concatenate(([True], (g[o][1:] != g[o][:-1]) | (wh[o][1:] != wh[o][:-1])))
        cls = np.cumsum(new) - 1
        weight = np.bincount(cls, weights=np.where(once[o], 1, 2))
        seen_once = np.bincount(cls, weights=once[o])
        sort = sort[o][(weight[cls] >= 2) & (seen_once[cls] > 0)]
    if len(sort):
        byte_group = np.full(len(buf), -1, np.int64)
        byte_group[suffix[sort]] = group[owner[sort]]
        order, new = _ranked(buf, suffix[sort], byte_group, length)
        hit = np.zeros(len(buf), bool)
        hit[order[1:][~new[1:]]] = True
        hit[order[:-1][~new[1:]]] = True
        dup |= hit[suffix]
    edges = np.concatenate(([0], np.cumsum(count)))
    return [_runs(suffix[edges[i] : edges[i + 1]][dup[edges[i] : edges[i + 1]]] - starts[i]) for i in range(len(ctx))]


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of contexts (rows sorted by h) sorted a few thousand rows at a time; a group is never cut."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def flush(table: pa.Table) -> pa.RecordBatch:
        h = table.column("h").to_numpy()
        runs = _judge(h, table.column("ctx").to_pylist(), table.column("mult").to_numpy())
        typed = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        return pa.record_batch({"h": table.column("h").combine_chunks(), "name": table.column("name").combine_chunks(),
                                "runs": pa.array(runs, typed)})

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < SORT_ROWS:
            continue
        table = pa.Table.from_batches(held)
        h = table.column("h").to_numpy()
        cut = int(np.searchsorted(h, h[-1], "left"))  # the last group may go on in the next batch
        if cut > 0:
            yield flush(table.slice(0, cut))
            table = table.slice(cut)
        held, rows = table.to_batches(), table.num_rows
    if rows:
        yield flush(pa.Table.from_batches(held))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        spans_of = batch.column("spans").to_pylist()
        n_bytes, n_removed, n_spans, digest = [], [], [], []
        for text, spans in zip(texts, spans_of):
            data = (text or "").encode()
            gone = np.zeros(len(data) + 1, np.int64)
            if spans:
                np.add.at(gone, [s["a"] for s in spans], 1)
                np.add.at(gone, [min(s["b"], len(data)) for s in spans], -1)
            mask = np.cumsum(gone[:-1]) > 0
            n_bytes.append(len(data))
            n_removed.append(int(mask.sum()))
            n_spans.append(int(np.count_nonzero(mask[1:] & ~mask[:-1]) + (len(mask) > 0 and mask[0])))
            kept = np.frombuffer(data, np.uint8)[~mask].tobytes() if len(data) else b""
            digest.append(hashlib.sha256(kept).hexdigest())
        yield pa.record_batch({
            "doc_id": batch.column("doc_id"), "n_bytes": pa.array(n_bytes, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()),
            "kept_sha256": pa.array(digest, pa.string()),
        })


def duplicate_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row of docs.

    A byte is removed when a 200-byte string covering it starts at another place too, in the same or another row;
    strings are judged on the input. n_spans counts maximal removed runs; kept_sha256 is the sha256 of the bytes left.
    Defined cases: a null text is empty (0 bytes, the digest of nothing); texts under 200 bytes keep everything; a
    repeated row is a text of its own, so two equal rows of 200 bytes or more lose all; null doc_ids are kept as rows;
    an empty table gives no rows. Extra columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    ready(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"),
                       F.col(text).cast("string").alias("text"))
    anchors = rows.select("row", "text").mapInArrow(_anchor_rows, "h long, row long, lo int, hi int")
    anchors = saved(anchors, "suffix-anchors")
    twice = anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    found = anchors.join(twice, "h", "left_semi").groupBy("row").agg(
        F.collect_list(F.struct("h", "lo", "hi")).alias("found"))
    contexts = rows.join(found, "row").select("row", "text", "found").mapInArrow(
        _context_rows, "h long, name binary, ctx binary, row long, lo int")
    contexts = saved(contexts, "suffix-contexts")
    distinct = contexts.groupBy("h", "name", "ctx").agg(F.count("*").alias("mult"))
    judged = distinct.repartition("h").sortWithinPartitions("h").mapInArrow(
        _judged, "h long, name binary, runs array<struct<a:int,b:int>>")
    judged = saved(judged.where(F.size("runs") > 0), "suffix-judged")
    spans = contexts.select("h", "name", "row", "lo").join(judged, ["h", "name"]).select(
        "row", F.explode(F.transform("runs", lambda r: F.struct((r["a"] + F.col("lo")).alias("a"),
                                                                  (r["b"] + F.col("lo") + LENGTH).alias("b")))).alias("s"))
    spans = spans.groupBy("row").agg(F.collect_list("s").alias("spans"))
    out = rows.join(spans, "row", "left").select("doc_id", "text", "spans")
    return out.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
