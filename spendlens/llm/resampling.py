"""Target-distribution importance resampling of documents, with word features interned per batch in an
open-addressed NumPy table.

Each batch of texts is cut into words on its bytes; every occurrence is keyed by the xxhash64 of its bytes and
inserted into a table of linear probing whose slots hold the key, a representative occurrence (whose bytes verify
every later key match, so a collision of two different words takes the next slot), the word's bucket (crc32 of its
bytes modulo the bucket count) and its count. Bucket counts of all batches are summed by Spark, for the documents and
for the target texts; the gains of the buckets (one number per bucket, a fixed parameter of 10,000) go to the tasks,
and each occurrence's slot id gathers its gain. The draw is a global sort of the eligible documents by score, ranked
by partition offsets, so no task sees more than its own range.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import ready, saved
from .words import blocks

#: Bucket count, seed text of the draw, share drawn in percent, words a document needs to be drawn.
BUCKETS = 10_000
SEED = "2024"
PERCENT = 10
MIN_WORDS = 20
#: A byte that belongs to a word (A-Z are lower-cased first): digits, letters and every byte of a non-ASCII character.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and row of every word of a block; words never cross rows."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = WORD_BYTES[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[cuts] = inside[cuts]
    cuts = cuts[cuts > 0]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


class InternTable:
    """Open-addressed table of the words of one block: keys, representative occurrence, bucket and count per slot."""

    def __init__(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int = BUCKETS):
        self.low, self.starts, self.lengths = low, starts, ends - starts
        view = memoryview(low)
        keys = np.fromiter((xxhash.xxh64_intdigest(view[s:e]) for s, e in zip(starts.tolist(), ends.tolist())),
                           np.uint64, len(starts))
        size = 1 << max(4, (2 * len(keys)).bit_length())
        mask = np.uint64(size - 1)
        self.key = np.zeros(size, np.uint64)
        self.rep = np.full(size, -1, np.int64)
        self.slot = np.full(len(keys), -1, np.int64)
        probe = (keys & mask).astype(np.int64)
        pending = np.arange(len(keys))
        while len(pending):
            at = probe[pending]
            free = self.rep[at] < 0
            if free.any():  # the first occurrence that reaches a free slot owns it
                slots, first = np.unique(at[free], return_index=True)
                owners = pending[free][first]
                self.rep[slots], self.key[slots] = owners, keys[owners]
            same = self.key[at] == keys[pending]
            same[same] = self._equal(pending[same], self.rep[at[same]])
            self.slot[pending[same]] = at[same]
            pending = pending[~same]
            probe[pending] = (probe[pending] + 1) & (size - 1)
        used = np.flatnonzero(self.rep >= 0)
        self.bucket = np.zeros(size, np.int64)
        self.bucket[used] = [zlib.crc32(view[s : s + n]) % buckets
                             for s, n in zip(starts[self.rep[used]].tolist(), self.lengths[self.rep[used]].tolist())]
        self.count = np.bincount(self.slot, minlength=size)

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether occurrences a and b hold the same bytes: the byte verification of a key match."""
        same = self.lengths[a] == self.lengths[b]
        n = self.lengths[a][same]
        if not len(n):
            return same
        begin = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(begin, n)
        differ = self.low[np.repeat(self.starts[a][same], n) + within] != self.low[np.repeat(self.starts[b][same], n) + within]
        same[same] = np.add.reduceat(differ, begin) == 0
        return same


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, InternTable]]:
    for row, end, raw, offsets in blocks(texts):
        low = LOWER[raw]
        starts, ends, rows = word_spans(raw, offsets)
        yield row, end, offsets, rows, starts, ends, InternTable(low, starts, ends)


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all words of all rows of texts: one row per bucket that occurs."""
    ready(texts.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, table in _blocks(batch.column(0)):
                total += np.bincount(table.bucket, weights=table.count, minlength=buckets).astype(np.int64)
        seen = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

    found = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(counted, "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """gain per bucket: floor(1000 * ln((t + 1) * (S + B) / ((s + 1) * (T + B)))), s and t the bucket's words in docs and
    target, S and T all their words, B the bucket count. One number per bucket reaches the driver."""
    s = np.zeros(buckets, np.float64)
    t = np.zeros(buckets, np.float64)
    for row in bucket_counts(docs, text, buckets).collect():
        s[row["bucket"]] = row["n"]
    for row in bucket_counts(target, text, buckets).collect():
        t[row["bucket"]] = row["n"]
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gains: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight) per row: words and the sum of their buckets' gains (0 without words)."""
    ready(docs.sparkSession)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = np.zeros(batch.num_rows, np.int64)
            weight = np.zeros(batch.num_rows, np.int64)
            for row, end, _, rows, _, _, table in _blocks(batch.column(1)):
                gain = gains[table.bucket[table.slot]]
                count[row:end] = np.bincount(rows, minlength=end - row)
                sums = np.concatenate(([0], np.cumsum(gain)))
                edges = np.searchsorted(rows, np.arange(end - row + 1))
                weight[row:end] = sums[edges[1:]] - sums[edges[:-1]]
            yield pa.record_batch({"doc_id": batch.column(0), "n_features": pa.array(count), "weight": pa.array(weight)})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(weighed, "doc_id long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text",
             target_text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of docs.

    score = weight + floor(-1000 * ln(-ln((h + 0.5) / 2**32))), h the first 8 hex digits of sha256('2024:<doc_id>'):
    a Gumbel draw fixed by the doc_id. Of the N rows with at least 20 words and a doc_id, floor(percent * N / 100) of
    highest score are drawn, equal scores to the smaller doc_id; rank numbers them from 1, others have a null rank.

    Defined cases: a null or empty text has no words (weight 0, never drawn); a null doc_id is never drawn (its score
    is null) but its words count in the statistics; repeated rows are separate rows; empty tables give no rows (an empty
    target gives every bucket t = 0). Extra columns are ignored whatever their names.
    """
    gains = bucket_gains(docs.select(F.col(text).alias("text")), target.select(F.col(target_text).alias("text")))
    found = weights(docs, gains, doc_id, text)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(SEED + ":"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    found = found.withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id())
    found = saved(found, "resample-scores")

    eligible = found.where((F.col("n_features") >= MIN_WORDS) & F.col("doc_id").isNotNull())
    draws = eligible.count() * percent // 100
    ordered = eligible.select("row", "doc_id", "score").orderBy(F.desc("score"), "doc_id", "row")
    ordered = saved(ordered.select("row", F.spark_partition_id().alias("part"),
                                   F.monotonically_increasing_id().alias("at")), "resample-order")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ordered.groupBy("part").agg(F.count("*").alias("n"))  # one row per partition of the sort
    offsets = offsets.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranks = ordered.join(F.broadcast(offsets), "part").select(
        "row", (F.col("offset") + F.col("at") - F.shiftleft(F.col("part").cast("long"), 33) + 1).alias("rank"))
    ranks = ranks.where(F.col("rank") <= draws)
    return found.join(ranks, "row", "left").select(
        "doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
