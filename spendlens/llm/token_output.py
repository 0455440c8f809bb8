"""Token ids as ORC files in document order: run-length encoded ids, row indexes, Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import TOKENIZER, encoder, slices
from .storage import ready

END_ID = 2
SCHEMA = "part int, first long, doc_id long, n_tokens int, ids array<int>"


def write_token_file(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, stripe_bytes: int = 16 << 20) -> None:
    """Encode every whole text, append end_id, and write the ids in ascending doc_id order as a folder of ORC files.

    Texts move once, to ranges of doc_id; each range is sorted, encoded and written by one task, which also stores its
    number (part) and for each document the ids before it in the range (first). A range holds its documents one batch at a
    time. Stripes can be read in parallel; min/max statistics, row indexes and a Bloom filter on doc_id prune them.
    A null text has the end id alone. A null doc_id comes first; rows of one doc_id follow in the order of their texts.
    """
    parts = ready(docs.sparkSession)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, first, coder = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for batch in batches:
            row = 0
            for texts in slices(batch.column("text")):
                ids, before = coder.encode_flat(texts, end_id)
                n = np.diff(before)
                yield pa.record_batch({
                    "part": pa.array(np.full(len(n), part, np.int32)),
                    "first": pa.array(first + before[:-1]),
                    "doc_id": batch.column("doc_id").slice(row, len(n)),
                    "n_tokens": pa.array(n.astype(np.int32)),
                    "ids": pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(ids.view(np.int32))),
                })
                row += len(n)
                first += int(before[-1])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranges = texts.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    (
        ranges.mapInArrow(encoded, SCHEMA).write
        .option("orc.bloom.filter.columns", "doc_id").option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", 1000).option("compression", "zstd").orc(path)
    )


def read_token_file(spark: SparkSession, path: str, first_doc: int | None = None, last_doc: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a written folder, or of the documents in a range of ids, which prunes stripes.

    start counts the ids of all documents before this one in the whole folder.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    totals = rows.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("n"))  # a row per written range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    if first_doc is not None:
        rows = rows.where(F.col("doc_id") >= first_doc)
    if last_doc is not None:
        rows = rows.where(F.col("doc_id") <= last_doc)
    rows = rows.join(totals, "part")
    return rows.select("doc_id", (F.col("before") + F.col("first")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def id_checksums(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): ids as little-endian unsigned 32-bit integers, for rows of read_token_file."""
    ready(rows.sparkSession)

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False))).cast("B")
            at = ids.offsets.to_numpy() * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.record_batch({**{c: batch.column(c) for c in ("doc_id", "start", "n_tokens")}, "ids_crc32": pa.array(crc, pa.int64())})

    return rows.mapInArrow(checked, "doc_id long, start long, n_tokens long, ids_crc32 long")
