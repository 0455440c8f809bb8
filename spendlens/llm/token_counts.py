"""Token counts: an exact histogram of encoded lengths that answers every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import TOKENIZER, encoder, slices
from .storage import ready

#: Lengths of one bucket of the two-level sums; a bucket's rows meet in one task, at most so many.
BUCKET = 1024


def encoded_lengths(docs: DataFrame, tokenizer: str = TOKENIZER, text: str = "text") -> DataFrame:
    """(n_tokens) per document: ids of the whole text, no special tokens; 0 for a null or empty text."""
    ready(docs.sparkSession)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch.column(0)):
                yield pa.record_batch({"n_tokens": pa.array(np.diff(coder.encode_flat(part)[1]))})

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(lengths, "n_tokens long")


def length_histogram(docs: DataFrame, tokenizer: str = TOKENIZER, text: str = "text") -> DataFrame:
    """One row per length that occurs, read as a context limit of so many tokens.

    n_tokens (the length, or limit), n_docs and n_tokens_sum (documents of just this length and their tokens),
    docs_within and tokens_within (documents that fit the limit), docs_beyond and tokens_beyond (those that don't: the
    suffix sums), truncated_tokens (what is left of all documents when each is cut to the limit), quantile (share of
    documents that fit). An empty table gives no rows; null and empty texts have length 0; repeated rows count each time.

    Documents are counted per length before the shuffle, so what moves is one row per task and length. Suffix sums take
    two levels: totals of buckets of 1024 lengths, then sums inside a bucket, so no task sees more than one bucket's lengths
    or the list of buckets.
    """
    lengths = encoded_lengths(docs, tokenizer, text).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    lengths = lengths.select(
        "n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("n_tokens_sum"),
        F.floor(F.col("n_tokens") / BUCKET).alias("bucket"),
    )
    totals = lengths.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens_sum").alias("t"))
    later = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "bucket",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_later"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_later"),
        F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("all_tokens"),
    )
    inside = Window.partitionBy("bucket").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    rows = lengths.join(totals, "bucket").select(
        "n_tokens", "n_docs", "n_tokens_sum", "all_docs", "all_tokens",
        (F.coalesce(F.sum("n_docs").over(inside), F.lit(0)) + F.col("d_later")).alias("docs_beyond"),
        (F.coalesce(F.sum("n_tokens_sum").over(inside), F.lit(0)) + F.col("t_later")).alias("tokens_beyond"),
    )
    return rows.select(
        "n_tokens", "n_docs", "n_tokens_sum",
        (F.col("all_docs") - F.col("docs_beyond")).alias("docs_within"),
        (F.col("all_tokens") - F.col("tokens_beyond")).alias("tokens_within"),
        "docs_beyond", "tokens_beyond",
        (F.col("all_tokens") - F.col("tokens_beyond") + F.col("docs_beyond") * F.col("n_tokens")).alias("truncated_tokens"),
        ((F.col("all_docs") - F.col("docs_beyond")) / F.col("all_docs")).alias("quantile"),
    )
