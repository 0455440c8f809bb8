"""Packing by lexical retrieval: a sharded BM25 index finds unused neighbours that fill each seed document's window."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TOKENIZER, encoder, slices
from .storage import ready, saved

WINDOW = 1024
END_ID = 0
#: A shard of the index holds documents until they have so many tokens; it is what a task keeps in memory at a time.
SHARD_TOKENS = 2_000_000
#: A term that one in so many documents of the shard holds has its weights in a row for all of them, others have postings.
DENSE = 8
K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, ids, signature): little-endian 16-bit ids, or 32-bit ones for larger vocabularies; signature is the least hash
    of two adjacent ids, so that documents with the same wording tend to be neighbours in its order."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        narrow = coder.tokenizer.get_vocab_size() <= 1 << 16
        for batch in batches:
            row = 0
            for texts in slices(batch.column("text")):
                ids, cuts = coder.encode_flat(texts, end_id)
                pairs = ids * np.uint32(0x9E3779B1) + np.append(ids[1:], 0).astype(np.uint32) * np.uint32(0x85EBCA77)
                pairs = (pairs ^ (pairs >> np.uint32(15))) * np.uint32(0xC2B2AE3D)
                pairs[cuts[1:] - 1] = np.uint32(0xFFFFFFFF)  # a document's last id has no successor
                least = np.minimum.reduceat(pairs, cuts[:-1])
                flat = ids.astype(np.uint16) if narrow else ids
                at = pa.array((cuts * flat.itemsize).astype(np.int32)).buffers()[1]
                blobs = pa.Array.from_buffers(pa.binary(), len(texts), [None, at, pa.py_buffer(flat)])
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(row, len(texts)), "ids": blobs, "signature": pa.array(least.astype(np.int64))})
                row += len(texts)

    return docs.mapInArrow(encode, "doc_id long, ids binary, signature long")


class Shard:
    """An inverted index of documents with BM25 weights, and which of them are still unused."""

    def __init__(self, ids: list[np.ndarray]) -> None:
        sizes = np.array([len(x) for x in ids])
        self.sizes, self.first = sizes.tolist(), np.append(0, np.cumsum(sizes))
        flat = np.concatenate(ids).astype(np.int64)
        self.raw = memoryview(flat.astype("<u4")).cast("B")
        keys, tf = np.unique((np.repeat(np.arange(len(ids)), sizes) << 32) | flat, return_counts=True)
        doc, term = keys >> 32, keys & 0xFFFFFFFF
        terms, term = np.unique(term, return_inverse=True)
        df = np.bincount(term, minlength=len(terms))
        idf = np.log1p((len(ids) - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / sizes.mean()))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight, self.at = doc[order], weight[order], np.append(0, np.cumsum(df))
        often = df * DENSE >= len(ids)
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.rows = np.zeros((int(often.sum()), len(ids)), np.float32)
        at = order[often[term[order]]]
        self.rows[self.row[term[at]], doc[at]] = weight[at]
        shared = np.flatnonzero(df[term] > 1)  # a term of one document finds no other
        shared = shared[np.lexsort((df[term[shared]], doc[shared]))]
        self.query = term[shared]
        self.query_at = np.searchsorted(doc[shared], np.arange(len(ids) + 1)).tolist()
        self.unused = np.ones(len(ids))
        self.left = len(ids)
        self.live = np.arange(len(ids))  # documents of the columns of rows: all that are unused, and some used ones
        self.next = 0

    def use(self, doc: int) -> None:
        self.left -= int(self.unused[doc])
        self.unused[doc] = 0

    def next_unused(self) -> int | None:
        while self.next < len(self.sizes) and not self.unused[self.next]:
            self.next += 1
        return self.next if self.next < len(self.sizes) else None

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused documents by falling BM25 score for all terms of the seed; then, if asked for more, those that share no
        term with it in order."""
        terms = self.query[self.query_at[seed] : self.query_at[seed + 1]]
        if len(terms):
            if self.left < 0.75 * len(self.live):
                kept = self.unused[self.live] > 0
                self.live, self.rows = self.live[kept], np.ascontiguousarray(self.rows[:, kept])
            row = self.row[terms]
            rare = terms[row < 0]
            first, n = self.at[rare], self.at[rare + 1] - self.at[rare]
            at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            live = self.live
            scores = np.bincount(self.doc[at], self.weight[at], len(self.sizes))[live]
            scores = (scores + self.rows[row[row >= 0]].sum(0)) * self.unused[live]
            while len(scores):
                best = int(scores.argmax())
                if scores[best] <= 0:
                    break
                scores[best] = 0
                yield int(live[best])
        while (doc := self.next_unused()) is not None:
            yield doc


def pack(shard: Shard, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as pieces (document, first id, ids). All but the last ones hold `window` ids.

    A seed fills windows of its own; what is left of it opens one that neighbours fill. The last of them is cut where the
    window ends, and its rest is the next seed. What remains at the end is cut into sequences whose lengths are powers of two.
    """
    seed, start = shard.next_unused(), 0
    while seed is not None:
        shard.use(seed)
        size = shard.sizes[seed]
        while size - start >= window:
            yield [(seed, start, window)]
            start += window
        if start == size:
            seed, start = shard.next_unused(), 0
            continue
        pieces, room, rest = [(seed, start, size - start)], window - (size - start), None
        for doc in shard.neighbours(seed):
            shard.use(doc)
            take = min(room, shard.sizes[doc])
            pieces.append((doc, 0, take))
            room -= take
            if take < shard.sizes[doc]:
                rest = (doc, take)
            if not room:
                break
        if room:
            yield from powers_of_two(pieces)
            return
        yield pieces
        seed, start = rest or (shard.next_unused(), 0)


def powers_of_two(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    left = sum(x[2] for x in pieces)
    queue = pieces[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out = []
        while room:
            doc, start, n = queue.pop()
            take = min(n, room)
            out.append((doc, start, take))
            room -= take
            if take < n:
                queue.append((doc, start + take, n - take))
        yield out


def packed_sequences(docs: DataFrame, window: int = WINDOW, tokenizer: str = TOKENIZER, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): every id of every row of docs (doc_id, text) once.

    start counts the document's ids before the piece, doc_tokens all of them with the end id, offset the sequence's ids
    before it. No sequence has padding: each is full, or its length is a power of two. Ids are written once to the shared
    folder, then dealt to ranges of their signature and doc_id, so that equal wordings meet while a group of copies of any
    size is spread over several ranges; a task indexes and packs its range in shards of bounded size, and every document
    of the range ends in one. Null and empty texts have the end id alone; repeated rows and null ids are packed like others.
    """
    parts = ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = saved(encoded(docs, tokenizer, end_id), "encoded")
    ranges = ids.repartitionByRange(parts, "signature", "doc_id").sortWithinPartitions("signature", "doc_id", "ids")

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        kind = "<u2" if encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        names: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def closed() -> pa.RecordBatch:
            nonlocal base
            shard, rows = Shard(held), []
            first, raw = shard.first.tolist(), shard.raw
            for pieces in pack(shard, window):
                offset = 0
                for doc, start, n in pieces:
                    a = (first[doc] + start) * 4
                    rows.append((names[doc], start, n, zlib.crc32(raw[a : a + 4 * n]), shard.sizes[doc], base, offset))
                    offset += n
                base += 1
            kinds = [f.split() for f in PIECES.split(", ")]
            columns = zip(*rows, strict=True)
            return pa.record_batch({name: pa.array(list(c), pa.int64()) for (name, _), c in zip(kinds, columns, strict=True)})

        for batch in batches:
            names += batch.column("doc_id").to_pylist()
            for blob in batch.column("ids"):
                held.append(np.frombuffer(blob.as_buffer(), kind).copy())
                size += len(held[-1])
                if size >= shard_tokens:
                    names, later = names[: len(held)], names[len(held) :]
                    yield closed()
                    names, held, size = later, [], 0
        if held:
            yield closed()

    return ranges.select("doc_id", "ids").mapInArrow(packs, PIECES)
