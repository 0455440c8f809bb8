"""Ranked lexical search, importance resampling and suffix dedup against brute force on small texts."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from spendlens.llm import lexical_search, resampling, suffix_dedup

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def search_wanted(docs, items, top=10):
    bags = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    n_docs = sum(1 for _, _, n in bags if n)
    n_terms = sum(n for _, _, n in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    out = set()
    for item, text in items:
        scores = []
        for d, c, n in bags:
            if d is None or not n:
                continue
            m = 25 + (75 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, d))
        for rank, (s, d) in enumerate(sorted(scores)[:top], 1):
            out.add((item, rank, d, -s))
    return out


def made_texts(seed=5, n=70):
    rng = random.Random(seed)
    words = ["Apple", "apple", "pear", "fig", "ÉTÉ", "x1", "9", "plum", "kiwi", "lime", "yam"] + [f"w{i}" for i in range(30)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.3:
            rows.append((i, rng.choice(rows)[1]))  # copies: one class, ties broken by doc_id
        else:
            rows.append((i, " ".join(rng.choice(words) for _ in range(rng.choice((1, 5, 30))))))
    rows += [(200, None), (201, ""), (202, "!!! ..."), (203, "apple " * 2000), (None, "apple pear"), (5, "fig fig")]
    items = [(1, "apple pear"), (2, "fig, fig; kiwi"), (3, None), (4, "zzz"), (5, "Apple x1 9 w3 w4 w5")]
    return rows, items


def test_ranked_search_matches_brute_force(spark):
    rows, items = made_texts()
    docs = spark.createDataFrame(rows, DOCS).withColumn("Item_ID", F.lit(7))
    found = lexical_search.ranked_search(docs, spark.createDataFrame(items, ITEMS))
    got = {(r.item_id, r.rank, r.doc_id, r.score) for r in found.collect()}
    assert got == search_wanted(rows, items)


def test_ranked_search_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert lexical_search.ranked_search(empty, spark.createDataFrame([(1, "a")], ITEMS)).count() == 0
    docs = spark.createDataFrame([(1, "a b")], DOCS)
    assert lexical_search.ranked_search(docs, spark.createDataFrame([], ITEMS)).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, "")], DOCS)
    assert lexical_search.ranked_search(nulls, spark.createDataFrame([(1, "a")], ITEMS)).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def resample_wanted(docs, target, percent=10):
    def words(text):
        return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    def hist(texts):
        return Counter(zlib.crc32(w.encode()) % 10000 for t in texts for w in words(t))

    s, t = hist(x for _, x in docs), hist(target)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)}
    rows = []
    for d, text in docs:
        w = words(text)
        weight = sum(gain[zlib.crc32(x.encode()) % 10000] for x in w)
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"2024:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([d, len(w), weight, score, None])
    eligible = sorted((r for r in rows if r[0] is not None and r[1] >= 20), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(eligible[: len(eligible) * percent // 100], 1):
        r[4] = rank
    return sorted(map(tuple, rows), key=repr)


def test_resampling_matches_brute_force(spark):
    rows, items = made_texts(seed=9, n=120)
    rows += [(300, "Ünïcode wörds ÄÖ 漢字 " * 30), (301, "a" * 100000)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("ROW", F.lit(1))
    got = resampling.resample(docs, spark.createDataFrame(items, ITEMS).select("text"))
    got = sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
    assert got == resample_wanted(rows, [t for _, t in items])


def test_resampling_empty_and_collisions(spark):
    empty = spark.createDataFrame([], DOCS)
    assert resampling.resample(empty, spark.createDataFrame([], ITEMS).select("text")).count() == 0
    low = np.frombuffer(b"ab ab cd", np.uint8)
    table = resampling.InternTable(low, np.array([0, 3, 6]), np.array([2, 5, 8]))
    table.key[:] = 0  # a forced collision: keys equal, bytes differ, so cd takes a slot of its own
    assert table.slot[0] == table.slot[1] and table.count[table.slot[0]] == 2 and table.count[table.slot[2]] == 1


def bytes_wanted(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(data[i : i + length] for _, data in texts for i in range(len(data) - length + 1))
    out = []
    for d, data in texts:
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if seen[data[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
        out.append((d, len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def byte_texts(seed=11, n=50):
    rng = random.Random(seed)
    alphabet = "ab cé\n漢"
    passage = "".join(rng.choice(alphabet) for _ in range(260))
    rows = []
    for i in range(n):
        text = "".join(rng.choice("abcdefghij klmnop") for _ in range(rng.choice((10, 150, 400, 900))))
        if rng.random() < 0.4:
            at = rng.randrange(len(text) + 1)
            text = text[:at] + passage[: rng.choice((150, 199, 200, 201, 260))] + text[at:]
        if rows and rng.random() < 0.2:
            text = rng.choice(rows)[1] or ""
            if text and rng.random() < 0.5:
                k = rng.randrange(len(text))
                text = text[:k] + "Z" + text[k + 1 :]
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, "x" * 1000), (103, "ab" * 300 + "c"), (None, "q" * 10), (5, rows[5][1])]
    return rows


def test_suffix_sort_orders_like_bytes():
    rng = np.random.default_rng(4)
    buf = rng.integers(97, 100, 3000).astype(np.uint8)
    starts = rng.choice(2800, 500, replace=False)
    group = np.zeros(len(buf), np.int64)
    order = suffix_dedup.suffix_sort(buf, starts, group, 20)
    keys = [buf[s : s + 20].tobytes() for s in order]
    assert keys == sorted(keys)


def test_suffix_sort_reads_bytes_once_a_round():
    """Long ties, groups and all lengths: as sorted() by bytes, and equal neighbours are known without hashes."""
    rng = np.random.default_rng(6)
    passage = rng.integers(0, 256, 400).astype(np.uint8)
    buf = np.concatenate([np.concatenate((passage[rng.integers(0, 9) :], rng.integers(0, 2, 30).astype(np.uint8))) for _ in range(40)])
    starts = rng.permutation(len(buf) - 200)[:4000]
    group = rng.integers(0, 3, len(buf))
    for length in (1, 3, 8, 13, 50, 200):
        order, new = suffix_dedup._ranked(buf, starts, group, length)
        keys = [(group[s], buf[s : s + length].tobytes()) for s in order.tolist()]
        assert keys == sorted(keys)
        assert new.tolist() == [True, *(a != b for a, b in zip(keys, keys[1:]))]


def test_suffix_dedup_matches_brute_force(spark):
    rows = byte_texts()
    docs = spark.createDataFrame(rows, DOCS).withColumn("TEXT_", F.lit("x"))
    got = suffix_dedup.duplicate_bytes(docs).collect()
    assert sorted(map(tuple, got), key=repr) == bytes_wanted(rows, 200)
    assert suffix_dedup.duplicate_bytes(spark.createDataFrame([], DOCS)).count() == 0
