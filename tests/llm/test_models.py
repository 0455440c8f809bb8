"""Vectors, languages, token files, counts, packing and the pipeline."""

from __future__ import annotations

import math
import random
import struct
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from spendlens.llm import bpe, embedding_dedup, language_id, packing, queries, token_counts, token_output
from spendlens.llm.storage import new_path

DOCS = "doc_id long, text string"
TEXTS = [
    (5, "The cat sat on the mat."), (3, None), (8, ""), (1, "Don't  stop\n\n now\t!\r\nI'm here's"), (9, "é ünï   code 漢字 \U0001f600"),
    (2, "<|endoftext|> is text here"), (4, "a\x00b c\x1fd \x85e"), (7, "word " * 3000), (6, " lead and trail \n"), (10, "The cat sat on the mat."), (11, "x" * 5000),
]


def reference_ids(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_dictionary_encoder_is_exact(spark):
    rng = random.Random(1)
    signs = ["a", "Bc", " ", "  ", "\n", "'s", "'", "9", "12", ".", ",!", "é", "　", "​", "don't", "\t", "ß", "-", "_", "漢"]
    texts = [t for _, t in TEXTS] + ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(400)]
    coder = bpe.Encoder(public_tokenizers.path(bpe.TOKENIZER))
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)]
        assert got == [reference_ids(t) for t in texts]


def test_encoder_sends_each_distinct_piece_once():
    coder = bpe.Encoder(public_tokenizers.path(bpe.TOKENIZER))
    sent, whole = [], coder._whole
    coder._whole = lambda texts: sent.extend(texts) or whole(texts)
    texts = [f"Again the same words, the same words.\nAgain {i % 3}" for i in range(500)] + [None, "", " ", "\n"]
    ids, cuts = coder.encode_flat(texts, 7)
    wanted = {t: [*reference_ids(t), 7] for t in set(texts)}
    assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == [wanted[t] for t in texts]
    assert sum(map(len, sent)) < 100


def test_slices_take_texts_from_the_column_a_part_at_a_time():
    texts = [None, "", "é" * 30, "b" * 200, None, "c" * 10, "d" * 90, ""]
    column = pa.array(["before", *texts]).slice(1)
    for most in (1, 50, 100, 10_000):
        parts = list(bpe.slices(column, most))
        assert [t for part in parts for t in part] == texts == [t for part in bpe.slices(texts, most) for t in part]
        assert all(sum(len((t or "").encode()) for t in part[:-1]) < most for part in parts)
    assert list(bpe.slices(column.slice(0, 0))) == [] == list(bpe.slices([]))


def test_token_file_round_trip(spark):
    df = spark.createDataFrame(TEXTS, DOCS).withColumn("part", F.lit("x")).withColumn("ids", F.lit(1)).repartition(4)
    path = new_path(spark, "token-test")
    token_output.write_token_file(df, path)
    got = {r.doc_id: r for r in token_output.id_checksums(token_output.read_token_file(spark, path)).collect()}
    before = 0
    for doc, text in sorted(TEXTS):
        ids = [*reference_ids(text), 2]
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (before, len(ids), crc(ids))
        before += len(ids)
    some = token_output.read_token_file(spark, path, 4, 6)
    assert {r.doc_id: r.start for r in some.collect()} == {d: got[d].start for d in (4, 5, 6)}
    assert "PushedFilters: [IsNotNull(doc_id)" in some._jdf.queryExecution().toString() or "GreaterThanOrEqual(doc_id" in some._jdf.queryExecution().toString()


def test_token_file_null_ids_repeats_and_no_rows(spark):
    path = new_path(spark, "token-test")
    token_output.write_token_file(spark.createDataFrame([(2, "b"), (None, "a"), (2, "b"), (2, None)], DOCS), path)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_output.read_token_file(spark, path).collect())
    assert got == [(0, None, 2), (2, 2, 1), (3, 2, 2), (5, 2, 2)]
    path = new_path(spark, "token-test")
    token_output.write_token_file(spark.createDataFrame([], DOCS), path)
    assert token_output.id_checksums(token_output.read_token_file(spark, path)).count() == 0


def test_length_histogram(spark):
    df = spark.createDataFrame(TEXTS + TEXTS[:2], DOCS).withColumn("n_tokens", F.lit(1)).repartition(3)
    lengths = [len(reference_ids(t)) for _, t in TEXTS + TEXTS[:2]]
    got = {r.n_tokens: r for r in token_counts.length_histogram(df).collect()}
    assert set(got) == set(lengths)
    for limit, r in got.items():
        within, beyond = [x for x in lengths if x <= limit], [x for x in lengths if x > limit]
        assert (r.n_docs, r.n_tokens_sum) == (lengths.count(limit), lengths.count(limit) * limit)
        assert (r.docs_within, r.tokens_within, r.docs_beyond, r.tokens_beyond) == (len(within), sum(within), len(beyond), sum(beyond))
        assert r.truncated_tokens == sum(min(x, limit) for x in lengths) and r.quantile == len(within) / len(lengths)
    assert token_counts.length_histogram(df.limit(0)).count() == 0


@pytest.mark.parametrize("shard_tokens", [200, 2_000_000])
def test_packing(spark, shard_tokens):
    rng = random.Random(9)
    rows = TEXTS + [(100 + i, " ".join(rng.choice(("sun", "moon", "star", "sea", "wind")) for _ in range(rng.randrange(400)))) for i in range(80)]
    df = spark.createDataFrame(rows, DOCS).withColumn("start", F.lit(0)).withColumn("signature", F.lit("s")).repartition(3)
    pieces = packing.packed_sequences(df, shard_tokens=shard_tokens).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == {d for d, _ in rows}
    for doc, text in rows:
        ids, at = [*reference_ids(text), 0], 0
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids) and p.ids_crc32 == crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0
    assert packing.packed_sequences(df.limit(0)).count() == 0


def test_packing_prefers_related_documents():
    topics = [np.arange(t * 50, t * 50 + 50) for t in range(4)]
    rng = np.random.default_rng(3)
    ids = [rng.choice(topics[i % 4], 100) for i in range(40)]
    same = total = 0
    for pieces in packing.pack(packing.Shard(ids), 256):
        kinds = [doc % 4 for doc, _, _ in pieces]
        same += sum(a == b for a, b in zip(kinds, kinds[1:]))
        total += len(kinds) - 1
    assert same / total > 0.8


def test_packing_ranks_by_all_terms_of_a_seed():
    """A seed of 40 terms: 12 rare ones are in document 2, the other 28 in 3 and 4; 1 shares nothing."""
    seed = np.arange(40)
    ids = [seed, np.arange(100, 140), np.arange(12), np.arange(12, 40), np.arange(12, 40), np.arange(200, 240)]
    shard = packing.Shard(ids)
    shard.use(0)
    found = shard.neighbours(0)
    order = []
    for doc in found:
        shard.use(doc)
        order.append(doc)
    assert set(order[:3]) == {2, 3, 4} and order[3:] == [1, 5]

    rng = np.random.default_rng(5)
    ids = [rng.integers(0, 300, rng.integers(5, 120)) for _ in range(60)]
    shard = packing.Shard(ids)
    sets, mean = [set(x.tolist()) for x in ids], sum(map(len, ids)) / len(ids)
    df = {t: sum(t in s for s in sets) for t in range(300)}
    for seed in range(0, 60, 7):
        def score(doc, seed=seed):
            tf = np.bincount(ids[doc], minlength=300)
            norm = packing.K1 * (1 - packing.B + packing.B * len(ids[doc]) / mean)
            return sum(math.log1p((60 - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (packing.K1 + 1) / (tf[t] + norm) for t in sets[seed] & sets[doc] if df[t] > 1)

        found = shard.neighbours(seed)
        first = [next(found) for _ in range(20)]
        best = sorted(map(score, range(60)), reverse=True)[:20]
        assert [score(d) for d in first] == pytest.approx(best, rel=1e-5)


def test_repeated_and_null_rows_are_packed(spark):
    rows = [(1, "same text"), (1, "same text"), (None, None), (None, "x")]
    pieces = packing.packed_sequences(spark.createDataFrame(rows, DOCS)).collect()
    assert sum(p.length for p in pieces) == sum(len(reference_ids(t)) + 1 for _, t in rows)


def vectors_wanted(rows):
    usable = {i: v for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v) and i is not None}
    links = {i: 0 for i, _ in rows}
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(usable, 2):
        x, y = np.array(usable[a], float), np.array(usable[b], float)
        if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
            links[a] += 1
            links[b] += 1
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    return {i: (links[i], root(i), root(i) == i) for i, _ in rows}


@pytest.mark.parametrize("dims", [2, 24])
def test_near_duplicates(spark, monkeypatch, dims):
    monkeypatch.setattr(embedding_dedup, "PER_PIVOT", 12)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(60, dims))
    more = np.concatenate([base, base[:20] + rng.normal(0, 0.1, (20, dims)), base[:10] * 3.0, np.repeat(base[5:6], 25, 0), base[:3] * 1e-30])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(more)]
    rows += [(500, None), (501, [0.0] * dims), (502, [math.nan] + [1.0] * (dims - 1)), (503, [None] + [1.0] * (dims - 1)), (504, []), (505, [math.inf] * dims), (506, [1.0] * (dims + 1)), (507, [2.0] * (dims + 1))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cid", F.lit("c")).withColumn("v", F.lit(0)).repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == vectors_wanted(rows)


def test_near_duplicates_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(df).where("vec_id is not null").collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True)]
    assert [tuple(r) for r in embedding_dedup.near_duplicates(df).where("vec_id is null").collect()] == [(None, 0, None, False)]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_bound_every_group(spark, monkeypatch):
    """Vectors without clusters and a tight cluster: no group holds more than two blocks, as hashes deal them."""
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    monkeypatch.setattr(embedding_dedup, "PER_PIVOT", 150)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 20)
    largest, real = [], PandasGroupedOpsMixin.applyInArrow

    def seen(self, func, schema):
        if "copies" in self._df.columns:
            keys = [c for c in self._df.columns if c not in ("home", "cid", "copies", "v")]
            largest.append(self._df.groupBy(*keys).count().agg(F.max("count")).head()[0])
        return real(self, func, schema)

    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInArrow", seen)
    rng = np.random.default_rng(8)
    base = np.concatenate([rng.normal(size=(250, 16)), np.ones((150, 16)) + rng.normal(0, 0.2, (150, 16))])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == vectors_wanted(rows)
    assert largest and largest[0] <= 2 * 20 * 1.7


def test_near_duplicates_move_each_vector_once(spark, monkeypatch):
    """Vectors without clusters: what is shuffled to be compared grows with the table, not with its square."""
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    monkeypatch.setattr(embedding_dedup, "PER_PIVOT", 60)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 20)
    moved, real = [], PandasGroupedOpsMixin.applyInArrow

    def seen(self, func, schema):
        moved.append(self._df.count())
        return real(self, func, schema)

    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInArrow", seen)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(240, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, base[:30], base[:30] + rng.normal(0, 0.1, (30, 16))]))]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == vectors_wanted(rows)
    assert moved == [270]


def test_near_duplicates_in_clusters_and_books(spark, monkeypatch):
    """Single precision, many books, cells far apart and cells that touch; one vector makes up a third of the rows."""
    monkeypatch.setattr(embedding_dedup, "PER_PIVOT", 16)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    monkeypatch.setattr(embedding_dedup, "LEAST_BOOKS", 5)
    rng = np.random.default_rng(10)
    centers = rng.normal(size=(12, 6))
    base = np.concatenate([c + rng.normal(0, s, (15, 6)) for c, s in zip(centers, np.linspace(0.05, 0.8, 12))] + [np.repeat(centers[:1], 90, 0)]).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in zip(rng.permutation(len(base)).tolist(), base)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == vectors_wanted(rows)


@pytest.mark.parametrize("dense", [0, 2])
def test_links_of_blocks(monkeypatch, dense):
    """A comparison by its close pairs, and by all products, in tiles: the same links as by brute force."""
    monkeypatch.setattr(embedding_dedup, "DENSE", dense)
    monkeypatch.setattr(embedding_dedup, "TILE", 50)
    rng = np.random.default_rng(11)
    rows = np.concatenate([c + rng.normal(0, 0.35, (40, 20)) for c in rng.normal(size=(5, 20))])
    rows = np.concatenate([rows, np.eye(20)[:1], 0.9 * np.eye(20)[:1] + np.sqrt(1 - 0.81) * np.eye(20)[1:2]])
    rng.shuffle(rows)
    units = embedding_dedup._unit(rows)
    turn, copies = embedding_dedup._Turn(units, 0.9), rng.integers(1, 5, len(rows))
    turn.first = 8
    blocks = [embedding_dedup._Block(rows[p], p + 1000, copies[p], turn) for p in np.split(np.arange(len(rows)), [93])]
    counts, spans, space = np.zeros(len(rows), int), [], embedding_dedup._Space()
    for i, j in ((0, 0), (0, 1), (1, 1)):
        order = embedding_dedup._Order(*(np.zeros(len(blocks[k].cids)) for k in (i, j)), 0.0)
        for of_a, of_b, low, high in embedding_dedup._links(blocks[i], blocks[j], order, 0.9, space):
            counts[blocks[i].cids - 1000] += of_a
            counts[blocks[j].cids - 1000] += of_b * (i != j)
            spans += zip(low.tolist(), high.tolist())
    linked = np.einsum("ik,jk->ij", units, units) >= 0.9
    np.fill_diagonal(linked, False)
    assert 100 < linked.sum() and counts.tolist() == (linked @ copies).tolist()
    label = np.arange(len(rows))
    for _ in rows:
        label = np.minimum(label, np.where(linked, label[None], len(rows)).min(1))
    spanned = np.arange(len(rows))
    for _ in rows:
        for low, high in spans:
            spanned[low - 1000] = spanned[high - 1000] = min(spanned[low - 1000], spanned[high - 1000])
    assert spanned.tolist() == label.tolist()


def test_language_id_held_out(spark, small):
    got = queries.op4_language_id(spark, small)
    truth = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang")
    held = got.join(truth, "doc_id").where("held_out").collect()
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in held)


def test_language_id_corner_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "fr"), (4, "", None), (5, "12 + 34 !", "en"), (6, "漢字", None), (7, "the dog", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("old")).withColumn("margin", F.lit(2))
    found = language_id.predict(df, language_id.train(df))
    got = {r.doc_id: r for r in found.collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 7)] == ["en", "fr", "und", "und", "und", "en"]
    assert got[6].lang_pred in ("en", "fr") and got[3].ambiguous and got[1].margin == 2 and got[3].score == 0
    nothing = language_id.train(df.where("lang is null"))
    assert {r.lang_pred for r in language_id.predict(df, nothing).collect()} == {"und"}
    one = language_id.predict(df, language_id.train(df.where("lang = 'en'"))).where("doc_id = 7").head()
    assert one.lang_pred == "en"
    assert language_id.predict(df.limit(0), nothing).count() == 0


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 30])
def test_codewords_differ_in_many_bits(n):
    code = language_id.codewords(n)
    apart = min((code[a] != code[b]).sum() for a, b in combinations(range(n), 2))
    assert apart >= (1 if n == 2 else 2 if n == 3 else 4)
    assert (abs(code.sum(0)) < n).all()


def test_ambiguous_codewords_are_flagged():
    code = language_id.codewords(4)
    model = language_id.Model(list("abcd"), code, np.zeros((1, 7), np.float32), np.ones(7) / 7)
    margins = np.stack([8.0 * code[2], np.zeros(7), 8.0 * np.where(np.arange(7) == 1, -code[1], code[1])])
    best, score, lead = language_id.decode(model, margins)
    assert best[0] == 2 and best[2] == 1 and best[1] == 0  # one flipped bit is corrected
    assert lead[1] == 0 and abs(score[1] - 0.25) < 1e-12 and lead[0] > 0.2


def test_pipeline(spark, small):
    """Every stage against its operator's brute force lies in the operators' tests; here, what each stage lets through."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names, kept = [n for n, _ in corpus_pipeline.STAGES], {}
    extra = [(10_000, None, None, None, None), (10_001, "123 !!", "en", "s", 6)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, small), name)
        kept[name] = docs
        if name != names[-1]:
            assert docs.columns == before.columns
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in kept.items()}
    assert ids["language"] == {r.doc_id for r in before.collect()} - {10_000, 10_001}
    from tests.llm.test_texts import decontamination_wanted, jaccard_wanted

    rows = [(r.doc_id, r.text) for r in kept["language"].collect()]
    assert ids["near_copies"] == {d for d, (_, group) in jaccard_wanted(rows).items() if d == group}
    rows = [(r.doc_id, r.text) for r in kept["near_copies"].collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert ids["decontamination"] == {d for d, (_, hit, _) in decontamination_wanted(rows, items).items() if not hit}
    assert ids["secrets"] == ids["decontamination"] == ids["packing"]
    assert kept["secrets"].where(F.col("text").rlike('token = "[0-9a-f]{40}"')).count() == 0
    lengths = kept["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    assert lengths.where("n != m").count() == 0


def test_pipeline_language_rejects_what_decoding_rejects(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rng = random.Random(4)
    clean = {x: " ".join(r.text for r in docs.where(F.col("lang") == x).orderBy("doc_id").limit(12).collect())[:6000] for x in ("en", "fr")}
    extra = [
        (10_000, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(80))),
        (10_001, clean["en"][:2500] + " " + clean["fr"][:2500]), (10_002, clean["en"][3000:]), (10_003, clean["en"][:100].rsplit(" ", 1)[0]),
    ]
    more = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in extra], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.union(more), small).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.collect()} | {10_002, 10_003}


def test_pipeline_without_labels_keeps_texts_with_letters(spark, small):
    rows = [(1, "some text", None, "s", 9), (2, "12 !", None, "s", 4), (3, None, None, "s", None), (4, "漢字", None, "s", 2)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{small}/documents.parquet").schema)
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, small).collect()} == {1, 4}


def test_queries_without_sql():
    missing = set(queries.QUERIES) - set(queries.ORACLE)
    assert missing == {"op4_language_id", "op5_token_output", "op6_secret_scan", "op9_packing", "op10_token_counts"}
    assert corpus_pipeline.ORACLE_SQL is None
