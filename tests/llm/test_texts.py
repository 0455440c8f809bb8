"""Operators on words against brute force: small texts with nulls, ties, repeats, long and empty ones."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlens.llm import decontamination, jaccard_join, secret_scan, substring_dedup, url_filter
from spendlens.llm.components import components

DOCS = "doc_id long, text string"
EMPTY = [(901, None), (902, ""), (903, " \t\n"), (904, "Über"), (None, None)]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def spaced(text):
    return [w.decode() for w in (text or "").encode().split()]


def made(seed=3, n=60):
    """Texts of few words with copies, near copies and common passages, one of them very long."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["É", "straße", "The", "THE"]
    passage = [rng.choice(words) for _ in range(30)]
    rows = []
    for i in range(n):
        kind = rng.random()
        text = [rng.choice(words) for _ in range(rng.choice((3, 20, 80)))]
        if kind < 0.3 and rows:
            text = spaced(rng.choice(rows)[1])
            for _ in range(rng.randrange(3)):
                text[rng.randrange(len(text))] = rng.choice(words)
        elif kind < 0.6:
            at = rng.randrange(len(text))
            text = text[:at] + passage[: rng.choice((10, 13, 14, 30))] + text[at:]
        rows.append((i * 3, rng.choice((" ", "\n", "\t ")).join(text)))
    rows.append((7, " ".join(rng.choice(words) for _ in range(5000))))
    return rows + EMPTY


@pytest.mark.parametrize("window", [3, 13])
def test_substring_dedup(spark, window):
    rows = made()
    want, seen = {}, {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = spaced(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[i : i + window]), doc) < doc:
                gone.update(range(i, i + window))
        want[doc] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    want[None] = (0, 0, "")
    df = spark.createDataFrame(rows, DOCS).withColumn("found", F.lit(1)).withColumn("range", F.lit("x")).repartition(5)
    got = substring_dedup.duplicate_spans(df, window).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == want
    for r in got:
        covered = {i for f in r.factors for i in range(f.first, f.first + f.words)}
        assert len(covered) == r.n_removed and all(f.words >= window for f in r.factors)


def test_substring_dedup_repeated_ids_and_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], DOCS)
    got = sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.duplicate_spans(df).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 20)]
    assert substring_dedup.duplicate_spans(df.limit(0)).count() == 0


def sets_of(rows, k=5):
    out = {}
    for doc, text in rows:
        w = spaced(lower(text))
        out[doc] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def least_reachable(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def jaccard_wanted(rows):
    sets = {d: s for d, s in sets_of(rows).items() if d is not None}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    groups = least_reachable(sets, links)
    return {d: (len(sets[d]), groups[d]) for d in sets}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_groups(spark, seed):
    rows = made(seed, 90)
    df = spark.createDataFrame(rows, DOCS).withColumn("n", F.lit("x")).withColumn("sid", F.lit(None).cast("string")).repartition(4)
    got = jaccard_join.jaccard_groups(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == jaccard_wanted(rows)
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(0, None)]


def test_jaccard_tree_finds_what_chains_miss(spark, monkeypatch):
    """Chains of texts that each link with the next only, in cells cut into blocks, with every shingle called frequent."""
    monkeypatch.setattr(jaccard_join, "SEEN", 1)
    monkeypatch.setattr(jaccard_join, "CELL", 4)
    monkeypatch.setattr(jaccard_join, "LEAF", 2)
    rng = random.Random(5)
    words = [f"x{i}" for i in range(400)]
    rows = [(100 + i, " ".join(words[5 * i : 5 * i + 60])) for i in range(40)]
    rows += [(300 + i, " ".join(words[100:150] + [rng.choice(words) for _ in range(4)])) for i in range(20)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = jaccard_join.jaccard_groups(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard_wanted(rows)


def test_tree_join_against_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    base = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (30, 60, 200)]
    sets = []
    for _ in range(120):
        own = base[rng.integers(3)].copy()
        change = rng.random(len(own)) < rng.choice((0.02, 0.1, 0.3))
        own[change] = rng.integers(0, 1 << 63, change.sum(), dtype=np.uint64)
        sets.append(np.unique(own[rng.random(len(own)) < 0.95]))
    sizes, sids = np.array([len(s) for s in sets]), np.arange(len(sets))
    vectors = [jaccard_join.count_vector(s) for s in sets]
    a, b = jaccard_join.tree_join(sids, sizes, [v.tobytes() for v in vectors], sids, np.zeros(len(sets), int))
    got = set(zip(a.tolist(), b.tolist(), strict=True))
    links = {(i, j) for i, j in combinations(range(len(sets)), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    assert links and links <= got and len(got) < len(sets) * (len(sets) - 1) // 2


def test_jaccard_frequent_shingles_are_counted_in_place():
    rng = np.random.default_rng(2)
    for n, most in ((100, 400), (5, 1000), (1, 2), (0, 9)):
        held = {i: np.unique(rng.integers(0, most, n).astype(np.uint64)) for i in range(50)}
        counts = Counter(v for own in held.values() for v in own.tolist())
        assert jaccard_join.seen_often(held).tolist() == sorted([v, c] for v, c in counts.items() if c >= jaccard_join.SEEN)
        assert not held
    held = {i: np.unique(rng.integers(0, 1 << 60, 10_000).astype(np.uint64)) for i in range(100)}
    size = sum(x.nbytes for x in held.values())
    tracemalloc.start()
    jaccard_join.seen_often(held)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * size  # the sets themselves were there before


def test_jaccard_no_rows(spark):
    assert jaccard_join.jaccard_groups(spark.createDataFrame([], DOCS)).count() == 0
    alone = jaccard_join.jaccard_groups(spark.createDataFrame([(5, None)], DOCS)).collect()
    assert [tuple(r) for r in alone] == [(5, 0, 5)]


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def decontamination_wanted(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = terms(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    want = {}
    for doc, text in docs:
        w, hit, names = terms(text), set(), set()
        for i in range(len(w)):
            for n in {len(x) for x in windows}:
                if tuple(w[i : i + n]) in windows and i + n <= len(w):
                    hit.update(range(i, i + n))
                    names |= {str(x) for x in windows[tuple(w[i : i + n])] if x is not None}
        want[doc] = (len(w), len(hit), sorted(names))
    return want


def test_decontamination(spark):
    docs = made(8)
    texts = [t for _, t in docs if t and len(spaced(t)) > 30]
    items = [(1, " ".join(spaced(texts[0])[3:20])), (10, " ".join(spaced(texts[0])[3:20])), (2, "The, straße-É!"), (3, None), (4, ""), (None, texts[1][:90]), (5, "unseen words"), (6, "w1")]
    items += [(6, "w1"), (7, texts[2].upper())]
    df = spark.createDataFrame(docs, DOCS).withColumn("_key", F.lit("mine")).withColumn("items", F.lit(0)).withColumn("term", F.lit(0))
    got = decontamination.decontaminate(df.repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == decontamination_wanted(docs, items)
    assert all(r._key == "mine" and r.contaminated == (r.n_hit > 0) for r in got)
    assert len(got) == len(docs)


def test_decontamination_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b"), (1, "a b")], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in decontamination.decontaminate(docs, items).collect()] == [(2, 0), (2, 0)]
    assert decontamination.decontaminate(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_decontamination_long_text_with_frequent_candidates(spark):
    """A text of 80,000 words with the item's first word everywhere: the words are split once, not per candidate."""
    filler = " ".join(["the", "cat"] * 40_000)
    text = filler + " the cat sat on the mat " + filler
    docs = spark.createDataFrame([(1, text), (2, "the cat")], DOCS)
    items = spark.createDataFrame([(9, "the cat sat on the mat")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontamination.decontaminate(docs, items).collect()}
    assert got == {1: (160_006, 6, ["9"]), 2: (2, 0, [])}


def test_decontamination_runs_no_python(spark):
    docs = spark.createDataFrame([(1, "a b c")], DOCS)
    plan = decontamination.decontaminate(docs, docs.select(F.col("doc_id").alias("item_id"), "text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 52), (60, 29)], [(5, 4), (4, 5), (None, 3)]])
def test_components(spark, edges):
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    real = [e for e in edges if None not in e and e[0] != e[1]]
    assert {r.id: r.component for r in got} == least_reachable({x for e in real for x in e}, real)


PAGES = [
    (1, "https://A.example.ORG/es/x?q#f", None), (2, "http://example.org/en/12", ""), (3, "http://a.com/de/1", "<p>"), (4, None, None), (5, "no url", "x"),
    (6, "https://alias.net/1", '<link rel="canonical" href="http://a.com/de/1#top">'), (7, "https://alias.net/2", "<LINK REL=canonical HREF='https://alias.net/1'>"),
    (8, "https://ok.com/fr/", '<link href="http://a.com/de/1" rel="canonical">'), (9, "https://alone.net", '<meta http-equiv="refresh" content="0; url=https://other.net/">'),
    (10, "https://notexample.org", None), (10, "https://notexample.org", None), (11, "x://badcom/de/1", None),
]


def test_url_filter(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("component", F.lit(1)).withColumn("_node", F.lit(1))
    redirects = spark.createDataFrame([("https://alias.net/2", "https://far.net/z"), (None, "x"), ("https://far.net/z", "https://far.net/z")], "from_url string, to_url string")
    far = spark.createDataFrame([(12, "https://far.net/z", None)], "page_id long, url string, html string")
    rows = url_filter.judge_urls(pages.select("page_id", "url", "html", "component", "_node").unionByName(far, True), redirects=redirects).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert got == {
        1: ("a.example.org", "/es/x", "example.org/es/", "block"), 2: ("example.org", "/en/12", "example.org/en/1", "block"),
        3: ("a.com", "/de/1", "com/de/", "block"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"),
        6: ("alias.net", "/1", None, "block"), 7: ("alias.net", "/2", None, "block"), 8: ("ok.com", "/fr/", "com/fr/", "allow"),
        9: ("alone.net", "", None, "allow"), 10: ("notexample.org", "", None, "allow"), 11: ("badcom", "/de/1", None, "allow"),
        12: ("far.net", "/z", None, "block"),
    }
    assert len(rows) == len(PAGES) + 1
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_url_filter_resolves_relative_targets(spark):
    link, refresh = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    forms = [
        ("https://X.net/a/b?q=1", link.format("//y.com/de/1")), ("https://x.net/1", refresh.format("//y.com/de/2")),
        ("https://x.com/en/2", link.format("/de/1")), ("https://x.com/a/b/c", link.format("../../de/./1#top")), ("http://x.com", refresh.format("de/1")),
        ("https://x.com/it/k", refresh.format("../de/x/..")), ("https://x.com/it/", link.format("?p=1")), ("https://x.com/z", link.format("mailto:a@x.com")),
        ("no address", link.format("/de/1")), ("https://x.com/u", link.format("/de2?u=https://x.com/de/1")),
    ]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(forms)], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(pages).collect()}
    assert [got[i] for i in range(10)] == ["block"] * 6 + ["allow"] * 4
    ends = {(r.a, r.b) for r in url_filter.page_edges(pages).collect()}
    assert ends >= {("https://x.com/a/b/c", "https://x.com/de/1"), ("https://x.com/it/k", "https://x.com/de/"), ("https://x.com/it/", "https://x.com/it/?p=1")}
    assert len(ends) == 8


def secret_rows():
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "omega", "lambda"]
    rows = []
    for i in range(160):
        text = [rng.choice(words) for _ in range(30)]
        digest = hashlib.sha1(str(i).encode()).hexdigest()
        if i % 4 == 0:
            text[10:10] = ["token", "=", f'"{digest}"']
        if i % 4 == 1:
            text[5:5] = ["".join(rng.choice(words) for _ in range(5))]
        if i % 4 == 2:
            text[7:7] = [str(rng.randrange(10**15, 10**16))]
        rows.append((i, " ".join(text), "en", f"src{i % 3}", 0))
    return rows + [(900, None, None, None, None), (901, "", "en", None, 0)]


def test_secret_scan_and_redaction(spark):
    docs = spark.createDataFrame(secret_rows(), "doc_id long, text string, lang string, source string, n_chars long").withColumn("_key", F.lit(5))
    got = secret_scan.scan_secrets(docs).collect()
    candidates = {(d, i, v) for d, t, *_ in secret_rows() for i, w in enumerate((t or "").split(" ")) for v in re.findall(secret_scan.CANDIDATE, w)}
    assert {(r.doc_id, r.word, r.value) for r in got} == candidates
    assert {r.doc_id for r in got if r.is_secret} == set(range(0, 160, 4))
    clean = {r.doc_id: r for r in secret_scan.redact(docs).collect()}
    assert len(clean) == 162 and clean[0]._key == 5 and clean[900].text is None
    for d, t, *_ in secret_rows():
        want = re.sub('"[0-9a-f]{40}"', '"[SECRET]"', t) if t is not None and d % 4 == 0 and d < 900 else t
        assert clean[d].text == want
    assert clean[0].n_chars == len(clean[0].text)


def test_secret_forest_on_held_out_findings(spark):
    """Learned on three quarters of the findings, judged on the rest by whether a digest was planted."""
    docs = secret_scan._keyed(spark.createDataFrame(secret_rows(), "doc_id long, text string, lang string, source string, n_chars long"))
    words = secret_scan.dictionary(docs)
    found = secret_scan.findings(docs, words)
    scanner = secret_scan.train(secret_scan.rule_labels(found.where("doc_id % 16 < 12")), words)
    rest = secret_scan.scored(found.where("doc_id % 16 >= 12"), scanner).collect()
    assert len(rest) > 20 and all((r.score >= 0.5) == (len(r.value) == 40) for r in rest)


def test_secret_scan_with_nothing_to_learn(spark):
    schema = "doc_id long, text string"
    only = spark.createDataFrame([(1, f"password = '{'a1' * 12}'"), (1, f"password = '{'a1' * 12}'"), (None, "x")], schema)
    assert [(r.doc_id, r.is_secret) for r in secret_scan.scan_secrets(only).collect()] == [(1, True), (1, True)]
    assert secret_scan.scan_secrets(only.limit(0)).count() == 0
    assert secret_scan.redact(only.limit(0)).count() == 0


def test_short_and_punctuated_passwords_are_found_and_redacted(spark):
    planted = [
        ('password = "hunter2-prod"', "hunter2-prod"), ("pwd=Tr0ub4dor&3", "Tr0ub4dor&3"), ("api_key: k9.x!2$,", "k9.x!2$"),
        ("secret ='p4$$w0rd'", "p4$$w0rd"), ('{"auth_token":"a1.b2!c3"}', "a1.b2!c3"),
    ]
    rows = [(i, f"alpha beta {planted[i % 5][0]} gamma x{planted[i % 5][1]} delta") for i in range(60)]
    rows += [(100 + i, f"alpha {''.join(('omega', 'delta', 'gamma')[(i >> k) % 3] for k in range(5))} beta gamma = x1 delta") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.value) for r in secret_scan.scan_secrets(docs).where("is_secret").collect()}
    assert found >= {(i, planted[i % 5][1]) for i in range(60)} and all(d < 100 for d, _ in found)
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    for i, text in rows:
        form, value = planted[i % 5]
        want = text.replace(form, form.replace(value, "[SECRET]")) if i < 100 else text
        assert clean[i] == want
