"""The operators of this subpackage as registered queries over whole tables, and their DuckDB twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import decontaminate
from .embedding_dedup import near_duplicates
from .jaccard_join import jaccard_groups
from .lexical_search import ranked_search
from .resampling import resample
from .suffix_dedup import duplicate_bytes
from .language_id import held_out, predict, train
from .packing import packed_sequences
from .secret_scan import scan_secrets
from .storage import new_path
from .substring_dedup import duplicate_spans
from .token_counts import length_histogram
from .token_output import id_checksums, read_token_file, write_token_file
from .url_filter import judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duplicate_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-ids")
    write_token_file(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return id_checksums(read_token_file(spark, path))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    digest = F.sha2("value", 256).alias("value_sha256")
    return found.select("doc_id", "word", F.length("value").alias("n_chars"), digest, F.round("score", 6).alias("score"), "is_secret")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_sequences(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(table(spark, sf_dir, "documents").select("text"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = ranked_search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("item_id", "rank", "doc_id", "score")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark").select("text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_embedding_dedup, op2_decontamination, op3_substring_dedup, op4_language_id, op5_token_output,
        op6_secret_scan, op7_url_filter, op8_jaccard_join, op9_packing, op10_token_counts,
        op11_lexical_search, op12_suffix_dedup, op13_resampling,
    )
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_TERMS11 = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), [])"

ORACLE: dict[str, str] = {
    "op11_lexical_search": f"""
WITH d AS (SELECT doc_id, {_TERMS11} AS w FROM documents),
stats AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n_docs, sum(len(w)) AS n_terms FROM d),
dt AS (SELECT doc_id, t, count(*) AS tf FROM d, unnest(w) AS u(t) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM dt GROUP BY t),
q AS (SELECT item_id, t, count(*) AS q_count FROM (SELECT item_id, {_TERMS11} AS w FROM benchmark), unnest(w) AS u(t) GROUP BY ALL),
m AS (SELECT doc_id, 25 + (75 * len(w)::BIGINT * n_docs) // n_terms AS m FROM d, stats),
w AS (SELECT t, floor(1000 * ln((2.0 * n_docs + 2) / (2.0 * df + 1)))::BIGINT AS w FROM df, stats),
s AS (
  SELECT item_id, dt.doc_id, sum(q_count * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS score
  FROM q JOIN dt USING (t) JOIN w USING (t) JOIN m ON m.doc_id = dt.doc_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score::BIGINT AS score FROM r WHERE rank <= 10""",
    "op1_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) END >= 0.9),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON least.x = e.vec_id LEFT JOIN counts ON counts.x = e.vec_id""",
    "op2_decontamination": f"""
WITH items AS (SELECT item_id, {_TERMS} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS p
  FROM items, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS t(i) WHERE len(w) > 0),
d AS (SELECT doc_id, coalesce({_TERMS}, []) AS w FROM documents),
runs AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS p
  FROM d, (SELECT DISTINCT n FROM win) AS lengths, unnest(generate_series(1, len(w) - n + 1)) AS t(i)),
hits AS (SELECT DISTINCT doc_id, i, runs.n, item_id FROM runs JOIN win ON runs.p = win.p AND runs.n = win.n),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, unnest(generate_series(i, i + n - 1)) AS t(j) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) AS x GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op3_substring_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS p
  FROM d, unnest(generate_series(1, len(w) - 12)) AS t(i)),
first AS (SELECT p, min(doc_id) AS least FROM win GROUP BY p HAVING min(doc_id) < max(doc_id)),
covered AS (
  SELECT DISTINCT doc_id, j FROM win JOIN first USING (p), unnest(generate_series(i, i + 12)) AS t(j) WHERE doc_id > least),
words AS (SELECT doc_id, j, w[j] AS word FROM d, unnest(generate_series(1, len(w))) AS t(j)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS n
  FROM words ANTI JOIN covered USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op7_url_filter": r"""
WITH RECURSIVE parts AS (
  SELECT page_id, html,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, split_part(url, '#', 1) AS node
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts),
links AS (
  SELECT node AS x, split_part(regexp_extract(html, '(?i)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1), '#', 1) AS y
  FROM ruled WHERE regexp_matches(html, '(?i)<link[^>]*rel="canonical"[^>]*href="')),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
blocked(node) AS (
  SELECT node FROM ruled WHERE rule IN ('example.org/es/', 'example.org/en/1', 'com/de/')
  UNION SELECT y FROM blocked JOIN both_ways ON x = node)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN node IN (SELECT node FROM blocked) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""",
    "op8_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS p
  FROM d, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.p = b.p AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.y) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.x = d.doc_id GROUP BY d.doc_id, n.n""",
}
