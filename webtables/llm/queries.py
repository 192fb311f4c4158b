"""The registered queries of the operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, dac, exact_dedup, merkle, ngram_join, packing, quality, simhash, substring_dedup, toxicity, url_filter, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(_table(spark, sf_dir, "documents"), size=4, percent=85).drop("class_size", "n_links")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=0)


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removals(_table(spark, sf_dir, "documents"), window=50).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = dac.token_store(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return dac.read_digests(spark, files)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


#: The contract's rules: (verdict, host, path).
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def llm_queries():
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_quality": op2_quality,
        "op3_toxicity": op3_toxicity,
        "op4_ngram_join": op4_ngram_join,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_nearest": op6_nearest,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_token_files": op8_token_files,
        "op9_bpe": op9_bpe,
        "op10_url_filter": op10_url_filter,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_whitening": op12_whitening,
        "op13_simhash": op13_simhash,
        "pipeline": pipeline,
    }


OP1_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), k AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i : i + 3], ' '))
                                      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id
FROM reach r JOIN documents d ON d.doc_id = r.a LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), p AS (
  SELECT doc_id, unnest(range(1, len(words) - 48)) AS i, words FROM w WHERE len(words) >= 50
), k AS (SELECT doc_id, i, md5(array_to_string(words[i : i + 49], ' ')) AS win FROM p),
f AS (SELECT win, min(doc_id) AS first FROM k GROUP BY win HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM k JOIN f USING (win) WHERE first < doc_id
), g AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_transform(
         list_filter(range(1, len(words) + 1), lambda j: NOT list_contains(gone, j)), lambda j: words[j]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""

#: Rules on the page's own URL, else the verdict of its aliases by canonical links and
#: refresh redirects to whole URLs.
OP10_SQL = r"""
WITH RECURSIVE rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
tags AS (
  SELECT regexp_extract(url, '^[^#]*') AS a, unnest(regexp_extract_all(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?\s*canonical\b[^>]*>|<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?\s*refresh\b[^>]*>')) AS tag FROM pages
), edges AS (
  SELECT a, regexp_extract(CASE WHEN tag ILIKE '<link%' THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''>\s]*)', 1)
                                ELSE trim(regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''>]+)', 1)) END, '^[^#]*') AS b FROM tags
), links AS (SELECT a, b FROM edges WHERE b LIKE '%://%' AND a <> b),
twoway AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, a AS b FROM twoway UNION SELECT r.a, t.b FROM reach r JOIN twoway t ON t.a = r.b),
urls AS (SELECT url AS u FROM pages UNION SELECT b FROM twoway),
parts AS (
  SELECT u, lower(regexp_extract(coalesce(u, ''), '(?s)^.*?://([^/?#]*)', 1)) AS host,
         regexp_extract(coalesce(u, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM urls
), ruled AS (
  SELECT u, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL
), alias AS (SELECT r.a, min(x.verdict) AS verdict FROM reach r JOIN ruled x ON x.u = r.b GROUP BY r.a)
SELECT page_id, host, path, x.rule, coalesce(x.verdict, alias.verdict, 'allow') AS verdict
FROM pages JOIN ruled x ON x.u IS NOT DISTINCT FROM url LEFT JOIN alias ON alias.a = regexp_extract(url, '^[^#]*')
"""


#: Leaves, the levels of each source's tree and of the tree of subroots, then each leaf's
#: runs of siblings, joined to its proof and folded. crc32 is spelled out bit by bit.
OP11_SQL = r"""
WITH RECURSIVE heads AS (
  SELECT doc_id, source, text, list_aggregate(list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)],
         lambda v: CASE WHEN v IS NULL THEN '-' ELSE strlen(v) || ':' || v END), 'string_agg', '') AS head FROM documents
), hashed AS (
  SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
         sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END) AS changed,
         xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
           lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 5 = 0 AS hit
  FROM heads
), leaves AS MATERIALIZED (
  SELECT *, coalesce('=' || source, '') AS tree, count(*) OVER (PARTITION BY source) AS n,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM hashed
), low AS (
  SELECT tree, 0 AS level, pos, leaf AS digest, n FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM low WHERE n > 1 GROUP BY tree, level, pos // 16
), subroots AS MATERIALIZED (
  SELECT tree, digest, level AS height, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
  SELECT 0 AS level, pos, digest, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM high WHERE n > 1 GROUP BY level, pos // 16
), runs AS MATERIALIZED (
  SELECT tree, level, pos // 16 AS run, list(digest ORDER BY pos) AS digests
  FROM (SELECT * FROM low UNION ALL SELECT 'top', * FROM high) WHERE n > 1 GROUP BY ALL
), way AS (
  SELECT l.tree, l.pos, r.level AS step, r.digests, CAST((l.pos // CAST(16 ** r.level AS BIGINT)) % 16 AS INTEGER) AS j
  FROM leaves l JOIN runs r ON r.tree = l.tree AND r.run = l.pos // CAST(16 ** (r.level + 1) AS BIGINT)
  UNION ALL
  SELECT l.tree, l.pos, s.height + r.level, r.digests, CAST((s.pos // CAST(16 ** r.level AS BIGINT)) % 16 AS INTEGER)
  FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN runs r ON r.tree = 'top' AND r.run = s.pos // CAST(16 ** (r.level + 1) AS BIGINT)
), paths AS (
  SELECT tree, pos, string_agg(array_to_string(digests[1 : j] || digests[j + 2 :], ''), '' ORDER BY step) AS proof,
         list(array_to_string(digests[1 : j], '') || '.' || array_to_string(digests[j + 2 :], '') ORDER BY step) AS steps
  FROM way GROUP BY tree, pos
), folded AS (
  SELECT doc_id, leaf, s.digest AS subroot, (SELECT digest FROM high WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
         list_reduce([CASE WHEN hit THEN changed ELSE leaf END] || coalesce(steps, []), lambda c, s: sha256(split_part(s, '.', 1) || c || split_part(s, '.', 2))) AS folded_root
  FROM leaves l JOIN subroots s USING (tree) LEFT JOIN paths p ON p.tree = l.tree AND p.pos = l.pos
)
SELECT *, folded_root = root AS verified FROM folded
"""


def llm_oracles():
    return {"op1_exact_dedup": OP1_SQL, "op4_ngram_join": OP4_SQL, "op7_substring_dedup": OP7_SQL, "op10_url_filter": OP10_SQL, "op11_merkle_manifest": OP11_SQL}
