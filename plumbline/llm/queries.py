"""The queries of the corpus operators with their production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from plumbline.llm import ballkmeans, edits, flac, html, jaccard, langid, minhash, mixing, quality, tokens, topk, urls, whitening
from plumbline.llm.common import use_workers

#: Rules of the URL filter: (verdict, host, path).
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Listed URLs: sites of advertisers and spammers, and two sites' articles numbered below LISTED_ARTICLES, made by a rule.
LISTED_URLS = tuple(f"http://{name}.example.com/" for name in ("ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"))
LISTED_SITES, LISTED_ARTICLES = ("thther", "ththth"), 8192
BPE_RANKS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listed_urls(spark: SparkSession) -> DataFrame:
    each = lambda *values: F.explode(F.array(*map(F.lit, values)))
    parts = spark.range(LISTED_ARTICLES).select("id", each("", "www.", "m.", "blog.").alias("sub")).withColumn("site", each(*LISTED_SITES)).withColumn("end", each("com", "net")).withColumn("lang", each("en", "es"))
    articles = parts.select(F.format_string("http://%s%s.example.%s/%s/%d", "sub", "site", "end", "lang", "id").alias("url"))
    return articles.unionByName(spark.createDataFrame([(u,) for u in LISTED_URLS], "url string"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), listed_urls(spark), URL_RULES)


def op2_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_digests(flac.store_texts(table(spark, sf_dir, "documents")))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN, keep=["doc_id"], with_ids=False)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs), ["doc_id"])


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf_dir, "documents"), "doc_id", "text", k=4, percent=85)


def op5_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 with each document's number of links."""
    return jaccard.similar_groups(table(spark, sf_dir, "documents"), "doc_id", "text", k=4, percent=85, links=True)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits a document at places that its doc_id implies: an insertion, a deletion and a replacement."""
    import public_tokenizers

    n = F.length(F.coalesce("text", F.lit("")))
    at = [F.pmod(F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(str(i)))), n + 1).cast("long") for i in range(3)]
    todo = F.array(*(F.struct(a.alias("at"), (a + cut).alias("upto"), F.lit(new).alias("new")) for a, cut, new in zip(at, (0, 12, 8), (" (revised)", "", "\n\nUpdate: it's 2024."))))
    return edits.count_under_edits(table(spark, sf_dir, "documents"), todo, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN, keep=["doc_id"])


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out("doc_id"))
    known = langid.profiles(docs.where("not held_out"))
    return langid.identify(docs, known, ["doc_id", "held_out"])


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"), "doc_id", "text", k=3, percent=85)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), count=16, scale=64.0)


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ballkmeans.ball_kmeans(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dim=64, scale=256.0, seed=2)


OP1_SQL = r"""
WITH cut AS (
  SELECT page_id,
    CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's') ELSE '' END AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule,
    regexp_replace(regexp_replace(host, ':[0-9]*$', ''), '^www\.', '') AS bare
  FROM cut)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(bare, '^((m|blog)\.)?(thther|ththth)\.example\.(com|net)$') AND regexp_matches(path, '^/+(en|es)/+(0|[1-9][0-9]*)/*$')
      AND TRY_CAST(regexp_extract(path, '([0-9]+)/*$', 1) AS BIGINT) < 8192 THEN 'block'
    WHEN regexp_matches(bare, '^(.*\.)?(ads-track|casino-win|cheap-pills|free-bets|spam-farm)\.example\.com$') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""

OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM o JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.v, r.root FROM r JOIN e ON r.doc_id = e.u)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

OP5_LINKS_SQL = OP5_SQL.replace("SELECT r.doc_id, coalesce", "SELECT r.doc_id, (SELECT count(*) FROM e WHERE e.u = r.doc_id) AS n_links, coalesce")

OP11_SQL = (
    OP5_SQL.replace("len(ws) < 4", "len(ws) < 3").replace("len(ws) - 2", "len(ws) - 1").replace("ws[i:i + 3]", "ws[i:i + 2]")
    .replace("SELECT r.doc_id, coalesce", "SELECT r.doc_id, r.doc_id = min(r.root) AS kept, coalesce")
)

OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

OP13_START = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INTEGER) AS c, x FROM v ORDER BY sha256('2:' || vec_id) LIMIT 40)"""
OP13_PLACE = """,
a{0} AS MATERIALIZED (
  SELECT vec_id, x, min(struct_pack(d := d, c := c)) AS m FROM (
    SELECT vec_id, v.x, c, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i]))) AS d FROM v CROSS JOIN c{0} b)
  GROUP BY vec_id, x)"""
OP13_MOVE = """,
s{0} AS (
  SELECT c, list(q ORDER BY i) AS x FROM (
    SELECT c, i, CAST((sum(z) - ((sum(z) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS q
    FROM (SELECT m.c AS c, unnest(range(1, 65)) AS i, unnest(x) AS z FROM a{0}) GROUP BY c, i) GROUP BY c),
c{1} AS MATERIALIZED (SELECT b.c, coalesce(s.x, b.x) AS x FROM c{0} b LEFT JOIN s{0} s ON s.c = b.c)"""
OP13_SQL = OP13_START + "".join(OP13_PLACE.format(i) + OP13_MOVE.format(i, i + 1) for i in range(5)) + OP13_PLACE.format(5) + """
SELECT vec_id, m.c AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(b.x, ',')) AS centroid_sha256
FROM a5 JOIN c5 b ON b.c = m.c
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_quality_classifier": op4_quality_classifier, "op6_html_extraction": op6_html_extraction, "op7_edit_aware_counts": op7_edit_aware_counts, "op1_url_filter": op1_url_filter, "op2_flac_media": op2_flac_media, "op3_byte_bpe": op3_byte_bpe, "op5_ngram_jaccard": op5_ngram_jaccard, "op5_ngram_jaccard_links": op5_ngram_jaccard_links, "op8_mix_sources": op8_mix_sources, "op9_exact_top_k": op9_exact_top_k, "op10_language_id": op10_language_id, "op11_minhash_dedup": op11_minhash_dedup, "op12_whitening": op12_whitening, "op13_ball_kmeans": op13_ball_kmeans}
ORACLE_SQL: dict[str, str] = {"op1_url_filter": OP1_SQL, "op5_ngram_jaccard": OP5_SQL, "op5_ngram_jaccard_links": OP5_LINKS_SQL, "op9_exact_top_k": OP9_SQL, "op11_minhash_dedup": OP11_SQL, "op13_ball_kmeans": OP13_SQL}
