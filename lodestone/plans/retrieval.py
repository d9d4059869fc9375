"""Queries of tokens, ranking and retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..session import checkpoint_dir, table
from .catalog import query

TERMS = ["the", "cache", "module", "session", "index", "the"]


@query("SELECT doc_id, CAST(len(list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '')) AS BIGINT) AS n FROM documents")
def token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(R.words(F.col("text"))).cast("bigint").alias("n"))


@query(
    """WITH p AS (SELECT DISTINCT unnest(list_filter(string_split_regex(text, '\\s+'), lambda w: regexp_matches(w, '[一-鿿㐀-䶿豈-﫿぀-ゟ゠-ヿ가-힯]'))) AS part FROM documents)
    SELECT DISTINCT md5(part) AS hash, unnest(CASE WHEN length(part) <= 2 THEN [part] ELSE list_transform(range(1, length(part)), lambda i: substr(part, CAST(i AS INTEGER), 2)) END) AS gram FROM p"""
)
def cjk_bigrams(spark, d):
    """The pairs of characters of every part of a text that holds CJK."""
    p = table(spark, d, "documents").select(F.explode(F.filter(F.split("text", r"\s+"), R.has_cjk)).alias("part")).distinct()
    return p.select(F.md5("part").alias("hash"), F.explode(R.bigrams(F.col("part"))).alias("gram")).distinct()


@query("SELECT doc_id, coalesce(regexp_matches(text, '[一-鿿㐀-䶿豈-﫿぀-ゟ゠-ヿ가-힯]'), false) AS cjk FROM documents")
def cjk_detect(spark, d):
    return table(spark, d, "documents").select("doc_id", R.has_cjk(F.col("text")).alias("cjk"))


@query(
    """SELECT DISTINCT name, part FROM (SELECT name, unnest(list_filter(string_split_regex(regexp_replace(regexp_replace(
       translate(name, '_-', '  '), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([^A-Z ])([A-Z])', '\\1 \\2', 'g'), ' +'), lambda w: length(w) >= 2)) AS part
       FROM call_sites WHERE name IS NOT NULL)"""
)
def identifier_split(spark, d):
    names = table(spark, d, "call_sites").where("name IS NOT NULL").select("name").distinct()
    return names.select("name", F.explode(R.identifier_parts(F.col("name"))).alias("part")).distinct()


_CJK = "[一-鿿㐀-䶿豈-﫿぀-ゟ゠-ヿ가-힯]"
_TOKENS = f"""
 pa AS (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS pos FROM (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '') AS ps FROM documents)),
 tok AS (SELECT doc_id, pos, true AS whole, unnest(CASE WHEN length(p) > 2 AND regexp_matches(p, '{_CJK}') THEN list_transform(range(1, length(p)), lambda i: substr(p, CAST(i AS INTEGER), 2)) ELSE [p] END) AS term FROM pa
   UNION ALL SELECT doc_id, pos, false, unnest(list_filter(string_split(translate(p, '-', '_'), '_'), lambda w: length(w) >= 2)) FROM pa WHERE NOT regexp_matches(p, '{_CJK}')),
 tf AS (SELECT * FROM (SELECT doc_id, term, count(*) FILTER (whole) + CAST(coalesce(min(pos) FILTER (NOT whole) < coalesce(min(pos) FILTER (whole), 1000000000), false) AS BIGINT) AS tf FROM tok GROUP BY ALL) WHERE tf > 0)"""
_BM25 = f"""{_TOKENS}, dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY 1),
 c AS (SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS n, (SELECT sum(dl) FROM dl) AS total),
 i AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, c GROUP BY term, n),
 q AS (SELECT unnest(['the', 'cache', 'module', 'session', 'index', 'the']) AS term),
 w AS (SELECT q.term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM i) ELSE raw END AS idf FROM q JOIN i USING (term)),
 bm AS (SELECT doc_id, CAST(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (CAST(total AS DOUBLE) / n)))) AS DOUBLE) AS score FROM w JOIN tf USING (term) JOIN dl USING (doc_id), c GROUP BY doc_id)
"""


@query(f"WITH {_TOKENS} SELECT doc_id, term, tf FROM tf")
def keyword_index(spark, d):
    return R.build_index(table(spark, d, "documents"), keep=lambda df: df).postings.select(F.col("key").alias("doc_id"), "term", "tf")


def _index(spark, d):
    """The index, written to the shared folder and read again, as a service would keep it."""
    folder = f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    R.save_index(R.build_index(table(spark, d, "documents")), folder)
    return R.load_index(spark, folder)


@query(f"WITH {_BM25} SELECT doc_id, round(score, 4) AS score FROM bm WHERE score > 0 ORDER BY bm.score DESC, doc_id LIMIT 20")
def bm25_topk(spark, d):
    got = R.bm25(_index(spark, d), TERMS)
    return got.orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", F.round("score", 4).alias("score"))


def _one(rows, vec):
    q = F.broadcast(rows.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1))
    return rows.crossJoin(q)


@query(
    """SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)
       ORDER BY list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) DESC, vec_id LIMIT 20"""
)
def dense_cosine_topk(spark, d):
    e = table(spark, d, "embeddings")
    s = _one(e, 0).where(R.usable(F.col("embedding"))).select("vec_id", R.cosine(F.col("embedding"), F.col("q")).alias("score"))
    return s.orderBy(F.desc("score"), "vec_id").limit(20).select("vec_id", F.round("score", 6).alias("score"))


@query(
    """SELECT vec_id, round(list_distance(embedding::DOUBLE[], q::DOUBLE[]), 6) AS distance FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)
       ORDER BY list_distance(embedding::DOUBLE[], q::DOUBLE[]), vec_id LIMIT 20"""
)
def dense_l2_topk(spark, d):
    e = table(spark, d, "embeddings")
    s = _one(e, 0).select("vec_id", R.l2(F.col("embedding"), F.col("q")).alias("distance"))
    return s.orderBy("distance", "vec_id").limit(20).select("vec_id", F.round("distance", 6).alias("distance"))


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query, e.vec_id AS key, round(list_cosine_similarity(q.v, e.v), 12) AS score FROM e q, e WHERE q.vec_id % 50 = 0),
       r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM s) SELECT query, key, round(score, 6) AS score, rank FROM r WHERE rank <= 20"""
)
def knn_cosine(spark, d):
    e = table(spark, d, "embeddings")
    return R.neighbours(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding").withColumn("score", F.round("score", 6))


_FUSED = f"""WITH {_BM25}, b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm WHERE score > 0 QUALIFY rank <= 20),
 v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) DESC, vec_id) AS rank
       FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) QUALIFY rank <= 20),
 f AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT * FROM b UNION ALL SELECT * FROM v) GROUP BY doc_id)"""


def _fused(spark, d):
    e = table(spark, d, "embeddings")
    dense = _one(e, 0).where(R.usable(F.col("embedding"))).select(F.col("vec_id").alias("doc_id"), R.cosine(F.col("embedding"), F.col("q")).alias("score"))
    return R.rrf([R.top(R.bm25(R.build_index(table(spark, d, "documents")), TERMS), "doc_id"), R.top(dense, "doc_id")], "doc_id")


@query(f"{_FUSED} SELECT doc_id, round(score, 6) AS score FROM f")
def rrf_fuse(spark, d):
    return _fused(spark, d).select("doc_id", F.round("score", 6).alias("score"))


_OVERLAP = """coalesce(len(list_intersect(list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda w: w <> ''), ['the', 'cache', 'module', 'session', 'index'])) / 5.0::DOUBLE, 0)"""


@query(
    f"""{_FUSED}, t AS (SELECT doc_id FROM f ORDER BY score DESC, doc_id LIMIT 20), s AS (SELECT t.doc_id, {_OVERLAP} AS score FROM t LEFT JOIN documents USING (doc_id))
    SELECT doc_id, round(score, 4) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 5"""
)
def hybrid_search(spark, d):
    """Keywords and vectors, fused by rank, the first 20 reranked, the first 5 of these."""
    first = _fused(spark, d).orderBy(F.desc("score"), "doc_id").limit(20)
    return R.rerank(first, table(spark, d, "documents"), "doc_id", "text", TERMS).withColumn("score", F.round("score", 4))


@query(
    f"""WITH {_BM25}, b AS (SELECT doc_id, score FROM bm WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20),
    s AS (SELECT b.doc_id, {_OVERLAP} AS score FROM b JOIN documents USING (doc_id)) SELECT doc_id, round(score, 4) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 5"""
)
def rerank_overlap(spark, d):
    docs = table(spark, d, "documents")
    first = R.bm25(R.build_index(docs), TERMS).orderBy(F.desc("score"), "doc_id").limit(20)
    return R.rerank(first, docs, "doc_id", "text", TERMS).withColumn("score", F.round("score", 4))


@query(
    """SELECT vec_id, round(list_distance(embedding::DOUBLE[], q::DOUBLE[]), 6) AS distance FROM embeddings, (SELECT embedding AS q, label AS l FROM embeddings WHERE vec_id = 0)
       WHERE label = l ORDER BY list_distance(embedding::DOUBLE[], q::DOUBLE[]), vec_id LIMIT 20"""
)
def dense_l2_filtered(spark, d):
    """The nearest vectors among those with the query's label."""
    e = table(spark, d, "embeddings")
    same = e.join(F.broadcast(e.where("vec_id = 0").select("label").limit(1)), "label", "left_semi")
    q = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1))
    s = same.crossJoin(q).select("vec_id", R.l2(F.col("embedding"), F.col("q")).alias("distance"))
    return s.orderBy("distance", "vec_id").limit(20).select("vec_id", F.round("distance", 6).alias("distance"))


@query()
def mmr_select(spark, d):
    e = table(spark, d, "embeddings")
    near = _one(e, 0).select("vec_id", "embedding", R.cosine(F.col("embedding"), F.col("q")).alias("rel")).orderBy(F.desc("rel"), "vec_id").limit(40)
    return R.mmr(near, "vec_id", "embedding", "rel")


@query()
def hashing_embed(spark, d):
    return R.hashing_embedder(table(spark, d, "documents"), "doc_id", "text")


@query(
    """WITH t AS (SELECT chunk_id, any_value(text) AS text FROM chunks WHERE strlen(text) > 6000 GROUP BY 1),
       n AS (SELECT *, unnest(range(1, CAST(greatest(ceil((length(text) - 200) / 1800.0), 1) AS BIGINT) + 1)) AS n FROM t)
       SELECT chunk_id, n, md5(substr(text, CAST((n - 1) * 1800 + 1 AS BIGINT), 2000)) AS piece FROM n"""
)
def chunk_oversize(spark, d):
    t = table(spark, d, "chunks").where(F.octet_length("text") > 6000).select("chunk_id", "text").dropDuplicates(["chunk_id"])
    return t.select("chunk_id", F.explode(R.fixed_stride(F.col("text"))).alias("x")).select("chunk_id", "x.n", F.md5("x.piece").alias("piece"))


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS part FROM documents WHERE text IS NOT NULL")
def line_slice(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", R.line_slice(F.col("text"), F.lit(2), F.lit(4)).alias("part"))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
def utf8_len(spark, d):
    return table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"))


@query(
    """SELECT doc_id, CASE WHEN text IS NULL OR strlen(text) <= 2000 THEN text ELSE substr(text, 1, list_max(list_filter(range(500, 2001), lambda k: strlen(substr(text, 1, k)) <= 2000))) || chr(10) || '... (truncated)' END AS part FROM documents"""
)
def truncate_utf8(spark, d):
    return table(spark, d, "documents").select("doc_id", R.truncate_utf8(F.col("text"), 2000).alias("part"))


@query(
    """SELECT chunk_id, true AS short_enough, true AS complete FROM chunks WHERE strlen(text) > 6000 GROUP BY chunk_id"""
)
def fine_split(spark, d):
    """What the pieces of every long chunk must be: at most 2,000 characters, and together all its words."""
    c = table(spark, d, "chunks").where(F.octet_length("text") > 6000)
    whole = c.groupBy("chunk_id").agg(F.first("text").alias("whole"))
    squeeze = lambda x: F.regexp_replace(x, r"\s+", "")
    got = R.fine_split(c).groupBy("chunk_id").agg(F.max(F.length("text")).alias("most"), F.sum(F.length(squeeze(F.col("text")))).alias("sum"), F.min(F.col("title").rlike(r" \[\d+/\d+\]$")).alias("titled"))
    return got.join(whole, "chunk_id").select("chunk_id", ((F.col("most") <= 2000) & F.col("titled")).alias("short_enough"), (F.col("sum") >= F.length(squeeze(F.col("whole")))).alias("complete"))


@query("SELECT path, md5(content) AS hash FROM (SELECT DISTINCT path, content FROM source_files)")
def hash_md5(spark, d):
    return table(spark, d, "source_files").select("path", F.md5("content").alias("hash")).distinct()


@query(
    """WITH c AS (SELECT DISTINCT source, chunk_id FROM chunks), gone AS (SELECT source_path FROM file_hash WHERE content_hash IS NULL)
       SELECT source, count(*) AS chunks FROM c WHERE source IS NOT NULL AND NOT EXISTS (SELECT 1 FROM gone WHERE source_path = source) GROUP BY 1"""
)
def index_delete_by_source(spark, d):
    gone = table(spark, d, "file_hash").where("content_hash IS NULL").select(F.col("source_path").alias("source"))
    left = table(spark, d, "chunks").where("source IS NOT NULL").select("source", "chunk_id").distinct().join(gone, "source", "left_anti")
    return left.groupBy("source").agg(F.count("*").alias("chunks"))


@query("SELECT DISTINCT chunk_id, source, title, symbol_name, symbol_type FROM chunks")
def index_list(spark, d):
    return table(spark, d, "chunks").select("chunk_id", "source", "title", "symbol_name", "symbol_type").distinct()
