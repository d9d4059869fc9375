"""Tokens, BM25, vectors, rank fusion, diversity and reranking."""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut

#: Ranges of ideographs, kana and hangul that count as CJK.
CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}]"


def words(text: Column) -> Column:
    """White-space tokens of the lower-cased text; null gives none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def identifier_parts(name: Column) -> Column:
    """Parts of an identifier of two or more characters, split at ``_``, ``-`` and changes of case."""
    spaced = F.regexp_replace(F.regexp_replace(F.translate(name, "_-", "  "), r"([A-Z]+)([A-Z][a-z])", "$1 $2"), r"([^A-Z ])([A-Z])", "$1 $2")
    return F.filter(F.split(spaced, " +"), lambda w: F.length(w) >= 2)


def bigrams(part: Column) -> Column:
    """Overlapping character pairs; parts of up to two characters stay whole."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(part) - 1, F.lit(1))), lambda i: F.substring(part, i, F.lit(2)))
    return F.when(F.length(part) <= 2, F.array(part)).otherwise(pairs)


def has_cjk(text: Column) -> Column:
    return F.coalesce(text.rlike(CJK), F.lit(False))


def keyword_tokens(text: Column) -> Column:
    """Search tokens: CJK parts as bigrams, others as themselves followed by their lower-cased new
    identifier parts (those not yet in the list)."""
    parts = F.filter(F.split(text, r"\s+"), lambda p: p != "")

    def add(acc, p):
        whole = F.concat(acc, F.array(p))
        sub = F.array_except(F.transform(identifier_parts(p), lambda s: F.lower(s)), whole)
        return F.when(p.rlike(CJK), F.concat(acc, bigrams(p))).otherwise(F.concat(whole, sub))

    return F.aggregate(parts, F.expr("array()").cast("array<string>"), add)


_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
_CJK = re.compile(r"[\u4e00-\u9fff\u3400-\u4dbf\uf900-\ufaff\u3040-\u309f\u30a0-\u30ff\uac00-\ud7af]")


def token_counts(text: str) -> tuple[Counter, int]:
    """The search tokens of a lower-cased text with their counts, and how many there are: a CJK part as its
    pairs of characters, another as itself and its parts at ``_`` and ``-`` that are not in the list yet."""
    out: Counter = Counter()
    for part in _SPACE.split(text):
        if not part:
            continue
        if _CJK.search(part):
            out.update([part] if len(part) <= 2 else [part[i : i + 2] for i in range(len(part) - 1)])
            continue
        out[part] += 1
        if "_" in part or "-" in part:
            for sub in part.replace("-", "_").split("_"):
                if len(sub) >= 2 and sub not in out:
                    out[sub] = 1
    return out, sum(out.values())


@dataclass
class Index:
    """A keyword index: ``postings`` (``key, term, tf, dl``), ``terms`` (``term, df``) and one row of
    ``corpus`` (``n`` documents, ``total`` tokens, ``mean`` idf of all terms)."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame
    key: str


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", keep=cut) -> Index:
    """Tokens are counted within each document, so that only its distinct terms are shuffled, by term and key:
    a frequent term is no single task. Repeated keys are indexed once; null texts have no tokens. ``keep``
    stores a table that several others are made from."""
    data = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))

    def run(batches):
        for b in batches:
            keys, terms, tfs, dls = [], [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts, size = token_counts(t)
                counts[None] = 0  # the document itself
                keys.extend([k] * len(counts))
                dls.extend([size] * len(counts))
                terms.extend(counts.keys())
                tfs.extend(counts.values())
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(terms, pa.string()), pa.array(tfs, pa.int64()), pa.array(dls, pa.int64())], ["key", "term", "tf", "dl"])

    every = keep(data.mapInArrow(run, f"key {dict(data.dtypes)['key']}, term string, tf bigint, dl bigint").dropDuplicates(["term", "key"]))
    terms = every.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"))
    size = every.where("term IS NULL").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"))
    corpus = terms.crossJoin(F.broadcast(size)).agg(F.max("n").alias("n"), F.max("total").alias("total"), F.avg(_idf()).alias("mean"))  # one row on the right
    return Index(every.where("term IS NOT NULL"), terms, corpus, key)


def _idf() -> Column:
    return F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def save_index(index: Index, folder: str, buckets: int = 64, salts: int = 16) -> None:
    """Writes an index; postings lie in folders by bucket of their term, so a query reads only its own."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    spread_ = index.postings.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(salts)))
    spread_.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    index.terms.write.mode("overwrite").parquet(f"{folder}/terms")
    index.corpus.select("*", F.lit(index.key).alias("key"), F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{folder}/corpus")


def load_index(spark: SparkSession, folder: str) -> Index:
    corpus = spark.read.parquet(f"{folder}/corpus")
    row = corpus.first()
    return Index(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/terms"), corpus.select("n", "total", "mean"), row["key"])


def bm25(index: Index, query: list[str], k1: float = 1.5, b: float = 0.75, eps: float = 0.25, buckets: int = 64) -> DataFrame:
    """``key, score`` of the documents with a positive score; the query is tokenized like the documents and
    repeated tokens add. Idf below zero becomes ``eps`` times the mean idf over all terms. Statistics cover
    all documents; only postings of query terms are read."""
    spark = index.postings.sparkSession
    times: Counter = Counter()
    for q in query:
        times.update(token_counts(q.lower())[0])
    terms = spark.createDataFrame(list(times.items()), "term string, times bigint")
    wanted = index.terms.join(F.broadcast(terms), "term").crossJoin(F.broadcast(index.corpus))  # as long as the query
    wanted = wanted.withColumn("idf", F.when(_idf() < 0, eps * F.col("mean")).otherwise(_idf())).select("term", "times", "idf", "n", "total")
    rows = index.postings.where(F.col("term").isin(list(times)))
    if "bucket" in rows.columns:
        at = [r[0] for r in terms.select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).distinct().collect()]
        rows = rows.where(F.col("bucket").isin(at))
    hits = rows.join(F.broadcast(wanted), "term")
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / (F.col("total") / F.col("n")))
    return hits.groupBy("key").agg(F.sum(F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / norm).alias("score")).where("score > 0").withColumnRenamed("key", index.key)


def _double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))))


def usable(v: Column) -> Column:
    """Vectors that are there and not all zero."""
    return F.coalesce(v.isNotNull() & F.exists(v, lambda x: x != 0), F.lit(False))


def neighbours(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 20, metric: str = "cosine", block: int = 4096) -> DataFrame:
    """``query, key, score``: the k nearest rows of every query vector, exactly. Queries are taken in
    blocks of bounded size; each task keeps its own k best per query before anything is shuffled."""
    spark = rows.sparkSession
    data = rows.where(usable(F.col(vector))).select(F.col(key).alias("key"), F.col(vector).alias("v"))
    out, ids, vecs = None, [], []

    def run_block(ids, vecs):
        q = np.asarray(vecs, np.float64)
        held = spark.sparkContext.broadcast((np.asarray(ids), q))

        def run(batches):
            qid, q = held.value
            best = [[] for _ in qid]
            for b in batches:
                keys = np.asarray(b.column(0).to_pylist(), np.int64)
                v = np.asarray(b.column(1).to_pylist(), np.float64)
                if not len(keys):
                    continue
                if metric == "cosine":
                    s = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
                else:
                    s = -np.sqrt(np.maximum(((q[:, None, :] - v[None, :, :]) ** 2).sum(-1), 0)) if len(q) * v.size < 4_000_000 else -np.stack([np.sqrt(((x - v) ** 2).sum(1)) for x in q])
                for i in range(len(qid)):
                    row = np.round(s[i], 12)
                    top = np.lexsort((keys, -row))[:k]
                    best[i] = sorted(best[i] + [(-row[j], int(keys[j])) for j in top])[:k]
            rows = [(int(qid[i]), key, -s) for i in range(len(qid)) for s, key in best[i]]
            cols = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], ["query", "key", "score"])

        return data.mapInArrow(run, "query bigint, key bigint, score double")

    for r in queries.where(usable(F.col(vector))).select(F.col(key), F.col(vector)).orderBy(key).toLocalIterator():
        ids.append(r[0])
        vecs.append(r[1])
        if len(ids) == block:
            part = run_block(ids, vecs)
            out = part if out is None else out.unionByName(part)
            ids, vecs = [], []
    if ids or out is None:
        part = run_block(ids, vecs) if ids else spark.createDataFrame([], "query bigint, key bigint, score double")
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    return out.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k).withColumn("score", F.col("score") if metric == "cosine" else -F.col("score"))


def top(scored: DataFrame, key: str, k: int = 20, score: str = "score") -> DataFrame:
    """The k best rows with their rank from 1; ties go to the smaller key."""
    best = scored.orderBy(F.desc(score), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)).cast("bigint"))


def rrf(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (``key, rank`` from 1)."""
    every = None
    for ranked in lists:
        part = ranked.select(key, (F.lit(1.0) / (k + F.col("rank"))).alias("part"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(key).agg(F.sum("part").alias("score"))


def mmr(candidates: DataFrame, key: str, vector: str, relevance: str, k: int = 20, weight: float = 0.7) -> DataFrame:
    """Maximal marginal relevance over a bounded list of candidates (one group): ``key, step``."""

    def pick(table: pa.Table) -> pa.Table:
        keys, rel = table[key].to_pylist(), np.asarray(table[relevance].to_pylist(), float)
        v = np.asarray(table[vector].to_pylist(), float)
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        order = sorted(range(len(keys)), key=lambda i: keys[i])
        chosen: list[int] = []
        while order and len(chosen) < k:
            near = (v[order] @ v[chosen].T).max(1) if chosen else np.zeros(len(order))
            best = int(np.argmax(np.round(weight * rel[order] - (1 - weight) * near, 12)))
            chosen.append(order.pop(best))
        return pa.table({key: pa.array([keys[i] for i in chosen], pa.int64()), "step": pa.array(range(1, len(chosen) + 1), pa.int64())})

    return candidates.withColumn("_g", F.lit(0)).groupBy("_g").applyInArrow(pick, f"{key} bigint, step bigint")


def overlap_score(text: Column, query: list[str]) -> Column:
    """Share of the query's words that the text holds: the offline scorer for reranking."""
    q = F.array(*[F.lit(w.lower()) for w in dict.fromkeys(query)])
    return F.size(F.array_intersect(words(text), q)) / F.size(q)


def rerank(candidates: DataFrame, texts: DataFrame, key: str, text: str, query: list[str], k: int = 5, scorer: Callable[[Column, list[str]], Column] = overlap_score) -> DataFrame:
    """The k best of a bounded list of candidates by a scorer of (text, query), which a caller can replace by
    a model in an Arrow UDF; a candidate without a text scores 0; ties go to the smaller key."""
    found = texts.join(F.broadcast(candidates.select(key)), key).groupBy(key).agg(F.max(text).alias(text))
    scored = candidates.select(key).join(found, key, "left").select(key, F.coalesce(scorer(F.col(text), query), F.lit(0.0)).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def embed(texts: DataFrame, key: str, text: str, embedder: Callable[[list[str]], list[list[float]]], width: int, batch: int = 100, retries: int = 3, wait: float = 0.0) -> DataFrame:
    """``key, embedding, failed``: texts sent to an embedder in batches; a batch that raises is tried again up to
    ``retries`` times, waiting ``wait`` seconds, twice as long each time; one that still fails gives vectors
    of zeros. Null texts are empty ones."""
    data = texts.select(key, F.coalesce(F.col(text), F.lit("")).alias("t"))

    def run(batches):
        for b in batches:
            t, out, bad = b.column(1).to_pylist(), [], []
            for i in range(0, len(t), batch):
                part = t[i : i + batch]
                for turn in range(retries + 1):
                    try:
                        got, failed = embedder(part), False
                        break
                    except Exception:
                        got, failed = [[0.0] * width] * len(part), True
                        time.sleep(wait * 2**turn)
                out.extend(got)
                bad.extend([failed] * len(part))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32())), pa.array(bad, pa.bool_())], [key, "embedding", "failed"])

    return data.mapInArrow(run, f"{key} {dict(texts.dtypes)[key]}, embedding array<float>, failed boolean")


def hashing_embedder(texts: DataFrame, key: str, text: str, width: int = 64) -> DataFrame:
    """Deterministic stand-in for an embedding service: signed hashed words, normalised."""

    def run(batches):
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                v = np.zeros(width)
                for w in re.findall(r"\w+", (t or "").lower()):
                    h = int.from_bytes(__import__("hashlib").md5(w.encode()).digest()[:8], "little")
                    v[h % width] += 1 if h >> 63 else -1
                n = np.linalg.norm(v)
                out.append((v / n if n else v).astype(np.float32).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32()))], [key, "embedding"])

    return texts.select(key, text).mapInArrow(run, f"{key} {dict(texts.dtypes)[key]}, embedding array<float>")


def fixed_stride(text: Column, size: int = 2000, overlap: int = 200) -> Column:
    """Windows of ``size`` characters that overlap by ``overlap``: array of (n, piece)."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length(text) - overlap) / step), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.cast("bigint").alias("n"), F.substring(text, (i - 1) * step + 1, F.lit(size)).alias("piece")))


def line_slice(text: Column, first: Column, last: Column) -> Column:
    """Lines first..last (from 1, inclusive); an end before the start gives one line."""
    return F.array_join(F.slice(F.split(text, "\n", -1), first, F.greatest(last - first + 1, F.lit(1))), "\n")


def truncate_utf8(text: Column, limit: int, notice: str = "\n... (truncated)") -> Column:
    """At most ``limit`` UTF-8 bytes, cut between characters, with a notice where something was cut."""
    raw = F.encode(text, "UTF-8")
    inside = lambda i: F.substring(F.hex(F.substring(raw, i, 1)), 1, 1).isin("8", "9", "A", "B")
    # the byte after the cut begins a character, or the cut goes back before the one that it would split
    end = F.when(~inside(limit + 1), limit).when(~inside(limit), limit - 1).when(~inside(limit - 1), limit - 2).otherwise(limit - 3)
    whole = raw.substr(F.lit(1), F.greatest(end, F.lit(0))).cast("string")
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(whole, F.lit(notice)))


#: Where a text of a language is cut first, next, and so on.
SEPARATORS = {
    "python": ["\nclass ", "\ndef ", "\n\tdef ", "\n\n", "\n", " ", ""],
    "javascript": ["\nfunction ", "\nconst ", "\nlet ", "\nvar ", "\nclass ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase ", "\ndefault ", "\n\n", "\n", " ", ""],
    "typescript": ["\nenum ", "\ninterface ", "\nnamespace ", "\ntype ", "\nclass ", "\nfunction ", "\nconst ", "\nlet ", "\nvar ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase ", "\ndefault ", "\n\n", "\n", " ", ""],
    "": ["\n\n", "\n", " ", ""],
}


def split_recursively(text: str, separators: list[str], size: int = 2000, overlap: int = 200) -> list[str]:
    """Pieces of at most ``size`` characters: cut at the first separator that occurs, parts still too long at
    the next ones, short parts joined again; a piece begins with the last parts of the one before, up to
    ``overlap`` characters of them."""
    parts, todo = [], [(text, 0)]
    while todo:
        t, level = todo.pop()
        if len(t) <= size or level >= len(separators):
            parts.append(t)
            continue
        sep = separators[level]
        cells = [t[i : i + size - overlap] for i in range(0, len(t), size - overlap)] if not sep else t.split(sep)
        if sep:
            cells = [cells[0], *[sep + c for c in cells[1:]]]
        todo.extend((c, level + 1) for c in reversed(cells) if c)
    out, held, n = [], [], 0
    for p in parts:
        if held and n + len(p) > size:
            out.append("".join(held))
            while held and (n > overlap or n + len(p) > size):
                n -= len(held.pop(0))
        held.append(p)
        n += len(p)
    return [*out, "".join(held)] if held else out


def fine_split(chunks: DataFrame, key: str = "chunk_id", max_bytes: int = 6000, size: int = 2000, overlap: int = 200) -> DataFrame:
    """``key, piece`` (from 1), ``pieces, title, text``: chunks of more than ``max_bytes`` UTF-8 bytes cut by
    the separators of their language; titles of pieces end in `` [i/n]``. Of repeated keys one is kept."""
    long = chunks.where((F.octet_length("text") > max_bytes) & F.col(key).isNotNull()).select(F.col(key).alias("key"), "title", F.lower("language").alias("language"), "text")

    def run(batches):
        for b in batches:
            rows = []
            for k, title, language, text in zip(*(c.to_pylist() for c in b.columns)):
                got = split_recursively(text, SEPARATORS.get(language or "", SEPARATORS[""]), size, overlap)
                rows.extend((k, i, len(got), f"{title or ''} [{i}/{len(got)}]", t) for i, t in enumerate(got, 1))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (b.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.string()))], ["key", "piece", "pieces", "title", "text"])

    got = long.mapInArrow(run, f"key {dict(chunks.dtypes)[key]}, piece bigint, pieces bigint, title string, text string")
    return got.dropDuplicates(["key", "piece"]).withColumnRenamed("key", key)
