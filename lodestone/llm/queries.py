"""Named queries of the training-data operators, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import table
from . import leakage, packing, provenance, segment, sentences, sourcecode

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# 1 generated, minified or vendored source files -------------------------------------------------
@query()
def p1_found(spark, d):
    return provenance.not_hand_written(table(spark, d, "source_files")).select("path")


@query()
def p1_reasons(spark, d):
    found = provenance.not_hand_written(table(spark, d, "source_files"))
    return found.select("path", F.concat_ws(",", "reasons").alias("reasons"), "repos", "copies")


# 3 functions paired with their documentation ---------------------------------------------------
@query()
def p3_found(spark, d):
    return sourcecode.documented_functions(table(spark, d, "source_files")).select("path", "name", "line")


@query()
def p3_pairs(spark, d):
    return sourcecode.documented_functions(table(spark, d, "source_files"))


# 4 source files that do not parse --------------------------------------------------------------
@query()
def p4_found(spark, d):
    return sourcecode.syntax_errors(table(spark, d, "source_files")).select("path").distinct()


@query()
def p4_rates(spark, d):
    return sourcecode.syntax_rates(table(spark, d, "source_files"))


# 2 splitting oversized items -------------------------------------------------------------------
_LONG = "SELECT chunk_id, any_value(text) AS text FROM chunks WHERE strlen(text) > 6000 GROUP BY chunk_id"


@query(
    f"""
    WITH t AS ({_LONG}), l AS (SELECT chunk_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM t)
    SELECT chunk_id, CAST(0 AS BIGINT) AS line_no FROM t UNION ALL SELECT chunk_id, line_no FROM l WHERE length(line) > 2000
    """
)
def p2_found(spark, d):
    got = segment.oversized_pieces(table(spark, d, "chunks")).where("piece = 1")
    lines = F.concat(F.array(F.lit(0).cast("bigint")), "cut_lines")
    return got.select("chunk_id", F.explode(lines).alias("line_no"))


@query()
def p2_pieces(spark, d):
    return segment.split_oversized(table(spark, d, "chunks"))


@query(
    f"""
    WITH t AS ({_LONG}) SELECT chunk_id, true AS small_enough, true AS overlap_kept, true AS covers, true AS lines_right, true AS lines_whole FROM t
    """
)
def p2_invariants(spark, d):
    """What the pieces of every long text must be: at most 2,000 characters, overlapping by 200 at most and
    by something, without a gap from the first to the last character, with the right line numbers, and with
    every line of up to 2,000 characters whole in one of them."""
    chunks = table(spark, d, "chunks").where(F.octet_length("text") > 6000)
    whole = chunks.groupBy("chunk_id").agg(F.first("text").alias("whole"), F.first("start_line").alias("line"))
    got = segment.oversized_pieces(chunks).groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("piece", "start_char", "end_char", "start_line", "end_line", "text"))).alias("p"))
    p = F.col("p")
    pairs = F.arrays_zip(F.slice(p, 1, F.size(p) - 1).alias("a"), F.slice(p, 2, F.size(p) - 1).alias("b"))
    first = F.greatest(F.coalesce("line", F.lit(1)), F.lit(1))
    breaks = lambda x: F.length(x) - F.length(F.translate(x, "\n", ""))
    upto = lambda n: F.substring(F.col("whole"), F.lit(1), n.cast("int"))
    shared = lambda x: x["a"]["end_char"] - x["b"]["start_char"]
    gap = lambda x: F.translate(F.substring(F.col("whole"), (x["a"]["end_char"] + 1).cast("int"), (-shared(x)).cast("int")), "\n", "") == ""
    # a line that no piece holds whole would end after the piece in which it starts and begin before the next
    lines = F.split(F.col("whole"), "\n", -1)
    joined = F.array_join(F.transform(p, lambda x: x["text"]), "\n\u0000\n")
    return got.join(whole, "chunk_id").select(
        "chunk_id",
        F.forall(p, lambda x: (F.length(x["text"]) <= 2000) & (x["text"] == F.substring(F.col("whole"), (x["start_char"] + 1).cast("int"), (x["end_char"] - x["start_char"]).cast("int")))).alias("small_enough"),
        F.forall(pairs, lambda x: (shared(x) <= 200) & (x["b"]["end_char"] > x["a"]["end_char"])).alias("overlap_kept"),
        (F.forall(pairs, lambda x: (shared(x) >= 0) | gap(x)) & (p[0]["start_char"] == 0) & (F.element_at(p, -1)["end_char"] == F.length("whole"))).alias("covers"),
        F.forall(p, lambda x: (x["start_line"] == first + breaks(upto(x["start_char"]))) & (x["end_line"] == x["start_line"] + breaks(x["text"]))).alias("lines_right"),
        F.forall(lines, lambda x: (F.length(x) > 2000) | F.contains(F.concat(F.lit("\n"), joined, F.lit("\n")), x)).alias("lines_whole"),
    )


# 6 filling fixed-capacity containers -----------------------------------------------------------
@query()
def p6_containers(spark, d):
    return packing.fill_containers(table(spark, d, "documents"))


@query()
def p6_fill(spark, d):
    return packing.container_stats(packing.fill_containers(table(spark, d, "documents")))


@query("SELECT count(DISTINCT doc_id) AS documents, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS overlapping, CAST(0 AS BIGINT) AS split_without_need, CAST(0 AS BIGINT) AS wrong_sizes FROM documents")
def p6_invariants(spark, d):
    """What the containers must be: every document in them, none overfull, no two documents in one place, none
    split that fits, and the sizes of its pieces those of its tokens."""
    documents = table(spark, d, "documents")
    got = packing.fill_containers(documents)
    full = got.groupBy("container").agg(F.sum("tokens").alias("n")).agg(F.count_if(F.col("n") > 2048).alias("overfull"))
    w = Window.partitionBy("container").orderBy("offset", "doc_id")
    apart = got.where("tokens > 0").withColumn("end", F.lag(F.col("offset") + F.col("tokens")).over(w)).agg(F.count_if(F.col("offset") < F.coalesce("end", F.lit(0))).alias("overlapping"))
    sizes = packing.token_counts(documents).dropDuplicates(["key"]).withColumnRenamed("key", "doc_id")
    per = got.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("sum")).join(sizes, "doc_id")
    whole = per.agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= 2048)).alias("split_without_need"), F.count_if(F.col("sum") != F.col("tokens")).alias("wrong_sizes"))
    return whole.crossJoin(full).crossJoin(apart)  # one row each


# 7 evaluation texts leaking into training text -------------------------------------------------
@query()
def p7_found(spark, d):
    got = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return got.where("kind = 'stretch'").select("doc_id", "item_id")


@query()
def p7_leaks(spark, d):
    got = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return got.withColumn("cosine", F.round("cosine", 4))


# 8 sentence boundaries --------------------------------------------------------------------------
@query()
def p8_found(spark, d):
    return sentences.split_sentences(table(spark, d, "documents")).select("doc_id", "start_pos", "end_pos")


@query()
def p8_sentences(spark, d):
    return sentences.split_sentences(table(spark, d, "documents"))


@query("SELECT doc_id, true AS ordered, true AS trimmed, true AS numbered FROM documents WHERE regexp_matches(text, '\\S') GROUP BY doc_id")
def p8_invariants(spark, d):
    """What the sentences of every text that is not blank must be: in order without overlap, without white
    space at their ends, numbered from 1."""
    w = Window.partitionBy("doc_id").orderBy("start_pos")
    got = sentences.split_sentences(table(spark, d, "documents")).withColumns({"before": F.lag("end_pos").over(w), "n": F.row_number().over(w)})
    text = F.col("text")
    return got.groupBy("doc_id").agg(
        F.min((F.col("start_pos") >= F.coalesce("before", F.lit(0))) & (F.col("end_pos") > F.col("start_pos"))).alias("ordered"),
        F.min((F.length(text) == F.col("end_pos") - F.col("start_pos")) & ~text.rlike(r"^\s|\s$")).alias("trimmed"),
        F.min(F.col("n") == F.col("sentence")).alias("numbered"),
    )
