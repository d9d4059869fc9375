"""Filling fixed-capacity containers, by matching of large items.

Sizes are counted with a public tokenizer. What is planned is the histogram of sizes (at most one entry
per size up to the capacity), never the documents: items over a third of the capacity are matched
greedily, the largest with the largest that still fits, at most two to a container; smaller ones go to
the container with the smallest gap that takes them. All items of a size are placed in bulk, so the plan
is a short list of ranges of ranks, and each document finds its place by its rank among those of its
size. Ranks are counted within salted groups, so a size that a third of all documents share is no
single task.
"""

from __future__ import annotations

import bisect
import os

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, spread

#: The default tokenizer file; the environment or a parameter names another.
TOKENIZER = os.environ.get("LODESTONE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Placements ``(size, first rank, ranks, per container, first container, offset)`` and the number of
    containers: rank ``first + r`` of a size lies in container ``first container + r // per``, at
    ``offset + (r % per) * size``."""
    left = {s: n for s, n in histogram.items() if n > 0 and 0 < s <= capacity}
    used = dict.fromkeys(left, 0)
    out, bins = [], 0
    groups: dict[int, list[tuple[int, int]]] = {}  # gap -> [(first container, containers)]

    def place(size, n, per, first, offset):
        out.append((size, used[size], n, per, first, offset))
        used[size] += n
        left[size] -= n

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        s = large[-1]
        if not left[s]:
            large.pop()
            continue
        k = bisect.bisect_right(large, capacity - s) - 1
        while k >= 0 and not left[large[k]]:
            k -= 1
        if k < 0:
            n = left[s]
            place(s, n, 1, bins, 0)
            gap = capacity - s
        elif large[k] == s:
            n = left[s] // 2
            if not n:  # one of its size is left: the next smaller one
                k -= 1
                while k >= 0 and not left[large[k]]:
                    k -= 1
                n = 1
                place(s, 1, 1, bins, 0)
                gap = capacity - s
                if k >= 0:
                    place(large[k], 1, 1, bins, s)
                    gap -= large[k]
            else:
                place(s, 2 * n, 2, bins, 0)
                gap = capacity - 2 * s
        else:
            p = large[k]
            n = min(left[s], left[p])
            place(s, n, 1, bins, 0)
            place(p, n, 1, bins, s)
            gap = capacity - s - p
        groups.setdefault(gap, []).append((bins, n))
        bins += n
    gaps = sorted(g for g in groups if g)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            k = bisect.bisect_left(gaps, s)
            if k == len(gaps):
                per = capacity // s
                full, rest = divmod(left[s], per)
                for n, each in ((full, per), (1 if rest else 0, rest)):
                    if n:
                        place(s, n * each, each, bins, 0)
                        gap = capacity - each * s
                        if gap:
                            groups.setdefault(gap, []).append((bins, n))
                            if gap not in gaps:
                                bisect.insort(gaps, gap)
                        bins += n
                continue
            gap = gaps[k]
            first, n = groups[gap].pop()
            per = gap // s
            take = min(n, left[s] // per)
            if not take:
                take, per = 1, left[s]
            if n > take:
                groups[gap].append((first + take, n - take))
            if not groups[gap]:
                gaps.pop(k)
            place(s, take * per, per, first, capacity - gap)
            rest = gap - per * s
            if rest:
                if not groups.get(rest):
                    bisect.insort(gaps, rest)
                groups.setdefault(rest, []).append((first, take))
    return out, bins


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``key, tokens``; null texts have 0 tokens."""
    name = tokenizer or TOKENIZER
    documents.sparkSession.sparkContext.addFile(name)  # executors need not have it where the driver does
    data = spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text")))

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import SparkFiles
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(SparkFiles.get(os.path.basename(name)))
        tok.encode_special_tokens = True
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = []
            for i in range(0, len(texts), 256):
                n.extend(len(e) for e in tok.encode_batch_fast(texts[i : i + 256], add_special_tokens=False))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["key", "tokens"])

    kind = dict(data.dtypes)["key"]
    return data.mapInArrow(run, f"key {kind}, tokens bigint")


def fill_containers(
    documents: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, tokenizer: str | None = None, salts: int = 256
) -> DataFrame:
    """``key, piece, container, offset, tokens``: one row per document, several only for one larger than a
    container (full containers, then a remainder that is placed like any document).

    Documents without tokens lie at offset 0 of container 0; of rows that repeat a key one is kept; rows
    with a null key are dropped. Containers are numbered from 0 without gaps."""
    sizes = cut(token_counts(documents.where(F.col(key).isNotNull()), key, text, tokenizer).dropDuplicates(["key"]))
    parts = sizes.where("tokens > 0").select(
        "key",
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.ceil(F.col("tokens") / capacity))).alias("piece"),
        "tokens",
    ).select("key", "piece", F.least(F.lit(capacity).cast("bigint"), F.col("tokens") - (F.col("piece") - 1) * capacity).alias("size"),
             F.pmod(F.xxhash64("key", "piece"), F.lit(salts)).alias("salt"))
    per_salt = parts.groupBy("size", "salt").count()
    counts = {r["size"]: r["n"] for r in per_salt.groupBy("size").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    placed, _ = plan(counts, capacity)
    before = per_salt.select("size", "salt", (F.sum("count").over(Window.partitionBy("size").orderBy("salt")) - F.col("count")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("size", "salt").orderBy("key", "piece")) - 1
    ranked = parts.withColumn("rank", rank).join(before, ["size", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    spark = documents.sparkSession
    # bounded by the capacity, not by the data
    slots = spark.createDataFrame(
        [tuple(map(int, p)) for p in placed] or [(0, 0, 0, 1, 0, 0)], "size bigint, first bigint, n bigint, per bigint, container bigint, at bigint"
    ).where("n > 0")
    hit = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    r = F.col("rank") - F.col("first")
    out = ranked.join(F.broadcast(slots), "size").where(hit).select(
        "key", "piece",
        (F.col("container") + F.floor(r / F.col("per"))).alias("container"),
        (F.col("at") + F.pmod(r, F.col("per")) * F.col("size")).alias("offset"),
        F.col("size").alias("tokens"),
    )
    zero = F.lit(0).cast("bigint")
    empty = sizes.where("tokens = 0").select("key", F.lit(1).cast("bigint").alias("piece"), zero.alias("container"), zero.alias("offset"), zero.alias("tokens"))
    return out.unionByName(empty).withColumnRenamed("key", key)


def container_stats(filled: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, documents' rows, tokens, the share of space used and containers overfilled."""
    per = filled.groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    return per.agg(
        F.count("*").alias("containers"),
        F.sum("n").alias("rows"),
        F.sum("tokens").alias("tokens"),
        F.round(F.sum("tokens") / (F.count("*") * capacity), 6).alias("fill"),
        F.sum(F.when(F.col("tokens") > capacity, 1).otherwise(0)).cast("bigint").alias("overfull"),
    )
