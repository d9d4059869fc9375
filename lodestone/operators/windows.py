"""Budgets, sessions and other ordered windows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def history(rows: DataFrame, key: list[str], order: Column, size: Column, turns: int = 6, budget: int = 4800) -> DataFrame:
    """The newest rows of each key: at most ``turns`` of them, while their sizes add up to the budget. Each
    task keeps its own newest rows of a key before anything is shuffled."""
    w = Window.partitionBy(*key).orderBy(order)
    few = rows.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= turns)
    run = F.sum(size).over(Window.partitionBy(*key).orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return few.withColumns({"used": run.cast("bigint"), "turn": F.col("turn").cast("bigint")}).where(F.col("used") <= budget)


def pack(rows: DataFrame, key: list[str], order: list[Column], text: str, cap: int = 1000, budget: int = 33600) -> DataFrame:
    """Texts cut to ``cap`` characters fill a budget in order; the one that no longer fits is cut to what
    is left, the rest is dropped by the budget (the feature of this operator)."""
    w = Window.partitionBy(*key).orderBy(*order)
    cut = F.substring(F.coalesce(F.col(text), F.lit("")), 1, cap)
    before = F.coalesce(F.sum(F.length("_c")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumn("_c", cut).withColumns({"position": F.row_number().over(w).cast("bigint"), "_b": before})
    room = F.greatest(F.lit(0), F.lit(budget) - F.col("_b"))
    return out.where(F.col("_b") < budget).withColumn("piece", F.substring(F.col("_c"), F.lit(1), room.cast("int"))).drop("_c", "_b")


def add_sources(used: DataFrame, sources: DataFrame, key: list[str], order: list[Column], text: str, budget: int, until: float = 0.85, most: int = 3, notice: str = "\n... (truncated)") -> DataFrame:
    """``key, position, piece``: what fills the rest of a budget after packing (``used`` has ``key`` and its
    ``size`` so far): where less than ``until`` of it is used, the first ``most`` sources, the one that does not
    fit cut to what is left with a notice. Blank sources are passed over."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    first = sources.where(F.length(F.trim(text)) > 0).withColumn("position", rank).where(F.col("position") <= most)
    room = first.join(used.where(F.col("size") < until * budget), key)
    before = F.coalesce(F.sum(F.length(text)).over(Window.partitionBy(*key).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = (F.lit(budget) - F.col("size") - before).cast("int")
    piece = F.when(F.length(text) <= left, F.col(text)).when(left > 20, F.concat(F.substring(F.col(text), F.lit(1), left - 20), F.lit(notice)))
    return room.select(*key, F.col("position").cast("bigint").alias("position"), piece.alias("piece")).where("piece IS NOT NULL")


def sessions(events: DataFrame, key: list[str], at: str, gap_seconds: int) -> DataFrame:
    """``key, started, ended, events``: changes no more than ``gap`` apart belong together."""
    w = Window.partitionBy(*key).orderBy(at)
    late = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp")) > gap_seconds * 1_000_000
    marked = events.withColumn("_s", F.sum(F.when(F.coalesce(late, F.lit(True)), 1).otherwise(0)).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*key, "_s").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("events")).drop("_s")


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def throttle(events: DataFrame, key: str, at: str, ident: str, terminal: Column, gap: float = 0.3) -> DataFrame:
    """``key, ident``: an event is sent if ``gap`` seconds have passed since the last one sent for its key,
    or if it is terminal. The state is one number per key: rows are sorted within partitions by key and
    time and streamed, so a key of any size is never held in memory."""
    spark_key = dict(events.dtypes)[key]
    rows = events.select(
        F.col(key).alias("k"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("t"), F.col(ident).alias("i"), F.coalesce(terminal, F.lit(False)).alias("e")
    )
    ordered = rows.repartition("k").sortWithinPartitions("k", "t", "i")

    def run(batches):
        current, last = object(), None
        for b in batches:
            ks, ids = [], []
            for k, t, i, e in zip(*(c.to_pylist() for c in b.columns)):
                if k != current:
                    current, last = k, None
                if e or last is None or t - last >= gap - 1e-9:
                    ks.append(k)
                    ids.append(i)
                    last = t
            yield pa.RecordBatch.from_arrays([pa.array(ks, b.schema.field(0).type), pa.array(ids, b.schema.field(2).type)], [key, ident])

    return ordered.mapInArrow(run, f"{key} {spark_key}, {ident} {dict(events.dtypes)[ident]}")


def token_bucket(events: DataFrame, key: str, at: str, ident: str, rate: float, burst: int = 10) -> DataFrame:
    """``key, ident, sent``: when each request may go, in seconds: a bucket of ``burst`` tokens is filled at
    ``rate`` a second, a request takes one and waits for it, those of a key one after the other. Streamed like
    ``throttle``."""
    rows = events.select(F.col(key).alias("k"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("t"), F.col(ident).alias("i"))
    ordered = rows.repartition("k").sortWithinPartitions("k", "t", "i")

    def run(batches):
        current, tokens, last = object(), float(burst), 0.0
        for b in batches:
            ks, ids, out = [], [], []
            for k, t, i in zip(*(c.to_pylist() for c in b.columns)):
                if k != current:
                    current, tokens, last = k, float(burst), t
                now = max(t, last)
                tokens = min(float(burst), tokens + (now - last) * rate)
                wait = max(0.0, (1.0 - tokens) / rate)
                tokens, last = max(0.0, tokens - 1.0), now + wait
                ks.append(k)
                ids.append(i)
                out.append(last)
            yield pa.RecordBatch.from_arrays([pa.array(ks, b.schema.field(0).type), pa.array(ids, b.schema.field(2).type), pa.array(out, pa.float64())], [key, ident, "sent"])

    kinds = dict(events.dtypes)
    return ordered.mapInArrow(run, f"{key} {kinds[key]}, {ident} {kinds[ident]}, sent double")


def live(rows: DataFrame, key: list[str], at: str, ident: str, ttl_seconds: float, now: Column) -> DataFrame:
    """The newest entry of each key that is no older than its time to live; ties go to the larger ``ident``."""
    last = rows.groupBy(*key).agg(F.max(F.struct(at, ident)).alias("x"))
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(f"x.{at}").cast("timestamp"))
    return last.where(age <= ttl_seconds * 1_000_000).select(*key, F.col(f"x.{ident}").alias(ident))


def accumulate(rows: DataFrame, key: list[str], order: str, text: str) -> DataFrame:
    """The text of each key so far, row by row, as a client that appends chunks would show it."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("so_far", F.concat_ws("", F.collect_list(text).over(w)))
