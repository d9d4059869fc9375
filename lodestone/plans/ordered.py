"""Queries over ordered windows and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import windows as W
from ..session import table
from ..streaming import changes
from .catalog import query

_DOCS = "docs AS (SELECT doc_id, source, text, length(text) AS n FROM documents WHERE source IS NOT NULL AND text IS NOT NULL)"


def _docs(spark, d):
    return table(spark, d, "documents").where("source IS NOT NULL AND text IS NOT NULL").select("doc_id", "source", "text", F.length("text").alias("n"))


@query(
    f"WITH {_DOCS}, w AS (SELECT source, doc_id, row_number() OVER o AS turn, CAST(sum(n) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM docs WINDOW o AS (PARTITION BY source ORDER BY doc_id DESC)) SELECT source, doc_id, turn, used FROM w WHERE turn <= 6 AND used <= 4800"
)
def history_window(spark, d):
    return W.history(_docs(spark, d), ["source"], F.desc("doc_id"), F.col("n")).select("source", "doc_id", "turn", "used")


@query(
    f"""WITH {_DOCS}, c AS (SELECT source, doc_id, substr(text, 1, 1000) AS c FROM docs), w AS (SELECT *, coalesce(sum(length(c)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position FROM c) SELECT source, doc_id, position, CAST(length(substr(c, 1, CAST(33600 - b AS INTEGER))) AS BIGINT) AS size FROM w WHERE b < 33600"""
)
def context_pack(spark, d):
    return W.pack(_docs(spark, d), ["source"], [F.col("doc_id")], "text").select("source", "doc_id", "position", F.length("piece").cast("bigint").alias("size"))


@query(
    f"""WITH {_DOCS}, u AS (SELECT source, least(sum(length(substr(text, 1, 1000))), 33600) AS size FROM docs GROUP BY source), f AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY n DESC, doc_id) AS position FROM docs WHERE length(trim(text, ' ')) > 0 QUALIFY position <= 3),
    r AS (SELECT f.*, 48000 - size - coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM f JOIN u USING (source) WHERE size < 40800)
    SELECT source, position, CAST(CASE WHEN length(text) <= room THEN length(text) ELSE room - 20 + 16 END AS BIGINT) AS size FROM r WHERE length(text) <= room OR room > 20"""
)
def context_sources(spark, d):
    """What follows the packed texts of each source: its three longest, as far as there is room."""
    docs = _docs(spark, d)
    packed = W.pack(docs, ["source"], [F.col("doc_id")], "text").groupBy("source").agg(F.sum(F.length("piece")).alias("size"))
    return W.add_sources(packed, docs, ["source"], [F.desc("n"), F.col("doc_id")], "text", 48000).select("source", "position", F.length("piece").cast("bigint").alias("size"))


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER o IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER o) > 1800000000 THEN 1 ELSE 0 END AS n FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM s GROUP BY user_id, s"""
)
def debounce_session(spark, d):
    return W.sessions(table(spark, d, "events"), ["user_id"], "ts", 1800)


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER o IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER o) > 1800000000 THEN 1 ELSE 0 END AS n FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, epoch_us(min(ts)) AS started, count(*) AS events FROM s GROUP BY user_id, s"""
)
def stream_session(spark, d):
    stream = changes.read_stream(spark, f"{d}/events.parquet")
    return changes.run_to_table(changes.debounce(stream, ["user_id"], "ts", "30 minutes"), "complete").withColumn("started", F.unix_micros("started"))


@query()
def throttle(spark, d):
    e = table(spark, d, "events")
    return W.throttle(e, "user_id", "ts", "event_id", F.col("event_type") == "error", 3600.0)


@query(
    """WITH n AS (SELECT max(ts) AS now FROM events), r AS (SELECT *, rank() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS r FROM events)
    SELECT user_id, event_type, max(event_id) AS event_id FROM r, n WHERE r = 1 AND epoch_us(now) - epoch_us(ts) <= 604800000000 GROUP BY 1, 2"""
)
def ttl_latest(spark, d):
    """The newest event of each kind, while it is no older than a week at the last event."""
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now")).first()["now"]
    return W.live(e, ["user_id", "event_type"], "ts", "event_id", 604800, F.lit(now))


@query("SELECT p_brand, p_partkey, rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 8")
def topn_per_group(spark, d):
    return W.top_per_group(table(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 8).select("p_brand", "p_partkey", "rank")


@query(f"WITH {_DOCS} SELECT source, min(doc_id) AS first FROM docs GROUP BY source ORDER BY first LIMIT 3")
def distinct_sources(spark, d):
    return _docs(spark, d).groupBy("source").agg(F.min("doc_id").alias("first")).orderBy("first").limit(3)


@query(
    """WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, ts, event_id, event_type FROM events), p AS (SELECT a.event_id AS source_id, b.event_id AS sink_id, a.user_id, a.day, a.ts AS t1, b.ts AS t2 FROM s a JOIN s b ON a.user_id = b.user_id AND a.day = b.day WHERE a.event_type = 'error' AND b.event_type = 'purchase')
    SELECT source_id, sink_id, CASE WHEN EXISTS (SELECT 1 FROM s v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND v.day = p.day AND v.ts > t1 AND v.ts < t2) THEN 'low' WHEN t1 < t2 THEN 'medium' ELSE 'high' END AS risk FROM p"""
)
def risk_theta(spark, d):
    day = F.to_date("ts")
    s = table(spark, d, "events").select("user_id", day.alias("day"), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "event_type")
    # the first view after each event: a pair is clean if it comes before the sink, so no list of views is kept
    later = Window.partitionBy("user_id", "day").orderBy("at").rangeBetween(1, Window.unboundedFollowing)
    s = s.withColumn("view", F.min(F.when(F.col("event_type") == "view", F.col("at"))).over(later))
    k = ["user_id", "day"]
    a = s.where("event_type = 'error'").select(*k, F.col("at").alias("t1"), "view", F.col("event_id").alias("source_id"))
    b = s.where("event_type = 'purchase'").select(*k, F.col("at").alias("t2"), F.col("event_id").alias("sink_id"))
    clean = F.coalesce(F.col("view") < F.col("t2"), F.lit(False))
    return a.join(b, k).select("source_id", "sink_id", F.when(clean, "low").when(F.col("t1") < F.col("t2"), "medium").otherwise("high").alias("risk"))
