"""Queries on jobs, messages, usage and generic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import token_estimate
from corpusloom.operators import tables as ops
from corpusloom.plans.base import Query, register, table
from corpusloom.streaming import jobs

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
TOKENS = r"""CASE WHEN length({0}) = 0 THEN 0 ELSE greatest(1, CASE WHEN len(regexp_extract_all({0}, '[\x00-\x7F]')) > 0 THEN greatest(1, round_even(len(regexp_extract_all({0}, '[\x00-\x7F]')) / 4, 0)) ELSE 0 END
 + len(regexp_extract_all({0}, '[㐀-鿿぀-ヿ가-힯]')) + round_even((length({0}) - len(regexp_extract_all({0}, '[\x00-\x7F㐀-鿿぀-ヿ가-힯]'))) / 2, 0))::INT END"""


def entered(sql: str | None = None):
    return register(QUERIES, ORACLE_SQL, sql)


@entered("SELECT user_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS n_{t}" for t in ("view", "click", "purchase")) + " FROM events GROUP BY user_id")
def job_status_counts(spark, sf) -> DataFrame:
    return ops.status_counts(table(spark, sf, "events"), "user_id", ["view", "click", "purchase"], "event_type")


@entered("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM events) WHERE p = 1")
def latest_job(spark, sf) -> DataFrame:
    return ops.latest(table(spark, sf, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@entered("SELECT user_id, bool_or(event_type NOT IN ('click', 'view')) AS has_pending, count(*) AS n FROM events GROUP BY user_id")
def has_pending(spark, sf) -> DataFrame:
    status = F.when(F.col("event_type") == "click", "ready").when(F.col("event_type") == "view", "failed").otherwise("pending")
    return ops.pending(table(spark, sf, "events").select("user_id", status.alias("status")), "user_id")


@entered("SELECT conv_id, turn, p AS back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS p FROM conversations) WHERE p <= 3")
def last_messages(spark, sf) -> DataFrame:
    return ops.last_messages(table(spark, sf, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "back")


@entered("""SELECT conv_id, turn, role FROM (SELECT *, coalesce(count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u
            FROM conversations WHERE trim(coalesce(text, '')) <> '') WHERE u < 2""")
def last_user_turns(spark, sf) -> DataFrame:
    return ops.last_user_turns(table(spark, sf, "conversations"), "conv_id", "turn", 2).select("conv_id", "turn", "role")


@entered(f"""SELECT conv_id, sum(CASE WHEN role <> 'assistant' THEN {TOKENS.format("(role || chr(10) || text)")} ELSE 0 END)::BIGINT AS tokens_in,
            sum(CASE WHEN role = 'assistant' THEN {TOKENS.format('text')} ELSE 0 END)::BIGINT AS tokens_out FROM conversations GROUP BY conv_id""")
def usage_by_conversation(spark, sf) -> DataFrame:
    return ops.usage(table(spark, sf, "conversations"), "conv_id")


@entered("""WITH r AS (SELECT user_id, event_id % 7 AS t, CASE WHEN event_type = 'click' THEN NULL ELSE round(value, 2) END AS c, CASE WHEN event_type = 'click' THEN 'provider' ELSE 'estimated' END AS o FROM events)
            SELECT user_id, sum(t)::BIGINT AS tokens_in, (sum(t) * 2)::BIGINT AS tokens_out, round(sum(c), 2) AS cost, CASE WHEN count(DISTINCT o) = 1 THEN min(o) ELSE 'mixed' END AS origin FROM r GROUP BY user_id""")
def merged_usage(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    click = F.col("event_type") == "click"
    rows = e.select("user_id", (F.col("event_id") % 7).alias("tokens_in"), (F.col("event_id") % 7 * 2).alias("tokens_out"), F.when(~click, F.round("value", 2)).alias("cost"), F.when(click, "provider").otherwise("estimated").alias("origin"))
    return ops.merge_usage(rows, "user_id").withColumn("cost", F.round("cost", 2))


@entered(f"SELECT source, count(*) AS texts, sum(t)::BIGINT AS tokens, round(sum(t) / 1000 * 0.02, 6) AS cost FROM (SELECT source, {TOKENS.format('text')} AS t FROM documents) GROUP BY source")
def embedding_cost(spark, sf) -> DataFrame:
    rows = table(spark, sf, "documents").select("source", token_estimate(F.col("text")).alias("t"))
    sums = rows.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum("t").alias("tokens"))
    return sums.withColumn("cost", F.round(ops.cost(F.col("tokens"), F.lit(0.02)), 6))


@entered("SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40")
def pagination(spark, sf) -> DataFrame:
    return ops.page(table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice"), [F.desc("p_retailprice"), "p_partkey"], 20, 40)


@entered("SELECT doc_id, n_chars, md5(text) AS body FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, quality AS n_chars, md5(toxic::VARCHAR) AS body FROM labels")
def replace_chunks_by_source(spark, sf) -> DataFrame:
    old = table(spark, sf, "documents").select("doc_id", "n_chars", F.md5("text").alias("body"))
    new = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("n_chars"), F.md5(F.col("toxic").cast("string").cast("binary")).alias("body"))
    return ops.replace_by_key(old, new, "doc_id")


@entered("SELECT d.doc_id, coalesce(l.quality, -1) AS version FROM documents d LEFT JOIN labels l USING (doc_id)")
def upsert_snapshots(spark, sf) -> DataFrame:
    old = table(spark, sf, "documents").select("doc_id", F.lit(-1).alias("version"))
    return ops.upsert(old, table(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("version")), "doc_id")


@entered("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascade_delete(spark, sf) -> DataFrame:
    gone = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return ops.cascade_delete(gone, "l_orderkey", table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))[0]


@entered("SELECT o_custkey, count(*) AS live FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey")
def soft_deleted(spark, sf) -> DataFrame:
    rows = table(spark, sf, "orders").withColumn("deleted_at", F.lit(None).cast("timestamp"))
    return ops.live(ops.soft_delete(rows, F.col("o_orderstatus") == "P", F.lit("2024-01-01").cast("timestamp"))).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("live"))


@entered("SELECT n_name, count(*) AS orders FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' GROUP BY n_name")
def runs_in_time_range(spark, sf) -> DataFrame:
    inside = ops.in_time_range(table(spark, sf, "orders"), "o_orderdate", F.lit("1995-01-01").cast("date"), F.lit("1996-12-31").cast("date")).select("o_custkey")
    joined = inside.join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"))


@entered("SELECT user_id, event_type, n, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS share FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)")
def stage_shares(spark, sf) -> DataFrame:
    rows = table(spark, sf, "events").withColumn("one", F.lit(1))
    return ops.share_of_total(rows, "user_id", "event_type", "one").select("user_id", "event_type", F.col("value").alias("n"), F.round("share", 6).alias("share"))


@entered("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id::VARCHAR), event_id) AS p FROM events) WHERE p <= 10")
def stratified_sample(spark, sf) -> DataFrame:
    return ops.stratified(table(spark, sf, "events"), "event_type", "event_id", 10).select("event_type", "event_id")


@entered("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_status_counts(spark, sf) -> DataFrame:
    return jobs.windowed_counts(table(spark, sf, "events"), "ts", "event_type")


@entered("SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS events FROM events GROUP BY user_id")
def latest_status(spark, sf) -> DataFrame:
    return jobs.latest_status(table(spark, sf, "events"), "user_id", "ts", "event_type", "event_id")


@entered("SELECT user_id, CASE count(*) FILTER (event_type = 'purchase') WHEN 0 THEN 'no_chunks' WHEN 1 THEN 'single_chunk' ELSE 'streaming' END AS mode FROM events GROUP BY user_id")
def delivery_modes(spark, sf) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(jobs.delivery_mode(F.count_if(F.col("event_type") == "purchase")).alias("mode"))


@entered(r"""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events""")
def lenient_metadata(spark, sf) -> DataFrame:
    from corpusloom.sources.web import lenient_json

    return table(spark, sf, "events").select("event_id", lenient_json(F.col("props"), "k int")["k"].alias("k"))
