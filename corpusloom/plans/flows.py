"""Queries over whole requests and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import grounding, requests, retrieval, tables
from corpusloom.plans import search
from corpusloom.plans.base import Query, documents, register, table

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def entered(sql: str | None = None):
    return register(QUERIES, ORACLE_SQL, sql)


@entered("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license')")
def text_search(spark, sf) -> DataFrame:
    return requests.text_search(documents(spark, sf), F.lit(" License"), "text", "source").select("doc_id")


@entered(r"""WITH l AS (SELECT conv_id, turn, role || ': ' || trim(regexp_replace(text, '\s+', ' ', 'g')) AS line FROM conversations WHERE trim(coalesce(text, '')) <> ''),
    u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM l) SELECT conv_id, md5(string_agg(line, chr(10) ORDER BY turn)) AS history FROM u WHERE used <= 1200 GROUP BY conv_id""")
def history_contexts(spark, sf) -> DataFrame:
    return requests.history_context(table(spark, sf, "conversations"), "conv_id", "turn").withColumn("history", F.md5("history"))


@entered(f"WITH {search._BM25}, r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN id % 3 = 0 THEN id END DESC NULLS LAST, score DESC, id) AS rank FROM bm25 WHERE rank <= 20) SELECT query_id, id, rank FROM r WHERE rank <= 5")
def reranked(spark, sf) -> DataFrame:
    found = retrieval.bm25_search(search.asked(spark, sf), k=20, index=search.index(spark, sf))
    scores = found.where("id % 3 = 0").select("query_id", "id", F.col("id").cast("double").alias("score"))
    return requests.rerank(found, scores, 5).select("query_id", "id", "rank")


@entered("SELECT source, toxic AS verdict, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY source, toxic")
def verdict_rates(spark, sf) -> DataFrame:
    rows = documents(spark, sf).select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("verdict")), "doc_id")
    return requests.verdict_rates(rows, "source", "verdict").withColumn("rate", F.round("rate", 6))


@entered("SELECT source, scope_count, chunk_count FROM (SELECT 'src' || (item_id % 20) AS source, count(DISTINCT item_id) AS scope_count, count(*) AS chunk_count FROM benchmark GROUP BY 1)")
def scope_diagnostics(spark, sf) -> DataFrame:
    rows = search.asked(spark, sf).select(F.col("scope").alias("query_id"), F.col("query_id").alias("scope"))
    return grounding.diagnostics(rows).select(F.col("query_id").alias("source"), F.col("source_count").alias("scope_count"), "chunk_count")


@entered("SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 32 AS batch FROM events")
def fixed_batches(spark, sf) -> DataFrame:
    return tables.batches(table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id", 32)


@entered("""WITH RECURSIVE r AS (SELECT source, doc_id, length(text) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE length(text) <= 20000),
    f AS (SELECT source, doc_id, k, true AS kept, t AS used FROM r WHERE k = 1
          UNION ALL SELECT r.source, r.doc_id, r.k, f.used + r.t <= 20000, CASE WHEN f.used + r.t <= 20000 THEN f.used + r.t ELSE f.used END FROM f JOIN r ON r.source = f.source AND r.k = f.k + 1)
    SELECT source, doc_id, length(text) AS tokens FROM f JOIN documents d USING (doc_id, source) WHERE kept""")
def budgeted_chunks(spark, sf) -> DataFrame:
    rows = documents(spark, sf).select("source", "doc_id", F.length("text").alias("tokens"))
    return requests.within_budget(rows, "source", "doc_id", "tokens", 20_000)


@entered("""WITH RECURSIVE i AS (SELECT source, doc_id, length(text) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM documents),
    p AS (SELECT *, CASE WHEN k = 0 THEN 0 WHEN k = n - 1 THEN 1 WHEN k = n // 2 THEN 2 WHEN k = n // 4 THEN 3 WHEN k = 3 * n // 4 THEN 4 ELSE 5 END AS spot FROM i),
    r AS (SELECT source, doc_id, t, row_number() OVER (PARTITION BY source ORDER BY spot, k) AS k FROM p WHERE t <= 9000),
    f AS (SELECT source, doc_id, k, true AS kept, t AS used FROM r WHERE k = 1
          UNION ALL SELECT r.source, r.doc_id, r.k, f.used + r.t <= 9000, CASE WHEN f.used + r.t <= 9000 THEN f.used + r.t ELSE f.used END FROM f JOIN r ON r.source = f.source AND r.k = f.k + 1)
    SELECT source, doc_id, length(text) AS tokens FROM f JOIN documents d USING (doc_id, source) WHERE kept""")
def prioritised_chunks(spark, sf) -> DataFrame:
    """A source's documents as its chunks, offered to the budget first, last, middle and quarters first."""
    inside = Window.partitionBy("source").orderBy("doc_id")
    index, count = F.row_number().over(inside) - 1, F.count(F.lit(1)).over(Window.partitionBy("source"))
    rows = documents(spark, sf).select("source", "doc_id", F.length("text").alias("tokens"), index.alias("k"), count.alias("n"))
    offered = rows.select("source", "doc_id", "tokens", requests.priority(F.col("k"), F.col("n")).alias("place"))
    return requests.within_budget(offered, "source", "place", "tokens", 9000).select("source", "doc_id", "tokens")


@entered(f"WITH {search._BM25} SELECT query_id, rank AS citation_index, id FROM bm25 WHERE rank <= 5")
def prepared_answers(spark, sf) -> DataFrame:
    """Requests for which no model has answered: each is its own search."""
    asked = search.asked(spark, sf).select(F.col("query_id").alias("request_id"), "scope", "query", F.lit(False).alias("has_history"))
    none = asked.select("request_id", F.lit(None).cast("string").alias("raw"))
    return requests.prepare_answers(requests.apply_rewrites(asked, none), search.passages(spark, sf), index=search.index(spark, sf)).select("query_id", "citation_index", "id")


_FIRST = "regexp_extract(text, '[A-Za-z]+')"


@entered(f"""WITH a AS (SELECT item_id AS request_id, 'it ' || {_FIRST} || ' Kafka_' || item_id AS query, {_FIRST} AS w, item_id % 6 AS k FROM benchmark),
    o AS (SELECT *, CASE k WHEN 0 THEN 'what about ' || w || ' Kafka_' || request_id WHEN 1 THEN 'what about ' || w ELSE query END AS said FROM a)
    SELECT request_id, CASE WHEN k IN (0, 1) THEN 'standalone_expansion' WHEN k = 5 THEN 'reference_resolution' ELSE 'no_rewrite' END AS strategy,
           CASE WHEN k IN (0, 1, 5) THEN said ELSE query END AS final_query,
           CASE k WHEN 0 THEN said WHEN 1 THEN w || ' Kafka_' || request_id ELSE query END AS first_search, k IN (0, 1) AS rewritten FROM o""")
def rewritten_requests(spark, sf) -> DataFrame:
    """Model outputs of every branch, made from the items: a good one; one whose searches alone keep the terms; one in a code
    fence; one that drops a term; one that can't be read; and one that says the same with a strategy that isn't known."""
    k, word = F.col("item_id") % 6, F.regexp_extract("text", "[A-Za-z]+", 0)
    name = F.concat(F.lit("Kafka_"), F.col("item_id"))
    query = F.concat(F.lit("it "), word, F.lit(" "), name)
    items = table(spark, sf, "benchmark")
    asked = items.select(F.col("item_id").alias("request_id"), query.alias("query"), F.lit(True).alias("has_history"))
    said = lambda text, searches, strategy: F.to_json(F.struct(text.alias("query"), searches.alias("search_queries"), strategy.alias("strategy")))
    about, none, expand = F.concat(F.lit("what about "), word), F.array().cast("array<string>"), F.lit("standalone_expansion")
    whole = F.concat(about, F.lit(" "), name)
    raw = (
        F.when(k == 0, said(whole, none, expand)).when(k == 1, said(about, F.array(F.concat_ws(" ", word, name)), expand)).when(k == 2, said(F.concat(F.lit("``` "), whole), F.array(whole), expand))
        .when(k == 3, said(F.lit("tell me more"), none, expand)).when(k == 4, F.lit("{ not an object")).otherwise(said(query, none, F.lit("other")))
    )
    made = requests.apply_rewrites(asked, items.select(F.col("item_id").alias("request_id"), raw.alias("raw")))
    return made.select("request_id", "strategy", "final_query", F.get("searches", F.lit(0)).alias("first_search"), "rewritten")


_LONG = "l AS (UNPIVOT (SELECT query_id, recall::DOUBLE AS recall, precision::DOUBLE AS precision, hit::DOUBLE AS hit, ndcg::DOUBLE AS ndcg, reciprocal_rank::DOUBLE AS reciprocal_rank FROM m) ON recall, precision, hit, ndcg, reciprocal_rank INTO NAME metric_type VALUE metric_value)"


@entered(f"WITH {search._BM25}, {search._COSINE}, {search._FUSED}, ranked AS (SELECT query_id, id, rank FROM fused WHERE rank <= 10), {search._TRUTH}, {search.MEASURED}, {_LONG} SELECT query_id, metric_type, round(metric_value, 6) AS metric_value FROM l")
def evaluation_runs(spark, sf) -> DataFrame:
    q, p = search.embedded(spark, sf)
    return requests.evaluation_run(q, p, search.truth(spark, sf), index=search.index(spark, sf)).withColumn("metric_value", F.round("metric_value", 6))


@entered("SELECT event_id, props AS object FROM events")
def recovered_json(spark, sf) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", F.concat(F.lit("note {x "), "props", F.lit(" end")).alias("raw"))
    return requests.recover_json(rows, "raw").select("event_id", "object")
