"""Queries for the service tables: listings, scopes, ingestion, usage, errors, citations, experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import chunking, evaluation, grounding, requests, retrieval, tables
from corpusloom.plans import search
from corpusloom.plans.base import Query, documents, register, table
from corpusloom.plans.corpus import _HTML, KEYWORDS, _keywords
from corpusloom.plans.tables import TOKENS
from corpusloom.sources import readers, web
from corpusloom.streaming import progress as jobs_progress

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def entered(sql: str | None = None):
    return register(QUERIES, ORACLE_SQL, sql)


# ---- notebooks are customers, sources orders, jobs line items


def notebooks(spark, sf) -> DataFrame:
    gone = F.when(F.col("c_nationkey") % 5 == 0, F.lit("2024-01-01").cast("timestamp"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("notebook_id"), F.col("c_nationkey").alias("owner"), gone.alias("deleted_at"))


def sources(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("source_id"), F.col("o_custkey").alias("notebook_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("error_message"))


def jobs(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("job_id"))


@entered("SELECT l_orderkey AS source_id, l_linenumber AS job_id, o_custkey AS notebook_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_nationkey % 5 <> 0")
def live_jobs(spark, sf) -> DataFrame:
    return tables.live_jobs(jobs(spark, sf), sources(spark, sf), notebooks(spark, sf)).select("source_id", "job_id", "notebook_id")


@entered("""SELECT e.source_id, o.o_orderkey IS NOT NULL AS found FROM (SELECT DISTINCT event_id * 2 AS source_id FROM events) e
    LEFT JOIN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey % 5 <> 0 AND c_nationkey = 3) o ON o.o_orderkey = e.source_id""")
def live_sources(spark, sf) -> DataFrame:
    asked = table(spark, sf, "events").select((F.col("event_id") * 2).alias("source_id"))
    return tables.live_sources(asked, sources(spark, sf), notebooks(spark, sf), F.lit(3))


@entered("""WITH p AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
    SELECT CASE WHEN o_orderstatus = 'F' THEN 'pending' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS error_message, count(*) AS sources,
           (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM p)) AS jobs_left FROM orders GROUP BY 1, 2""")
def reset_ingestion(spark, sf) -> DataFrame:
    chosen = sources(spark, sf).where("status = 'F'")
    fresh, left, _ = tables.reset_ingestion(sources(spark, sf), jobs(spark, sf), jobs(spark, sf), chosen)
    counted = fresh.groupBy("status", "error_message").agg(F.count(F.lit(1)).alias("sources"))
    return counted.join(F.broadcast(left.agg(F.count(F.lit(1)).alias("jobs_left"))))  # one row


@entered("SELECT count(*) AS total, ceil(count(*) / 50)::BIGINT AS pages FROM documents")
def listing_totals(spark, sf) -> DataFrame:
    return tables.total_pages(table(spark, sf, "documents"), 50).withColumn("pages", F.col("pages").cast("long"))


@entered("SELECT o_orderkey, o_orderdate FROM orders")
def newest_sources(spark, sf) -> DataFrame:
    return tables.newest_first(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


@entered("SELECT o_orderpriority, count(*) AS n, count(*) FILTER (coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END, 'pending') IN ('pending', 'failed')) AS retryable FROM orders GROUP BY o_orderpriority")
def retryable_sources(spark, sf) -> DataFrame:
    own = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus"))
    rows = table(spark, sf, "orders").withColumn("status", tables.effective_status(own, F.lit("pending")))
    again = tables.retryable_sources(rows).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("retryable"))
    return rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).join(again, "o_orderpriority", "left").withColumn("retryable", F.coalesce("retryable", F.lit(0)))


@entered("SELECT label, count(*) AS total, count(*) FILTER (vec_id % 7 <> 0) AS embedded, round(count(*) FILTER (vec_id % 7 <> 0) / count(*) * 100, 6) AS coverage_percent FROM embeddings GROUP BY label")
def embedding_coverage(spark, sf) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("label", F.when(F.col("vec_id") % 7 != 0, F.col("embedding")).alias("embedding"))
    return retrieval.embedding_coverage(rows, "label").withColumn("coverage_percent", F.round("coverage_percent", 6))


# ---- usage, errors, languages


@entered("""SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS prompt_tokens, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'click' THEN 0 ELSE event_id % 50 END AS completion_tokens,
    CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'click' THEN user_id ELSE user_id + event_id % 50 END AS total_tokens, CASE WHEN event_type = 'view' THEN event_id % 9 END AS cached_tokens FROM events""")
def usage_payloads(spark, sf) -> DataFrame:
    into, out = F.col("user_id").alias("prompt_tokens"), (F.col("event_id") % 50).alias("completion_tokens")
    nested = F.to_json(F.struct(F.struct(into, out, F.struct((F.col("event_id") % 9).alias("cached_tokens")).alias("prompt_tokens_details")).alias("usage")))
    raw = F.when(F.col("event_type") == "view", nested).when(F.col("event_type") == "click", F.to_json(F.struct(F.col("user_id").cast("string").alias("prompt_tokens")))).when(F.col("event_type") == "error", F.lit('{"usage": {}}')).otherwise(F.to_json(F.struct(into, out)))
    return table(spark, sf, "events").select("event_id", tx.usage_payload(raw).alias("u")).select("event_id", "u.*")


def _contains(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(m, '{w}')" for w in words) + ")"


@entered(f"""WITH e AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 429 WHEN 1 THEN 503 ELSE 400 END AS status, lower(text || CASE conv_id % 4 WHEN 0 THEN ' Quota reached' WHEN 1 THEN ' gateway Timeout' WHEN 2 THEN ' unsafe: safety' ELSE '' END) AS m FROM conversations)
    SELECT conv_id, turn, CASE WHEN (status = 429 OR contains(m, '429')) AND {_contains(tx.QUOTA_WORDS)} THEN 'quota' WHEN {_contains(tx.SAFETY_WORDS)} THEN 'safety' WHEN status IN (429, 503) AND {_contains(tx.UPSTREAM_WORDS)} THEN 'temporary' ELSE 'internal' END AS error,
           status <> 400 AS again FROM e""")
def error_classes(spark, sf) -> DataFrame:
    status = F.when(F.col("turn") % 3 == 0, 429).when(F.col("turn") % 3 == 1, 503).otherwise(400)
    more = F.when(F.col("conv_id") % 4 == 0, " Quota reached").when(F.col("conv_id") % 4 == 1, " gateway Timeout").when(F.col("conv_id") % 4 == 2, " unsafe: safety").otherwise("")
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.error_class(status, F.concat("text", more)).alias("error"), tx.retryable(status).alias("again"))


@entered("""SELECT event_type, CASE event_type WHEN 'view' THEN 'Ingestion failed while loading the source.' WHEN 'click' THEN 'Ingestion failed while preparing chunks.' ELSE 'Ingestion failed.' END AS message, count(*) AS n FROM events GROUP BY event_type""")
def safe_messages(spark, sf) -> DataFrame:
    step = F.when(F.col("event_type") == "view", "fetch").when(F.col("event_type") == "click", "chunk").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_type", tx.safe_message(step).alias("message")).groupBy("event_type", "message").agg(F.count(F.lit(1)).alias("n"))


@entered("""SELECT conv_id, CASE WHEN bool_or(role = 'user' AND regexp_matches(text, '[㐀-䶿一-鿿]')) THEN 'zh' WHEN bool_or(role = 'user' AND regexp_matches(text, '[A-Za-z]')) THEN 'en' ELSE 'same_as_user' END AS language FROM conversations GROUP BY conv_id""")
def thread_languages(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("conv_id").agg(tx.thread_language(F.col("text"), F.col("role")).alias("language"))


@entered("SELECT event_id, least(greatest(coalesce(try_cast(json_extract_string(props, '$.k') AS INT), 10), 1), 50) AS top_k, (event_id % 97)::VARCHAR AS page FROM events")
def clamped_limits(spark, sf) -> DataFrame:
    k = tx.clamp(F.get_json_object("props", "$.k"), 1, 50, 10)
    return table(spark, sf, "events").select("event_id", k.alias("top_k"), tx.page_label(F.col("event_id") % 97).alias("page"))


@entered("SELECT p_partkey, round(p_size / 1000 * 0.5 + p_size * 2 / 1000 * 0.5, 9) AS cost FROM part")
def chat_costs(spark, sf) -> DataFrame:
    none = F.lit(None).cast("double")
    return table(spark, sf, "part").select("p_partkey", F.round(tables.chat_cost(F.col("p_size"), F.col("p_size") * 2, F.lit(0.5), none), 9).alias("cost"))


@entered(r"SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9一-鿿]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'node') AS slug, CASE WHEN length(p_name) <= 12 THEN p_name ELSE '...' || right(p_name, 12) END AS tail FROM part")
def slugs(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", tx.slug(F.col("p_name")).alias("slug"), tx.tail(F.col("p_name"), 12).alias("tail"))


@entered(r"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'missing URL' WHEN 2 THEN 'unsupported type' END AS problem, CASE WHEN page_id % 4 = 3 THEN substr(md5(url), 1, 20) END AS document, 'page ' || page_id AS title FROM pages""")
def routed_sources(spark, sf) -> DataFrame:
    """Every source with what keeps it from being read, the id of a shared document, and a title from a file name."""
    kind = F.element_at(F.array(F.lit("url"), F.lit("video"), F.lit("mail"), F.lit("document")), (F.col("page_id") % 4 + 1).cast("int"))
    url = F.when(F.col("page_id") % 4 == 3, F.concat(F.lit("https://docs.google.com/document/d/"), F.substring(F.md5("url"), 1, 20), F.lit("/edit"))).when(F.col("page_id") % 4 != 1, F.col("url"))
    rows = table(spark, sf, "pages").select("page_id", kind.alias("source_type"), F.lit(None).cast("string").alias("file_path"), url.alias("original_url"))
    name = F.concat(F.lit("/in/page_"), F.col("page_id"), F.lit(".html"))
    return web.route(rows).select("page_id", F.col("error.message").alias("problem"), web.document_id(F.col("original_url")).alias("document"), web.file_title(name).alias("title"))


_STEPS = ["queued", "starting", "fetching", "parsing", "chunking", "snapshot", "embedding", "saving", "completed", "unknown"]


def job_events(spark, sf) -> DataFrame:
    """The events of users as those of jobs: statuses and steps by event."""
    pick = lambda names, k: F.element_at(F.array(*[F.lit(x) for x in names]), (k + 1).cast("int"))
    status = pick(["queued", "running", "failed", "running", "completed"], F.col("event_id") % 5)
    return table(spark, sf, "events").select(F.col("user_id").alias("job_id"), "ts", "event_id", status.alias("status"), pick(_STEPS, F.col("event_id") % 10).alias("step"))


@entered(f"""WITH e AS (SELECT user_id AS job_id, ts, event_id::VARCHAR AS tie, ['queued', 'running', 'failed', 'running', 'completed'][event_id % 5 + 1] AS status, {_STEPS}[event_id % 10 + 1] AS step FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, tie DESC) AS k, min(ts) FILTER (status = 'failed') OVER (PARTITION BY job_id) AS failed, count(*) OVER (PARTITION BY job_id) AS events FROM e)
    SELECT job_id, status, step, CASE WHEN status = 'completed' THEN 100 ELSE coalesce({list(jobs_progress.STEPS.values())}[list_position({list(jobs_progress.STEPS)}, step)], 0) END AS percent,
           status IN ('queued', 'running') AND coalesce(failed < ts, false) AS retrying, events FROM n WHERE k = 1""")
def job_progress(spark, sf) -> DataFrame:
    return jobs_progress.progress(job_events(spark, sf), "job_id", "ts", "status", "step", "event_id").drop("updated")


def mixed_sources(spark, sf) -> DataFrame:
    """Every page as a source, of types that can and can't be read."""
    k = F.col("page_id") % 6
    kind = F.element_at(F.array(*[F.lit(x) for x in ("url", "url", "mail", "pdf", "url", "text")]), (k + 1).cast("int"))
    url = F.when(k == 0, F.col("url")).when(k == 4, F.concat("url", F.lit("#gone")))
    return table(spark, sf, "pages").select(F.col("page_id").alias("source_id"), kind.alias("source_type"), F.when(k == 3, F.lit("/in/a.pdf")).alias("file_path"), url.alias("original_url"))


@entered(f"""WITH p AS (SELECT url, min({_HTML}) AS text FROM pages GROUP BY url), s AS (SELECT page_id AS source_id, page_id % 6 AS k, CASE WHEN page_id % 6 = 0 THEN url WHEN page_id % 6 = 4 THEN url || '#gone' END AS url FROM pages),
    t AS (SELECT s.*, p.text, p.url IS NOT NULL AS there FROM s LEFT JOIN p USING (url))
    SELECT source_id, CASE WHEN k IN (0, 4) AND trim(text) <> '' THEN md5(text) END AS text_md5,
           CASE WHEN k IN (0, 4) AND there AND trim(coalesce(text, '')) <> '' THEN NULL WHEN k = 3 OR k IN (0, 4) AND there THEN 'parse' ELSE 'fetch' END AS step,
           CASE WHEN k IN (0, 4) THEN CASE WHEN NOT there THEN 'page not fetched' WHEN trim(coalesce(text, '')) = '' THEN 'no text content' END
                ELSE ['missing URL', 'unsupported type', 'no reader for PDF layout', NULL, 'missing file path'][k] END AS message FROM t""")
def read_sources(spark, sf) -> DataFrame:
    """Each source's text, or the step that it fails in."""
    read = readers.read_sources(mixed_sources(spark, sf), pages=table(spark, sf, "pages").select("url", "html"))
    return read.select("source_id", F.md5("text").alias("text_md5"), "error.step", "error.message")


@entered("SELECT vec_id, round(embedding[1]::DOUBLE, 3) AS first, len(embedding) AS size FROM embeddings")
def parsed_vectors(spark, sf) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", F.to_json("embedding").alias("raw"))
    return rows.select("vec_id", retrieval.parse_vector(F.col("raw")).alias("v")).select("vec_id", F.round(F.get("v", F.lit(0)), 3).alias("first"), F.size("v").alias("size"))


# ---- pages and chunks


_PAGES = "pages_of AS (SELECT doc_id, unnest(range((n_chars - 1) // 1000 + 1)) AS k, n_chars FROM documents WHERE n_chars > 0), spans AS (SELECT doc_id, k + 1 AS page_number, k * 1000 AS a, least(k * 1000 + 1000, n_chars) AS b FROM pages_of)"
_PARTS = "parts AS (SELECT doc_id, unnest(range((n_chars - 1) // 700 + 1)) AS chunk_index, n_chars FROM documents WHERE n_chars > 0), chunks AS (SELECT doc_id, chunk_index, chunk_index * 700 AS s, least(chunk_index * 700 + 900, n_chars) AS e FROM parts)"


@entered(f"WITH {_PAGES}, {_PARTS} SELECT c.doc_id, chunk_index, min(page_number) AS first_page, count(*) AS n_pages, min(CASE WHEN a <= s AND s < b THEN page_number END) AS page FROM chunks c JOIN spans p ON p.doc_id = c.doc_id AND s < b AND e > a GROUP BY c.doc_id, chunk_index")
def chunk_pages(spark, sf) -> DataFrame:
    """Spans of 900 characters every 700 met with pages of 1000 characters."""
    docs = table(spark, sf, "documents").where("n_chars > 0")
    cut = lambda step, width: docs.select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_chars") - 1) / step).cast("int"))).alias("k")).select("doc_id", "k", (F.col("k") * step).alias("char_start"), F.least(F.col("k") * step + width, F.col("n_chars").cast("int")).alias("char_end"))
    pages = cut(1000, 1000).select("doc_id", (F.col("k") + 1).alias("page_number"), F.array().cast("array<string>").alias("headings"), "char_start", "char_end")
    found = chunking.with_pages(cut(700, 900).withColumnRenamed("k", "chunk_index"), pages, "doc_id")
    return found.select("doc_id", "chunk_index", F.get("pages", F.lit(0)).alias("first_page"), F.size("pages").alias("n_pages"), "page")


@entered(f"WITH {KEYWORDS}, e AS (SELECT source, doc_id, term, weight, sum({TOKENS.format('term')}) OVER (PARTITION BY source ORDER BY weight DESC, term, doc_id) AS used FROM top) SELECT source, doc_id, term, weight FROM e WHERE used <= 2000")
def content_maps(spark, sf) -> DataFrame:
    words = _keywords(spark, sf).hint("merge").join(documents(spark, sf).select("doc_id", "source"), "doc_id")
    return requests.content_map(words, "source", "doc_id").select("source", "doc_id", "term", "weight")


# ---- citations and experiments


@entered(f"WITH {search._BM25}, c AS (SELECT query_id, query_id % 4 + 1 AS citation_index FROM asked) SELECT c.query_id, bm25.id, c.citation_index, CASE WHEN length(text) <= 220 THEN text ELSE substr(text, 1, 217) || '...' END AS quote, round(score, 6) AS score, 'title ' || bm25.id AS source_title FROM c JOIN bm25 ON bm25.query_id = c.query_id AND bm25.rank = c.citation_index AND rank <= 5 JOIN documents ON doc_id = bm25.id")
def citation_rows(spark, sf) -> DataFrame:
    found = grounding.evidence(retrieval.bm25_search(search.asked(spark, sf), k=5, index=search.index(spark, sf)), search.passages(spark, sf))
    titles = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("title "), "doc_id").alias("source_title"))
    return grounding.citation_rows(search._answers(spark, sf), found, titles).select("query_id", "id", "citation_index", "quote", F.round("score", 6).alias("score"), "source_title")


@entered("SELECT l_orderkey AS query_id, count(d.doc_id) AS kept, count(*) - count(d.doc_id) AS removed FROM lineitem LEFT JOIN documents d ON d.doc_id = l_partkey GROUP BY l_orderkey")
def removed_citations(spark, sf) -> DataFrame:
    cited = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("id"))
    return grounding.removed_counts(cited, table(spark, sf, "documents").select(F.col("doc_id").alias("id")))


@entered(rf"""WITH {search._PAIRS}, s AS (SELECT conv_id, len([x for x in {search._W.format('answer')}[1:5] if length(x) > 3 AND contains(lower(question), x)]) > 0 AS good FROM pairs)
    SELECT c.conv_id AS query_id, round(coalesce(avg(good::INT), 1.0), 6) AS support_rate, round(coalesce(avg((NOT good)::INT), 0.0), 6) AS wrong_rate FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id = c.conv_id GROUP BY c.conv_id""")
def citation_support_rates(spark, sf) -> DataFrame:
    """Every answer cites the question before it; conversations without an answer cite nothing."""
    said = table(spark, sf, "conversations")
    pairs = tables.question_pairs(said, "conv_id", "turn").select(F.col("conv_id").alias("query_id"), "answer", F.col("question").alias("content"))
    found = evaluation.citation_support(pairs, said.select(F.col("conv_id").alias("query_id")))
    return found.select("query_id", F.round("support_rate", 6).alias("support_rate"), F.round("wrong_rate", 6).alias("wrong_rate"))


@entered("SELECT user_id, string_agg(event_type || ':' || event_id, ',' ORDER BY event_type || ':' || event_id) AS metrics FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-02 00:00:00' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') GROUP BY user_id")
def run_listing(spark, sf) -> DataFrame:
    """Users are runs, their events of a day the metrics; only runs with a purchase."""
    events = table(spark, sf, "events")
    day = tables.in_time_range(events, "ts", F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-02").cast("timestamp"))
    kinds = events.where("event_type = 'purchase'").select("user_id")
    runs = day.select("user_id").distinct().join(kinds, "user_id", "left_semi")
    found = evaluation.runs_with_metrics(runs, day.select("user_id", F.concat_ws(":", "event_type", "event_id").alias("metric_type"), F.col("value").alias("metric_value")), "user_id")
    return found.select("user_id", F.array_join(F.transform("metrics", lambda m: m["metric_type"]), ",").alias("metrics"))


@entered("""WITH r AS (SELECT source, n_chars AS v, 1 AS a, 0 AS b FROM documents UNION ALL SELECT source, length(text) - length(replace(text, ' ', '')), 0, 1 FROM documents),
    s AS (SELECT source, v, sum(a) AS a, sum(b) AS b FROM r GROUP BY source, v),
    g AS (SELECT source, abs(sum(a) OVER (PARTITION BY source ORDER BY v) / sum(a) OVER (PARTITION BY source) - sum(b) OVER (PARTITION BY source ORDER BY v) / sum(b) OVER (PARTITION BY source)) AS gap FROM s)
    SELECT source, round(max(gap), 6) AS ks FROM g GROUP BY source""")
def distribution_gaps(spark, sf) -> DataFrame:
    pairs = documents(spark, sf).select("source", F.col("n_chars").cast("long").alias("a"), (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).cast("long").alias("b"))
    return evaluation.kolmogorov_smirnov(pairs, "source").withColumn("ks", F.round("ks", 6))


@entered("""WITH m AS (SELECT event_type AS metric_type, avg(value) FILTER (user_id % 2 = 0) AS a, avg(value) FILTER (user_id % 2 = 1) AS b, count(*) FILTER (user_id % 2 = 0) AS n_a, count(*) FILTER (user_id % 2 = 1) AS n_b,
        var_samp(value) FILTER (user_id % 2 = 0) AS va, var_samp(value) FILTER (user_id % 2 = 1) AS vb FROM events GROUP BY event_type)
    SELECT metric_type, n_a, n_b, round(b - a, 6) AS change, abs(b - a) > 1.96 * sqrt(va / n_a + vb / n_b) AS significant FROM m""")
def ab_tests(spark, sf) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("event_type").alias("metric_type"), F.col("value").alias("metric_value"), F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("variant"))
    return evaluation.ab_test(rows, "variant", "a", "b").select("metric_type", "n_a", "n_b", F.round("change", 6).alias("change"), "significant")


@entered("""WITH m AS (SELECT ts::DATE AS day, event_type AS metric_type, avg(value) AS mean, coalesce(var_samp(value) / count(value), 0) AS e FROM events GROUP BY ALL),
    b AS (SELECT *, lag(mean) OVER w AS before, lag(e) OVER w AS be FROM m WINDOW w AS (PARTITION BY metric_type ORDER BY day))
    SELECT day::VARCHAR AS day, metric_type, round(mean, 6) AS mean, round(before, 6) AS before FROM b WHERE mean < before - 1.96 * sqrt(e + be)""")
def metric_regressions(spark, sf) -> DataFrame:
    rows = table(spark, sf, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("metric_type"), F.col("value").alias("metric_value"))
    return evaluation.regressions(rows, "day").select(F.col("day").cast("string").alias("day"), "metric_type", F.round("mean", 6).alias("mean"), F.round("before", 6).alias("before"))


@entered(f"WITH {search._BM25} SELECT query_id, source, string_agg(rank, ',' ORDER BY rank) AS indices FROM bm25 JOIN documents ON doc_id = bm25.id WHERE rank <= 5 GROUP BY query_id, source")
def evidence_by_source(spark, sf) -> DataFrame:
    found = grounding.evidence(retrieval.bm25_search(search.asked(spark, sf), k=5, index=search.index(spark, sf)), search.passages(spark, sf))
    return grounding.by_source(found.hint("merge").join(search.passages(spark, sf).select("id", "scope"), "id")).select("query_id", F.col("scope").alias("source"), F.array_join("indices", ",").alias("indices"))


@entered("""WITH a AS (SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN '' WHEN item_id % 3 = 1 THEN text ELSE 'I don''t have enough information' END AS answer, text AS question, item_id % 5 AS n, CASE WHEN item_id % 2 = 0 THEN 'zh' END AS spoken FROM benchmark)
    SELECT query_id, CASE WHEN n = 0 OR answer = '' THEN CASE WHEN spoken = 'zh' OR regexp_matches(question, '[㐀-䶿一-鿿]') THEN '我没有足够的信息' ELSE 'I don''t have enough information' END ELSE answer END AS answer, NOT (n = 0 OR answer = '') AS cited FROM a""")
def final_answers(spark, sf) -> DataFrame:
    """Every second thread is in Chinese."""
    n = F.col("item_id") % 3
    spoken = F.when(F.col("item_id") % 2 == 0, "zh").alias("thread_language")
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.when(n == 0, "").when(n == 1, F.col("text")).otherwise(tx.UNKNOWN["en"]).alias("answer"), F.col("text").alias("question"), spoken)
    counts = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 5).alias("chunk_count"))
    return grounding.finalise(rows, counts).select("query_id", "answer", "cited")


@entered("""WITH v AS (SELECT event_type, value, ('0x' || substr(md5('11:' || event_id), 1, 12))::BIGINT AS n FROM events WHERE value IS NOT NULL),
    d AS (SELECT event_type, value, r, n, ((n % 1000003 * 48271 % 1000003) + r * 69621 % 1000003) % 1000003 AS m FROM v, (SELECT unnest(range(1, 201)) AS r)),
    u AS (SELECT event_type, value, r, ((m * m % 1000003 * m + n // 1000003) % 1000003)::DOUBLE / 1000003::DOUBLE AS u FROM d),
    w AS (SELECT event_type, value, r, (u >= 0.367879::DOUBLE)::INT + (u >= 0.735759::DOUBLE)::INT + (u >= 0.919699::DOUBLE)::INT + (u >= 0.981012::DOUBLE)::INT + (u >= 0.996340::DOUBLE)::INT AS w FROM u),
    m AS (SELECT event_type, r, coalesce(sum(w * value) / nullif(sum(w), 0), avg(value)) AS m FROM w GROUP BY event_type, r)
    SELECT event_type AS metric_type, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY event_type""")
def bootstrap_intervals(spark, sf) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("event_type").alias("metric_type"), F.col("value").alias("metric_value"), F.col("event_id").alias("key"))
    return evaluation.bootstrap(rows, 200).select("metric_type", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@entered("""WITH p AS (SELECT DISTINCT lower(array_to_string(regexp_extract_all(text, '[A-Za-z]+')[1:2], ' ')) AS phrase FROM benchmark)
    SELECT phrase, count(*) AS documents FROM p JOIN documents ON phrase <> '' AND contains(lower(text), phrase) GROUP BY phrase""")
def phrase_matches(spark, sf) -> DataFrame:
    """How many documents hold the first two words of a benchmark item; all phrases are met in one pass."""
    words = F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), 1, 2)
    wanted = table(spark, sf, "benchmark").select(F.array_join(words, " ").alias("phrase"))
    return requests.phrase_matches(documents(spark, sf), wanted, "doc_id", "text").groupBy("phrase").agg(F.count(F.lit(1)).alias("documents"))


@entered("""WITH m AS (SELECT event_type AS metric_type, round(avg(value), 6) AS metric_value, count(*) AS n, count(DISTINCT user_id) AS users, max(event_id) AS last FROM events GROUP BY event_type)
    SELECT metric_type, metric_value, n, users, last FROM m""")
def metric_metadata(spark, sf) -> DataFrame:
    """Means with what they were taken over, kept in one VARIANT column and read from it."""
    made = table(spark, sf, "events").groupBy(F.col("event_type").alias("metric_type")).agg(F.round(F.avg("value"), 6).alias("metric_value"), F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.max("event_id").alias("last"))
    return evaluation.with_metadata(made, "n", "users", "last").select("metric_type", "metric_value", *[F.variant_get("metadata", f"$.{c}", "bigint").alias(c) for c in ("n", "users", "last")])


@entered("""SELECT c_custkey::VARCHAR AS run_id, l_linestatus AS metric_type, round(sum(l_quantity), 2) AS metric_value, count(*) AS n
    FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate <= DATE '1996-12-31'
      AND c_custkey IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linestatus = 'O' AND o_orderdate >= DATE '1995-01-01' AND o_orderdate <= DATE '1996-12-31')
    GROUP BY c_custkey, l_linestatus""")
def metrics_export(spark, sf) -> DataFrame:
    """Customers are runs of the days of 1995 and 1996, their quantities by line status metrics; only those with an open line."""
    orders = table(spark, sf, "orders").where("o_orderdate BETWEEN DATE'1995-01-01' AND DATE'1996-12-31'")
    lines = table(spark, sf, "lineitem").join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").cast("string").alias("run_id"), F.col("l_linestatus").alias("metric_type"))
    metrics = evaluation.with_metadata(lines.agg(F.round(F.sum("l_quantity"), 2).alias("metric_value"), F.count(F.lit(1)).alias("n")), "n")
    runs = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("run_id"), F.col("c_nationkey").alias("notebook_id"), F.col("c_name").alias("query"), F.lit("completed").alias("status"), F.lit("1996-01-01").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("completed_at"))
    made = evaluation.metrics_export(runs, metrics, ["O"], F.lit("1995-01-01").cast("timestamp"))
    return made.select("run_id", "metric_type", "metric_value", F.get_json_object("metadata", "$.n").cast("long").alias("n"))
