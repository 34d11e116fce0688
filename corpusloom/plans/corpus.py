"""Queries that prepare and profile the corpus: pages, chunks, keywords, coverage, query gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import profiles, requests, tables
from corpusloom.operators.chunking import chunk
from corpusloom.plans.base import Query, documents, register, stored, table
from corpusloom.plans.tables import TOKENS
from corpusloom.sources import web

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def entered(sql: str | None = None):
    return register(QUERIES, ORACLE_SQL, sql)


def word_list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


# references count without their semicolon too, as pages cut off in one show: these four names are of those that HTML so allows
_HTML = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gis'),
 '<style[^>]*>.*?</style>', '', 'gis'), '<[^>]+>', ' ', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))"""


@entered(f"SELECT page_id, md5({_HTML}) AS text_md5, length({_HTML}) AS n FROM pages")
def html_text(spark, sf) -> DataFrame:
    found = table(spark, sf, "pages").select("page_id", web.html_text(F.col("html")).alias("t"))
    return found.select("page_id", F.md5("t").alias("text_md5"), F.length("t").alias("n"))


@entered(r"SELECT page_id, nullif(trim(regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1)), '') AS title FROM pages")
def html_title(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", web.html_title(F.col("html")).alias("title"))


@entered(r"""SELECT doc_id, coalesce(array_to_string([l for l in [trim(x) for x in string_split(text, chr(10))] if length(l) > 0 AND length(l) < 100 AND NOT regexp_matches(l, '[.,;:]$') AND len(regexp_split_to_array(l, '\s+')) <= 10][1:10], '|'), '') AS headings FROM documents""")
def heading_lines(spark, sf) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.array_join(web.heading_lines(F.col("text")), "|").alias("headings"))


@entered(r"SELECT doc_id, [l for l in [trim(x) for x in string_split(text, chr(10))] if l <> '' AND length(l) < 200][1] AS title FROM documents")
def text_title(spark, sf) -> DataFrame:
    return documents(spark, sf).select("doc_id", web.text_title(F.col("text")).alias("title"))


@entered(r"SELECT doc_id, sha256(array_to_string([trim(regexp_replace(x, '\s+', ' ', 'g')) for x in string_split(text, chr(10))], chr(10))) AS hash FROM documents")
def normalised_text(spark, sf) -> DataFrame:
    return documents(spark, sf).select("doc_id", tx.content_hash(tx.normalise_text(F.col("text"))).alias("hash"))


@entered(r"""SELECT page_id, nullif(regexp_extract(u, '(?:youtube\.com/watch\?(?:.*&)?v=)([A-Za-z0-9_-]{11})', 1), '') AS video, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host
              FROM (SELECT page_id, url, 'https://www.youtube.com/watch?t=1&v=' || substr(md5(url), 1, 11) AS u FROM pages)""")
def url_ids(spark, sf) -> DataFrame:
    made = F.concat(F.lit("https://www.youtube.com/watch?t=1&v="), F.substring(F.md5("url"), 1, 11))
    return table(spark, sf, "pages").select("page_id", web.video_id(made).alias("video"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))


@entered("""SELECT source, doc_id, coalesce(sum(CASE WHEN trim(text) = '' THEN 0 ELSE length(text) + 1 END) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM documents""")
def page_offsets(spark, sf) -> DataFrame:
    return web.page_offsets(documents(spark, sf), "source", "doc_id", "text").select("source", "doc_id", "char_start")


@entered("SELECT CASE WHEN kind = 'docx' AND n_chars > 10485760 OR kind = 'text' AND n_chars > 10485760 THEN 'too large' WHEN kind = 'exe' THEN 'type not allowed' END AS error, count(*) AS n FROM (SELECT CASE doc_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'exe' ELSE 'docx' END AS kind, n_chars * 2000 AS n_chars FROM documents) GROUP BY 1")
def upload_rules(spark, sf) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 0, "text").when(F.col("doc_id") % 3 == 1, "exe").otherwise("docx")
    return documents(spark, sf).select(web.upload_error(kind, F.col("n_chars") * 2000).alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@entered(f"SELECT doc_id, {TOKENS.format('text')} AS tokens FROM documents")
def token_estimates(spark, sf) -> DataFrame:
    return documents(spark, sf).select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


CHUNKS = rf"""
WITH RECURSIVE d AS (SELECT doc_id AS id, text, length(regexp_extract(text, '^\s*')) AS lead, regexp_extract_all(regexp_replace(text, '^\s+|\s+$', '', 'g'), '(?s).+?(?:\n+|[。！？；]\s*|[.!?;](?:\s+|\z)|\z)') AS raw
    FROM documents WHERE regexp_matches(text, '\S')),
r AS (SELECT id, unnest(raw) AS p0, unnest(range(len(raw))) AS k0 FROM d),
w AS (SELECT id, k0, p0, {TOKENS.format('p0')} AS t0 FROM r),
c AS (SELECT id, k0, 0 AS j, p0 AS p FROM w WHERE t0 <= 800 UNION ALL
      SELECT id, k0, j, substr(p0, j * 3200 + 1, 3200) AS p FROM (SELECT id, k0, p0, unnest(range((length(p0) - 1) // 3200 + 1)) AS j FROM w WHERE t0 > 800)),
o AS (SELECT id, p, k0, j, coalesce(sum(length(p)) OVER (PARTITION BY id ORDER BY k0, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM c),
z AS (SELECT o.id, row_number() OVER (PARTITION BY o.id ORDER BY k0, j) - 1 AS i, (s + lead)::BIGINT AS s, (s + lead + length(p))::BIGINT AS e, {TOKENS.format('p')} AS t FROM o JOIN d ON o.id = d.id WHERE regexp_matches(p, '\S')),
q AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
        coalesce(max(CASE WHEN t > 75 THEN i END) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS big FROM z),
b AS (SELECT x.id, x.i, coalesce(min(y.i), x.i) AS back FROM q x LEFT JOIN q y ON y.id = x.id AND y.i < x.i AND y.i >= x.i - 75 AND y.i > x.big
        AND x.before - (y.before + y.t) < 75 AND x.before + x.t - y.before <= 800 GROUP BY x.id, x.i),
g AS (SELECT x.id, x.i AS a, min(y.i) AS b FROM q x LEFT JOIN q y ON y.id = x.id AND y.i > x.i AND y.before + y.t - x.before > 800 GROUP BY x.id, x.i),
f AS (SELECT id, a, b, 0 AS k FROM g WHERE a = 0 UNION ALL SELECT g.id, g.a, g.b, k + 1 FROM f JOIN b ON b.id = f.id AND b.i = f.b JOIN g ON g.id = b.id AND g.a = b.back),
chunks AS (SELECT f.id, f.k AS chunk_index, CASE WHEN f.k = 0 THEN 0 ELSE x.s END::BIGINT AS char_start, CASE WHEN f.b IS NULL THEN length(d.text) ELSE y.e END::BIGINT AS char_end,
             substr(d.text, CASE WHEN f.k = 0 THEN 1 ELSE x.s + 1 END, CASE WHEN f.b IS NULL THEN length(d.text) ELSE y.e END - CASE WHEN f.k = 0 THEN 0 ELSE x.s END) AS content
           FROM f JOIN d ON d.id = f.id JOIN q x ON x.id = f.id AND x.i = f.a LEFT JOIN q y ON y.id = f.id AND y.i = f.b - 1)
"""


@entered(CHUNKS + f"SELECT id AS doc_id, chunk_index, char_start, char_end, {TOKENS.format('content')} AS token_count, md5(content) AS body FROM chunks")
def chunk_documents(spark, sf) -> DataFrame:
    found = chunk(documents(spark, sf))
    return found.select(F.col("id").alias("doc_id"), "chunk_index", "char_start", "char_end", "token_count", F.md5("content").alias("body"))


@entered(CHUNKS + f""", s AS (SELECT *, coalesce(max(char_end) OVER (PARTITION BY id ORDER BY char_start, char_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), char_start) AS m, {TOKENS.format('content')} AS t FROM chunks)
    SELECT id AS doc_id, count(*) AS chunk_count, sum(t)::BIGINT AS tokens, max(char_end) AS char_length, sum(greatest(char_end - greatest(char_start, m), 0))::BIGINT AS covered,
           round_even(least(1.0, sum(greatest(char_end - greatest(char_start, m), 0)) / max(char_end)), 4) AS coverage_ratio FROM s GROUP BY id""")
def source_metrics(spark, sf) -> DataFrame:
    return profiles.content_metrics(chunk(documents(spark, sf))).withColumnRenamed("id", "doc_id")


@entered(CHUNKS + "SELECT id AS doc_id, chunk_index FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM chunks) WHERE chunk_index IN (0, n // 2, n - 1)")
def representative_chunks(spark, sf) -> DataFrame:
    return profiles.representative(chunk(documents(spark, sf))).select(F.col("id").alias("doc_id"), "chunk_index")


_HEADINGS = r"[l for l in [trim(regexp_replace(x, '\s+', ' ', 'g')) for x in string_split(text, chr(10))] if length(l) > 0 AND length(l) < 100 AND NOT regexp_matches(l, '[.,;:]$') AND len(string_split(l, ' ')) <= 10]"
KEYWORDS = rf"""t AS (SELECT doc_id, source, unnest(regexp_extract_all(text, '{profiles.LATIN_TERM}')) AS label, 1.0 AS w FROM documents
    UNION ALL SELECT doc_id, source, unnest([h for h in regexp_extract_all(text, '{profiles.HAN_TERM}') if h NOT IN {word_list(profiles.CHINESE_STOPWORDS)}]), 0.8 FROM documents),
k AS (SELECT doc_id, source, term, round(sum(w)::DOUBLE, 3) AS weight FROM (SELECT doc_id, source, lower(label) AS term, w FROM t WHERE lower(label) NOT IN {word_list(profiles.KEYWORD_STOPWORDS)}
    UNION ALL SELECT doc_id, source, lower(unnest({_HEADINGS}[1:3])), 3.0 FROM documents) GROUP BY doc_id, source, term),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank FROM k) WHERE rank <= 15)"""


def _keywords(spark, sf) -> DataFrame:
    rows = documents(spark, sf).select("doc_id", F.lit(0).alias("chunk_index"), F.col("text").alias("content"), web.heading_lines(F.col("text")).alias("headings"))
    return profiles.keywords(rows, "doc_id", headings="headings")


@entered(f"WITH {KEYWORDS} SELECT doc_id, rank, term, weight FROM top")
def source_keywords(spark, sf) -> DataFrame:
    return _keywords(spark, sf).select("doc_id", "rank", "term", "weight")


@entered(f"WITH {KEYWORDS} SELECT source, rank, term, weight, sources FROM (SELECT source, term, sum(weight) AS weight, count(*) AS sources, row_number() OVER (PARTITION BY source ORDER BY sum(weight) DESC, term) AS rank FROM top GROUP BY source, term) WHERE rank <= 10")
def key_topics(spark, sf) -> DataFrame:
    words = _keywords(spark, sf).hint("merge").join(documents(spark, sf).select("doc_id", "source"), "doc_id")
    return profiles.key_topics(words, "source").select("source", "rank", "term", "weight", "sources")


@entered(f"""WITH {KEYWORDS}, s AS (SELECT source, doc_id, list_sort(list_distinct(list(term))) AS terms FROM top GROUP BY source, doc_id),
    c AS (SELECT source, terms, min(doc_id) AS doc_id, count(*) AS n FROM s GROUP BY source, terms)
    SELECT x.source, x.doc_id AS a, y.doc_id AS b, x.n AS sources_a, y.n AS sources_b, len(list_intersect(x.terms, y.terms)) AS shared,
           round(len(list_intersect(x.terms, y.terms)) / (len(x.terms) + len(y.terms) - len(list_intersect(x.terms, y.terms))), 6) AS overlap
    FROM c x JOIN c y ON x.source = y.source AND x.doc_id < y.doc_id WHERE len(list_intersect(x.terms, y.terms)) > 0""")
def source_overlap(spark, sf) -> DataFrame:
    words = lambda: _keywords(spark, sf).hint("merge").join(documents(spark, sf).select("doc_id", "source"), "doc_id").select("source", "doc_id", "term")
    made = profiles.source_overlap(_kept(spark, sf, "source_terms", words), "source", "doc_id")
    # a share of two small whole numbers is never half way between two of six places, so this is its rounding, without a decimal for each pair
    return made.withColumn("overlap", F.floor(F.col("overlap") * 1000000 + 0.5) / 1000000)


@entered(r"""SELECT doc_id, CASE WHEN length(f) <= 220 THEN f ELSE rtrim(substr(f, 1, 217)) || '...' END AS excerpt, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview
    FROM (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents)""")
def excerpts(spark, sf) -> DataFrame:
    return documents(spark, sf).select("doc_id", tx.excerpt(F.col("text")).alias("excerpt"), tx.preview(F.col("text")).alias("preview"))


@entered(r"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[㐀-䶿一-鿿]') THEN 'zh' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'same_as_user' END AS language FROM conversations")
def message_language(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.language(F.col("text")).alias("language"))


_STOPS = word_list([*tx.STOPWORDS, *tx.GENERIC_TERMS])
_GATED = rf"""g AS (SELECT conv_id, turn, turn > 1 AS history, q, len(g) AS n, len([t for t in g if t NOT IN {_STOPS} AND length(t) >= 3]) AS terms,
        len(list_distinct([lower(trim(t)) for t in list_concat(regexp_extract_all(q, '`([^`]+)`', 1), [t for t in regexp_extract_all(q, '{tx.TOPIC_TOKEN}') if lower(t) NOT IN {_STOPS}]) if trim(t) <> ''])) AS protected,
        regexp_matches(q, '{tx.CODE_OR_ERROR}') AS code, regexp_matches(q, '{tx.PRONOUN}') AS pronoun, regexp_matches(q, '{tx.FOLLOW_UP}') AS follow, regexp_matches(q, '{tx.SUMMARY}') AS summary,
        regexp_matches(q, '{tx.COMPARISON}') AS comparison, regexp_matches(q, '{tx.EVIDENCE}') AS evidence
    FROM (SELECT *, regexp_extract_all(lower(q), '{tx.GATE_TOKEN}') AS g FROM (SELECT conv_id, turn, coalesce(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS q FROM conversations WHERE role = 'user'))),
f AS (SELECT *, CASE WHEN q = '' THEN false WHEN code THEN true WHEN pronoun OR follow OR summary OR comparison OR evidence THEN false ELSE (protected > 0 AND n >= 3) OR (terms >= 2 AND n >= 6) END AS friendly,
        CASE WHEN history THEN 'standalone_expansion' ELSE 'keyword_enrichment' END AS expand FROM g)"""


@entered(rf"""WITH {_GATED} SELECT conv_id, turn, protected, CASE WHEN q = '' OR code THEN 'no_rewrite' WHEN history AND pronoun THEN 'reference_resolution' WHEN history AND follow THEN 'standalone_expansion' WHEN summary THEN expand
    WHEN comparison OR evidence THEN CASE WHEN terms > 0 THEN 'keyword_enrichment' ELSE 'standalone_expansion' END WHEN n <= 6 AND NOT friendly THEN expand WHEN history AND n <= 4 THEN 'standalone_expansion' ELSE 'no_rewrite' END AS strategy FROM f""")
def rewrite_strategies(spark, sf) -> DataFrame:
    asked = table(spark, sf, "conversations").where("role = 'user'")
    return asked.select("conv_id", "turn", tx.rewrite_strategy(F.col("text"), F.col("turn") > 1).alias("strategy"), F.size(tx.protected_terms(F.col("text"))).alias("protected"))


@entered(rf"""SELECT conv_id, turn, len([t for t in regexp_extract_all(lower(text), '[A-Za-z0-9_./:-]+') if t NOT IN {word_list(tx.STOPWORDS)} AND t NOT IN {word_list(tx.GENERIC_TERMS)} AND length(t) >= 3]) AS terms FROM conversations WHERE role = 'user'""")
def meaningful_terms(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.size(tx.meaningful_terms(F.col("text"))).alias("terms"))


_TOPICS = rf"""m AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM chosen),
    l AS (SELECT conv_id, turn, [x for x in regexp_extract_all(t, '{tx.TOPIC_TOKEN}') if lower(x) NOT IN {_STOPS} AND regexp_matches(x, '[A-Z0-9_./:-]')] AS names, [lower(x) for x in regexp_extract_all(t, '{tx.WORD_TOKEN}') if lower(x) NOT IN {_STOPS}] AS words FROM m),
    e AS (SELECT conv_id, turn, 0 AS kind, unnest(names) AS label, unnest(range(len(names))) AS pos FROM l
          UNION ALL SELECT conv_id, turn, 1, unnest([words[i] || ' ' || words[i + 1] for i in range(1, len(words))]), unnest(range(greatest(len(words) - 1, 0))) FROM l UNION ALL SELECT conv_id, turn, 2, unnest(words), unnest(range(len(words))) FROM l),
    c AS (SELECT conv_id, lower(label) AS low, kind, count(*) AS n, min(turn * 1000000 + pos) AS first, arg_min(label, turn * 1000000 + pos) AS topic FROM e GROUP BY conv_id, lower(label), kind),
    o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, low ORDER BY kind) AS p FROM c) WHERE p = 1),
    topics AS (SELECT conv_id, rank, topic, kind, n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY kind, CASE WHEN kind > 0 THEN -n ELSE 0 END, first) AS rank FROM o) WHERE rank <= 6)"""


@entered(f"WITH chosen AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), {_TOPICS} SELECT * FROM topics")
def conversation_topics(spark, sf) -> DataFrame:
    return tables.history_topics(table(spark, sf, "conversations").where("role = 'user'"), "conv_id", "turn")


@entered(rf"""WITH spoken AS (SELECT conv_id, turn, coalesce(nullif(lower(trim(role)), ''), 'unknown') AS role, text FROM conversations WHERE trim(coalesce(text, '')) <> ''),
    chosen AS (SELECT * FROM (SELECT *, coalesce(count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM spoken) WHERE u < 4), {_TOPICS},
    f AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM chosen),
    x AS (SELECT conv_id, 2 AS part, turn, '- ' || role || ': ' || CASE WHEN length(t) <= 240 THEN t ELSE '...' || right(t, 237) END AS line FROM f
          UNION ALL SELECT conv_id, 0, NULL, 'Recent topics/entities: ' || string_agg(topic, ', ' ORDER BY rank) FROM topics GROUP BY conv_id UNION ALL SELECT DISTINCT conv_id, 1, NULL::INT, 'Recent turns:' FROM f),
    s AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY part DESC, turn DESC) AS used, sum(length(line) + 1) OVER (PARTITION BY conv_id) AS every FROM x)
    SELECT conv_id, md5(string_agg(line, chr(10) ORDER BY part, turn)) AS context, count(*) AS lines FROM s WHERE every - 1 <= 700 OR used <= 700 GROUP BY conv_id""")
def rewrite_contexts(spark, sf) -> DataFrame:
    """Contexts of at most 700 characters, so that long ones are cut."""
    made = requests.rewrite_context(table(spark, sf, "conversations"), "conv_id", "turn", 700)
    return made.select("conv_id", F.md5("context").alias("context"), F.size(F.split("context", "\n")).cast("long").alias("lines"))


def _kept(spark, sf, name: str, made) -> DataFrame:
    """What ``made()`` gives, written at its first use in an application and read by all who need it."""
    return spark.read.parquet(stored(spark, sf, name, lambda to: made().write.parquet(to)))


def _headed(spark, sf) -> DataFrame:
    """Chunks with the first heading lines of their content."""
    made = lambda: chunk(documents(spark, sf)).withColumn("headings", F.slice(web.heading_lines(F.col("content")), 1, 3))
    return _kept(spark, sf, "chunks", made)


def _digested(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Chunks, outline, keywords and digests of the documents, each stored, so that the text is chunked once."""
    chunks = _headed(spark, sf)
    sections = _kept(spark, sf, "sections", lambda: profiles.outline(chunks, "id", "headings"))
    terms = _kept(spark, sf, "chunk_terms", lambda: profiles.keywords(chunks, headings="headings"))
    docs = documents(spark, sf).select(F.col("doc_id").alias("id"), "text")
    return chunks, sections, terms, _kept(spark, sf, "digests", lambda: profiles.digests(docs, chunks, sections, terms))


@entered()
def source_digests(spark, sf) -> DataFrame:
    return _digested(spark, sf)[3]


@entered()
def source_outlines(spark, sf) -> DataFrame:
    return profiles.outline(_headed(spark, sf), "id", "headings")


@entered()
def source_snapshots(spark, sf) -> DataFrame:
    chunks, sections, terms, digested = _digested(spark, sf)
    docs = documents(spark, sf).select(F.col("doc_id").alias("id"), "text")
    return profiles.snapshots(docs, digested, profiles.content_metrics(chunks, sections=sections, terms=terms))


@entered()
def snapshot_summaries(spark, sf) -> DataFrame:
    _, _, terms, digested = _digested(spark, sf)
    listed = terms.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("keywords"))
    return profiles.snapshot_summaries(digested.join(listed.hint("merge"), "id", "left"))


@entered()
def normalised_digests(spark, sf) -> DataFrame:
    """Drafts whose passages partly point to chunks that don't exist, and every third without any words."""
    chunks, _, terms, digested = _digested(spark, sf)
    listed = terms.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label", "weight", "chunks"))), lambda x: F.struct(x["label"].alias("term"), x["weight"].alias("weight"), x["chunks"].alias("chunks"))).alias("keywords"))
    full = digested.join(listed.hint("merge"), "id")
    bare = F.col("id") % 3 == 0
    moved = F.transform("passages", lambda p: F.struct((p["chunk_index"] * 2).alias("chunk_index"), p["text"].alias("text")))
    drafts = full.select("id", F.when(bare, "").otherwise(F.col("overview")).alias("overview"), "themes", "assertions", moved.alias("passages"), "gaps", F.when(bare, F.slice("keywords", 1, 0)).otherwise(F.col("keywords")).alias("keywords"))
    return profiles.normalised_digests(drafts, chunks, full)


_V5 = "substr({0}, 1, 12) || '5' || substr({0}, 14, 3) || substr('89ab', ('0x' || substr({0}, 17, 1))::INT % 4 + 1, 1) || substr({0}, 18, 15)"


@entered(CHUNKS + f""", n AS (SELECT id, chunk_index, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(id::VARCHAR)) AS p, chunk_index || ':' || char_start || ':' || char_end || ':' || substr(sha1(content), 1, 12) AS name FROM chunks),
    h AS (SELECT id, chunk_index, sha1(unhex({_V5.format('p')}) || encode(name)) AS h FROM n), u AS (SELECT id, chunk_index, {_V5.format('h')} AS u FROM h)
    SELECT id, chunk_index, substr(u, 1, 8) || '-' || substr(u, 9, 4) || '-' || substr(u, 13, 4) || '-' || substr(u, 17, 4) || '-' || substr(u, 21, 12) AS chunk_id FROM u""")
def stable_chunk_ids(spark, sf) -> DataFrame:
    made = chunk(documents(spark, sf))
    return made.select("id", "chunk_index", tx.stable_chunk_id(tx.named_uuid(F.col("id")), F.col("chunk_index"), F.col("char_start"), F.col("char_end"), F.col("content")).alias("chunk_id"))
