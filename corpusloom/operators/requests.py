"""Whole requests: history, rewriting, retrieval, evidence, prompt; evaluation runs; verdicts and re-ranking."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.functions import text as tx
from corpusloom.operators import evaluation, grounding, retrieval, tables


def text_search(passages: DataFrame, wanted: Column, content: str = "content", title: str = "title") -> DataFrame:
    """Rows whose content or title holds a phrase, whatever its case; a blank phrase keeps all."""
    phrase = F.lower(F.trim(F.coalesce(wanted, F.lit(""))))
    return passages.where((phrase == "") | F.contains(F.lower(content), phrase) | F.coalesce(F.contains(F.lower(title), phrase), F.lit(False)))


#: Phrases that one automaton may hold; they go to the tasks with the function.
PHRASES = 200_000


def phrase_matches(rows: DataFrame, phrases: DataFrame, key: str, text: str, phrase: str = "phrase") -> DataFrame:
    """(key, phrase) wherever the text holds a phrase, whatever its case: what :func:`text_search` finds for each phrase.

    All phrases are met in one pass over a text by an Aho-Corasick automaton, in Arrow batches, where the rows lie. Blank phrases
    are left out; more than ``PHRASES`` different ones are an error.
    """
    lowered = F.lower(F.trim(F.col(phrase)))
    listed = [r[0] for r in phrases.where(lowered != "").select(lowered).distinct().limit(PHRASES + 1).collect()]
    if len(listed) > PHRASES:
        raise ValueError(f"more than {PHRASES} phrases")
    kind = rows.schema[key].dataType
    wanted = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        words = ahocorasick.Automaton()
        for one in listed:
            words.add_word(one, one)
        if listed:
            words.make_automaton()
        for batch in batches:
            at, found = [], []
            for k, value in enumerate(batch.column(1).to_pylist() if listed else []):
                seen = {p for _, p in words.iter(value)} if value else ()
                at += [k] * len(seen)
                found += sorted(seen)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())).cast(wanted), pa.array(found, pa.string())], [key, "phrase"])

    return rows.select(key, F.lower(F.col(text)).alias("_text")).mapInArrow(run, f"`{key}` {kind.simpleString()}, phrase string")


def history_context(messages: DataFrame, by: str, order: str, most: int = 1200, role: str = "role", text: str = "text") -> DataFrame:
    """The newest lines of each conversation that fit ``most`` characters, oldest first."""
    line = F.concat(F.col(role), F.lit(": "), tx.collapse(F.col(text)))
    rows = messages.where(F.trim(F.coalesce(text, F.lit(""))) != "").select(by, order, line.alias("line"))
    used = F.sum(F.length("line") + 1).over(Window.partitionBy(by).orderBy(F.desc(order)))
    kept = rows.withColumn("used", used).where(F.col("used") <= most)
    return kept.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "\n").alias("history"))


# The most characters of a rewrite's context and of a message in it, and its headings.
CONTEXT_CHARS, MESSAGE_CHARS, TURNS = 4000, 240, 4
TOPICS_HEADING, TURNS_HEADING = "Recent topics/entities: ", "Recent turns:"


def rewrite_context(messages: DataFrame, by: str, order: str, most: int = CONTEXT_CHARS, turns: int = TURNS, role: str = "role", text: str = "text") -> DataFrame:
    """(by, context) of each conversation, for rewriting its next question: topics, then the messages since the ``turns``-th last of the user.

    A longer message keeps its last ``MESSAGE_CHARS`` characters, dots included. A context of more than ``most`` characters keeps the
    last lines that fit. Blank messages don't count; a conversation of no others has no row.
    """
    spoken = messages.withColumn(role, F.coalesce(F.nullif(F.lower(F.trim(role)), F.lit("")), F.lit("unknown")))
    chosen = tables.last_user_turns(spoken, by, order, turns, role, text)
    said = tx.collapse(F.col(text))
    short = F.when(F.length(said) <= MESSAGE_CHARS, said).otherwise(F.concat(F.lit("..."), F.substring(said, -(MESSAGE_CHARS - 3), MESSAGE_CHARS - 3)))
    lines = chosen.select(by, F.lit(2).alias("part"), F.col(order).alias("_at"), F.concat(F.lit("- "), F.col(role), F.lit(": "), short).alias("line"))
    topics = tables.history_topics(chosen, by, order, text).groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "topic"))), lambda t: t["topic"]), ", ").alias("topics"))
    heads = lines.select(by).distinct().join(topics.hint("merge"), by, "left")
    named = F.array(F.struct(F.lit(0).alias("part"), F.concat(F.lit(TOPICS_HEADING), "topics").alias("line")), F.struct(F.lit(1).alias("part"), F.lit(TURNS_HEADING).alias("line")))
    every = heads.select(by, F.inline(named)).where("line IS NOT NULL").withColumn("_at", F.lit(None).cast(lines.schema["_at"].dataType)).unionByName(lines)
    back = Window.partitionBy(by).orderBy(F.desc("part"), F.desc("_at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("line") + 1
    kept = every.withColumns({"_used": F.sum(size).over(back), "_all": F.sum(size).over(Window.partitionBy(by))}).where((F.col("_all") - 1 <= most) | (F.col("_used") <= most))
    return kept.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "_at", "line"))), lambda x: x["line"]), "\n").alias("context"))


def parse_rewrite(raw: Column, fallback: Column | None = None) -> Column:
    """struct(query, searches, strategy) of a model's answer; the query is null where it can't be used.

    A JSON object counts, fenced or bare, under the usual names; a text that is none counts if it looks like a
    query. A strategy that isn't known becomes ``fallback``.
    """
    whole = F.trim(raw)
    fenced = F.trim(F.regexp_extract(whole, r"(?is)```(?:json)?\s*\n?(.*?)\n?```", 1))
    object_ = lambda c: F.when(c.startswith("{") & c.endswith("}") & F.get_json_object(c, "$").isNotNull(), c)
    found = F.coalesce(object_(whole), object_(fenced))
    named = F.coalesce(*[F.nullif(F.get_json_object(found, f"$.{k}"), F.lit("")) for k in ("standalone_query", "query", "rewritten_query")])
    query = tx.clean_query(F.when(found.isNotNull(), F.coalesce(named, F.lit(""))).otherwise(whole))
    best = F.when(tx.looks_like_query(query), query)
    listed = F.from_json(F.get_json_object(found, "$.search_queries"), "array<string>")
    said = F.lower(F.trim(F.get_json_object(found, "$.strategy")))
    strategy = F.when(said.isin(tx.STRATEGIES), said).otherwise(F.lit(None).cast("string") if fallback is None else fallback)
    return F.struct(best.alias("query"), search_queries(listed, best).alias("searches"), strategy.alias("strategy"))


def search_queries(listed: Column, standalone: Column, most: int = 3) -> Column:
    """Cleaned queries, each once, the standalone one if there are none."""
    clean = F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda q: tx.clean_query(q)), lambda q: tx.looks_like_query(q))
    return tx.ordered_distinct(F.when(F.size(clean) > 0, clean).otherwise(F.array(standalone)), most)


def apply_rewrites(requests: DataFrame, outputs: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Requests (request_id, query, has_history) with their strategy, final query and searches.

    A model's output (request_id, raw) counts only where the gate asks for a rewrite of an ``allowed`` strategy (all if not given),
    it can be parsed, its query holds no code fence, and query and searches together keep the protected terms. Every
    request whose output doesn't count is its own search, with strategy no_rewrite. ``rewritten`` is whether the query that
    is used is another one.
    """
    gate = tx.rewrite_strategy(F.col("query"), F.col("has_history"))
    gate = F.when(gate.isin(allowed if allowed is not None else tx.STRATEGIES), gate).otherwise("no_rewrite")
    parsed = outputs.select("request_id", parse_rewrite(F.col("raw")).alias("r"))
    joined = requests.withColumn("strategy", gate).join(parsed, "request_id", "left")
    plain = tx.collapse(F.col("query"))
    fenced = F.contains("r.query", F.lit("```")) | F.contains("r.query", F.lit("~~~"))
    said = F.concat_ws(" ", "r.query", "r.searches")
    good = F.coalesce((F.col("strategy") != "no_rewrite") & F.col("r.query").isNotNull() & ~fenced & tx.keeps_terms(said, tx.protected_terms(F.col("query"))), F.lit(False))
    final = F.when(good, F.col("r.query")).otherwise(plain)
    return joined.select(*requests.columns, F.when(good, F.coalesce("r.strategy", "strategy")).otherwise("no_rewrite").alias("strategy"), final.alias("final_query"),
                         F.when(good, F.col("r.searches")).otherwise(F.array(plain)).alias("searches"), (F.lower(final) != F.lower(plain)).alias("rewritten"))


def prepare_answers(requests: DataFrame, passages: DataFrame, k: int = 5, index: retrieval.Index | None = None) -> DataFrame:
    """Evidence of each request: its searches retrieved, merged, numbered (query_id is the request).

    Passages (scope, id, text) with an ``embedding`` are searched by hybrid search, where the requests' searches
    are embedded likewise; others by BM25.
    """
    each = requests.select("request_id", "scope", F.posexplode("searches").alias("n", "query")).withColumn("query_id", F.concat_ws("#", "request_id", "n"))
    asked = each.select("query_id", "scope", "query")
    if "embedding" in passages.columns:
        found = retrieval.hybrid_search(retrieval.embed(asked, "query"), passages, 2 * k, index=index)
    else:
        found = retrieval.bm25_search(asked, passages, 2 * k, index=index)
    merged = retrieval.merge_queries(found.join(each.select("query_id", "request_id").hint("merge"), "query_id"), k)
    return grounding.evidence(merged.select(F.col("request_id").alias("query_id"), "rank", "id", "score"), passages)


def evaluation_run(queries: DataFrame, passages: DataFrame, truth: DataFrame, k: int = 10, index: retrieval.Index | None = None) -> DataFrame:
    """(query_id, metric_type, metric_value) of a retrieval run: hybrid search where there are embeddings, else BM25."""
    if "embedding" in queries.columns and "embedding" in passages.columns:
        ranked = retrieval.hybrid_search(queries, passages, k, index=index)
    else:
        ranked = retrieval.bm25_search(queries, passages, k, index=index)
    wide = evaluation.retrieval_metrics(ranked, truth, k).withColumn("hit", F.col("hit").cast("double"))
    return evaluation.long_metrics(wide, "query_id", ["recall", "precision", "hit", "ndcg", "reciprocal_rank"])


def record_run(runs: DataFrame, metrics: DataFrame, made: DataFrame, key: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """Runs with their status, and the metric table with the rows of these runs replaced by ``made``.

    A run without any new row has failed and says so; its old rows go too.
    """
    have = made.select(key).distinct().withColumn("_made", F.lit(True))
    done = F.coalesce("_made", F.lit(False))
    marked = runs.drop("status", "error_message").join(have, key, "left").withColumns({"status": F.when(done, "completed").otherwise("failed"), "error_message": F.when(~done, "no truth to evaluate against")}).drop("_made")
    return marked, metrics.join(runs.select(key).distinct(), key, "left_anti").unionByName(made)


def verdict_rates(verdicts: DataFrame, by: str, verdict: str) -> DataFrame:
    """Share of each verdict among a group's."""
    return verdicts.groupBy(by, verdict).agg(F.count(F.lit(1)).alias("n")).withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def rerank(ranked: DataFrame, scores: DataFrame, k: int = 10) -> DataFrame:
    """Candidates (query_id, id, score) ordered anew by given scores; unscored ones come after, as they were."""
    joined = ranked.drop("rank").join(scores.select("query_id", "id", F.col("score").alias("new")), ["query_id", "id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.col("new").desc_nulls_last(), F.desc("score"), "id")
    return joined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def within_budget(rows: DataFrame, by: str, order: str, tokens: str, budget: int) -> DataFrame:
    """Rows in order while they fit; one that doesn't is passed over, later ones may still fit.

    Rows larger than the whole budget are left out first. The others are sorted inside the partitions of their
    groups and streamed: a task holds one running sum, never a group.
    """
    names, kinds = [by, order, tokens], dict(rows.dtypes)
    fits = rows.where(F.col(tokens) <= budget)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used = None, None
        for batch in batches:
            keep = []
            for group, size in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if used is None or group != now:
                    now, used = group, 0
                keep.append(used + size <= budget)
                used += size if keep[-1] else 0
            yield batch.filter(pa.array(keep, pa.bool_()))

    ordered = fits.select(*names).repartition(by).sortWithinPartitions(by, order)
    kept = ordered.mapInArrow(take, ", ".join(f"`{c}` {kinds[c]}" for c in names)).select(by, order)
    return fits.hint("merge").join(kept, [by, order], "left_semi")


def priority(index: Column, count: Column) -> Column:
    """Order in which chunks are offered to a budget: first, last, middle, quarters, then the rest."""
    last = count - 1
    spots = [F.lit(0), last, F.floor(count / 2), F.floor(count / 4), F.floor(3 * count / 4)]
    place = F.coalesce(*[F.when(index == s, F.lit(n)) for n, s in enumerate(spots)], F.lit(5))
    return place * F.lit(1_000_000) + index


def content_map(words: DataFrame, scope: str, source: str, budget: int = 2000) -> DataFrame:
    """Edges between a scope's themes and its sources, heaviest first, within a token budget."""
    edges = words.select(scope, source, "term", "weight", tx.token_estimate(F.col("term")).alias("tokens"))
    used = F.sum("tokens").over(Window.partitionBy(scope).orderBy(F.desc("weight"), "term", source))
    return edges.withColumn("used", used).where(F.col("used") <= budget).drop("used", "tokens")


_KEYS = ("overview", "themes", "assertions", "keywords", "passages")


def _objects(text: str | None) -> list[str]:
    """JSON objects that start anywhere in a text, the best first: with an overview, more known keys, longer, earlier."""
    import json

    found, decoder, text = [], json.JSONDecoder(), text or ""
    at = text.find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
            found.append((bool(value.get("overview")), sum(k in value for k in _KEYS), end - at, -at, text[at:end]))
        except ValueError:
            pass
        at = text.find("{", at + 1)
    return [f[-1] for f in sorted(found, reverse=True)]


def recover_json(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``object``, the best JSON object inside a text that a model wrote; null if there is none."""

    @F.arrow_udf("string")
    def best(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([next(iter(_objects(t)), None) for t in batch.to_pylist()], pa.string())

    return rows.withColumn("object", best(F.col(text)))
