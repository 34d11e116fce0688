"""Per-source profiles: coverage, keywords, outlines, digests, overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import bind, collapse, content_hash, excerpt, ordered_distinct, slug, snapshot_sentences, trim_to_tokens
from corpusloom.operators.retrieval import with_scope

# Term patterns, words that are no keywords, and the limits of a snapshot.
LATIN_TERM = r"[A-Za-z][A-Za-z0-9_.:/-]{2,}"
HAN_TERM = "[一-鿿]{2,8}"
KEYWORD_STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "into", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with"]
CHINESE_STOPWORDS = ["我们", "你们", "他们", "以及", "这个", "那个", "这里", "那里", "因为", "所以", "如果", "但是", "然后"]
THEMES, ASSERTIONS, PASSAGES, KEYWORDS, OVERVIEW_TOKENS = 8, 5, 3, 15, 120
SCHEMA_VERSION = "1.0"
#: Classes of a block that meets others of its scope, about, and pairs of classes that are looked at in one go.
MEETING, PAIRS = 8192, 1 << 18
NO_OUTLINE = "No explicit heading structure detected in the source."


def _fresh(spans: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Spans with ``fresh``, the length that those before them in their key don't cover."""
    before = F.max(end).over(Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("fresh", F.greatest(F.col(end) - F.greatest(F.col(start), F.coalesce(before, F.col(start))), F.lit(0)))


def merged_length(spans: DataFrame, key: str) -> DataFrame:
    """Length covered by the union of (start, end) spans of each key."""
    return _fresh(spans, key).groupBy(key).agg(F.sum("fresh").alias("covered"))


def coverage(covered: Column, length: Column) -> Column:
    return F.when(length > 0, F.bround(F.least(F.lit(1.0), covered / length), 4)).otherwise(0.0)


def _among(term: Column, words: list[str]) -> Column:
    return F.array_contains(F.array(*[F.lit(w) for w in words]), term)


def keywords(chunks: DataFrame, key: str = "id", text: str = "content", most: int = KEYWORDS, headings: str | None = None, depth: int = 3) -> DataFrame:
    """(key, rank, term, label, weight, chunks): the weightiest terms of each source.

    A chunk's first ``depth`` headings weigh 3.0, Latin terms 1.0, Han runs 0.8. Terms are one whatever their case;
    the label is the first form seen, ``chunks`` the first three chunks that have the term. Ties go by the term.
    """
    weighed = lambda items, w: F.transform(items, lambda t: F.struct(t.alias("label"), F.lit(w).alias("w")))
    latin = F.filter(F.regexp_extract_all(F.col(text), F.lit(LATIN_TERM), F.lit(0)), lambda t: ~_among(F.lower(t), KEYWORD_STOPWORDS))
    han = F.filter(F.regexp_extract_all(F.col(text), F.lit(HAN_TERM), F.lit(0)), lambda t: ~_among(t, CHINESE_STOPWORDS))
    lists = [weighed(latin, 1.0), weighed(han, 0.8)]
    if headings is not None:
        lists.insert(0, weighed(F.filter(F.transform(F.slice(F.coalesce(headings, F.array().cast("array<string>")), 1, depth), collapse), lambda t: t != ""), 3.0))
    # a source's text moves once; its terms, many times as large, are then counted and ranked where they lie
    placed = chunks.repartition(key)
    each = placed.select(key, "chunk_index", F.posexplode(F.concat(*lists)).alias("pos", "_t")).select(key, "chunk_index", "pos", "_t.*")
    # counted by hash as they are written; only different forms are sorted
    forms = each.groupBy(key, "chunk_index", "label").agg(F.sum("w").alias("w"), F.min("pos").alias("pos"))
    by_chunk = forms.groupBy(key, F.lower("label").alias("term"), "chunk_index").agg(F.sum("w").alias("w"), F.min_by("label", "pos").alias("label"))
    summed = by_chunk.groupBy(key, "term").agg(F.round(F.sum("w"), 3).alias("weight"), F.min_by("label", "chunk_index").alias("label"), F.slice(F.array_sort(F.collect_list("chunk_index")), 1, 3).alias("chunks"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("weight"), "term"))
    return summed.withColumn("rank", place).where(F.col("rank") <= most).select(key, "rank", "term", "label", "weight", "chunks")


def representative(chunks: DataFrame, key: str = "id") -> DataFrame:
    """First, middle and last chunk of each source."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return chunks.withColumn("n", n).where((F.col("chunk_index") == 0) | (F.col("chunk_index") == F.floor(F.col("n") / 2)) | (F.col("chunk_index") == F.col("n") - 1)).drop("n")


def outline(rows: DataFrame, key: str, headings: str, depth: int = 3) -> DataFrame:
    """Nodes of the heading paths of (key, chunk_index, headings) rows: id, parent, depth, path, label, chunk references.

    Blank headings don't count; ``place`` orders the nodes of a source by depth and path.
    """
    path = F.filter(F.transform(F.slice(F.col(headings), 1, depth), collapse), lambda h: h != "")
    each = rows.select(key, "chunk_index", path.alias("path"), F.explode(F.sequence(F.lit(1), F.greatest(F.size(path), F.lit(1)))).alias("depth")).where(F.size("path") >= F.col("depth"))
    name = lambda d: F.array_join(F.transform(F.slice("path", 1, d), slug), "/")
    nodes = each.select(key, "chunk_index", "depth", F.slice("path", 1, F.col("depth")).alias("path"), F.element_at("path", F.col("depth")).alias("label"), name(F.col("depth")).alias("node"), F.when(F.col("depth") > 1, name(F.greatest(F.col("depth") - 1, F.lit(1)))).alias("parent"))
    found = nodes.groupBy(key, "node", "depth").agg(F.min_by("label", "chunk_index").alias("label"), F.first("parent").alias("parent"), F.min_by("path", "chunk_index").alias("path"), F.array_sort(F.collect_set("chunk_index")).alias("chunks"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("depth", F.array_join("path", "/"), "node")))


def content_metrics(chunks: DataFrame, key: str = "id", sections: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    """Chunks, tokens, length and coverage of each source; with an outline its sections and depth, with keywords their number."""
    placed = _fresh(chunks.select(key, "token_count", "char_start", "char_end"), key, "char_start", "char_end")  # chunks are made once
    sizes = placed.groupBy(key).agg(F.count(F.lit(1)).alias("chunk_count"), F.sum("token_count").alias("tokens"), F.max("char_end").alias("char_length"), F.sum("fresh").alias("covered"))
    found = sizes.withColumn("coverage_ratio", coverage(F.col("covered"), F.col("char_length")))
    none = lambda *names: {n: F.coalesce(n, F.lit(0)) for n in names}
    if sections is not None:
        counted = sections.groupBy(key).agg(F.count(F.lit(1)).alias("section_count"), F.max("depth").alias("heading_depth"))
        found = found.join(counted.hint("merge"), key, "left").withColumns(none("section_count", "heading_depth"))
    if terms is not None:
        found = found.join(terms.groupBy(key).agg(F.count(F.lit(1)).alias("keyword_count")).hint("merge"), key, "left").withColumns(none("keyword_count"))
    return found


def overview(text: Column, sentences: Column | None = None) -> Column:
    """The first two sentences, within 120 tokens; the text itself where it has none."""
    said = F.array_join(F.slice(snapshot_sentences(text) if sentences is None else sentences, 1, 2), " ")
    return trim_to_tokens(bind(said, lambda s: F.when(s != "", s).otherwise(text)), OVERVIEW_TOKENS)


def fallback_overview(text: Column, first_chunks: Column) -> Column:
    """An overview that isn't empty: two sentences of the full text, else the first two chunks, else the text."""
    said = F.array_join(F.slice(snapshot_sentences(F.coalesce(text, F.lit(""))), 1, 2), " ")
    chunks = F.array_join(F.slice(F.coalesce(first_chunks, F.array().cast("array<string>")), 1, 2), " ")
    return trim_to_tokens(F.coalesce(F.nullif(said, F.lit("")), F.nullif(chunks, F.lit("")), text, F.lit("")), OVERVIEW_TOKENS)


def passages(chunks: DataFrame, key: str = "id", most: int = PASSAGES) -> DataFrame:
    """Excerpts of the first chunks of each source, as (chunk_index, text)."""
    rows = F.array_sort(F.collect_list(F.struct("chunk_index", excerpt(F.col("content")).alias("text"))))
    return chunks.where(F.col("chunk_index") < most).groupBy(key).agg(rows.alias("passages"))


def digests(docs: DataFrame, chunks: DataFrame, sections: DataFrame, terms: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, overview, themes, assertions, passages, gaps) of each source that has chunks.

    Themes are outline labels, then keywords; assertions the first different sentences. ``sections`` is an
    :func:`outline`, ``terms`` are :func:`keywords`; only their first few rows of a source are put together.
    """
    listed = lambda rows, order, item, name, most: rows.where(F.col(order) <= most).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, item))), lambda x: x[item]).alias(name))
    labels = listed(sections, "place", "label", "labels", 4 * THEMES)
    words = listed(terms, "rank", "label", "words", KEYWORDS)
    none = F.array().cast("array<string>")
    said = bind(snapshot_sentences(F.col(text)), lambda s: F.struct(overview(F.col(text), s).alias("overview"), ordered_distinct(s, ASSERTIONS).alias("assertions")))
    made = docs.select(key, said.alias("_said")).select(key, "_said.*")
    made = made.join(passages(chunks, key).hint("merge"), key).join(labels.hint("merge"), key, "left").join(words.hint("merge"), key, "left")
    themes = ordered_distinct(F.concat(F.coalesce("labels", none), F.coalesce("words", none)), THEMES)
    gaps = F.when(F.col("labels").isNull(), F.array(F.lit(NO_OUTLINE))).otherwise(none)
    return made.select(key, "overview", themes.alias("themes"), "assertions", "passages", gaps.alias("gaps"))


def normalised_digests(drafts: DataFrame, chunks: DataFrame, fallbacks: DataFrame, key: str = "id") -> DataFrame:
    """Digests (key, overview, themes, assertions, passages, gaps, keywords) that a model drafted, within limits.

    Passages (chunk_index, text) and references of keywords (term, weight, chunks) to chunks that don't exist go;
    a keyword without any left refers to the first chunk. What is empty then comes from ``fallbacks``: overview,
    passages and keywords of each source.
    """
    known = chunks.groupBy(key).agg(F.max("chunk_index").alias("last"))  # chunks are numbered without gaps
    other = fallbacks.select(key, *[F.col(c).alias(f"other_{c}") for c in ("overview", "passages", "keywords")])
    both = drafts.join(known.hint("merge"), key).join(other.hint("merge"), key, "left")
    exists = lambda k: k.between(0, F.col("last"))
    kept = F.transform(F.slice(F.filter("passages", lambda p: exists(p["chunk_index"])), 1, PASSAGES), lambda p: F.struct(p["chunk_index"].alias("chunk_index"), excerpt(p["text"]).alias("text")))
    refs = lambda w: F.filter(F.coalesce(w["chunks"], F.array().cast("array<int>")), exists)
    terms = F.transform(F.filter("keywords", lambda w: collapse(F.coalesce(w["term"], F.lit(""))) != ""), lambda w: F.struct(collapse(w["term"]).alias("term"), F.round(F.coalesce(w["weight"], F.lit(1.0)), 3).alias("weight"), F.when(F.size(refs(w)) > 0, F.slice(refs(w), 1, 3)).otherwise(F.array(F.lit(0))).alias("chunks")))
    filled = lambda made, name: F.when(F.size(made) > 0, made).otherwise(F.col(f"other_{name}"))
    return both.select(
        key, F.coalesce(F.nullif(trim_to_tokens(F.col("overview"), OVERVIEW_TOKENS), F.lit("")), "other_overview").alias("overview"),
        ordered_distinct(F.col("themes"), THEMES).alias("themes"), ordered_distinct(F.col("assertions"), ASSERTIONS).alias("assertions"),
        filled(kept, "passages").alias("passages"), ordered_distinct(F.col("gaps"), ASSERTIONS).alias("gaps"), F.slice(filled(terms, "keywords"), 1, KEYWORDS).alias("keywords"),
    )


def snapshots(docs: DataFrame, digested: DataFrame, metrics: DataFrame, key: str = "id", text: str = "text", method: str = "heuristic") -> DataFrame:
    """One row a source with its identity, content hash, schema version, metrics and digest, ready to be upserted."""
    identity = docs.select(key, content_hash(F.col(text)).alias("source_content_hash"))
    parts = lambda df: F.struct(*[c for c in df.columns if c != key])
    made = identity.join(metrics.select(key, parts(metrics).alias("deterministic")).hint("merge"), key).join(digested.select(key, parts(digested).alias("semantic")).hint("merge"), key)
    return made.select(key, F.lit(SCHEMA_VERSION).alias("schema_version"), "source_content_hash", F.lit(method).alias("generation_method"), "deterministic", "semantic")


def snapshot_summaries(stored: DataFrame, key: str = "id") -> DataFrame:
    """(key, overview, themes, top_keywords) of stored digests; sources where all is empty are left out.

    ``stored`` has overview, themes, assertions, passages (text) and keywords (a list of terms). An empty overview is
    made of the first two assertions, else of the first passage that isn't blank.
    """
    exact = lambda items, most: F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")), 1, most)
    blank = lambda c: F.nullif(c, F.lit(""))
    asserted = F.array_join(exact(F.col("assertions"), 2), " ")
    passage = F.get(exact(F.transform("passages", lambda p: p["text"]), 1), F.lit(0))
    made = stored.select(key, F.coalesce(blank(F.trim("overview")), blank(asserted), passage, F.lit("")).alias("overview"), exact(F.col("themes"), THEMES).alias("themes"), exact(F.col("keywords"), 10).alias("top_keywords"))
    return made.where((F.col("overview") != "") | (F.size("themes") > 0) | (F.size("top_keywords") > 0))


def key_topics(words: DataFrame, scope: str, most: int = 10) -> DataFrame:
    """Keywords of all sources of a scope by summed weight."""
    total = words.groupBy(scope, "term").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("sources"))
    return total.withColumn("rank", F.row_number().over(Window.partitionBy(scope).orderBy(F.desc("weight"), "term"))).where(F.col("rank") <= most)


def _pairs(most: int):
    """Rows (scope, same, left, right) of two blocks of classes (id, sources, terms): their pairs that share a term. Terms both blocks
    have are looked up in an inverted list of the right one, some rows of the left one at a time, ``most`` pairs in one go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                scope, same, left, right = (batch.column(n)[k] for n in range(4))
                both, n, m = pa.concat_arrays([left.values, right.values]), len(left.values), len(right.values)
                ids, sources, terms = (both.field(c) for c in range(3))
                place, sizes = pc.rank(ids, tiebreaker="min").to_numpy(), terms.value_lengths().to_numpy().astype(np.int64)
                coded = terms.flatten().dictionary_encode()
                codes, owner, ends = coded.indices.to_numpy(), np.repeat(np.arange(n + m), sizes), np.concatenate([[0], np.cumsum(sizes)])
                listed = owner[ends[n] :][np.argsort(codes[ends[n] :], kind="stable")] - n
                times = np.bincount(codes[ends[n] :], minlength=len(coded.dictionary))
                first, step = np.cumsum(times) - times, max(1, most // m)
                for at in range(0, n, step):
                    a, b = ends[at], ends[min(n, at + step)]
                    hits = times[codes[a:b]]
                    lists = np.repeat(first[codes[a:b]] - np.cumsum(hits) + hits, hits) + np.arange(hits.sum())
                    shared = np.bincount(np.repeat((owner[a:b] - at) * m, hits) + listed[lists])
                    cells = np.flatnonzero(shared)
                    shared, x, y = shared[cells], cells // m + at, cells % m + n
                    if same.as_py():
                        once = place[x] < place[y]
                        shared, x, y = shared[once], x[once], y[once]
                    else:
                        x, y = np.where(place[x] < place[y], x, y), np.where(place[x] < place[y], y, x)
                    columns = [pa.repeat(scope, len(x)), ids.take(pa.array(x)), ids.take(pa.array(y)), sources.take(pa.array(x)), sources.take(pa.array(y))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(shared), pa.array(shared / (sizes[x] + sizes[y] - shared))], ["scope", "a", "b", "sources_a", "sources_b", "shared", "overlap"])

    return run


def source_overlap(words: DataFrame, scope: str, key: str) -> DataFrame:
    """Jaccard similarity of the keyword sets of a scope's sources that share a keyword.

    Sources with the same set of keywords are one class and enter once: (scope, a, b, sources_a, sources_b, shared, overlap),
    where a and b are the smallest sources of two classes and sources_* how many sources the classes have.
    Each two blocks of a scope's classes meet once, as one row, and their pairs are made where they meet: a pair that shares
    nothing costs next to nothing. ``words`` are read twice.
    """
    sets = words.groupBy(scope, key).agg(F.array_sort(F.collect_set("term")).alias("terms"))
    classes = sets.groupBy(scope, "terms").agg(F.min(key).alias("id"), F.count(F.lit(1)).alias("sources")).withColumnRenamed(scope, "scope")
    sizes = words.groupBy(F.col(scope).alias("scope")).agg(F.ceil(F.count_distinct(key) / MEETING).cast("int").alias("blocks"))
    cut = with_scope(classes, sizes, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    packed = cut.groupBy("scope", "block", "blocks").agg(F.collect_list(F.struct("id", "sources", "terms")).alias("own"))
    # a fixed number of tasks, which Spark doesn't put together: what a cell takes is its pairs, not its bytes
    spark = words.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = lambda rows: rows.repartition(tasks, "scope", "low", "high")
    left = dealt(packed.select("scope", F.col("block").alias("low"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("high"), F.col("own").alias("left")))
    right = dealt(packed.select("scope", F.explode(F.sequence(F.lit(0), "block")).alias("low"), F.col("block").alias("high"), F.col("own").alias("right")))
    cells = left.hint("merge").join(right, ["scope", "low", "high"]).select("scope", F.expr("low = high").alias("same"), "left", "right")
    kind = dict(classes.dtypes)
    made = cells.mapInArrow(_pairs(PAIRS), f"scope {kind['scope']}, a {kind['id']}, b {kind['id']}, sources_a long, sources_b long, shared long, overlap double")
    return made.withColumnRenamed("scope", scope)
