"""Evidence, citations and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import citation_indices, language, quote, unknown_message


def evidence(ranked: DataFrame, passages: DataFrame) -> DataFrame:
    """Ranked passages with their number, quote and text; payload is joined after ranking."""
    body = passages.select("id", F.col("text").alias("content"), quote(F.col("text")).alias("quote"))
    return ranked.hint("merge").join(body, "id").select("query_id", F.col("rank").alias("citation_index"), "id", "score", "quote", "content")


def diagnostics(found: DataFrame, source: str = "scope") -> DataFrame:
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.count_distinct(source).alias("source_count"))


def structured_indices(raw: Column) -> Column:
    """Positive numbers of a JSON list of numbers, digit strings or objects with an index; each once."""
    items = F.from_json(raw, "array<string>")
    number = lambda x: F.coalesce(x.try_cast("int"), F.get_json_object(x, "$.index").try_cast("int"), F.get_json_object(x, "$.citation_index").try_cast("int"))
    return F.array_distinct(F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), number), lambda n: n > 0))


def answer_text(raw: Column) -> Column:
    """The answer of a JSON object under its usual names, else the text itself."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(raw, f"$.{k}")), F.lit("")) for k in ("answer", "text", "response", "content")], raw)


def align(answers: DataFrame, found: DataFrame, listed: Column | None = None) -> DataFrame:
    """(query_id, citation_index, id, missing): an answer's citations met with its evidence.

    Listed indices come first, then marks in the text that aren't listed; ``place`` keeps that order.
    """
    marks = citation_indices(F.col("answer"))
    every = marks if listed is None else F.array_union(listed, marks)
    cited = answers.select("query_id", F.posexplode(every).alias("place", "citation_index"))
    known = found.select("query_id", "citation_index", "id")
    return cited.hint("merge").join(known, ["query_id", "citation_index"], "left").withColumn("missing", F.col("id").isNull())


def validate_ids(cited: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """Each different id once, with whether it exists."""
    return cited.select(key).distinct().join(known.select(key).distinct().withColumn("valid", F.lit(True)), key, "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def keep_valid(citations: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    return citations.join(known.select(key), key, "left_semi")


def removed_counts(citations: DataFrame, known: DataFrame, by: str = "query_id", key: str = "id") -> DataFrame:
    """(by, kept, removed): how many citations of each answer point to chunks that exist, and how many don't."""
    marked = citations.join(known.select(key).distinct().withColumn("_known", F.lit(True)), key, "left")
    return marked.groupBy(by).agg(F.count("_known").alias("kept"), F.count_if(F.col("_known").isNull()).alias("removed"))


def finalise(answers: DataFrame, counts: DataFrame, question: str = "question", spoken: str = "thread_language") -> DataFrame:
    """Answers without evidence or text say that there isn't enough information, and cite nothing; all others stay as they are.

    That is said in the thread's language where there is a column ``spoken`` (:func:`text.thread_language`), else in the question's, in
    English if there is none. ``cited`` is whether citations stay: an answer that itself says it doesn't know keeps them.
    """
    joined = answers.join(counts.select("query_id", "chunk_count"), "query_id", "left")
    bare = (F.coalesce("chunk_count", F.lit(0)) == 0) | ~F.coalesce(F.col("answer").rlike(r"\S"), F.lit(False))
    asked = language(F.coalesce(question, F.lit("")) if question in answers.columns else F.lit(""))
    heard = F.coalesce(spoken, asked) if spoken in answers.columns else asked
    return joined.withColumns({"answer": F.when(bare, unknown_message(heard)).otherwise(F.col("answer")), "cited": ~bare})


def citation_rows(answers: DataFrame, found: DataFrame, titles: DataFrame) -> DataFrame:
    """(query_id, id, citation_index, quote, score, page, source_title) of what each answer cites, in order of the index.

    ``found`` is numbered evidence (with ``page`` if it has pages); ``titles`` has (id, source_title).
    """
    aligned = align(answers, found).where(~F.col("missing")).select("query_id", "citation_index")
    page = F.col("page").cast("string") if "page" in found.columns else F.lit(None).cast("string")
    packed = found.select("query_id", "citation_index", "id", "quote", "score", page.alias("page")).join(titles.select("id", "source_title"), "id")
    return aligned.hint("merge").join(packed, ["query_id", "citation_index"]).select("query_id", "id", "citation_index", "quote", "score", "page", "source_title").orderBy("query_id", "citation_index")


def by_source(found: DataFrame, source: str = "scope") -> DataFrame:
    """Evidence of a query grouped by source, sources in order of first appearance."""
    grouped = found.groupBy("query_id", source).agg(F.min("citation_index").alias("first"), F.array_sort(F.collect_list("citation_index")).alias("indices"))
    return grouped.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("first")))


def prompt(found: DataFrame, questions: DataFrame) -> DataFrame:
    """The numbered evidence block of each question."""
    line = F.concat(F.lit("["), F.col("citation_index"), F.lit("] "), F.col("content"))
    blocks = found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("citation_index", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("evidence"))
    return questions.join(blocks.hint("merge"), "query_id", "left").withColumn("prompt", F.concat_ws("\n\n", F.col("evidence"), F.concat(F.lit("Question: "), F.col("query"))))
