"""One call that reads sources of every type: rows with text, or with an error that names the step.

A source's type selects where its content is looked up: files by their path in a binary file scan, pages,
shared documents and video transcripts by address or id in tables of fetched content. Addresses are not fetched here:
remote services are tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import normalise_text
from corpusloom.sources import web

_ERROR = "struct<step: string, message: string>"


def file_contents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of every file below a folder; the path as the folder was given, in whatever form the store names it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    bare = lambda p: F.regexp_replace(p, r"^[A-Za-z0-9+.-]+:/+", "/")
    return found.select(bare(F.col("path")).alias("path"), "content")


def _failed(step: str, message: str) -> Column:
    return F.struct(F.lit(step).alias("step"), F.lit(message).alias("message")).cast(_ERROR)


def read_sources(sources: DataFrame, files: DataFrame | None = None, pages: DataFrame | None = None, documents: DataFrame | None = None, transcripts: DataFrame | None = None) -> DataFrame:
    """Each of ``sources`` (source_id, source_type, file_path, original_url) with title, text and error (step, message).

    files (path, content): text files, UTF-8 or Latin-1; the title is the file's name. pages (url, html); documents (document_id, text); transcripts
    (video_id, text). A content that isn't there fails in step fetch, one without any text in step parse, and so does a
    PDF, whose layout Spark has no reader for. Just one of text and error is null. Sources with one
    address share its content; a repeated address of fetched content is one, that of the smallest text.
    """
    routed = web.route(sources).select("source_id", "source_type", "file_path", "original_url", F.col("error").cast(_ERROR).alias("error"))
    bad = routed.where("error IS NOT NULL").select("source_id", "source_type", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("text"), "error")
    good = routed.where("error IS NULL").drop("error")
    pdf = good.where("source_type = 'pdf'").select("source_id", "source_type", web.file_title(F.col("file_path")).alias("title"), F.lit(None).cast("string").alias("text"), _failed("parse", "no reader for PDF layout").alias("error"))

    def looked_up(kind: str, key: Column, table: DataFrame | None, name: str, text: Column, title: Column, missing: str) -> DataFrame:
        asked = good.where(F.col("source_type") == kind).withColumn("_key", key)
        if table is None:
            found = asked.withColumns({"title": F.lit(None).cast("string"), "text": F.lit(None).cast("string"), "_there": F.lit(False)})
        else:
            wanted = asked.select("_key").distinct()
            met = table.withColumnRenamed(name, "_key").join(wanted.hint("shuffle_hash"), "_key", "left_semi")
            content = met.select("_key", text.alias("text"), title.alias("title")).groupBy("_key").agg(F.min(F.struct("text", "title")).alias("c"))
            found = asked.join(content.hint("merge"), "_key", "left").select("*", "c.text", "c.title", F.col("c").isNotNull().alias("_there"))
        blank = ~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
        error = F.when(~F.col("_there"), _failed("fetch", missing)).when(blank, _failed("parse", "no text content"))
        return found.select("source_id", "source_type", "title", F.when(~blank, F.col("text")).alias("text"), error.alias("error"))

    path = F.regexp_replace("file_path", r"^[A-Za-z0-9+.-]+:/+", "/")
    whole = normalise_text(F.col("text"))
    read = [
        looked_up("text", path, files, "path", normalise_text(web.decode(F.col("content"))) if files is not None else whole, web.file_title(F.col("_key")), "file not found"),
        looked_up("url", F.col("original_url"), pages, "url", web.html_text(F.col("html")) if pages is not None else whole, web.html_title(F.col("html")) if pages is not None else whole, "page not fetched"),
        looked_up("document", web.document_id(F.col("original_url")), documents, "document_id", whole, web.text_title(whole), "document not fetched"),
        looked_up("video", web.video_id(F.col("original_url")), transcripts, "video_id", whole, web.text_title(whole), "transcript not fetched"),
    ]
    return reduce(DataFrame.unionByName, [bad, pdf, *read])


def readable(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources with text, and those with an error."""
    return read.where("error IS NULL").drop("error"), read.where("error IS NOT NULL").select("source_id", "source_type", "error.step", "error.message")
