"""Rows from text, pages and uploads: decoding, extraction, titles, ids, routing and export."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions.text import collapse, normalise_text
from corpusloom.operators.tables import running

# Parts of a page that are no text, largest uploads by type, shapes of video addresses.
SCRIPT = r"(?is)<script[^>]*>.*?</script>"
STYLE = r"(?is)<style[^>]*>.*?</style>"
TAG = r"<[^>]+>"
UPLOAD_LIMITS = {"pdf": 50 << 20, "text": 10 << 20, "docx": 10 << 20}
_VIDEO = (r"(?:youtube\.com/watch\?(?:.*&)?v=)([A-Za-z0-9_-]{11})", r"youtu\.be/([A-Za-z0-9_-]{11})", r"youtube\.com/embed/([A-Za-z0-9_-]{11})", r"youtube\.com/shorts/([A-Za-z0-9_-]{11})")


def decode(content: Column) -> Column:
    """UTF-8 bytes, or else Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def text_pages(files: DataFrame) -> DataFrame:
    """Files (path, content) as page rows, with an error instead of text where nothing is left."""
    text = normalise_text(decode(F.col("content")))
    return files.select("path", text.alias("text"), F.lit(0).alias("char_start"), F.length(text).alias("char_end"), F.when(~text.rlike(r"\S"), "no text content").alias("error"))


@F.arrow_udf(StringType())
def unescaped(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Every named and numeric character reference as its character. Arrow, as Spark has no such function."""
    for batch in texts:
        yield pa.array([None if t is None else html.unescape(t) for t in batch.to_pylist()], pa.string())


def html_text(page: Column) -> Column:
    """Text of a page: scripts and styles leave nothing, tags a space, references become characters."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(page, SCRIPT, ""), STYLE, ""), TAG, " ")
    return collapse(F.when(F.contains(bare, F.lit("&")), unescaped(bare)).otherwise(bare))


def html_title(page: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(page, r"(?i)<title[^>]*>([^<]+)</title>", 1)), F.lit(""))


def heading_lines(text: Column, most: int = 10) -> Column:
    """Short lines without a closing stop, the first ``most``."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.trim(s))
    fits = F.filter(lines, lambda s: (F.length(s) > 0) & (F.length(s) < 100) & ~s.rlike(r"[.,;:]$") & (F.size(F.split(s, r"\s+")) <= 10))
    return F.slice(fits, 1, most)


def text_title(text: Column, stem: Column | None = None) -> Column:
    """The file's stem, else the first non-blank line under 200 characters."""
    line = F.get(F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: (s != "") & (F.length(s) < 200)), F.lit(0))
    return line if stem is None else F.coalesce(F.nullif(stem, F.lit("")), line)


def video_id(url: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in _VIDEO])


def document_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"docs\.google\.com/document/d/([A-Za-z0-9_-]+)", 1), F.lit(""))


def page_offsets(pages: DataFrame, source: str, order: str, text: str) -> DataFrame:
    """char_start and char_end of each page in its source's joined text, pages in ``order``, a whole number; blank pages take no room."""
    room = F.when(F.trim(F.col(text)) == "", 0).otherwise(F.length(text) + 1)
    placed = running(pages, source, order, room).withColumnRenamed("before", "char_start")
    return placed.withColumn("char_end", F.col("char_start") + F.greatest(room - 1, F.lit(0)))


def route(sources: DataFrame) -> DataFrame:
    """Sources with an error that names the step where something is missing; :func:`readers.read_sources` reads the others."""
    kind, path, url = F.col("source_type"), F.col("file_path"), F.col("original_url")
    problem = F.when(kind.isin("pdf", "text") & path.isNull(), "missing file path").when(kind.isin("url", "video", "document") & url.isNull(), "missing URL").when(~F.coalesce(kind.isin("pdf", "text", "url", "video", "document"), F.lit(False)), "unsupported type")
    return sources.withColumn("error", F.when(problem.isNotNull(), F.struct(F.lit("fetch").alias("step"), problem.alias("message"))))


def upload_error(kind: Column, size: Column) -> Column:
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in UPLOAD_LIMITS.items() for x in pair]), kind)
    return F.when(limit.isNull(), "type not allowed").when(size > limit, "too large")


def file_title(name: Column) -> Column:
    """A readable title from a file name: no folder, ending or separators."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"\.[A-Za-z0-9]{1,8}$", "")
    return collapse(F.regexp_replace(F.regexp_replace(stem, r"[\x00-\x1f]", ""), r"[_-]+", " "))


def lenient_json(text: Column, schema: str) -> Column:
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def export_csv(table: DataFrame, path: str, columns: list[str]) -> None:
    """Columns in a fixed order, times in ISO form, nothing for null; a table without rows has no header either."""
    kinds = dict(table.dtypes)
    cells = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) if kinds[c].startswith("timestamp") else F.col(c) for c in columns]
    table.select(*cells).write.mode("overwrite").option("header", not table.isEmpty()).option("emptyValue", "").csv(path)


def joined_pages(pages: DataFrame, source: str, order: str, text: str) -> DataFrame:
    """The full text of each source: its pages that aren't blank, in order, joined by a line end."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("_t")))), lambda x: x["_t"]), "\n")
    return pages.where(F.trim(text) != "").groupBy(source).agg(whole.alias("full_text"))


def sanitised_name(name: Column, most: int = 255) -> Column:
    """A file name without folders and control characters, cut to ``most`` characters; null if nothing is left."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"[\x00-\x1f\x7f]", ""))
    return F.nullif(F.substring(bare, 1, most), F.lit(""))
