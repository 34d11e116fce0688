"""Sentence-packed overlapping chunks, with source offsets."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import sentences, token_estimate


def packed(sizes: list[int], tokens: list[int], lead: int, length: int, high: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each chunk of a text from its pieces' sizes and tokens (0: blank), by running sums and bisection."""
    ends = list(accumulate(sizes, initial=lead))[1:]
    full = [k for k, t in enumerate(tokens) if t]
    t = [tokens[k] for k in full]
    until = list(accumulate(t))  # tokens up to and with each piece
    before = [0, *until[:-1]]
    big = list(accumulate((k if x > overlap else -1 for k, x in enumerate(t)), max))  # the last piece too large to repeat
    found, a = [], 0
    while True:
        b = max(a + 1, bisect_right(until, before[a] + high))
        start = 0 if a == 0 and not found else ends[full[a]] - sizes[full[a]]
        if b >= len(t):
            return [*found, (start, length)]
        found.append((start, ends[full[b - 1]]))
        a = min(b, max(bisect_right(until, before[b] - overlap), bisect_left(before, before[b] + t[b] - high), big[b - 1] + 1))


def chunk(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: int = 300, high: int = 800, overlap: int = 75) -> DataFrame:
    """(id, chunk_index, char_start, char_end, content, token_count) of every non-blank text.

    Sentences are packed until the next would pass ``high`` tokens. The next chunk then starts with the
    whole sentences before that one which fill the overlap (none of over ``overlap`` tokens), fewer if
    the next would not fit behind them. The first chunk starts at 0 and the last ends with the text.
    ``low`` is only checked. Sentences are split and sized in the JVM; only their numbers go through
    :func:`packed`, in Arrow batches. Each row is chunked where it lies: nothing is shuffled.
    """
    if not 0 < low < high or not 0 <= overlap < low:
        raise ValueError("need 0 <= overlap < low < high")
    size = 4 * high
    windows = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / size).cast("int")), lambda k: F.substring(p, k * size + 1, F.lit(size)))
    pieces = F.flatten(F.transform(sentences(F.col("text")), lambda p: F.when(F.length(p) <= high, F.array(p)).when(token_estimate(p) <= high, F.array(p)).otherwise(windows(p))))
    sized = F.transform(pieces, lambda p: F.struct(F.length(p).alias("size"), F.when(p.rlike(r"\S"), token_estimate(p)).otherwise(0).alias("tokens")))

    @F.arrow_udf("array<struct<char_start: int, char_end: int>>")
    def pack(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("char_start", pa.int32()), ("char_end", pa.int32())]))
        for columns in batches:
            rows = (packed(*row, high, overlap) for row in zip(*(c.to_pylist() for c in columns), strict=True))
            yield pa.array([[{"char_start": a, "char_end": b} for a, b in row] for row in rows], kind)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike(r"\S")).withColumn("z", sized)
    # marked nondeterministic so that no filter on the exploded array is inferred with the function in it
    cuts = rows.withColumn("cuts", pack.asNondeterministic()("z.size", "z.tokens", F.length(F.regexp_extract("text", r"^\s*", 0)), F.length("text")))
    each = cuts.select("id", "text", F.posexplode("cuts").alias("chunk_index", "c")).select("id", "chunk_index", "c.*", "text")
    content = F.substring(F.col("text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    return each.select("id", "chunk_index", "char_start", "char_end", content.alias("content")).withColumn("token_count", token_estimate(F.col("content")))


def with_pages(chunks: DataFrame, pages: DataFrame, source: str = "id") -> DataFrame:
    """Chunks with the pages that they overlap, the page of their start, and that page's headings."""
    p = pages.select(F.col(source).alias("_s"), "page_number", "headings", F.col("char_start").alias("p_start"), F.col("char_end").alias("p_end"))
    met = chunks.hint("merge").join(p, (F.col(source) == F.col("_s")) & (F.col("char_start") < F.col("p_end")) & (F.col("char_end") > F.col("p_start")), "left")
    holds = (F.col("p_start") <= F.col("char_start")) & (F.col("char_start") < F.col("p_end"))
    main = F.min_by(F.struct("page_number", "headings"), F.struct(~holds, "p_start"))
    found = met.groupBy(source, "chunk_index").agg(F.array_sort(F.collect_set("page_number")).alias("pages"), main.alias("main"))
    return chunks.hint("merge").join(found, [source, "chunk_index"]).withColumns({"page": F.col("main.page_number"), "headings": F.col("main.headings")}).drop("main")
