"""Streams over job events and new sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import content_hash, named_uuid, stable_chunk_id
from corpusloom.operators.chunking import chunk


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events of each kind in tumbling windows; a window is final once the watermark has passed it."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def latest_status(events: DataFrame, key: str, time: str, status: str, tie: str) -> DataFrame:
    """The newest status of each key by event time, however late the event came; for update mode."""
    newest = F.max(F.struct(time, tie, status)).alias("m")
    return events.groupBy(key).agg(newest, F.count(F.lit(1)).alias("events")).select(key, F.col(f"m.{time}").alias(time), F.col(f"m.{status}").alias(status), "events")


def merged_fields(events: DataFrame, key: str, time: str, fields: list[str]) -> DataFrame:
    """For every field its newest value that isn't null."""
    return events.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(time))).alias(f) for f in fields])


def delivery_mode(counts: Column) -> Column:
    """no_chunks, single_chunk or streaming, from a column with the number of deltas."""
    return F.when(counts == 0, "no_chunks").when(counts == 1, "single_chunk").otherwise("streaming")


def incremental_chunks(sources: DataFrame, store: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None, live: Callable[[SparkSession], DataFrame] | None = None):
    """Start a stream that keeps the chunks of new and changed sources in ``store`` (Parquet, by batch).

    A batch keeps each source's last row by ``order_col`` (of equal or absent orders the one with the larger hash),
    leaves out those whose content hash is that of their newest stored version, chunks the rest and writes them
    with stable ids under the batch's own folder, so that a replayed batch writes the same rows again. A source
    that has no chunks any more writes one row without content. :func:`current_chunks` reads the newest versions.

    ``live`` gives the sources (id) that still exist; it is asked anew in every batch. Rows of other sources are passed over,
    and stored sources that are gone get an empty version, so that work on a source that was deleted meanwhile
    leaves nothing behind.
    """

    def build(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        text = F.coalesce(F.col(text_col), F.lit(""))
        order = F.struct((F.lit(0) if order_col is None else F.col(order_col)).alias("at"), content_hash(text).alias("hash"))
        last = batch.groupBy(F.col(id_col).alias("id")).agg(F.max_by(text, order).alias("text"))
        rows, gone = last.withColumn("hash", content_hash(F.col("text"))), None
        here = None if live is None else live(spark).select("id").distinct()
        if here is not None:
            rows = rows.join(here.hint("merge"), "id", "left_semi")
        try:
            known = spark.read.parquet(store).where(F.col("version") < number).groupBy("id").agg(F.max(F.struct("version", "hash"))["hash"].alias("hash"))
            rows = rows.join(known.hint("merge"), ["id", "hash"], "left_anti")
            if here is not None:
                gone = known.where("hash IS NOT NULL").join(here.hint("merge"), "id", "left_anti").select("id", F.lit(None).cast("string").alias("hash"))
        except AnalysisException as error:  # the first batch finds no store
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        pieces = chunk(rows, "id", "text")
        uuid = F.when(F.col("id").cast("string").rlike("^[0-9a-fA-F-]{36}$"), F.col("id").cast("string")).otherwise(named_uuid(F.col("id")))
        named = pieces.withColumn("chunk_id", stable_chunk_id(uuid, F.col("chunk_index"), F.col("char_start"), F.col("char_end"), F.col("content")))
        made = rows.select("id", "hash").hint("merge").join(named, "id", "left")
        made = made if gone is None else made.unionByName(gone, allowMissingColumns=True)
        made.write.mode("overwrite").parquet(f"{store}/version={number}")

    return sources.writeStream.foreachBatch(build).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_chunks(stored: DataFrame) -> DataFrame:
    """The chunks of each source's newest version; a source whose newest version is blank has none."""
    newest = stored.groupBy("id").agg(F.max("version").alias("version"))
    return stored.join(newest, ["id", "version"], "left_semi").where("chunk_id IS NOT NULL")
