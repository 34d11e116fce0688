"""A chunk table in files, replaced source by source.

Rows lie in buckets by hash of their source. Saving a source writes the buckets of the sources that really change,
with dynamic partition overwrite: other buckets' files stay as they are, a run that brings nothing new writes nothing, and
the same run again gives the same rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.retrieval import l2_normalise

BUCKETS = 64
_NEVER_WRITTEN = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def _bucket(source: str) -> Column:
    return F.pmod(F.xxhash64(source), F.lit(BUCKETS)).cast("int")


def _digests(chunks: DataFrame, source: str) -> DataFrame:
    """(source, rows, digest): what tells whether a source's chunks are the same."""
    plain = [F.col(c) for c in sorted(set(chunks.columns) - {"bucket"})]
    return chunks.groupBy(source).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*plain).cast("decimal(38,0)")).alias("digest"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored chunks; None before anything has been saved."""
    try:
        return spark.read.parquet(path).drop("bucket")
    except AnalysisException as error:
        if error.getCondition() not in _NEVER_WRITTEN:
            raise
        return None


def save_chunks(chunks: DataFrame, path: str, sources: DataFrame | None = None, source: str = "source_id", embedding: str = "embedding") -> int:
    """Replace the stored chunks of ``sources`` (those of ``chunks`` if not given) by ``chunks``; the number of buckets written.

    A source without any chunk loses those it had. Embeddings are brought to length one; empty and zero vectors stay.
    The driver sees at most ``BUCKETS`` numbers.
    """
    spark = chunks.sparkSession
    if embedding in chunks.columns:
        chunks = chunks.withColumn(embedding, l2_normalise(F.col(embedding)))
    replaced = (chunks if sources is None else sources).select(source).distinct()
    old = read_chunks(spark, path)
    new = _digests(chunks, source)
    if old is None:
        changed, kept = new.select(source), chunks.limit(0)
    else:
        then = _digests(old, source).join(replaced.hint("merge"), source, "left_semi")
        differing = new.unionByName(then).groupBy(source, "rows", "digest").agg(F.count(F.lit(1)).alias("times")).where("times = 1")
        changed, kept = differing.select(source).distinct(), old
    touched = sorted(r[0] for r in changed.select(_bucket(source)).distinct().collect())
    if not touched:
        return 0
    there = kept.where(_bucket(source).isin(touched)).join(replaced.hint("merge"), source, "left_anti")
    rows = there.unionByName(chunks.where(_bucket(source).isin(touched)), allowMissingColumns=True).withColumn("bucket", _bucket(source))
    # an empty row set of a bucket would leave its old files
    filled = {r[0] for r in rows.select("bucket").distinct().collect()}
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64(source), F.lit(7919))).sortWithinPartitions("bucket", source)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for bucket in set(touched) - filled:
        spark.createDataFrame([], rows.drop("bucket").schema).write.mode("overwrite").parquet(f"{path}/bucket={bucket}")
    spark.catalog.refreshByPath(path)
    return len(touched)
