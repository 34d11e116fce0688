"""Reading tables and registering queries."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt out by id where the file has fewer splits than the cluster has cores."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` on all cores. A table of many splits, as any large one, is left where it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of a table's files: another one once the table has been written to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True), []
    while files.hasNext():
        status = files.next()
        found.append(f"{status.getPath()}:{status.getLen()}:{status.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(found)).encode()).hexdigest()


_stored: dict[tuple[str, str, str], tuple[str, str]] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[str], None], refresh: Callable[[str], None] | None = None, of: str = "documents") -> str:
    """The path of something derived from the table ``of``, built at its first use in an application.

    Once the table's files have changed, ``refresh`` brings it up to date; without one it is built anew, elsewhere. It lies
    in the shared checkpoint folder; where none is set, in the warehouse on a cluster and in a temporary
    folder on a single machine.
    """
    key, now = (spark.sparkContext.applicationId, sf_dir, name), fingerprint(spark, f"{sf_dir}/{of}.parquet")
    path, then = _stored.get(key, (None, None))
    if then != now:
        if path is None or refresh is None:
            folder = spark.conf.get("spark.checkpoint.dir", None)
            if not folder:
                local = spark.sparkContext.master.startswith("local")
                folder = tempfile.mkdtemp(prefix="spark-") if local else spark.conf.get("spark.sql.warehouse.dir")
            path = f"{folder}/{name}-{key[0]}-{hashlib.md5(f'{sf_dir} {now}'.encode()).hexdigest()}"
            build(path)
        else:
            refresh(path)
        _stored[key] = (path, now)
    return path


def register(queries: dict[str, Query], oracle: dict[str, str], sql: str | None = None) -> Callable[[Query], Query]:
    """A decorator that enters a query, with its SQL if there is one, under the function's name."""

    def enter(query: Query) -> Query:
        queries[query.__name__] = query
        if sql is not None:
            oracle[query.__name__] = sql
        return query

    return enter
