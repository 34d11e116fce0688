"""Approximate cosine search with inverted lists.

Each scope has centres, fitted by k-means on a bounded sample of its passages (at most ``SAMPLE``, those of the smallest hashes);
every passage is in the list of its nearest centre. A query is held against the centres of its scope, takes the
nearest lists until they have ``share`` of the scope's passages (and four times k at least), and scores what they
hold exactly. Scopes of few passages are so searched whole.

Vectors are multiplied in blocks, in tasks: passages by blocks of a scope when lists are made, shelves of neighbouring lists of about
``SHELF`` passages when they are searched. A task returns at most k rows of a query, so neither a large scope nor many
queries make a table of pairs. Null, empty and zero vectors are in no list and ask nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.retrieval import BLOCK, BUCKETS, has_vector, l2_normalise, norm, top_k

#: Passages of a scope that its centres are fitted on, and that a task searches at once; queries that it holds against them.
SAMPLE, SHELF, ASKED = 20_000, 2_000, 4_000
ROUNDS = 12


@dataclass
class Lists:
    """members (scope, shelf, list, id, embedding), of length one; centres (scope, list, shelf, centre, n, total): passages of a list and of its scope."""

    members: DataFrame
    centres: DataFrame


def list_count(passages: int, sample: int) -> int:
    """Eight times the root of a scope's passages, so that centres and lists grow alike; two passages a list at least."""
    return max(1, min(passages // 2, int(8 * passages**0.5), sample // 2))


def _rows(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64)


def _frame(columns: dict) -> pd.DataFrame:
    """Columns as they are: text stays Python strings."""
    return pd.DataFrame({name: pd.Series(values, dtype=object) if getattr(values, "dtype", object) == object else values for name, values in columns.items()})


def _plain(column: pd.Series) -> np.ndarray:
    return column.to_numpy() if column.dtype.kind in "iuf" else column.to_numpy(dtype=object)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre of greatest cosine, some thousand points at a time."""
    step = max(1, (1 << 22) // len(centres))
    return np.concatenate([np.argmax(points[k : k + step] @ centres.T, axis=1) for k in range(0, len(points), step)])


def _fit(sample: pd.DataFrame) -> pd.DataFrame:
    """Spherical k-means from spread-out rows of the sample; a centre that loses all its points stays where it is."""
    sample = sample.sort_values("place")
    points, total = _rows(sample["embedding"]), int(sample["total"].iloc[0])
    count = list_count(total, len(points))
    centres = points[np.linspace(0, len(points) - 1, count).astype(int)].copy()
    for _ in range(ROUNDS):
        own = _nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    shelves = -(-total // SHELF)
    return _frame({"scope": _plain(sample["scope"])[:count], "list": np.arange(count), "shelf": np.arange(count) * shelves // count, "centre": list(centres), "total": np.full(count, total)})


def _assign(passages: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
    if passages.empty or centres.empty:
        return pd.DataFrame({"scope": [], "shelf": [], "list": [], "id": [], "embedding": []})
    centres = centres.sort_values("list")
    own = _nearest(_rows(passages["embedding"]), _rows(centres["centre"]))
    return _frame({"scope": _plain(passages["scope"]), "shelf": centres["shelf"].to_numpy()[own], "list": centres["list"].to_numpy()[own], "id": _plain(passages["id"]), "embedding": passages["embedding"].tolist()})


def _bucket() -> Column:
    return F.pmod(F.xxhash64("scope"), F.lit(BUCKETS)).cast("int")


def _normalised(rows: DataFrame, key: str) -> DataFrame:
    vector = F.col("embedding")
    return rows.where(has_vector(vector)).where(norm(vector) > 0).select("scope", key, l2_normalise(vector).alias("embedding"))


def store_lists(passages: DataFrame, path: str) -> None:
    """Fit centres for every scope of ``passages`` (scope, id, embedding) and write all lists, sorted, in files by scope and shelf."""
    spark = passages.sparkSession
    rows = _normalised(passages, "id")
    kind = lambda name: rows.schema[name].dataType.simpleString()
    sizes = rows.groupBy("scope").agg(F.count(F.lit(1)).alias("total"))
    largest, every = sizes.agg(F.max("total"), F.sum("total")).first()
    blocks = max(1, -(-(largest or 0) // BLOCK))
    place = F.row_number().over(Window.partitionBy("scope").orderBy(F.xxhash64("id"), "id"))
    sample = rows.withColumn("place", place).where(F.col("place") <= SAMPLE).join(sizes.hint("merge"), "scope")
    fitted = f"{path}/fitted"
    sample.groupBy("scope").applyInPandas(_fit, f"scope {kind('scope')}, list int, shelf int, centre array<double>, total long").write.mode("overwrite").parquet(fitted)
    centres = spark.read.parquet(fitted)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    each = centres.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    placed = dealt.groupBy("scope", "block").cogroup(each.groupBy("scope", "block")).applyInPandas(_assign, f"scope {kind('scope')}, shelf int, list int, id {kind('id')}, embedding array<double>")
    files = max(1, -(-(every or 0) // (500 * SHELF * BUCKETS)))
    kept = placed.withColumn("bucket", _bucket()).withColumn("file", F.pmod(F.xxhash64("scope", "shelf"), F.lit(files)))
    kept.repartition("bucket", "file").drop("file").sortWithinPartitions("bucket", "scope", "shelf", "list", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/members")
    spark.createDataFrame([], placed.schema).write.mode("overwrite").parquet(f"{path}/members/bucket=-1")  # keeps the columns where there are no passages
    counts = spark.read.parquet(f"{path}/members").groupBy("scope", "list").agg(F.count(F.lit(1)).alias("n"))
    centres.join(counts.hint("merge"), ["scope", "list"]).write.mode("overwrite").parquet(f"{path}/centres")


def load_lists(spark: SparkSession, path: str, queries: DataFrame | None = None) -> Lists:
    """Stored lists, whole or the files of the queries' scopes: at most ``BUCKETS`` numbers reach the driver."""
    members = spark.read.parquet(f"{path}/members")
    if queries is not None:
        members = members.where(F.col("bucket").isin([r[0] for r in queries.select(_bucket()).distinct().collect()]))
    return Lists(members.drop("bucket"), spark.read.parquet(f"{path}/centres"))


def _probe(k: int, share: float):
    def run(queries: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "scope": [], "part": [], "shelf": [], "list": [], "n": []}
        if not queries.empty and not centres.empty:
            size, total = centres["n"].to_numpy(), int(centres["total"].iloc[0])
            shelf, number = centres["shelf"].to_numpy(), centres["list"].to_numpy()
            need = max(share * total, min(total, 4 * k))
            step = max(1, (1 << 22) // len(centres))
            for at in range(0, len(queries), step):
                some = queries.iloc[at : at + step]
                order = np.argsort(-(_rows(some["embedding"]) @ _rows(centres["centre"]).T), axis=1, kind="stable")
                before = np.cumsum(size[order], axis=1) - size[order]
                row, column = np.nonzero(before < need)
                taken = order[row, column]
                for name, values in (("query_id", _plain(some["query_id"])[row]), ("scope", _plain(some["scope"])[row]), ("part", _plain(some["part"])[row]), ("shelf", shelf[taken]), ("list", number[taken]), ("n", size[taken])):
                    out[name].append(values)
        return _frame({name: np.concatenate(values) if values else [] for name, values in out.items()})

    return run


def _asked(queries: DataFrame) -> tuple[DataFrame, int]:
    """Normalised queries dealt into parts of a scope, and the number of parts."""
    q = _normalised(queries, "query_id")
    most = q.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(1, -(-most // ASKED))
    return q.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")), parts


def probes(queries: DataFrame, lists: Lists, k: int = 10, share: float = 0.25) -> DataFrame:
    """(query_id, scope, part, shelf, list, n): the lists that a query looks through, and the passages in each."""
    q, parts = _asked(queries)
    kind = lambda name: q.schema[name].dataType.simpleString()
    each = lists.centres.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return q.groupBy("scope", "part").cogroup(each.groupBy("scope", "part")).applyInPandas(_probe(k, share), f"query_id {kind('query_id')}, scope {kind('scope')}, part int, shelf int, list int, n long")


def _search(k: int, least: float):
    def run(asked: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or members.empty:
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        points, vectors = _rows(members["embedding"]), _rows(asked["embedding"])
        place = np.empty(len(members), np.int64)
        place[np.argsort(_plain(members["id"]), kind="stable")] = np.arange(len(members))
        held = members.groupby("list").indices
        found = []
        for number, rows in asked.explode("lists").reset_index(drop=True).assign(row=np.repeat(np.arange(len(asked)), asked["lists"].map(len))).groupby("lists")["row"]:
            if number in held:
                inside, who = held[number], rows.to_numpy()
                scores = np.round(vectors[who] @ points[inside].T, 12)
                a, b = np.nonzero(scores >= least)
                found.append((who[a], inside[b], scores[a, b]))
        if not found:
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        who, what, score = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((place[what], -score, who))
        who, what, score = who[order], what[order], score[order]
        begin = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        best = np.arange(len(who)) - np.repeat(begin, np.diff(np.append(begin, len(who)))) < k
        return _frame({"query_id": _plain(asked["query_id"])[who[best]], "id": _plain(members["id"])[what[best]], "score": score[best]})

    return run


def approximate_search(queries: DataFrame, lists: Lists, k: int = 10, share: float = 0.25, least: float = 0.0) -> DataFrame:
    """The best k passages (query_id, id, score, rank) in the lists nearest to each query (query_id, scope, embedding); scores are exact."""
    q, parts = _asked(queries)
    wanted = probes(queries, lists, k, share).groupBy("scope", "part", "shelf", "query_id").agg(F.collect_list("list").alias("lists"))
    asked = wanted.join(q.hint("merge"), ["scope", "part", "query_id"])
    members = lists.members.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    kind = f"query_id {q.schema['query_id'].dataType.simpleString()}, id {lists.members.schema['id'].dataType.simpleString()}, score double"
    return top_k(asked.groupBy("scope", "shelf", "part").cogroup(members.groupBy("scope", "shelf", "part")).applyInPandas(_search(k, least), kind), k)
