"""Mixing sources to target weights.

Words are summed by source; each source's target share becomes a repetition rate, target over size. A
document is then emitted floor(rate) times, and once more if a uniform number drawn from a hash of its id
and the seed is below the fraction. Reruns agree, and an executor that is lost redraws the same numbers.

Targets share all words by weight. No source is repeated more than ``most`` times: what exceeds that goes
to the other sources by weight, until none is above (each round is one small aggregation; only sums reach
the driver, never the list of sources).

Null or wordless texts have size 0 and are emitted like others; a source without words has rate 0. A null
source is a source, the last one. Null ids draw one common number, repeated rows their id's number. Extra
columns of any name are carried through ``emit``. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import WORD, materialise


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def cycle_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1, 2, ... ``cycle``, repeating over the sources in code-point order, null last.

    Ranks come from a range-partitioned sort and the sizes of its partitions, so that no task sees all
    sources; only one number a partition is joined back.
    """
    parts = max(1, min(200, sources.count() // 10_000 + 1))
    order = [F.col("source").isNull(), F.col("source")]
    dealt = materialise(sources.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    before = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return dealt.join(F.broadcast(before), "part").withColumn("weight", 1 + (F.col("before") + F.col("at")) % cycle).drop("part", "at", "before")


def targets(sources: DataFrame, most: int = 3) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``: shares by weight, at most ``most`` times the size."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    # shares only grow, so whatever any round caps is what the largest share so far caps
    top, held = None, -1
    while True:
        capped = F.lit(False) if top is None else F.lit(top) * F.col("weight") > F.lit(float(most)) * F.col("source_size")
        row = sources.agg(F.sum(F.when(capped, F.col("source_size"))).alias("size"), F.sum(F.when(~capped, F.col("weight"))).alias("weight"), F.count_if(capped).alias("n")).first()
        share = float(total - most * (row["size"] or 0)) / float(row["weight"]) if row["weight"] else 0.0
        if row["n"] == held:
            break
        held, top = row["n"], share if top is None else max(top, share)
    return sources.withColumn("target", F.when(capped, F.lit(float(most)) * F.col("source_size")).otherwise(F.lit(share) * F.col("weight")))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 of key and seed."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: DataFrame | None = None, most: int = 3, seed: int = 17) -> DataFrame:
    """``doc`` (the whole row), id, size, source_size, target, rate and ``copies`` for every row.

    ``weights`` has (source, weight); without it weights cycle 1, 2, 3. A source that ``weights`` lacks has
    weight 0.
    """
    rows = docs.select(F.struct("*").alias("doc"), docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"), word_count(docs[text_col].cast("string")).alias("size"))
    sizes = materialise(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    if weights is None:
        weighted = cycle_weights(sizes)
    else:
        w = weights.select(F.col("source").alias("name"), F.col("weight").cast("double").alias("weight"))
        weighted = sizes.join(w.hint("merge"), F.col("source").eqNullSafe(F.col("name")), "left").select("source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    weighted = targets(materialise(weighted), most).select(F.col("source").alias("name"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    joined = rows.join(_sized(weighted), F.col("source").eqNullSafe(F.col("name")))
    draw = (uniform(F.col("id"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return joined.withColumn("rate", rate).withColumn("copies", F.floor("rate") + draw).select("doc", "id", "size", "source_size", "target", "rate", "copies")


def _sized(sources: DataFrame, most: int = 100_000) -> DataFrame:
    """Broadcast the table of sources if it has been counted to be small; else join it by sort and merge."""
    return F.broadcast(sources) if sources.count() <= most else sources.hint("merge")


def emit(plan: DataFrame) -> DataFrame:
    """The mix itself: each document's row as often as the plan says."""
    return plan.where("copies > 0").select("doc", F.explode(F.expr("sequence(1L, copies)")).alias("copy")).select("doc.*")
