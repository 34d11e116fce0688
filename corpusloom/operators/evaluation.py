"""Retrieval and answer quality for whole tables of runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.tables import in_time_range

# Words that hint at a contradiction.
CONTRAST = ("however", "but", "although", "contrary", "opposite", "disagree")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


#: Bytes of text whose words are hashed at once; factors of a byte's and of a word's place.
PIECE, BYTE, PLACE = 1 << 20, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _windows(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every run of ``width`` words, of all words of a shorter text, with the number of its text. White space only separates
    words; equal runs have equal hashes, others hardly ever."""
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data, ends = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]
    inside = ~((data == 32) | (data >= 9) & (data <= 13))
    before, after = np.concatenate([[False], inside[:-1]]) if len(inside) else inside, np.append(inside[1:], False) if len(inside) else inside
    before[ends[:-1][ends[:-1] < len(data)]] = False
    after[ends[1:][ends[1:] > 0] - 1] = False
    first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    # powers of an odd number and of its inverse, so that a word's hash doesn't depend on its place
    powers = lambda base: np.cumprod(np.append(np.uint64(1), np.full(len(data), base, np.uint64)))
    sums = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BYTE)[:-1]))
    words = (sums[last] - sums[first]) * powers(pow(BYTE, -1, 1 << 64))[first]
    words = (words ^ (words >> np.uint64(29))) * np.uint64(PLACE)
    factors = np.cumprod(np.full(width, PLACE, np.uint64))
    at = np.searchsorted(first, ends)
    counts, owner = np.diff(at), np.repeat(np.arange(len(texts)), np.diff(at))
    whole = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        whole += words[k : k + len(whole)] * factors[k]
    inner = np.flatnonzero(owner[: len(whole)] == owner[width - 1 :]) if len(whole) else np.zeros(0, np.int64)
    short = np.flatnonzero(counts < width)
    part = np.zeros(len(short), np.uint64)
    for k in range(width - 1):
        some = counts[short] > k
        part[some] += words[at[short[some]] + k] * factors[k]
    return np.concatenate([whole[inner], part]), np.concatenate([owner[inner], short])


def _pieces(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Rows with a text, about ``PIECE`` bytes of it at once, one row at least."""
    for batch in batches:
        batch = batch.filter(pc.is_valid(batch.column(text)))
        ends, at = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(False)), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
            yield batch.slice(at, to - at)
            at = to


def holding_any(docs: DataFrame, items: DataFrame, width: int = 8) -> DataFrame:
    """Those of ``docs`` (id, text) that may hold a run of ``width`` words of one of the few ``items`` (text), or all words of a shorter one:
    all that do and, as runs are told apart by 64 bits, hardly any other. The driver holds the items' hashes; texts stay where they lie."""
    hashed = items.select("text").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array(_windows(b.column(0), width)[0].view(np.int64))], ["hash"]) for b in _pieces(batches, 0)), "hash long")
    wanted = np.array([r[0] for r in hashed.distinct().collect()], np.int64).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, 1):
            hashes, owner = _windows(batch.column(1), width)
            kept = np.zeros(batch.num_rows, bool)
            kept[owner[np.isin(hashes, wanted)]] = True
            yield batch.filter(pa.array(kept))

    return docs.select("id", "text").mapInArrow(run, docs.select("id", "text").schema)


def relevant_ranks(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """Every query with a truth: its size and the ranks of relevant results, in order."""
    met = truth.join(ranked.select("query_id", "id", "rank").hint("merge"), ["query_id", "id"], "left")  # the truth is computed once
    return met.groupBy("query_id").agg(F.count_distinct("id").alias("relevant"), F.array_sort(F.collect_list("rank")).alias("ranks"))


def retrieval_metrics(ranked: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """recall, precision, hit and NDCG at k, and the reciprocal rank, of each query."""
    ranks = F.coalesce("ranks", F.array().cast("array<int>"))
    inside = F.size(F.filter(ranks, lambda r: r <= k))
    gain = F.aggregate(F.filter(ranks, lambda r: r <= k), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + F.lit(1.0)))
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + F.lit(1.0)))
    return relevant_ranks(ranked, truth).select(
        "query_id", (inside / F.col("relevant")).alias("recall"), (inside / k).alias("precision"), (inside > 0).cast("int").alias("hit"),
        (gain / best).alias("ndcg"), F.coalesce(1 / F.get(ranks, F.lit(0)), F.lit(0.0)).alias("reciprocal_rank"),
    )


def mean_reciprocal_rank(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)).alias("mrr"), F.count(F.lit(1)).alias("queries"))


def groundedness(answer: Column, source: Column) -> Column:
    """Share of an answer's different words that its sources have."""
    words = F.array_distinct(_words(answer))
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, _words(source))) / F.size(words)).otherwise(0.0)


def completeness(answer: Column, question: Column) -> Column:
    n, asked = F.size(_words(answer)), F.size(_words(question))
    return F.when((n == 0) | (asked == 0), 0.0).otherwise(F.least(F.lit(1.0), n / F.greatest(F.lit(10), 2 * asked)))


def faithfulness(answer: Column, source: Column) -> Column:
    doubt = "|".join(CONTRAST)
    return F.when(F.coalesce(answer, F.lit("")) == "", 0.0).when(source.isNull(), 1.0).when(~F.lower(answer).rlike(doubt), 1.0).when(F.lower(source).rlike(doubt), 0.8).otherwise(0.5)


def supports(answer: Column, content: Column) -> Column:
    """Whether a passage holds one of the answer's first five words of four letters or more."""
    return F.exists(F.slice(_words(answer), 1, 5), lambda w: (F.length(w) > 3) & F.contains(F.lower(content), w))


def citation_support(cited: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Support and wrong rates of (query_id, answer, content) rows; null content is a wrong citation.

    With ``answers`` (query_id) those that cite nothing have the rates 1 and 0.
    """
    good = F.coalesce(supports(F.col("answer"), F.col("content")), F.lit(False))
    found = cited.groupBy("query_id").agg(F.avg(good.cast("double")).alias("support_rate"), F.avg((~good).cast("double")).alias("wrong_rate"))
    if answers is None:
        return found
    every = answers.select("query_id").distinct().join(found.hint("merge"), "query_id", "left")
    return every.select("query_id", F.coalesce("support_rate", F.lit(1.0)).alias("support_rate"), F.coalesce("wrong_rate", F.lit(0.0)).alias("wrong_rate"))


def long_metrics(wide: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, metric_type, metric_value) without metrics that are absent."""
    return wide.unpivot(key, names, "metric_type", "metric_value").where("metric_value IS NOT NULL")


def summary(metrics: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """Mean of each metric over the chosen runs."""
    return metrics.join(runs.select(key).distinct(), key, "left_semi").groupBy("metric_type").agg(F.avg("metric_value").alias("mean"), F.count(F.lit(1)).alias("n"))


def with_metadata(metrics: DataFrame, *fields: str) -> DataFrame:
    """``metrics`` with ``metadata``, a VARIANT object of some of its columns, which leave: k, counts, lists of mixed types.

    Kinds of metrics have different fields; a null field isn't in the object. Read one with ``variant_get``.
    """
    return metrics.withColumn("metadata", F.parse_json(F.to_json(F.struct(*fields)))).drop(*fields)


#: The columns of an export, in their order.
EXPORTED = ["run_id", "notebook_id", "query", "status", "metric_type", "metric_value", "created_at", "completed_at", "metadata"]


def metrics_export(runs: DataFrame, metrics: DataFrame, kinds: list[str] | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """A row (``EXPORTED``) for each metric of the chosen runs, newest runs first; metadata as JSON.

    Runs of a time range (created_at) are chosen, and with ``kinds`` those that have one of these metrics, with all
    their metrics. Runs without metrics have no row.
    """
    chosen = in_time_range(runs, "created_at", start, end)
    if kinds is not None:
        chosen = chosen.join(metrics.where(F.col("metric_type").isin(kinds)).select("run_id"), "run_id", "left_semi")
    shown = F.to_json("metadata").alias("metadata") if "metadata" in metrics.columns else F.lit(None).cast("string").alias("metadata")
    joined = chosen.hint("merge").join(metrics.select("run_id", "metric_type", "metric_value", shown), "run_id")
    return joined.select(*EXPORTED).orderBy(F.desc("created_at"), "run_id", "metric_type")


def runs_with_metrics(runs: DataFrame, metrics: DataFrame, key: str, kinds: list[str] | None = None, time: str | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Runs of a time range, with ``metrics``: their (metric_type, metric_value) by type, empty if they have none.

    With ``kinds`` only runs that have one of these metrics stay, with all their metrics. A run has few metrics.
    """
    chosen = runs if time is None else in_time_range(runs, time, start, end)
    if kinds is not None:
        chosen = chosen.join(metrics.where(F.col("metric_type").isin(kinds)).select(key), key, "left_semi")
    rows = metrics.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("metric_type", "metric_value"))).alias("metrics"))
    none = F.array().cast("array<struct<metric_type: string, metric_value: double>>")
    return chosen.join(rows, key, "left").withColumn("metrics", F.coalesce("metrics", none))


def run_score(metrics: DataFrame, key: str) -> DataFrame:
    """Mean of the quality metrics of a run, else its first metric, and a band."""
    quality = F.col("metric_type").rlike("faithfulness|groundedness|completeness|support")
    scored = metrics.groupBy(key).agg(F.coalesce(F.avg(F.when(quality, F.col("metric_value"))), F.min_by("metric_value", "metric_type")).alias("score"))
    percent = F.col("score") * 100
    return scored.withColumn("band", F.when(percent < 60, "low").when(percent < 80, "medium").otherwise("high"))


def describe(metrics: DataFrame) -> DataFrame:
    v = F.col("metric_value")
    return metrics.groupBy("metric_type").agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


# A prime, factors of a row's number and of the round, and where Poisson's distribution function of mean 1 steps up.
PRIME, FACTORS, STEPS = 1_000_003, (48_271, 69_621), (0.367879, 0.735759, 0.919699, 0.981012, 0.996340)


def draws(numbers: np.ndarray, rounds: int) -> np.ndarray:
    """How often each row is drawn in each round: 0 to 5, from its number alone, so that SQL can draw alike."""
    mixed = (numbers % PRIME * FACTORS[0] % PRIME)[:, None] + (np.arange(1, rounds + 1) * FACTORS[1] % PRIME)[None, :]
    mixed = mixed % PRIME
    mixed = (mixed * mixed % PRIME * mixed + (numbers // PRIME)[:, None]) % PRIME
    return np.searchsorted(np.array(STEPS), mixed / PRIME, side="right")


def _weighted_sums(rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            names, values, numbers = batch.column(0).to_pylist(), batch.column(1).to_numpy(False), batch.column(2).to_numpy(False)
            at = np.array([held.setdefault(x, [len(held), np.zeros(rounds), np.zeros(rounds, np.int64), 0.0, 0])[0] for x in names], np.int64)
            for name, sums in held.items():
                mine = np.flatnonzero(at == sums[0])
                for k in range(0, len(mine), 4096):
                    some = mine[k : k + 4096]
                    drawn = draws(numbers[some], rounds)
                    sums[1] += values[some] @ drawn
                    sums[2] += drawn.sum(0)
                    sums[3] += values[some].sum()
                    sums[4] += len(some)
        if held:
            columns = list(zip(*held.values(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(columns[1]), pa.list_(pa.float64())), pa.array(list(columns[2]), pa.list_(pa.int64())), pa.array(columns[3], pa.float64()), pa.array(columns[4], pa.int64())],
                ["metric_type", "sums", "weights", "total", "n"],
            )

    return run


def bootstrap(metrics: DataFrame, rounds: int = 1000, seed: int = 11) -> DataFrame:
    """95 % interval of each metric's mean, from Poisson weights drawn by hash of seed and key.

    One pass: a task adds up ``rounds`` weighted sums of each metric as one array, and sends one row a metric. A round
    in which all weights are 0 counts with the plain mean. Rows without a value are left out.
    """
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long")
    rows = metrics.where("metric_value IS NOT NULL").select("metric_type", F.col("metric_value").cast("double"), number.alias("number"))
    parts = rows.mapInArrow(_weighted_sums(rounds), "metric_type string, sums array<double>, weights array<long>, total double, n long")
    each = parts.select("metric_type", "total", "n", F.posexplode(F.arrays_zip("sums", "weights")).alias("round", "z"))
    means = each.groupBy("metric_type", "round").agg((F.sum("z.sums") / F.nullif(F.sum("z.weights"), F.lit(0))).alias("m"), (F.sum("total") / F.sum("n")).alias("plain"))
    return means.groupBy("metric_type").agg(F.percentile(F.coalesce("m", "plain"), 0.025).alias("low"), F.percentile(F.coalesce("m", "plain"), 0.975).alias("high"))


def kappa(pairs: DataFrame) -> DataFrame:
    """Cohen's kappa of labels (a, b): agreement beyond chance, from the contingency table."""
    cells = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))).alias("same"))
    rows, cols = (cells.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias(f"n_{c}")) for c in ("a", "b"))
    chance = rows.join(cols, "label").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("c"))
    both = total.withColumn("one", F.lit(1)).join(F.broadcast(chance.withColumn("one", F.lit(1))), "one")  # one row each
    observed, expected = F.col("same") / F.col("t"), F.col("c") / (F.col("t") * F.col("t"))
    return both.select(observed.alias("agreement"), ((observed - expected) / (1 - expected)).alias("kappa"))


def spearman(pairs: DataFrame, by: str) -> DataFrame:
    """Rank correlation of (a, b) in each group, ties with their mean rank."""
    def ranks(c: str) -> Column:
        w = Window.partitionBy(by).orderBy(c)
        return F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(by, c)) - 1) / 2

    return pairs.select(by, ranks("a").alias("ra"), ranks("b").alias("rb")).groupBy(by).agg(F.corr("ra", "rb").alias("spearman"))


def kolmogorov_smirnov(pairs: DataFrame, by: str) -> DataFrame:
    """The largest gap between the distribution functions of a and b in each group."""
    rows = pairs.select(by, F.inline(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b")), F.struct(F.col("b").alias("v"), F.lit(0).alias("in_a"), F.lit(1).alias("in_b"))))).where("v IS NOT NULL")
    steps = rows.groupBy(by, "v").agg(F.sum("in_a").alias("na"), F.sum("in_b").alias("nb"))
    sums, whole = Window.partitionBy(by).orderBy("v"), Window.partitionBy(by)
    share = lambda c: F.sum(c).over(sums) / F.sum(c).over(whole)
    return steps.select(by, F.abs(share("na") - share("nb")).alias("gap")).groupBy(by).agg(F.max("gap").alias("ks"))


def ab_test(metrics: DataFrame, variant: str, first: str, second: str, z: float = 1.96) -> DataFrame:
    """Each metric's means under two variants, their difference, its interval, and whether that leaves 0 out."""
    v = F.col("metric_value")

    def side(name: str, tag: str) -> list[Column]:
        mine = F.when(F.col(variant) == name, v)
        return [F.avg(mine).alias(f"mean_{tag}"), (F.var_samp(mine) / F.count(mine)).alias(f"error_{tag}"), F.count(mine).alias(f"n_{tag}")]

    both = metrics.groupBy("metric_type").agg(*side(first, "a"), *side(second, "b"))
    change, width = F.col("mean_b") - F.col("mean_a"), z * F.sqrt(F.col("error_a") + F.col("error_b"))
    return both.select("metric_type", "mean_a", "mean_b", "n_a", "n_b", change.alias("change"), (change - width).alias("low"), (change + width).alias("high"), (F.abs(change) > width).alias("significant"))


def regressions(metrics: DataFrame, order: str, z: float = 1.96) -> DataFrame:
    """Run groups whose mean of a metric lies below the one before by more than the interval of both."""
    v = F.col("metric_value")
    means = metrics.groupBy(order, "metric_type").agg(F.avg(v).alias("mean"), F.coalesce(F.var_samp(v) / F.count(v), F.lit(0.0)).alias("error"))
    w = Window.partitionBy("metric_type").orderBy(order)
    both = means.withColumns({"before": F.lag("mean").over(w), "before_error": F.lag("error").over(w)})
    return both.where(F.col("mean") < F.col("before") - z * F.sqrt(F.col("error") + F.col("before_error"))).select(order, "metric_type", "mean", "before")


def compare_runs(metrics: DataFrame, order: str, digits: int = 6) -> DataFrame:
    """Each metric's mean by run group, rounded, and its change from the one before."""
    means = metrics.groupBy(order, "metric_type").agg(F.round(F.avg("metric_value"), digits).alias("mean"))
    return means.withColumn("change", F.col("mean") - F.lag("mean").over(Window.partitionBy("metric_type").orderBy(order)))
