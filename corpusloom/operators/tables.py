"""Relational operators on jobs, messages and sources: status, latest rows, usage, replacing and deleting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import GENERIC_TERMS, STOPWORDS, TOPIC_TOKEN, WORD_TOKEN, bind, collapse, token_estimate


def effective_status(ingestion: Column, source: Column) -> Column:
    return F.coalesce(ingestion, source)


def retryable_sources(sources: DataFrame, status: str = "status") -> DataFrame:
    return sources.where(F.col(status).isin("pending", "failed"))


def resolved(status: Column) -> Column:
    return status.isin("ready", "failed")


def status_counts(jobs: DataFrame, by: str, names: list[str], status: str = "status") -> DataFrame:
    """Jobs of each status, 0 where there are none."""
    return jobs.groupBy(by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(status) == s).alias(f"n_{s}") for s in names])


def latest(rows: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The newest row of each key; of equal times the larger id."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time), F.desc(tie)))
    return rows.withColumn("place", place).where("place = 1").drop("place")


def last_messages(messages: DataFrame, by: str, time: str, n: int) -> DataFrame:
    """The last n messages of each conversation; their order is ``time``."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(time)))
    return messages.withColumn("back", place).where(F.col("back") <= max(n, 0))


def last_user_turns(messages: DataFrame, by: str, time: str, n: int, role: str = "role", text: str = "text") -> DataFrame:
    """Messages from the n-th last user message on; blank messages are passed over."""
    spoken = messages.where(F.trim(F.coalesce(text, F.lit(""))) != "")
    later = F.count_if(F.col(role) == "user").over(Window.partitionBy(by).orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, -1))
    return spoken.withColumn("later_users", F.coalesce(later, F.lit(0))).where(F.col("later_users") < n)


def question_pairs(messages: DataFrame, by: str, time: str, role: str = "role", text: str = "text") -> DataFrame:
    """Each user message that an assistant answers next."""
    w = Window.partitionBy(by).orderBy(time)
    both = messages.withColumns({"next_role": F.lead(role).over(w), "answer": F.lead(text).over(w)})
    return both.where((F.col(role) == "user") & (F.col("next_role") == "assistant")).select(by, time, F.col(text).alias("question"), "answer")


def bigrams(words: Column) -> Column:
    pairs = lambda ws: F.when(F.size(ws) > 1, F.transform(F.slice(ws, 1, F.size(ws) - 1), lambda w, i: F.concat(w, F.lit(" "), F.element_at(ws, i + 2)))).otherwise(F.array().cast("array<string>"))
    return bind(words, pairs)  # else the words would be found anew for each of them


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


#: Numbers of the order column that share a segment of a running sum.
SEGMENT = 10_000


def running(rows: DataFrame, by: str, order: str, value: Column, segment: int = SEGMENT) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over all rows of the same ``by`` that come earlier in ``order``, a whole number column.

    In two levels: sums of segments of the order, at most one row to ``segment`` numbers, get running totals of their own;
    rows are summed inside their segment. So one large group is many tasks. Rows without an order come first.
    """
    cut = F.coalesce(F.floor(F.col(order) / segment), F.lit(-(1 << 62))).cast("long")
    rows = rows.withColumns({"_segment": cut, "_value": value})
    earlier = Window.partitionBy(by).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(by, "_segment").agg(F.sum("_value").alias("_sum")).select(F.col(by).alias("_by"), F.col("_segment").alias("_at"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carried"))
    inside = Window.partitionBy(by, "_segment").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    met = summed.join(totals.hint("merge"), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_segment") == F.col("_at")))
    return met.withColumn("before", F.col("_inside") + F.col("_carried")).drop("_by", "_at", "_carried", "_inside", "_segment", "_value")


def batches(rows: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """Number batches of fixed size inside each group, in the order of a whole number column."""
    return running(rows, by, order, F.lit(1)).withColumn("batch", F.floor(F.col("before") / size)).drop("before")


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All of ``new``, and the rows of ``old`` whose key it doesn't have."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Latest row wins, one a key."""
    every = old.withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1)))
    return every.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("turn")))).where("place = 1").drop("turn", "place")


def cascade_delete(gone: DataFrame, key: str, *children: DataFrame) -> list[DataFrame]:
    return [c.join(gone.select(key), key, "left_anti") for c in children]


def soft_delete(rows: DataFrame, condition: Column, at: Column) -> DataFrame:
    return rows.withColumn("deleted_at", F.when(condition, F.coalesce("deleted_at", at)).otherwise(F.col("deleted_at")))


def live(rows: DataFrame) -> DataFrame:
    return rows.where("deleted_at IS NULL")


def live_jobs(jobs: DataFrame, sources: DataFrame, notebooks: DataFrame) -> DataFrame:
    """Jobs (job_id, source_id) with their source (source_id, notebook_id), of notebooks that aren't deleted."""
    here = live(notebooks).select("notebook_id")
    return jobs.join(sources, "source_id").join(here, "notebook_id", "left_semi")


def live_sources(asked: DataFrame, sources: DataFrame, notebooks: DataFrame, owner: Column | None = None) -> DataFrame:
    """Each asked source_id with ``found``: whether it exists in a notebook that isn't deleted, of ``owner`` if given."""
    here = live(notebooks if owner is None else notebooks.where(F.col("owner") == owner)).select("notebook_id")
    known = sources.join(here, "notebook_id", "left_semi").select("source_id").distinct().withColumn("found", F.lit(True))
    return asked.select("source_id").distinct().join(known, "source_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def reset_ingestion(sources: DataFrame, jobs: DataFrame, chunks: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources pending again without an error, and jobs and chunks without those of the ``chosen`` source_id."""
    picked = chosen.select("source_id").distinct().withColumn("_again", F.lit(True))
    again = F.coalesce("_again", F.lit(False))
    fresh = sources.join(picked, "source_id", "left").withColumns({"status": F.when(again, "pending").otherwise(F.col("status")), "error_message": F.when(again, None).otherwise(F.col("error_message"))}).drop("_again")
    return fresh, *[t.join(picked, "source_id", "left_anti") for t in (jobs, chunks)]


def newest_first(rows: DataFrame, time: str, tie: str) -> DataFrame:
    return rows.orderBy(F.col(time).desc_nulls_last(), tie)


def total_pages(rows: DataFrame, size: int) -> DataFrame:
    """(total, pages) of a listing."""
    return rows.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / size))


def in_time_range(rows: DataFrame, time: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Rows from ``start`` to ``end``, both included; an end that isn't given is open."""
    for limit, keep in ((start, lambda v: F.col(time) >= v), (end, lambda v: F.col(time) <= v)):
        rows = rows if limit is None else rows.where(keep(limit))
    return rows


def pending(jobs: DataFrame, by: str, status: str = "status") -> DataFrame:
    """Whether a group still has jobs that aren't resolved, and how many jobs it has."""
    return jobs.groupBy(by).agg(F.bool_or(~resolved(F.col(status))).alias("has_pending"), F.count(F.lit(1)).alias("n"))


def cost(tokens: Column, rate: Column) -> Column:
    """Tokens by the thousand times a rate; null without a rate."""
    return tokens / 1000 * rate


def chat_cost(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    """One missing rate borrows the other."""
    return cost(tokens_in, F.coalesce(rate_in, rate_out)) + cost(tokens_out, F.coalesce(rate_out, rate_in))


def usage(messages: DataFrame, by: str, role: str = "role", text: str = "text") -> DataFrame:
    """Estimated tokens in and out of each conversation."""
    n = token_estimate(F.concat(F.col(role), F.lit("\n"), F.col(text)))
    said = token_estimate(F.col(text))
    return messages.groupBy(by).agg(F.sum(F.when(F.col(role) != "assistant", n).otherwise(0)).alias("tokens_in"), F.sum(F.when(F.col(role) == "assistant", said).otherwise(0)).alias("tokens_out"))


def merge_usage(rows: DataFrame, by: str) -> DataFrame:
    """Sums of usage rows; sums of optional fields are null if all are; where the figures come from."""
    kinds = F.array_sort(F.collect_set("origin"))
    origin = F.when(F.size(kinds) == 0, "none").when(F.size(kinds) == 1, F.get(kinds, F.lit(0))).otherwise("mixed")
    return rows.groupBy(by).agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost").alias("cost"), origin.alias("origin"))


def history_topics(messages: DataFrame, by: str, order: str, text: str = "text", most: int = 6) -> DataFrame:
    """A conversation's topics: identifiers in order, then word pairs and then words, the frequent first.

    An identifier has a capital, a digit or one of _ - . / : in it. Stop words don't count; a topic comes once,
    whatever its case; of equal counts the one seen first is first.
    """
    plain = lambda t: ~F.array_contains(F.array(*[F.lit(w) for w in [*STOPWORDS, *GENERIC_TERMS]]), F.lower(t))
    flat = collapse(F.col(text))
    names = F.filter(F.regexp_extract_all(flat, F.lit(TOPIC_TOKEN), F.lit(0)), lambda t: plain(t) & t.rlike(r"[A-Z0-9_\-./:]"))
    words = F.transform(F.filter(F.regexp_extract_all(flat, F.lit(WORD_TOKEN), F.lit(0)), plain), F.lower)
    tag = lambda items, kind: F.transform(items, lambda t: F.struct(t.alias("label"), F.lit(kind).alias("kind")))
    every = F.concat(tag(names, 0), tag(bigrams(words), 1), tag(words, 2))
    each = messages.select(by, order, F.posexplode(every).alias("pos", "_t")).select(by, order, "pos", "_t.*")
    found = each.groupBy(by, F.lower("label").alias("topic"), "kind").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(order, "pos", "label")).alias("first"))
    once = found.withColumn("turn", F.row_number().over(Window.partitionBy(by, "topic").orderBy("kind"))).where("turn = 1")
    rank = F.row_number().over(Window.partitionBy(by).orderBy("kind", F.when(F.col("kind") > 0, -F.col("n")).otherwise(0), "first"))
    return once.withColumn("rank", rank).where(F.col("rank") <= most).select(by, "rank", F.col("first.label").alias("topic"), "kind", "n")


def share_of_total(rows: DataFrame, by: str, stage: str, value: str) -> DataFrame:
    """Each stage's share of its group's total."""
    sums = rows.groupBy(by, stage).agg(F.sum(value).alias("value"))
    return sums.withColumn("share", F.col("value") / F.sum("value").over(Window.partitionBy(by)))


def stratified(rows: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """n rows of each stratum, by hash of their key."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.md5(F.col(key).cast("string")), key))
    return rows.withColumn("place", place).where(F.col("place") <= n).drop("place")


def poor_question(question: Column, passage: Column) -> Column:
    """Why a made-up question isn't wanted: too short, yes or no, or a copy of its passage."""
    words = F.array_distinct(F.split(F.lower(collapse(question)), " "))
    copied = F.size(F.array_intersect(words, F.split(F.lower(collapse(passage)), " "))) / F.size(words)
    return F.when(F.size(F.split(collapse(question), " ")) < 5, "short").when(F.lower(question).rlike(r"^(is|are|do|does|did|can|was|were|will|has|have)(?![\p{L}\p{M}\p{N}_])"), "yes or no").when(copied > 0.8, "copy")
