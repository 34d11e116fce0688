"""What the findings of round 4 found, each by a case that failed before."""

import re
import time
from itertools import combinations

from pyspark.sql import functions as F

from corpusloom.operators import evaluation, profiles, retrieval
from corpusloom.plans import base, search


def _overlaps(rows):
    """Pairs of classes that share a term, by plain sets."""
    sets, classes = {}, {}
    for scope, i, term in rows:
        sets.setdefault((scope, i), set()).add(term)
    for (scope, i), terms in sorted(sets.items()):
        classes.setdefault((scope, frozenset(terms)), []).append(i)
    met = combinations(sorted(classes.items(), key=lambda x: x[1][0]), 2)
    return sorted((s, x[0], y[0], len(x), len(y), len(a & b), len(a & b) / len(a | b)) for ((s, a), x), ((t, b), y) in met if s == t and a & b)


def test_blocks_of_a_scope_meet_once(spark, monkeypatch):
    """Scopes of several blocks, looked at in small goes; ids are numbers or names."""
    rows = [(f"s{k % 3 // 2}", k, f"t{(k + 3) * j % 17}") for k in range(90) for j in range(1, 5)]
    plain = profiles.source_overlap(spark.createDataFrame(rows, "scope string, id int, term string"), "scope", "id")
    assert plain.dtypes == [("scope", "string"), ("a", "int"), ("b", "int"), ("sources_a", "bigint"), ("sources_b", "bigint"), ("shared", "bigint"), ("overlap", "double")]
    for name, value in (("MEETING", 7), ("PAIRS", 20)):
        monkeypatch.setattr(profiles, name, value, raising=False)
    named = [(s, f"n{i:03}", t) for s, i, t in rows]
    for given, kind in ((rows, "int"), (named, "string")):
        made = profiles.source_overlap(spark.createDataFrame(given, f"scope string, id {kind}, term string"), "scope", "id")
        assert sorted(map(tuple, made.collect())) == _overlaps(given)
    assert sorted(map(tuple, plain.collect())) == _overlaps(rows)


def test_pairs_that_share_nothing_cost_little(spark):
    """One scope of 16,000 sources, 128 million pairs, hardly any of which share a word: each pair's sets were intersected, twice."""
    rows = spark.range(16_000).select(F.lit("s").alias("scope"), "id", F.explode(F.sequence(F.lit(0), F.lit(14))).alias("j"))
    words = rows.select("scope", "id", F.concat_ws("x", "j", F.when(F.col("j") == 0, F.col("id") % 8000).otherwise(F.col("id"))).alias("term"))
    began = time.time()
    found = profiles.source_overlap(words, "scope", "id")
    assert found.agg(F.count(F.lit(1)), F.sum(F.col("b") - F.col("a")), F.max("shared")).first()[:] == (8000, 8000 * 8000, 1)
    assert time.time() - began < 20


def test_known_queries_are_met_in_one_pass(spark, monkeypatch):
    """What the index finds, with ties, null texts and words that no passage has; a few terms and queries at a time."""
    text = F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), (F.col("id") * k % 5).cast("string")) for k in range(1, 8)], F.when(F.col("id") % 3 == 0, "w1x1 Ünï"))
    rows = spark.range(200).select(F.when(F.col("id") % 4 == 0, "b").otherwise("a").alias("scope"), "id", F.when(F.col("id") % 50 != 7, text).alias("text")).repartition(3)
    asked = spark.createDataFrame([(9, "a", "w1x1 w2x2 w2x2 ünï"), (2, "b", "W3x1 none"), (3, "a", "none"), (4, "a", "w7x3 w1x0 w4x4"), (5, "c", "w1x1"), (6, "a", "w5x0")], "query_id int, scope string, query string")
    monkeypatch.setattr(retrieval, "MET", 50)
    monkeypatch.setattr(retrieval, "ASKED", 2)
    wanted = retrieval.asked_terms(asked)
    for k in (3, 500):
        found = retrieval.bm25_pass(asked, wanted, retrieval.counted_terms(rows, wanted), k=k)
        plain = retrieval.bm25_search(asked, rows, k=k, pad_zero=False).select("query_id", "id", "score", "rank")
        assert found.dtypes == plain.dtypes
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    monkeypatch.setattr(retrieval, "few", lambda rows: False)
    assert retrieval.asked_terms(asked) is None


def test_one_run_over_the_corpus_needs_no_index(spark, sf, monkeypatch):
    """mean_reciprocal_rank had the postings of every word of every document shuffled and written."""
    def none(*args, **more):
        raise AssertionError("an index was built")

    monkeypatch.setattr(retrieval, "store_index", none)
    monkeypatch.setattr(base, "_stored", {})
    found = search.mean_reciprocal_rank(spark, sf)
    assert found.count() == 1 and found.first()["queries"] > 0


def test_documents_that_may_hold_an_item(spark):
    """Runs of words against plain Python: odd white space, short and empty texts, items next to each other."""
    items = ["a b c d", "x  y", "", "é ß\tç ñ"]
    docs = ["a b c", "z a\nb\r\nc z", "a b", "b c d e", "xx y", "x y", " x\x0by ", "x y z", "", " \t", "ß ç ñ", "é ß", "ab c", "c a b", None, "q " * 50 + "a b c", "a b c d e"]
    table = spark.createDataFrame(list(enumerate(docs)), "id long, text string").coalesce(1)
    found = evaluation.holding_any(table, spark.createDataFrame([(t,) for t in items], "text string"), 3)
    wanted = {tuple(w) for t in items for w in _runs(t)}
    assert sorted(r["id"] for r in found.collect()) == [i for i, t in enumerate(docs) if t is not None and {tuple(w) for w in _runs(t)} & wanted]


def _runs(text):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
    return [words[i : i + 3] for i in range(max(1, len(words) - 2))]
