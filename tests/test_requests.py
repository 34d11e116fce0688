import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import requests


def test_recover_json(spark):
    raw = ['x {"a": 1} y {"overview": "o", "themes": []} z', "no object {", None, '{"a": {"overview": "in"}}']
    got = [r["object"] for r in requests.recover_json(spark.createDataFrame(list(enumerate(raw)), "k int, t string"), "t").orderBy("k").collect()]
    assert json.loads(got[0])["overview"] == "o" and got[1] is None and got[2] is None and json.loads(got[3])["overview"] == "in"


def test_rewrites_are_gated_and_checked(spark):
    asked = spark.createDataFrame([(1, "what does it do", True), (2, "`x` fails", True), (3, "how about Kafka", True), (4, "why so", True)], "request_id int, query string, has_history boolean")
    outputs = spark.createDataFrame([(1, '```json\n{"query": "what does it do in Spark", "search_queries": ["spark job", "Spark job"]}\n```'), (2, '{"query": "other"}'), (3, '{"query": "tell me more"}')], "request_id int, raw string")
    got = {r["request_id"]: (r["final_query"], r["searches"], r["rewritten"]) for r in requests.apply_rewrites(asked, outputs).collect()}
    assert got[1] == ("what does it do in Spark", ["spark job"], True)
    assert got[2] == ("`x` fails", ["`x` fails"], False) and not got[3][2] and not got[4][2]


def test_rewrites_that_do_not_count(spark):
    """A fence, a strategy that isn't allowed, dropped terms: the request is its own search, without a rewrite. Searches may keep the terms."""
    asked = spark.createDataFrame([(k, "what about Kafka_x", True) for k in range(5)], "request_id int, query string, has_history boolean")
    said = lambda **x: json.dumps({"strategy": "keyword_enrichment"} | x)
    raw = [said(query="what about kafka_X logs"), said(query="logs", search_queries=["Kafka_x logs"]), said(query="``` Kafka_x"), said(query="logs"), None]
    outputs = spark.createDataFrame(list(enumerate(raw)), "request_id int, raw string")
    got = {r["request_id"]: (r["strategy"], r["final_query"], r["rewritten"]) for r in requests.apply_rewrites(asked, outputs).collect()}
    kept = ("no_rewrite", "what about Kafka_x", False)
    assert got == {0: ("keyword_enrichment", "what about kafka_X logs", True), 1: ("keyword_enrichment", "logs", True), 2: kept, 3: kept, 4: kept}
    assert {tuple(r) for r in requests.apply_rewrites(asked, outputs, ["keyword_enrichment"]).select("strategy", "rewritten").collect()} == {("no_rewrite", False)}


def test_phrases_are_found_as_contains_finds_them(spark, monkeypatch):
    texts = ["The cat sat.", "concatenate CATS", None, "", "a b c", "ÀÉ été"]
    phrases = ["cat", " Cat ", "at", "b", "été", "zz", "", "  ", None, "the cat"]
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "id int, text string, phrase string").repartition(3)
    wanted = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    got = sorted(map(tuple, requests.phrase_matches(rows, wanted, "id", "text").collect()))
    assert got == sorted((k, p) for k, t in enumerate(texts) for p in {(p or "").strip().lower() for p in phrases} if p and t and p in t.lower())
    assert requests.phrase_matches(rows, wanted.limit(0), "id", "text").count() == 0
    monkeypatch.setattr(requests, "PHRASES", 3)
    with pytest.raises(ValueError, match="phrases"):
        requests.phrase_matches(rows, wanted, "id", "text")


def test_budget_passes_over_what_does_not_fit(spark):
    rows = spark.createDataFrame([("s", 1, 5), ("s", 2, 9), ("s", 3, 4), ("t", 1, 99)], "s string, o int, n int")
    assert sorted((r["s"], r["o"]) for r in requests.within_budget(rows, "s", "o", "n", 10).collect()) == [("s", 1), ("s", 3)]
    order = [r["i"] for r in spark.range(9).select(F.col("id").alias("i")).orderBy(requests.priority(F.col("i"), F.lit(9))).collect()]
    assert order[:5] == [0, 8, 4, 2, 6]


def test_history_and_search(spark):
    said = spark.createDataFrame([(1, 0, "user", "a  b"), (1, 1, "assistant", "c" * 50), (1, 2, "user", "d"), (1, 3, "user", " ")], "c int, t int, role string, text string")
    assert requests.history_context(said, "c", "t", 20).first()["history"] == "user: d"
    rows = spark.createDataFrame([("Abc", None), ("x", "ABC"), ("y", None)], "content string, title string")
    assert requests.text_search(rows, F.lit("abc")).count() == 2 and requests.text_search(rows, F.lit(" ")).count() == 3
