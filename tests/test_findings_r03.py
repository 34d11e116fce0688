"""A case for each finding of the third round that was mended."""

import re
import time

import duckdb
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import evaluation, profiles, retrieval, tables
from corpusloom.plans import corpus, search
from corpusloom.sources import web


def test_digest_of_a_long_text_takes_one_pass(spark):
    """Five thousand different sentences: looking through all of them once for each would take minutes."""
    text = " ".join(f"Sentence number {k} says {k * 7919}." for k in range(5000))
    rows = spark.createDataFrame([(1, text)], "id int, text string").repartition(1)
    began = time.time()
    found = rows.select(tx.ordered_distinct(tx.snapshot_sentences(F.col("text")), 5).alias("a"), F.size(tx.ordered_distinct(tx.snapshot_sentences(F.concat_ws(" ", "text", F.upper("text"))))).alias("n")).first()
    assert found["a"] == [f"Sentence number {k} says {k * 7919}." for k in range(5)] and found["n"] == 5000
    assert time.time() - began < 20


def test_trimming_keeps_the_longest_run(spark):
    """Against every run's own estimate, in texts of mixed scripts."""
    for text in ("alpha βητα gamma 中文字 delta " * 9, "жёлтый дом стоит " * 12, "漢字 かな mixed tail " * 15):
        words = text.split()
        heads = spark.createDataFrame([(k, " ".join(words[:k])) for k in range(1, len(words) + 1)], "k int, head string")
        sizes = {r["k"]: r["n"] for r in heads.select("k", tx.token_estimate(F.col("head")).alias("n")).collect()}
        for budget in (1, 7, 20):
            best = max([k for k, n in sizes.items() if n <= budget], default=0)
            assert heads.limit(1).select(tx.trim_to_tokens(F.lit(text), budget)).first()[0] == " ".join(words[:best])


def test_keywords_move_a_text_once(spark):
    chunks = spark.createDataFrame([(1, 0, "alpha beta alpha")], "id int, chunk_index int, content string")
    plan = profiles.keywords(chunks)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_a_single_scope_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """One scope lies in one bucket, whose postings were one file whatever their number."""
    monkeypatch.setattr(retrieval, "PER_FILE", 1000)
    rows = spark.range(500).select(F.lit("all").alias("scope"), "id", F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), (F.col("id") * k % 97).cast("string")) for k in range(1, 17)]).alias("text"))
    retrieval.store_index(rows, str(tmp_path / "index"))
    assert len(list((tmp_path / "index" / "postings").glob("version=1/bucket=[0-9]*/*.parquet"))) >= 4
    asked = spark.createDataFrame([(1, "all", "w1x5 w2x9")], "query_id int, scope string, query string")
    found = [(r["id"], r["score"]) for r in retrieval.bm25_search(asked, index=retrieval.load_index(spark, str(tmp_path / "index"), asked)).orderBy("rank").collect()]
    assert found == [(r["id"], r["score"]) for r in retrieval.bm25_search(asked, rows).orderBy("rank").collect()]


def test_the_truth_is_computed_once(spark, sf):
    """Its shingles neither move nor are they made twice."""
    plan = evaluation.relevant_ranks(spark.createDataFrame([(1, 2, 3)], "query_id int, id int, rank int"), search.truth(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") == 1 and "BroadcastHashJoin" in plan


def test_pairs_of_words_find_the_words_once(spark):
    """A message of 3,000 words: finding its words anew for each of them would take minutes."""
    rows = spark.createDataFrame([(1, 0, "user", " ".join(f"word{k}x" for k in range(3000)))], "conv_id int, turn int, role string, text string")
    began = time.time()
    assert tables.history_topics(rows, "conv_id", "turn").count() == 6 and time.time() - began < 20


def test_sql_of_pages_and_questions_on_cut_references_and_accents(spark):
    """A reference without its semicolon is one; a word goes on over an accented letter."""
    page = "<p>a &amp;&amp &copy b</p>"
    assert duckdb.sql(f"SELECT {corpus._HTML} AS t FROM (SELECT '{page}' AS html)").fetchall()[0][0] == "a && © b"
    assert spark.range(1).select(web.html_text(F.lit(page))).first()[0] == "a && © b"
    asked = ["Doó una dos tres cuatro", "Do you see this now"]
    found = [spark.range(1).select(tables.poor_question(F.lit(q), F.lit("other"))).first()[0] for q in asked]
    pattern = re.search(r"regexp_matches\(lower\(question\), ('\^\(is.*?')\)", search.ORACLE_SQL["poor_questions"])[1]
    assert [duckdb.sql(f"SELECT regexp_matches(lower('{q}'), {pattern})").fetchall()[0][0] for q in asked] == [p == "yes or no" for p in found] == [False, True]


def test_terms_need_no_postings(spark):
    rows = spark.createDataFrame([(1, "s", "one two two"), (2, "s", "two"), (3, "t", ""), (4, "u", None)], "id int, scope string, text string")
    made = retrieval.bm25_terms(rows)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, retrieval.bm25_index(rows).terms.collect()))
    assert "block" not in made._jdf.queryExecution().executedPlan().toString()


def test_metrics_make_chunks_once(spark, sf):
    plan = corpus.source_metrics(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("FileScan parquet") == 1


def test_pairs_of_sources_are_not_shuffled(spark):
    """Every pair once, against plain sets; nothing is grouped after the classes have met."""
    rows = [("s", k, f"t{k * j % 11}") for k in range(40) for j in range(1, 4)]
    made = profiles.source_overlap(spark.createDataFrame(rows, "scope string, id int, term string"), "scope", "id")
    sets, classes = {k: frozenset(t for _, i, t in rows if i == k) for k in range(40)}, {}
    for k in sorted(sets):
        classes.setdefault(sets[k], []).append(k)
    want = sorted((min(x, y), max(x, y), len(s & t)) for s, (x, *_) in classes.items() for t, (y, *_) in classes.items() if x < y and s & t)
    assert sorted((r["a"], r["b"], r["shared"]) for r in made.collect()) == want
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Exchange" not in plan.split("SortMergeJoin")[0]


def test_postings_are_met_once_where_they_lie(spark, tmp_path, monkeypatch):
    """Padding met them three times; a block's words lay in many files, so that all postings of the asked words were shuffled."""
    monkeypatch.setattr(retrieval, "PER_FILE", 500)
    words = F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), (F.col("id") * k % 7).cast("string")) for k in range(1, 9)])
    path, rows = str(tmp_path / "index"), spark.range(500).select(F.lit("all").alias("scope"), "id", words.alias("text"))
    retrieval.store_index(rows, path)
    files = spark.read.parquet(f"{path}/postings/version=1").select("scope", "block", F.input_file_name().alias("file")).distinct().groupBy("scope", "block").agg(F.count(F.lit(1)).alias("files"))
    assert files.agg(F.max("files")).first()[0] == 1
    asked = spark.createDataFrame([(1, "all", "w1x5 w2x3"), (2, "all", "nothing"), (3, "all", "w8x1")], "query_id int, scope string, query string")
    found = retrieval.bm25_search(asked, k=90, index=retrieval.load_index(spark, path, asked))
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert sum("FileScan" in line and "part#" in line for line in plan.splitlines()) == 1
    got = {q: [(r["id"], r["score"] > 0) for r in found.where(f"query_id = {q}").orderBy("rank").collect()] for q in (1, 2, 3)}
    assert all(len(x) == 90 for x in got.values()) and got[2] == [(k, False) for k in range(90)]
    matched = [k for k in range(500) if k * 8 % 7 == 1]
    assert sorted(k for k, hit in got[3] if hit) == matched and [k for k, hit in got[3] if not hit] == [k for k in range(500) if k not in matched][: 90 - len(matched)]
    monkeypatch.setattr(retrieval, "few", lambda rows: False)
    many = retrieval.bm25_search(asked, k=90, index=retrieval.load_index(spark, path, asked))
    assert sorted(map(tuple, many.select(*found.columns).collect())) == sorted(map(tuple, found.collect()))


def test_terms_of_a_scope_are_not_one_task(spark):
    """Weights came by a shuffle on the scope alone."""
    plan = retrieval.bm25_terms(spark.createDataFrame([(1, "s", "one two two")], "id int, scope string, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [scope" not in plan


def test_words_are_those_of_two_passes(spark):
    """The tokens of one pass against replacing and splitting, over odd characters."""
    odd = ["Ünï_cødé a b cc", "x yy zz", "İstanbul ǅ ß", "𝒳𝒴 𐐀𐐁𐐂 é́e", "漢字かな　中 文字", "", " ", "a1-b2_c3 ٣٤ ½x", None]
    rows = spark.createDataFrame([(t,) for t in odd], "t string")
    before = F.filter(F.split(F.regexp_replace(F.lower("t"), r"[^\p{L}\p{N}_\s]", " "), r"\s+"), lambda w: F.length(w) > 1)
    assert all(r["a"] == r["b"] for r in rows.select(tx.lexical_tokens(F.col("t")).alias("a"), before.alias("b")).collect())
