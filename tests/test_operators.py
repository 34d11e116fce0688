"""Golden cases and awkward rows for the operators."""

import hashlib
import json
import math
import uuid

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import chunking, evaluation, grounding, lists, profiles, requests, retrieval, tables
from corpusloom.sources import web
from corpusloom.streaming import jobs


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "n"), [("", 0), ("abcd", 1), ("a", 1), ("你好", 2), ("abcdefghij", 2), ("é" * 5, 2)])
def test_token_estimate(spark, text, n):
    assert one(spark, tx.token_estimate(F.col("t")), t=text) == n


def test_small_text_functions(spark):
    assert one(spark, tx.lexical_tokens(F.col("t")), t="Hello, a World! x_y") == ["hello", "world", "x_y"]
    assert one(spark, tx.citation_indices(F.col("t")), t="x [1][3] y [1]") == [1, 3]
    assert one(spark, tx.snapshot_sentences(F.col("t")), t="One. Two!  Three") == ["One.", "Two!", "Three"]
    assert one(spark, tx.protected_terms(F.col("t")), t="why does `foo bar` call Foo_Bar and foo_bar") == ["foo bar", "foo", "bar", "call", "Foo_Bar"]
    assert one(spark, tx.slug(F.col("t")), t="  A b/C! ") == "a-b-c" and one(spark, tx.slug(F.col("t")), t="!!") == "node"
    assert one(spark, tx.trim_to_tokens(F.col("t"), 3), t="aaaa bbbb cccc dddd eeee") == "aaaa bbbb"
    assert one(spark, tx.clean_query(F.col("t")), t="\n Query: 'who is it' \nx") == "who is it"
    assert one(spark, tx.retryable(F.lit(503)), t="x")


@pytest.mark.parametrize(
    ("query", "history", "strategy"),
    [("", False, "no_rewrite"), ("`x` fails", True, "no_rewrite"), ("what does it do", True, "reference_resolution"), ("summarize", False, "keyword_enrichment"), ("compare apples oranges", False, "keyword_enrichment"), ("go on", True, "standalone_expansion")],
)
def test_rewrite_strategy(spark, query, history, strategy):
    assert one(spark, tx.rewrite_strategy(F.col("q"), F.lit(history)), q=query) == strategy


def test_stable_chunk_id_is_the_uuid_of_its_name(spark):
    source, name = uuid.UUID("0f8fad5b-d9cb-469f-a165-70867728950e"), "3:10:13:" + hashlib.sha1(b"abc").hexdigest()[:12]
    made = lambda s: one(spark, tx.stable_chunk_id(F.col("s"), F.lit(3), F.lit(10), F.lit(13), F.lit("abc")), s=s)
    assert made(str(source)) == made(str(source).upper()) == str(uuid.uuid5(source, name)) and made("no uuid") is None
    assert one(spark, tx.named_uuid(F.col("s")), s="17") == str(uuid.uuid5(uuid.NAMESPACE_URL, "17"))


def test_normalising(spark):
    assert one(spark, tx.normalise_text(F.col("t")), t="ﬁne　x  １２\n\u00a0 ½ ") == "fine x 12\n1⁄2"
    assert one(spark, tx.collapse(F.col("t")), t="\u2003a\u00a0\u3000b\x85") == "a b"
    assert one(spark, web.html_text(F.col("t")), t="foo<script>x</script>bar &eacute;&#x41; &amp;lt; <b>y</b><STYLE a>z</STYLE>") == "foobar éA &lt; y"


@pytest.mark.parametrize(
    ("status", "message", "name", "kind"),
    [(429, "slow down", None, "internal"), (429, "Quota exceeded", None, "quota"), (402, "insufficient funds", None, "internal"), (None, "余额不足", "RateLimitError", "quota"), (400, "CONTENT_FILTER hit", None, "safety"),
     (503, "x", None, "internal"), (503, "Bad Gateway", None, "temporary"), (None, None, "APITimeoutError", "temporary"), (200, "connection reset", None, "internal"), (None, "error 429: no credit", None, "quota")],
)
def test_error_classes(spark, status, message, name, kind):
    assert one(spark, tx.error_class(F.lit(status).cast("int"), F.lit(message).cast("string"), F.lit(name).cast("string"))) == kind


def test_queries_and_rewrites(spark):
    clean = lambda t: one(spark, tx.clean_query(F.col("t")), t=t)
    assert clean(" \n Standalone query:  - 'why \t so' -\nx") == "why so" and clean("") == "" and clean("a" * 300) == "a" * 240
    assert clean("word " * 60) == " ".join(["word"] * 48) and clean("`x` fails") == "`x` fails"
    looks = lambda t: one(spark, tx.looks_like_query(F.col("t")), t=t)
    assert looks("what is {x} now") and not looks("{x") and not looks("Because I say so") and not looks("你好") and not looks("a " * 33) and not looks("Here's the rewritten query a")
    parse = lambda t: one(spark, requests.parse_rewrite(F.col("t"), F.lit("keyword_enrichment")), t=t)
    assert parse('{"query": "a b", "strategy": " NO_rewrite ", "search_queries": ["x", "X", "", "y", "z", "w"]}').asDict() == {"query": "a b", "searches": ["x", "y", "z"], "strategy": "no_rewrite"}
    assert parse('```json\n{"standalone_query": "q", "strategy": "odd"}\n```')["strategy"] == "keyword_enrichment" and parse("```\n[1]\n``` {")["query"] is None
    assert parse("plain words")["searches"] == ["plain words"] and parse('{"query": ""}')["query"] is None
    topics = spark.createDataFrame([(1, 0, "Kafka uses my_topic and the log"), (1, 1, "kafka retention retention policy v2-x")], "c int, t int, text string")
    assert [r["topic"] for r in tables.history_topics(topics, "c", "t").orderBy("rank").collect()] == ["Kafka", "my_topic", "v2-x", "kafka uses", "uses topic", "topic log"]
    assert one(spark, tx.ordered_distinct(F.col("w"), 2), w=[" A  b", "a B", "", "c", "d"]) == ["A b", "c"]


def test_usage_and_messages(spark):
    usage = lambda t: one(spark, tx.usage_payload(F.col("t")), t=t)
    assert tuple(usage('{"usage": {"prompt_tokens": 3, "completion_tokens": "4", "input_tokens_details": {"cached_tokens": 2}}}')) == (3, 4, 7, 2)
    assert tuple(usage('{"total_tokens": 9.0}')) == (0, 0, 9, None) and usage("{}") is None and usage("no json") is None
    assert one(spark, tx.safe_message(F.col("s")), s="embed").endswith("embeddings.") and one(spark, tx.safe_message(F.col("s")), s="x") == "Ingestion failed."
    assert one(spark, tx.clamp(F.col("v"), 1, 20, 5), v="99") == 20 and one(spark, tx.clamp(F.col("v"), 1, 20, 5), v="x") == 5
    assert one(spark, tx.is_unknown(F.col("v")), v=" 我没有足够的信息 ") and one(spark, tx.retryable(F.lit(None).cast("int"), F.col("n")), n="RateLimitError")
    said = spark.createDataFrame([(1, "user", "hi"), (1, "user", "你好"), (2, "assistant", "hi"), (2, "user", "1")], "c int, role string, text string")
    assert {r["c"]: r["l"] for r in said.groupBy("c").agg(tx.thread_language(F.col("text"), F.col("role")).alias("l")).collect()} == {1: "zh", 2: "same_as_user"}


def pack(text, high=800, overlap=75):
    """Chunk spans in plain Python."""
    import re

    cost = lambda s: max(1, (max(1, round(sum(ord(c) < 128 for c in s) / 4)) if any(ord(c) < 128 for c in s) else 0) + round(sum(ord(c) > 127 for c in s) / 2))
    lead = len(text) - len(text.lstrip())
    z, at = [], lead
    for m in re.finditer(r"(?s).+?(?:\n+|[.!?;](?:\s+|\Z)|\Z)", text.strip()):
        parts = [m[0]] if cost(m[0]) <= high else [m[0][k : k + 4 * high] for k in range(0, len(m[0]), 4 * high)]
        for p in parts:
            if p.strip():
                z.append((at, at + len(p), cost(p)))
            at += len(p)
    out, first, i = [], 0, 0
    while i < len(z):
        if i > first and sum(t for *_, t in z[first : i + 1]) > high:
            out.append((first, i))
            k = i
            while k > 0 and sum(t for *_, t in z[k:i]) < overlap and z[k - 1][2] <= overlap and sum(t for *_, t in z[k - 1 : i + 1]) <= high:
                k -= 1
            first = k
        i += 1
    out.append((first, len(z)))
    return [(0 if n == 0 else z[a][0], len(text) if n == len(out) - 1 else z[b - 1][1]) for n, (a, b) in enumerate(out)]


def test_chunks_match_plain_python(spark):
    texts = [" Short. ", "word " * 5000, "\n".join(f"Sentence {i} is here. And more!" for i in range(400)), "x" * 9000, "tiny.\n" + "y" * 3200 + "\ntail. " * 30, "a. " * 3000]
    docs = spark.createDataFrame([*enumerate(texts), (90, None), (91, "  \n ")], "doc_id long, text string")
    for high, low, overlap in ((800, 300, 75), (40, 20, 10)):
        got = {}
        for r in chunking.chunk(docs, low=low, high=high, overlap=overlap).collect():
            got.setdefault(r["id"], []).append((r["chunk_index"], r["char_start"], r["char_end"], r["content"]))
        assert set(got) == set(range(len(texts)))
        for k, text in enumerate(texts):
            assert [(a, b) for _, a, b, _ in sorted(got[k])] == pack(text, high, overlap)
            assert all(text[a:b] == c for _, a, b, c in got[k])
    with pytest.raises(ValueError):
        chunking.chunk(docs, low=900)


def test_fusion_golden_case(spark):
    a = spark.createDataFrame([(0, "c1", 1, 0.9), (0, "c2", 2, 0.8)], "query_id int, id string, rank int, score double")
    b = spark.createDataFrame([(0, "c2", 1, 5.0), (0, "c3", 2, 4.0)], "query_id int, id string, rank int, score double")
    got = {r["id"]: (r["rank"], r["score"], r["rank_0"], r["rank_1"]) for r in retrieval.fuse([a, b], 10).collect()}
    assert got["c2"] == (1, pytest.approx(1 / 62 + 1 / 61), 2, 1) and got["c1"][1] == pytest.approx(1 / 61) and got["c3"][2] is None


def test_cosine_in_blocks_is_the_same(spark, monkeypatch):
    rows = [(i, "s", [float((i * 7) % 11 - 5), float((i * 3) % 13 - 6)]) for i in range(200)]
    p = spark.createDataFrame(rows, "id int, scope string, embedding array<double>")
    q = p.where("id < 5").withColumnRenamed("id", "query_id")
    whole = sorted(map(tuple, retrieval.cosine_search(q, p).collect()))
    monkeypatch.setattr(retrieval, "BLOCK", 17)
    assert sorted(map(tuple, retrieval.cosine_search(q, p).collect())) == whole and len(whole) == 50


def test_vectors_without_values_are_never_returned(spark):
    q = spark.createDataFrame([(1, "s", [1.0, 0.0])], "query_id int, scope string, embedding array<double>")
    p = spark.createDataFrame([(1, "s", [2.0, 0.0]), (2, "s", []), (3, "s", None), (4, "s", [0.0, 0.0]), (5, "s", [-1.0, 0.0]), (6, "t", [1.0, 0.0])], "id int, scope string, embedding array<double>")
    assert [(r["id"], r["score"]) for r in retrieval.cosine_search(q, p).collect()] == [(1, 1.0)]


def test_inverted_lists_recall_the_exact_neighbours(spark, tmp_path):
    """At least nine of ten of the nearest ten, from less than 30 % of the passages of their scopes."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").alias("scope"), "embedding")
    asked = rows.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    path = str(tmp_path / "lists")
    lists.store_lists(rows, path)
    held = lists.load_lists(spark, path, asked)
    assert held.members.count() == rows.count() == held.members.select("id").distinct().count()
    exact = {(r["query_id"], r["id"]): r["score"] for r in retrieval.cosine_search(asked, rows).collect()}
    found = {(r["query_id"], r["id"]): r["score"] for r in lists.approximate_search(asked, held).collect()}
    recall = len(exact.keys() & found.keys()) / len(exact)
    sizes = {r["scope"]: r["count"] for r in rows.groupBy("scope").count().collect()}
    scored = lists.probes(asked, held).groupBy("query_id", "scope").agg(F.sum("n").alias("n")).collect()
    share = sum(r["n"] for r in scored) / sum(sizes[r["scope"]] for r in scored)
    print(f"recall@10 {recall:.4f} of {len(exact)} rows, {share:.3f} of the passages scored")
    assert len(found) == len(exact) == 400 and recall >= 0.9 and share < 0.3
    assert all(found[key] == pytest.approx(exact[key]) for key in exact.keys() & found.keys())


def test_inverted_lists_of_small_scopes_are_exact(spark, tmp_path, monkeypatch):
    """Whole scopes are searched where they are small or the share is all; in parts and shelves too; ties, zero vectors and scopes without passages."""
    rows = spark.createDataFrame([(n, "s", [math.cos((n % 120) ** 1.1 * 0.01), math.sin((n % 120) ** 1.1 * 0.01)]) for n in range(150)] + [(900, "s", [0.0, 0.0]), (901, "t", [1.0, 0.0]), (902, "s", None), (903, "s", [])], "id int, scope string, embedding array<double>")
    asked = rows.where("id IN (0, 70, 149, 900, 901, 902)").withColumnRenamed("id", "query_id").union(spark.createDataFrame([(7, "gone", [1.0, 0.0])], "query_id int, scope string, embedding array<double>"))
    plain = lambda found: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in found.collect())
    for shelf, part in ((2_000, 4_000), (20, 2)):
        monkeypatch.setattr(lists, "SHELF", shelf)
        monkeypatch.setattr(lists, "ASKED", part)
        path = str(tmp_path / f"lists{shelf}")
        lists.store_lists(rows, path)
        for share, k in ((1.0, 3), (0.1, 200)):
            assert plain(lists.approximate_search(asked, lists.load_lists(spark, path, asked), k, share)) == plain(retrieval.cosine_search(asked.where("query_id <> 900"), rows, k))
        near = plain(lists.approximate_search(asked, lists.load_lists(spark, path), 3, 0.1))
        assert len(near) == 10 and {r for r in near if r[1] == 1} == {r for r in plain(retrieval.cosine_search(asked.where("query_id <> 900"), rows, 3)) if r[1] == 1}
    none = rows.where("id < 0")
    lists.store_lists(none, str(tmp_path / "none"))
    assert lists.approximate_search(asked, lists.load_lists(spark, str(tmp_path / "none"), asked)).collect() == []


def hot_rows(n):
    """A scope of n passages that all hold one word, few of them another."""
    return [(k, "hot", f"common w{k % 97} {'rare ' * (k % 1000 == 3)}x{k}") for k in range(n)] + [(10**6 + k, f"s{k}", f"common y{k}") for k in range(20)]


def test_blocks_are_left_out_and_nothing_is_lost(spark, tmp_path):
    """Every query against a search without bounds; a rare word leaves most blocks of a common one out."""
    passages = spark.createDataFrame(hot_rows(3000), "id int, scope string, text string")
    asked = spark.createDataFrame([(1, "hot", "rare common"), (2, "hot", "common"), (3, "hot", "w5 w6 x77 common nothing"), (4, "s3", "common y3"), (5, "hot", "absent"), (6, "none", "common")], "query_id int, scope string, query string")
    path = str(tmp_path / "index")
    retrieval.store_index(passages, path)
    held = retrieval.load_index(spark, path, asked)
    wanted = asked.select("query_id", "scope", F.explode(F.split("query", " ")).alias("term"))
    for k in (1, 3, 10, 100):
        got = sorted(map(tuple, retrieval.bm25_search(asked, k=k, pad_zero=False, index=held).select("query_id", "id", "score", "rank").collect()))
        terms = held.terms.join(wanted, ["scope", "term"]).select("query_id", "scope", "term", "idf")
        full = held.postings.join(terms, ["scope", "term"]).groupBy("query_id", "id").agg(F.round(F.sum(F.col("idf") * F.col("part")), 9).alias("score"))
        assert got == sorted(map(tuple, retrieval.top_k(full, k).select("query_id", "id", "score", "rank").collect())) and len({g[0] for g in got}) == 4
    blocks = {r["query_id"]: r["n"] for r in retrieval.kept_blocks(wanted, held, 3).groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    print("blocks kept of 47:", blocks)
    assert blocks[1] <= 3 and blocks[2] <= 47


def test_a_common_term_is_many_keys(spark, tmp_path):
    """The largest group of postings that meets its queries is a block, at any number of passages with the word; no window over terms."""
    largest = []
    for n in (1500, 6000):
        path = str(tmp_path / f"index{n}")
        retrieval.store_index(spark.createDataFrame(hot_rows(n), "id int, scope string, text string"), path)
        held = retrieval.load_index(spark, path)
        assert held.terms.where("scope = 'hot' AND term = 'common'").first()["df"] == n
        largest.append(held.postings.groupBy("scope", "term", "block").count().agg(F.max("count")).first()[0])
        assert held.blocks.where("scope = 'hot' AND term = 'common'").count() == -(-n // retrieval.BLOCK_OF)
    assert max(largest) < 2 * retrieval.BLOCK_OF
    asked = spark.createDataFrame([(1, "hot", "common rare")], "query_id int, scope string, query string")
    plan = retrieval.bm25_search(asked, k=3, pad_zero=False, index=held)._jdf.queryExecution().optimizedPlan().toString()
    assert all("query_id" in line.split("windowspecdefinition(")[1] for line in plan.splitlines() if "windowspecdefinition(" in line)


def test_bm25_pads_and_scores(spark):
    p = spark.createDataFrame([(1, "s", "python programming language"), (2, "s", "java programming basics"), (3, "s", ""), (4, "s", None), (5, "t", "python")], "id int, scope string, text string")
    q = spark.createDataFrame([(1, "s", "Python programming"), (2, "s", "  "), (3, "u", "python")], "query_id int, scope string, query string")
    got = [(r["query_id"], r["id"], r["score"] > 0) for r in retrieval.bm25_search(q, p, 3).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, True), (1, 2, True), (1, 3, False)]


def test_stored_index_is_searched_refreshed_and_invalidated(spark, tmp_path):
    rows = [(k, f"s{k % 5}", f"word{k} common text{k % 3}") for k in range(60)]
    passages = lambda r: spark.createDataFrame(r, "id int, scope string, text string")
    asked = spark.createDataFrame([(1, "s1", "word6 common"), (2, "s2", "text0 word7"), (3, "s4", "newword")], "query_id int, scope string, query string")
    path = str(tmp_path / "index")
    retrieval.store_index(passages(rows), path)
    answer = lambda r, **how: sorted(map(tuple, retrieval.bm25_search(asked, r, 4, **how).select("query_id", "id", "rank", "score").collect()))
    index = lambda: retrieval.load_index(spark, path, asked.select("scope"))
    assert answer(None, index=index()) == answer(passages(rows)) and len(answer(None, index=index())) == 12
    changed = [(k, s, t + (" newword" if k == 4 else "")) for k, s, t in rows if s != "s2"]
    retrieval.refresh_index(passages(changed), path, spark.createDataFrame([("s2",), ("s4",)], "scope string"))
    assert answer(None, index=index()) == answer(passages(changed)) and {q for q, *_ in answer(None, index=index())} == {1, 3}
    assert retrieval.load_index(spark, path).members.count() == len(changed)


def test_evaluation_golden_cases(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "x", 2), (1, "y", 3), (2, "x", 1), (2, "y", 2), (2, "b", 3), (3, "x", 1)], "query_id int, id string, rank int")
    truth = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "q")], "query_id int, id string")
    found = evaluation.retrieval_metrics(ranked, truth, 5)
    assert {r["query_id"]: r["recall"] for r in found.collect()} == {1: 0.5, 2: 1.0, 3: 0.0}
    assert evaluation.mean_reciprocal_rank(found).first()["mrr"] == pytest.approx((1 + 1 / 3 + 0) / 3)
    assert one(spark, evaluation.completeness(F.lit("a b c d e"), F.col("q")), q="two words") == 0.5
    assert one(spark, evaluation.groundedness(F.lit("the cat sat"), F.col("q")), q="The cat") == pytest.approx(2 / 3)
    assert one(spark, evaluation.faithfulness(F.lit("but no"), F.col("q")), q="yes") == 0.5
    rows = spark.createDataFrame([("m", float(i % 10), i) for i in range(200)], "metric_type string, metric_value double, key int")
    r = evaluation.bootstrap(rows, 200).first()
    assert r["low"] < 4.5 < r["high"] and r["high"] - r["low"] < 2
    one_row = evaluation.bootstrap(spark.createDataFrame([("m", 3.0, 1)], "metric_type string, metric_value double, key int"), 50).first()
    assert one_row["low"] == one_row["high"] == 3.0
    cited = spark.createDataFrame([(1, "some answer", "has some text"), (1, "some answer", None)], "query_id int, answer string, content string")
    found = {r["query_id"]: (r["support_rate"], r["wrong_rate"]) for r in evaluation.citation_support(cited, spark.createDataFrame([(1,), (2,)], "query_id int")).collect()}
    assert found == {1: (0.5, 0.5), 2: (1.0, 0.0)}
    runs, old = spark.createDataFrame([(1,), (2,)], "query_id int"), spark.createDataFrame([(1, "recall", 0.1), (2, "recall", 0.2), (9, "recall", 0.3)], "query_id int, metric_type string, metric_value double")
    marked, left = requests.record_run(runs, old, old.where("query_id = 1").withColumn("metric_value", F.lit(0.9)))
    assert {r["query_id"]: r["status"] for r in marked.collect()} == {1: "completed", 2: "failed"}
    assert sorted(map(tuple, left.collect())) == [(1, "recall", 0.9), (9, "recall", 0.3)]


def test_citations(spark):
    answers = spark.createDataFrame([(1, "x [1][3] y [1]")], "query_id int, answer string")
    found = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "query_id int, citation_index int, id string")
    got = [(r["citation_index"], r["id"], r["missing"]) for r in grounding.align(answers, found).orderBy("place").collect()]
    assert got == [(1, "a", False), (3, None, True)]
    assert one(spark, grounding.structured_indices(F.col("r")), r=json.dumps([2, "3", {"index": 4}, 0, "x", 2])) == [2, 3, 4]
    assert one(spark, grounding.answer_text(F.col("r")), r='{"response": " hi "}') == "hi"
    done = grounding.finalise(answers, spark.createDataFrame([], "query_id int, chunk_count long")).first()
    assert done["answer"] == tx.UNKNOWN["en"] and not done["cited"]
    rows = spark.createDataFrame([(1, " \n", "zh", "why"), (2, tx.UNKNOWN["en"], "zh", "why"), (3, "yes", None, "why"), (4, None, None, "为什么")], "query_id int, answer string, thread_language string, question string")
    counts = spark.createDataFrame([(k, 2) for k in range(1, 5)], "query_id int, chunk_count long")
    got = {r["query_id"]: (r["answer"], r["cited"]) for r in grounding.finalise(rows, counts).collect()}
    assert got == {1: (tx.UNKNOWN["zh"], False), 2: (tx.UNKNOWN["en"], True), 3: ("yes", True), 4: (tx.UNKNOWN["zh"], False)}


def test_running_sums_in_segments(spark):
    """Any cut into segments gives the sums of one window; a large group is many tasks."""
    rows = spark.createDataFrame([(g, o, (o * 7 + g) % 11) for g in (1, 2) for o in [*range(-5, 40), 1000, 10**9]] + [(None, 3, 4), (None, 5, 6), (3, None, 9), (3, 1, 2)], "g int, o long, v int")
    want = {}
    for g, o, v in sorted(map(tuple, rows.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0)):
        want[g, o] = sum(x for (h, p), x in [((r["g"], r["o"]), r["v"]) for r in rows.collect()] if h == g and (p is None or o is not None and p < o) and (h, p) != (g, o))
    for segment in (1, 7, 10_000):
        assert {(r["g"], r["o"]): r["before"] for r in tables.running(rows, "g", "o", F.col("v"), segment).collect()} == want
    many = spark.range(60_000).select(F.lit("one").alias("s"), F.col("id").alias("page"), F.lit("ab").alias("text"))
    placed = web.page_offsets(many, "s", "page", "text")
    assert placed.where("char_start <> page * 3 OR char_end <> char_start + 2").count() == 0
    assert placed.groupBy(F.floor(F.col("page") / tables.SEGMENT)).count().count() == 6
    assert tables.batches(many, "s", "page", 32).where("batch <> page div 32").count() == 0


def test_providers_get_full_batches(spark, tmp_path):
    """Every call but a task's last has as many texts as asked for, across Arrow batches; blank texts are never sent."""
    calls = str(tmp_path / "calls")

    def provider(texts):
        with open(calls, "a") as file:
            file.write(f"{len(texts)}\n")
        assert all(t.strip() for t in texts)
        return [[float(len(t)), 1.0] for t in texts], [len(t) // 4 for t in texts]

    rows = spark.createDataFrame([(k, None if k % 50 == 0 else " " if k % 50 == 1 else "word " * (k % 9 + 1), "x") for k in range(1000)], "id int, text string, cost string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {r["id"]: r for r in retrieval.embed_batches(rows, "id", "text", provider, 64, 2.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [int(x) for x in open(calls)] == [64] * 15 and len(got) == 1000
    assert got[0]["embedding"] is None and got[1]["tokens"] == 0 and got[2]["embedding"] == [15.0, 1.0]
    assert got[8]["tokens"] == 11 and got[8]["cost"] == pytest.approx(22e-6)
    assert retrieval.embed_batches(rows.limit(0), "id", "text", provider).collect() == []


def test_coverage_and_profiles(spark):
    spans = spark.createDataFrame([(1, 0, 10), (1, 5, 20), (1, 30, 40), (2, 3, 3)], "id int, start int, end int")
    got = {r["id"]: r["covered"] for r in profiles.merged_length(spans, "id").collect()}
    assert got == {1: 30, 2: 0} and one(spark, profiles.coverage(F.lit(30), F.col("n")), n=50) == 0.6
    rows = spark.createDataFrame([(1, 0, ["A", "B"]), (1, 1, ["A", "C", "D", "E"]), (1, 2, [])], "id int, chunk_index int, headings array<string>")
    nodes = {r["node"]: (r["parent"], r["chunks"]) for r in profiles.outline(rows, "id", "headings").collect()}
    assert nodes == {"a": (None, [0, 1]), "a/b": ("a", [0]), "a/c": ("a", [1]), "a/c/d": ("a/c", [1])}


def test_keywords_weigh_headings_and_keep_references(spark):
    rows = [(1, k, "Spark jobs spark 我们 数据", ["Data Flow"] if k < 2 else []) for k in range(5)]
    chunks = spark.createDataFrame(rows, "id int, chunk_index int, content string, headings array<string>")
    got = {r["term"]: (r["rank"], r["label"], r["weight"], r["chunks"]) for r in profiles.keywords(chunks, headings="headings").collect()}
    assert got == {"spark": (1, "Spark", 10.0, [0, 1, 2]), "data flow": (2, "Data Flow", 6.0, [0, 1]), "jobs": (3, "jobs", 5.0, [0, 1, 2]), "数据": (4, "数据", 4.0, [0, 1, 2])}


def test_digests_and_snapshots(spark):
    text = "First thing. Second thing! Third one. First  thing. Fifth."
    docs = spark.createDataFrame([(1, text), (2, "only"), (3, "no chunks")], "id int, text string")
    chunks = spark.createDataFrame([(1, k, f"chunk {k} " + "x" * 300, ["Head", "Sub"] if k == 1 else []) for k in range(4)] + [(2, 0, "only", [])], "id int, chunk_index int, content string, headings array<string>")
    sections, terms = profiles.outline(chunks, "id", "headings"), profiles.keywords(chunks, headings="headings")
    made = {r["id"]: r for r in profiles.digests(docs, chunks, sections, terms).collect()}
    assert set(made) == {1, 2} and made[1]["overview"] == "First thing. Second thing!" and made[1]["assertions"] == ["First thing.", "Second thing!", "Third one.", "Fifth."]
    assert made[1]["themes"][:3] == ["Head", "Sub", "chunk"] and made[1]["gaps"] == [] and made[2]["gaps"] == [profiles.NO_OUTLINE]
    assert [p["chunk_index"] for p in made[1]["passages"]] == [0, 1, 2] and made[1]["passages"][0]["text"].endswith("...")
    drafts = spark.createDataFrame([(1, "", ["T", "t", " "], ["a"], [(9, "gone"), (3, " kept ")], [], [("  big   term ", None, [0, 7]), ("", 1.0, [0]), ("other", 2.0, [8])]), (2, "own", [], [], [(5, "gone")], ["g"], [])],
                                   "id int, overview string, themes array<string>, assertions array<string>, passages array<struct<chunk_index: int, text: string>>, gaps array<string>, keywords array<struct<term: string, weight: double, chunks: array<int>>>")
    fallback = spark.createDataFrame([(1, "fb", [(0, "p")], [("k", 1.0, [0])]), (2, "fb2", [(0, "only")], [("k2", 1.0, [0])])], "id int, overview string, passages array<struct<chunk_index: int, text: string>>, keywords array<struct<term: string, weight: double, chunks: array<int>>>")
    got = {r["id"]: r for r in profiles.normalised_digests(drafts, chunks, fallback).collect()}
    assert got[1]["overview"] == "fb" and got[1]["themes"] == ["T"] and [tuple(p) for p in got[1]["passages"]] == [(3, "kept")]
    assert [(k["term"], k["weight"], k["chunks"]) for k in got[1]["keywords"]] == [("big term", 1.0, [0]), ("other", 2.0, [0])]
    assert got[2]["overview"] == "own" and [tuple(p) for p in got[2]["passages"]] == [(0, "only")] and got[2]["keywords"][0]["term"] == "k2"
    assert one(spark, profiles.fallback_overview(F.col("t"), F.array(F.lit("c1"), F.lit("c2"))), t="") == "c1 c2"
    stored = spark.createDataFrame([(1, " ", [], ["a", "b", "c"], [], []), (2, "", [], [], [(0, " "), (1, "p")], []), (3, "", [" "], [], [], [""]), (4, "o", ["x", "x "], [], [], ["k"] * 3)],
                                   "id int, overview string, themes array<string>, assertions array<string>, passages array<struct<chunk_index: int, text: string>>, keywords array<string>")
    assert {r["id"]: (r["overview"], r["themes"], r["top_keywords"]) for r in profiles.snapshot_summaries(stored).collect()} == {1: ("a b", [], []), 2: ("p", [], []), 4: ("o", ["x"], ["k"])}
    metrics = profiles.content_metrics(chunks.withColumns({"char_start": F.lit(0), "char_end": F.lit(5), "token_count": F.lit(2)}), sections=sections, terms=terms)
    assert {r["id"]: (r["section_count"], r["heading_depth"]) for r in metrics.collect()} == {1: (2, 2), 2: (0, 0)}
    snaps = profiles.snapshots(docs, profiles.digests(docs, chunks, sections, terms), metrics).collect()
    assert {r["source_content_hash"] for r in snaps} == {hashlib.sha256(t.encode()).hexdigest() for t in (text, "only")} and snaps[0]["schema_version"] == "1.0"


def test_pages_meet_chunks(spark):
    chunks = spark.createDataFrame([(1, 0, 0, 12), (1, 1, 12, 20)], "id int, chunk_index int, char_start int, char_end int")
    pages = spark.createDataFrame([(1, 1, ["H"], 0, 10), (1, 2, ["K"], 11, 20)], "id int, page_number int, headings array<string>, char_start int, char_end int")
    got = {r["chunk_index"]: (r["pages"], r["page"], r["headings"]) for r in chunking.with_pages(chunks, pages).collect()}
    assert got == {0: ([1, 2], 1, ["H"]), 1: ([2], 2, ["K"])}


def test_tables(spark):
    jobs_ = spark.createDataFrame([(1, 5, 10, "a"), (1, 5, 11, "b"), (2, 1, 3, "c")], "source int, at int, id int, status string")
    assert {r["source"]: r["status"] for r in tables.latest(jobs_, "source", "at", "id").collect()} == {1: "b", 2: "c"}
    assert one(spark, tables.chat_cost(F.lit(1000), F.lit(2000), F.col("r"), F.lit(None).cast("double")), r=0.5) == 1.5
    assert [r["n"] for r in tables.page(spark.range(9).withColumnRenamed("id", "n"), ["n"], 3, 2).collect()] == [2, 3, 4]
    assert one(spark, tables.bigrams(F.col("w")), w=["a", "b", "c"]) == ["a b", "b c"]


def test_scopes_and_resets(spark):
    books = spark.createDataFrame([(1, "me", None), (2, "me", "2024-01-01"), (3, "you", None)], "notebook_id int, owner string, deleted_at string")
    sources = spark.createDataFrame([(10, 1, "failed", "x"), (20, 2, "ready", None), (30, 3, "ready", None)], "source_id int, notebook_id int, status string, error_message string")
    asked = spark.createDataFrame([(10,), (20,), (30,), (40,), (10,)], "source_id int")
    found = lambda **how: {r["source_id"]: r["found"] for r in tables.live_sources(asked, sources, books, **how).collect()}
    assert found() == {10: True, 20: False, 30: True, 40: False} and found(owner=F.lit("me"))[30] is False
    jobs_ = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "job_id int, source_id int")
    assert {r["job_id"] for r in tables.live_jobs(jobs_, sources, books).collect()} == {1, 3}
    fresh, left, chunks = tables.reset_ingestion(sources, jobs_, jobs_, asked.where("source_id = 10"))
    assert {r["source_id"]: (r["status"], r["error_message"]) for r in fresh.collect()}[10] == ("pending", None) and left.count() == chunks.count() == 2
    empty = retrieval.embedding_coverage(spark.createDataFrame([], "embedding array<double>")).first()
    assert (empty["total"], empty["coverage_percent"]) == (0, 0.0)


def test_sources(spark, tmp_path):
    assert one(spark, web.html_text(F.col("h")), h="<p>a&amp;b</p><script>x</script> c") == "a&b c"
    assert one(spark, web.video_id(F.col("u")), u="https://youtu.be/abcdefghijk?t=1") == "abcdefghijk"
    assert one(spark, web.upload_error(F.lit("text"), F.col("n")), n=11 << 20) == "too large"
    assert one(spark, web.file_title(F.col("f")), f="a/b/my_long-name.pdf") == "my long name"
    (tmp_path / "a.txt").write_bytes("caf\xe9".encode("latin-1"))
    files = spark.read.format("binaryFile").load(str(tmp_path / "a.txt")).select("path", "content")
    assert web.text_pages(files).first()["text"] == "café"
    web.export_csv(spark.createDataFrame([(1, None, "x")], "a int, b string, c string"), str(tmp_path / "csv"), ["c", "b", "a"])
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["c", "b", "a"]


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    store, check = str(tmp_path / "store"), str(tmp_path / "check")
    first = [(1, "One sentence. Two."), (2, "Other text.")]
    spark.createDataFrame(first, "doc_id long, text string").write.parquet(str(source))
    read = lambda: spark.readStream.schema("doc_id long, text string").parquet(str(source))
    jobs.incremental_chunks(read(), store, check).awaitTermination()
    spark.createDataFrame([(2, "Changed."), (1, "One sentence. Two.")], "doc_id long, text string").write.mode("append").parquet(str(source))
    jobs.incremental_chunks(read(), store, check).awaitTermination()
    stored = spark.read.parquet(store)
    assert sorted((r["id"], r["version"]) for r in stored.collect()) == [(1, 0), (2, 0), (2, 1)]
    assert sorted((r["id"], r["content"]) for r in jobs.current_chunks(stored).collect()) == [(1, "One sentence. Two."), (2, "Changed.")]
    for k, more in enumerate(([(2, "Other text.")], [(1, " "), (3, "Only a.")])):
        spark.createDataFrame(more, "doc_id long, text string").write.mode("append").parquet(str(source))
        jobs.incremental_chunks(read(), store, check).awaitTermination()
        now = sorted((r["id"], r["content"]) for r in jobs.current_chunks(spark.read.parquet(store)).collect())
        assert now == [[(1, "One sentence. Two."), (2, "Other text.")], [(2, "Other text."), (3, "Only a.")]][k]
    fields = spark.createDataFrame([(1, 1, "a", None), (1, 2, None, "b"), (1, 3, None, None)], "k int, t int, x string, y string")
    assert jobs.merged_fields(fields, "k", "t", ["x", "y"]).first()[1:] == ("a", "b")


def test_status_counts_as_a_stream(spark, sf):
    events = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    query = jobs.latest_status(events, "user_id", "ts", "event_type", "event_id").writeStream.outputMode("complete").format("memory").queryName("newest").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = jobs.latest_status(spark.read.parquet(f"{sf}/events.parquet"), "user_id", "ts", "event_type", "event_id")
    assert sorted(map(tuple, spark.table("newest").collect())) == sorted(map(tuple, batch.collect()))


def test_newest_first_and_exports_are_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(k, None if k == 3 else f"2024-01-0{k % 3 + 1}") for k in range(6)], "id int, day string").withColumn("at", F.to_timestamp("day")).repartition(4)
    assert [r["id"] for r in tables.newest_first(rows, "at", "id").collect()] == [2, 5, 1, 4, 0, 3]
    runs = spark.createDataFrame([("a", 1, "q, 1", "completed", "2024-01-01", None), ("b", 1, 'say "x"', "completed", "2024-02-01", "2024-02-02"), ("c", 2, "q", "failed", "2024-03-01", None)], "run_id string, notebook_id int, query string, status string, c string, d string")
    runs = runs.select("run_id", "notebook_id", "query", "status", F.to_timestamp("c").alias("created_at"), F.to_timestamp("d").alias("completed_at"))
    metrics = evaluation.with_metadata(spark.createDataFrame([("a", "recall", 0.5, 10, None), ("b", "mrr", 0.25, None, "x"), ("b", "recall", 1.0, 5, None)], "run_id string, metric_type string, metric_value double, k int, note string"), "k", "note")
    made = evaluation.metrics_export(runs, metrics)
    assert [(r["run_id"], r["metric_type"], r["metadata"]) for r in made.collect()] == [("b", "mrr", '{"note":"x"}'), ("b", "recall", '{"k":5}'), ("a", "recall", '{"k":10}')]
    assert [r["run_id"] for r in evaluation.metrics_export(runs, metrics, ["mrr"]).collect()] == ["b", "b"] and evaluation.metrics_export(runs, metrics, end=F.lit("2024-01-01").cast("timestamp")).count() == 1
    web.export_csv(made.coalesce(1), str(tmp_path / "out"), evaluation.EXPORTED)
    (file,) = (tmp_path / "out").glob("*.csv")
    lines = file.read_text().splitlines()
    assert lines[0] == ",".join(evaluation.EXPORTED) and len(lines) == 4 and lines[3].startswith('a,1,"q, 1",completed,recall,0.5,2024-01-01T00:00:00,,')
    web.export_csv(made.limit(0), str(tmp_path / "none"), evaluation.EXPORTED)
    assert not any(f.read_text() for f in (tmp_path / "none").glob("*.csv"))


def test_merged_lists_keep_both_retrievers(spark):
    rows = [(1, 1, "x", 0.5, 1, 0.9, 2, None, None), (1, 2, "x", 0.25, 3, 0.9, 1, 4.0, 7), (1, 2, "y", 0.5, 1, None, None, 2.0, 1)]
    found = spark.createDataFrame(rows, "request_id int, query_id int, id string, score double, rank int, own_0 double, rank_0 int, own_1 double, rank_1 int")
    got = {r["id"]: (r["rank"], r["score"], r["vector_score"], r["vector_rank"], r["bm25_score"], r["bm25_rank"]) for r in retrieval.merge_queries(found).collect()}
    assert got == {"x": (1, 0.75, 0.9, 1, 4.0, 7), "y": (2, 0.5, None, None, 2.0, 1)}


def test_rewrite_contexts(spark):
    said = [(1, 0, "user", "old words here"), (1, 1, " User ", "Kafka_x  and logs"), (1, 2, "assistant", "y" * 300), (1, 3, None, "note"), (1, 4, "user", " "), (2, 0, "user", "")]
    rows = spark.createDataFrame(said, "c int, t int, role string, text string")
    whole = requests.rewrite_context(rows, "c", "t", turns=1).collect()
    assert len(whole) == 1
    lines = whole[0]["context"].split("\n")
    assert lines[0].startswith("Recent topics/entities: Kafka_x") and lines[1:] == ["Recent turns:", "- user: Kafka_x and logs", "- assistant: ..." + "y" * 237, "- unknown: note"]
    cut = requests.rewrite_context(rows, "c", "t", most=280, turns=1).first()["context"]
    assert cut == "\n".join(lines[3:])
