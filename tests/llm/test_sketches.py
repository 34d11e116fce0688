import hashlib
import math
import random
import re

import pytest
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.llm import queries, sketches


def cut(text):
    for stop in "\n。，、":
        text = text.replace(stop, stop + " ")
    words, out, open_ = text.split(" "), [], None
    chances = [xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42)) for a, b in zip(words, words[1:])] + [xxhash.xxh64_intdigest(words[-1].encode(), 42)]
    share = max(20.0, 0.15 * math.sqrt(len(text) - sum(text.count(stop) for stop in "\n。，、"))) * (1 << 20)
    for w, h in zip(words, chances):
        open_ = w if open_ is None else open_ + " " + w
        if h & (1 << 20) - 1 < int(share / len(set(chances))):
            out.append(open_)
            open_ = ""
    return [p for p in [*out, open_] if p]


def pieces(text):
    return set(cut(text))


def alike(a, b):
    x, y = pieces(a), pieces(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def brute(rows):
    """[(id, text)], different rows, no null ids -> {(id, text): (n, sha, near_edited, near_next)}"""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), alike(t, edited), alike(t, after))
    return out


def check(found, want):
    assert len(found) == len(want)
    for r in found:
        n, sha, edited, following = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert r["near_edited"] == pytest.approx(edited) and r["near_next"] == pytest.approx(following)


def test_query_matches_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = queries.op9_fingerprints(spark, sf).collect()
    check(found, brute(rows))
    assert not re.search("Python|Pandas|Arrow", queries.op9_fingerprints(spark, sf)._jdf.queryExecution().toString())
    by_text = {}
    for r in found:
        assert by_text.setdefault(dict(rows)[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]


def test_awkward_rows(spark):
    long = "\n".join(f"line {i}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, "a"), (4, "\n\n"), (5, long), (6, long + "x"), (7, "é🎉" * 5000), (9, "a\nb\nc"), (12, "x" * 100_000), (50, "a\nb")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, row int, mark int").repartition(3)
    check(sketches.compare_with_edits(docs).collect(), brute(rows))
    assert sketches.compare_with_edits(docs.where("doc_id < 0")).count() == 0
    again = docs.union(docs.where("doc_id IN (5, 9)")).union(docs.where("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long")))
    found = [(r["doc_id"], r["near_next"]) for r in sketches.compare_with_edits(again).collect()]
    assert len(found) == len(rows) + 3 and (9, 1.0) in found and (5, 1.0) in found and sum(i is None for i, _ in found) == 1


def test_paragraphs_go_by_content(spark):
    text = " ".join(f"word{i} of sentence {i // 9}" + (". " if i % 9 == 8 else "") for i in range(3000))
    rows = [text, "New words here. " + text, text.replace("\n", ""), "x" * 5000, "a", "", "é🎉." * 100, "汉字，汉字。" * 300]
    found = [r["p"] for r in spark.createDataFrame(list(enumerate(rows)), "k int, t string").orderBy("k").select(sketches.paragraphs(F.col("t")).alias("p")).collect()]
    assert found == [cut(t) for t in rows] and all("".join(p) == t for p, t in zip(found[:5], rows) if "\n" not in t)
    assert len(set(found[0]) & set(found[1])) >= 0.9 * len(found[0])


def test_one_more_character_keeps_half_at_any_length(spark):
    """From 100 to 20,000 code points, at powers of two too; texts with and without stops."""
    rng = random.Random(5)
    known = "the quick brown fox jumps over a lazy dog while many other animals watch and wait for something new to happen in their small quiet town by river".split()
    made = "".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) + " " for _ in range(5000))
    natural = "".join(rng.choice(known) + (". " if rng.random() < 0.1 else " ") for _ in range(6000))
    sizes = [n + d for n in (128, 256, 512, 1024, 2048, 4096, 8192, 16384) for d in (-1, 0, 1)] + [100, 150, 200, 300, 700, 3000, 10_000, 20_000]
    rows = []
    for n in sizes:
        for source in (made, natural):
            for at in (0, n // 2, n, rng.randrange(n)):
                start = rng.randrange(1000)
                t = source[start : start + n]
                rows.append((len(rows), t, t[:at] + rng.choice("ab .") + t[at:]))
    keys = spark.createDataFrame(rows, "k int, t string, u string").repartition(8).select("k", sketches.paragraph_digests(F.col("t")).alias("l"), sketches.paragraph_digests(F.col("u")).alias("r"))
    found = {r["k"]: r["near"] for r in keys.select("k", sketches.likeness(F.size("l"), F.size("r"), F.expr(sketches.difference_sql("l", "r"))).alias("near")).collect()}
    assert min(found.values()) >= 0.5
    assert all(found[k] == pytest.approx(alike(t, u)) for k, t, u in rows)


def test_unchanged_two_thirds_are_seen(spark):
    """Under 1 % of the edited texts of sf0.1 keep nothing: those of a few words."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").repartition(8)
    edited = F.concat(F.substring("text", 1, F.length("text") - F.floor(F.length("text") / 3).cast("int")), F.repeat(F.lit("other words here now. "), 3))
    both = docs.select(F.length("text").alias("n"), sketches.paragraph_digests(F.col("text")).alias("l"), sketches.paragraph_digests(edited).alias("r"))
    n, none, long = both.select(F.count(F.lit(1)), F.count_if(~F.arrays_overlap("l", "r")), F.count_if(~F.arrays_overlap("l", "r") & (F.col("n") > 400))).first()
    assert n > 9000 and none < 0.01 * n and long < 0.002 * n


def test_few_parts_need_a_second_sketch(spark):
    """Under 5 % of the neighbours of a table, which share next to nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(sketches.paragraph_digests(F.col("text")).alias("l"), F.xxhash64("text").alias("k"))
    both = docs.withColumn("r", F.lead("l").over(Window.orderBy("k"))).where("r IS NOT NULL").repartition(8)
    each = both.withColumn("m", F.expr(f"greatest({sketches.parts_sql('l')}, {sketches.parts_sql('r')})")).select("*", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("p"))
    parts = each.select(F.expr(sketches._part("l", "m")).alias("l"), F.expr(sketches._part("r", "m")).alias("r"))
    n, failed = parts.select(F.count(F.lit(1)), F.count_if(F.expr(sketches.differing_sql("l", "r")).isNull())).first()
    print(f"{failed} of {n} parts")
    assert n > 3000 and failed < 0.05 * n


def test_null_is_no_text_named_null(spark):
    docs = spark.createDataFrame([("null", "one text here"), (None, "other text"), (None, "one text here"), ("a", "b")], "doc_id string, text string")
    found = sketches.compare_with_edits(docs).collect()
    assert sorted((r["doc_id"] or "-", r["n_chars"]) for r in found) == [("-", 10), ("-", 13), ("a", 1), ("null", 13)]


@pytest.mark.parametrize("size", [0, 3, 6, 40])
def test_peeling_recovers_the_difference_or_fails(spark, size):
    def made(first, last):
        low = F.transform(F.sequence(F.lit(first), F.lit(last)), lambda k: F.xxhash64(k, F.col("id")).bitwiseAND(F.lit((1 << 40) - 1)))
        return F.transform(low, lambda d: F.shiftleft(F.xxhash64(d), 40).bitwiseOR(d))

    frame = spark.range(30).select(F.col("id"), made(1, 50 + size).alias("l"), made(1 + size // 2, 50).alias("r"))
    both = F.array_sort(F.concat(F.array_except("l", "r"), F.array_except("r", "l")))
    found = frame.select(*[F.expr(sketches.differing_sql("l", "r", level)).alias(f"d{level}") for level in range(4)], both.alias("differing")).collect()
    for r in found:
        got = [r[f"d{level}"] for level in range(4)]
        assert all(d is None or sorted(d) == r["differing"] for d in got)
    rate = [sum(r[f"d{level}"] is not None for r in found) for level in range(4)]
    assert rate[3] >= 28 and (size > 6 or rate[0] >= 25)
