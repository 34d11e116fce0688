"""Collocations against a plain count of every phrase, on the smallest tables and awkward rows."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import collocations, queries


def plain(rows, least=30, top=2000):
    """[(lang, text)] -> rows of the result."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = (text or "").encode().lower().decode()
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    gone = set()
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            gone |= {(lang, w[i : i + k]) for i in range(len(w) - k + 1) if 100 * a >= 80 * f[lang, w[i : i + k]]}
    out = {}
    for (lang, w), a in candidates.items():
        if (lang, w) not in gone:
            score, _, left, right = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -score) for lang, found in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def shown(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def frame(spark, rows):
    made = [(i, t, lang, "x", 1, 2) for i, (lang, t) in enumerate(rows)]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, phrase string, batch int, words int").repartition(3)


def test_query_matches_plain_python(spark, sf):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    assert shown(queries.op12_collocations(spark, sf)) == plain(rows)


PASSAGE = "the quick brown fox jumps over the lazy dog and runs away"
AWKWARD = [
    ("en", None), (None, None), ("en", ""), ("en", " \t\n.,;"), ("en", "one"), ("en", "one two"), ("en", "a b c"), ("en", "a b c d"), ("", "a b. a b! a b? a b"),
    *[("en", f"{PASSAGE}. other words {i}") for i in range(7)], *[(None, f"x{i} {PASSAGE.upper()}\x0btail") for i in range(5)], *[("und", PASSAGE)] * 3,
    ("fr", "la la la la la la la la la la"), ("fr", "É é\x1cé É é, É\té  é É"), ("de", " ".join(f"w{i % 50}" for i in range(20_000))), ("de", "y" * 70_000 + " z"),
]


@pytest.mark.parametrize(("least", "most"), [(2, 16 << 20), (3, 400), (6, 400)])
def test_awkward_rows_in_one_and_many_batches(spark, monkeypatch, least, most):
    monkeypatch.setattr(collocations, "batch_size", lambda *a: (most, 8 if most > 400 else 5))
    assert shown(collocations.collocations(frame(spark, AWKWARD), least=least)) == plain(AWKWARD, least)


def test_top_rows(spark):
    assert shown(collocations.collocations(frame(spark, AWKWARD), least=2, top=3)) == plain(AWKWARD, 2, 3)


def test_empty_table(spark):
    assert shown(collocations.collocations(frame(spark, []), least=1)) == []


def test_products_beyond_64_bits(spark, monkeypatch):
    """Counts of 10^13 times 2,000,000."""
    a, left, right = 10**13 + 7, 3 * 10**13 + 1, 2 * 10**13 + 3
    every = spark.createDataFrame([("en", "x y", 2, a), ("en", "x", 1, left), ("en", "y", 1, right)], "lang string, phrase string, size int, occurrences long")
    words = spark.createDataFrame([("en", 10**14)], "lang string, n long")
    monkeypatch.setattr(collocations, "phrases", lambda *a: (every, words))
    assert shown(collocations.collocations(every)) == [("en", 1, "x y", a, left, right, 10**14, 2000000 * a // (left + right))]


def test_flow_and_unary_paths():
    """Shorter counts come from the edges; a repeated passage is one path."""
    table = pa.table({"lang": ["en"] * 4, "text": [f"{PASSAGE}, first", f"{PASSAGE} second", "brown fox", "fox"]})
    graph = collocations.Graph(table)
    counts = [dict(zip([" ".join(graph.words(int(i), k + 1)) for i in at], n.tolist(), strict=True)) for k, (_, n, at) in enumerate(graph.orders)]
    assert counts[0]["fox"] == 4 and counts[0]["the"] == 4 and counts[1]["brown fox"] == 3 and counts[2]["quick brown fox"] == 2 and counts[3]["lazy dog and runs"] == 2
    edges, nodes = (np.zeros(len(graph.starts), np.int64) for _ in range(2))
    for told, (_, n, at) in ((edges, graph.orders[3]), (nodes, graph.orders[2])):
        told[at[n >= 2]] = n[n >= 2]
    (path,) = collocations._paths(graph, edges, nodes)
    assert " ".join(graph.words(path[0], path[1] + 3)) == PASSAGE and path[2] == 2
