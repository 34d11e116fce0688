"""Runs against a plain search over every period, on random sequences, the smallest tables and awkward rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from corpusloom.llm import periodic_runs, queries
from corpusloom.llm.shared import mixed


def plain_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = set()
    for s, length, q in runs:
        gone.update(range(s + q, s + length))
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def sequences():
    rng = random.Random(3)
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 200:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    yield from ([], [1], [1] * 300, fibonacci[-1], [0, 1] * 30 + [0] + [0, 1] * 30)
    yield [0, 1] + [0, 1, 0, 1, 0, 1, 0] * 2 + [1, 2]  # two progressions that meet
    for _ in range(1500):
        size, kinds = rng.randint(0, 90), rng.choice([1, 2, 2, 3, 5])
        base = [rng.randrange(kinds) for _ in range(rng.randint(1, 12))]
        words = rng.choice([(base * 90)[:size], [rng.randrange(kinds) for _ in range(size)], base * rng.randint(1, 9) + base[:1] + base * rng.randint(1, 9)])
        for _ in range(rng.randint(0, 3)):
            if words:
                words[rng.randrange(len(words))] = rng.randrange(kinds)
        yield words


def test_runs_of_any_sequence():
    for words in sequences():
        for least in (2, 12):
            numbers = mixed(np.array(words, np.uint64) + np.uint64(1))
            assert list(zip(*(x.tolist() for x in periodic_runs.runs_of(numbers, least)), strict=True)) == plain_runs(words, least)


def test_query_matches_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in queries.op11_periodic_runs(spark, sf).collect())
    assert got == sorted(plain_row(*r) for r in docs)
    assert sum(r[1] > 0 for r in got) > 5


PERIODIC = " ".join(["alpha", "beta", "gamma"] * 5)
AWKWARD = [
    (None, PERIODIC), (1, None), (2, ""), (3, " \t\n\x0b"), (4, "one"), (5, PERIODIC), (5, PERIODIC), (6, PERIODIC.upper() + "\x1c" + PERIODIC), (7, "same " * 20_000),
    (8, "  ".join(["é", "x"] * 3 + ["tail"])), (9, " ".join(f"w{i % 700}" for i in range(30_000))), (10, "a b\x0bc\x0ca b c a b c a b c"), (11, "x" * 70_000 + " y"),
]


def test_awkward_rows(spark):
    rows = spark.createDataFrame([(i, t, "x", 1, 0) for i, t in AWKWARD], "doc_id long, text string, runs string, id int, period int").repartition(3)
    got = periodic_runs.find_runs(rows).collect()
    want = []
    for i, t in AWKWARD:
        words = (t or "").encode().split()
        runs = plain_runs(words) if len(words) < 15_000 else [(0, 20_000, 1)] if i == 7 else [(0, 30_000, 700)]
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        want.append((i, len(words), runs, " ".join(w.decode() for k, w in enumerate(words) if k not in gone)))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r["id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed_text"]) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("rows", [[], [(None, None, "x")]])
def test_empty_tables_and_nulls(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = periodic_runs.find_runs(periodic_runs.with_planted_runs(docs), "id", "text").collect()
    assert [tuple(r) for r in got] == [(None, 0, [], "") for _ in rows]
