import numpy as np

import corpus_pipeline
from corpusloom.llm import near_copies
from tests.llm import brute


def jaccard(a, b, n=5):
    a, b = ({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set() for w in (brute.lower(a), brute.lower(b)))
    return len(a & b) / len(a | b) if a | b else 1.0


def planted():
    """Texts, changed copies on both sides of 0.8, a chain of near copies, and awkward rows."""
    rng = np.random.default_rng(3)
    texts = [None, "", " \n", "one two", "One  two", "one two three four five", "one two three four six"]
    for n in (30, 60, 120, 400, 900):
        for changes in (1, 2, 3, 5, 8, 13):
            words = [f"w{x}" for x in rng.integers(0, 5000, n)]
            texts.append(" ".join(words))
            for at in rng.integers(0, n, changes):
                words[at] = f"new{at}"
            texts.append("  ".join(words).upper())
    words = [f"c{x}" for x in range(100)]
    for k in range(12):
        texts.append(" ".join(words))
        words[8 * k] = f"d{k}"
    return list(enumerate(texts))


def test_stage_drops_planted_near_copies(spark, sf):
    rows = planted()
    root = {i: i for i, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = 0
    for i, a in rows:
        for j, b in rows[:i]:
            if jaccard(a, b) >= 0.8:
                pairs += 1
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near(spark, docs, sf).collect()}
    assert pairs > 25 and kept == {i for i, _ in rows if top(i) == i}


def test_candidates_hardly_miss_a_pair():
    rng = np.random.default_rng(4)
    missed = 0
    for _ in range(1000):
        common, own = rng.integers(0, 1 << 63, 80, dtype=np.uint64), rng.integers(0, 1 << 63, 20, dtype=np.uint64)
        a, b = (near_copies.band_keys(np.concatenate([common, x])) for x in (own[:10], own[10:]))
        missed += not (a == b).any()
    assert missed <= 1


def test_no_rows(spark, sf):
    assert corpus_pipeline.drop_near(spark, spark.createDataFrame([], "doc_id long, text string"), sf).count() == 0


def test_texts_that_share_a_passage_are_not_paired(spark, monkeypatch):
    """Hundreds of texts of similarity near 0.5 with two near copies among them: few pairs, both links found."""
    rng = np.random.default_rng(6)
    common = " ".join(f"c{k}" for k in range(60))
    rows = [(i, common + " " + " ".join(f"w{x}" for x in rng.integers(0, 10**6, 25))) for i in range(400)]
    rows += [(1000, rows[7][1] + " more"), (1001, "start " + rows[99][1])]
    asked = []
    plain = near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda pairs, *more: (asked.append(pairs.count()), plain(pairs, *more))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r["id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    assert {i: c for i, c in found.items() if i != c} == {1000: 7, 1001: 99}
    assert asked[1] < 4000


def test_what_is_connected_is_not_worked_out_again(spark, monkeypatch):
    """Checkpoints of a table with one crowd: every set of links was followed from its start, twice for the first."""
    from corpusloom.llm import components

    made = []
    plain = components.materialise
    monkeypatch.setattr(components, "materialise", lambda df: (made.append(1), plain(df))[1])
    rng = np.random.default_rng(7)
    common = " ".join(f"c{k}" for k in range(60))
    rows = [(i, common + " " + " ".join(f"w{x}" for x in rng.integers(0, 10**6, 25))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " more") for i in range(20)]
    found = {r["id"]: r["component_id"] for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {i: c for i, c in found.items() if i != c} == {100 + i: i for i in range(20)}
    assert len(made) <= 8


def test_links_that_lead_to_their_roots_take_no_round(spark, monkeypatch):
    from corpusloom.llm import components

    made = []
    plain = components.materialise
    monkeypatch.setattr(components, "materialise", lambda df: (made.append(1), plain(df))[1])
    of = lambda pairs: {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert of([(5, 1), (1, 7), (9, 9), (8, 2), (2, 8)]) == {1: 1, 5: 1, 7: 1, 2: 2, 8: 2} and len(made) == 1
    assert of([(k, k + 1) for k in range(40)]) == dict.fromkeys(range(41), 0)


def test_a_large_group_that_links_leave_in_parts_makes_no_pairs(spark, monkeypatch):
    """Copies changed by different degrees: those that are near join, the others are held against all; before, as pairs in rows."""
    rng = np.random.default_rng(8)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(240):
        words = list(base)
        for at in rng.integers(0, 120, 1 + i % 6):
            words[at] = f"x{rng.integers(10**9)}"
        rows.append((i, " ".join(words)))
    root = list(range(len(rows)))
    for i, a in rows:
        for j, b in rows[:i]:
            if root[i] != root[j] and jaccard(a, b) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    asked = []
    plain = near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda pairs, *more: (asked.append(pairs.count()), plain(pairs, *more))[1])
    monkeypatch.setattr(near_copies, "BLOCK", 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r["id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    assert found == dict(enumerate(root)) and 30 < len(set(root)) < 200
    assert asked[-1] < 2000


def test_cells_connect_what_any_pair_connects():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 60, n)) for n in rng.integers(1, 40, 70)] + [np.arange(5), np.arange(5)]
    common = near_copies.common_shingles(np.concatenate(sets), np.array([len(s) for s in sets]))
    assert all(common[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(72) for j in range(72) if i != j)
    alike = np.array([[i != j and len(np.intersect1d(a, b)) >= 0.5 * len(np.union1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    group = np.arange(72) // 2
    pairs = near_copies.connecting(alike, group)

    def parts(pairs):
        top = group.copy()
        for a, b in pairs:
            top[top == top[a]] = top[b]
        return {frozenset(np.flatnonzero(top == t).tolist()) for t in top}

    assert parts(pairs) == parts(np.argwhere(alike)) and 0 < len(pairs) < 36


def test_crowded_texts_have_few_fine_keys_that_hardly_miss_a_pair():
    """240 rows of each crowded text before."""
    rng = np.random.default_rng(10)
    missed = 0
    for _ in range(1000):
        common, own = rng.integers(0, 1 << 63, 80, dtype=np.uint64), rng.integers(0, 1 << 63, 20, dtype=np.uint64)
        a, b = (near_copies.band_keys(np.concatenate([common, x]), near_copies._FINE) for x in (own[:10], own[10:]))
        missed += not (a == b).any()
    assert missed <= 5 and len(a) <= 50


def test_crowds_take_few_checkpoints(spark, monkeypatch):
    """A crowd's way through the stage, with links in two rounds; each checkpoint and each shuffle before it has a file for every partition."""
    from corpusloom.llm import components

    made = []
    plain = near_copies.materialise
    for module in (components, near_copies):
        monkeypatch.setattr(module, "materialise", lambda df: (made.append(1), plain(df))[1])
    rng = np.random.default_rng(7)
    common = " ".join(f"c{k}" for k in range(60))
    rows = [(i, common + " " + " ".join(f"w{x}" for x in rng.integers(0, 10**6, 25))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " more") for i in range(20)]
    found = {r["id"]: r["component_id"] for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {i: c for i, c in found.items() if i != c} == {100 + i: i for i in range(20)}
    assert len(made) <= 20


def test_many_texts_of_one_star_are_verified_in_parts(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "STAR", 3)
    rng = np.random.default_rng(11)
    base = rng.integers(-(1 << 62), 1 << 62, 40)
    sets = [np.unique(np.concatenate([base[: rng.integers(25, 41)], rng.integers(-(1 << 62), 1 << 62, rng.integers(0, 12))]).view(np.uint64)).view(np.int64) for _ in range(30)]
    table = spark.createDataFrame([(i, [int(x) for x in s]) for i, s in enumerate(sets)], "class long, hashes array<long>")
    pairs = [(u, v) for u in (0, 7, 29) for v in range(30) if u != v]
    found = near_copies.verified(spark.createDataFrame(pairs, "u long, v long").repartition(5), table, 0.8)
    alike = {(u, v) for u, v in pairs if len(np.intersect1d(sets[u], sets[v])) >= 0.8 * len(np.union1d(sets[u], sets[v]))}
    assert {(r["u"], r["v"]) for r in found.collect()} == alike and 3 < len(alike) < 80
