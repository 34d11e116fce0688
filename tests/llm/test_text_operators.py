"""Operators against plain Python on the smallest tables and on awkward rows."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from corpusloom.llm import exact_dedup, language_model, packing, queries, simhash, substrings

from corpusloom.llm.shared import pack_sorted, span_hashes, unpack_sorted

from . import brute

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(40))
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two three four five six seven eight nine ten eleven twelve thirteen"),
    (6, "x " + PASSAGE + " y"), (7, PASSAGE), (8, "ÀÉ " + PASSAGE.upper() + " end"), (9, LONG), (10, LONG), (11, "tail\x0b" + PASSAGE + " z"),
    (12, "one two three four five six seven eight nine ten eleven twelve thirteen"), (13, "a\x1cb a  b   c\n  d "), (14, "x" * 70_000),
]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def frame(spark, rows):
    """With other columns whose names the operators use themselves."""
    made = [(i, t, "x", 1, 2.0) for i, t in rows]
    return spark.createDataFrame(made, "doc_id long, text string, batch string, shard int, hashes double").repartition(3)


def test_simhash_matches_brute_force(spark, docs):
    rows = docs[:150] + [(10_000 + i, t) for i, t in AWKWARD]
    got = {r["id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.simhash_components(rows)


def test_simhash_crowded_buckets_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(60):
            x = int(b)
            for bit in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(bit)
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    for crowd in (1, 8, 256):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        classes = spark.createDataFrame([(x,) for x in signed], "fp long")
        got = {(min(r), max(r)) for r in simhash.links(classes).collect()}
        assert got == want


def test_drop_near_duplicates_keeps_smallest_id_once(spark):
    rows = [(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (9, "q r s t u v"), (None, "a b c d")]
    kept = simhash.drop_near_duplicates(frame(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 9] and kept[0]["batch"] == "x"


def test_substrings_match_brute_force(spark, docs):
    rows = docs + [(10_000 + i, t) for i, t in AWKWARD]
    found = substrings.remove_repeats(frame(spark, rows)).collect()
    got = {r["doc_id"]: (r["n_words"], sum(x["end"] - x["start"] for x in r["removed"]), hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in found}
    assert len(found) == len(rows) and got == brute.repeats(rows)


def test_words_of_one_structure_are_told_apart(spark):
    """Thue-Morse words, which every polynomial hash modulo 2^64 confuses."""
    a = "a"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"t{k}" for k in range(12))
    rows = [(1, f"{a} {tail}"), (2, f"{b} {tail}"), (3, f"{a[:64]} {tail}"), (4, f"{b[:64]} {tail}"), (5, f"{a} {tail}"), (6, a[:128]), (7, b[:128])]
    found = {r["doc_id"]: r["removed"] for r in substrings.remove_repeats(frame(spark, rows)).collect()}
    assert [len(found[i]) for i in range(1, 8)] == [0, 0, 0, 0, 1, 0, 0]
    known = {r["doc_id"]: r["n_known"] for r in language_model.score_texts(frame(spark, [(i, t) for i, t in rows if i in (1, 2)]), folds=1, held=5).collect()}
    assert known == {1: 14, 2: 14}
    data = np.frombuffer((a + b).encode(), np.uint8)
    (h,) = span_hashes(data, (np.array([0, 2048, 0, 2048]), np.array([2048, 4096, 128, 2176])))
    assert len(set(h.tolist())) == 4


def test_all_null_and_all_equal_ids(spark):
    for key in (None, 4):
        rows = [(key, f"{PASSAGE} {i}") for i in range(300)]
        found = substrings.remove_repeats(frame(spark, rows)).collect()
        assert len(found) == 300 and not any(r["removed"] for r in found)
        assert len({r["score"] for r in language_model.score_texts(frame(spark, rows)).collect()}) < 300


def test_giant_document(spark):
    giant = " ".join(f"g{i}" for i in range(400_000))
    rows = [(1, giant), (2, giant[: len(giant) // 2]), (3, "small " + " ".join(f"g{i}" for i in range(100, 120)))]
    found = {r["doc_id"]: sum(x["end"] - x["start"] for x in r["removed"]) for r in substrings.remove_repeats(frame(spark, rows)).collect()}
    assert found[1] == 0 and found[3] == 20 and found[2] in (giant[: len(giant) // 2].count(" "), giant[: len(giant) // 2].count(" ") + 1)


def test_substrings_in_many_batches(spark, docs, monkeypatch):
    monkeypatch.setattr(substrings, "batch_size", lambda *_: (20_000, 37))
    rows = [(i, t) for i, t in docs] + [(10_000 + i, t) for i, t in AWKWARD] + [(2**63 - 1, PASSAGE + " z"), (-(2**63), " ".join(PASSAGE.split()[5:30]))]
    found = substrings.remove_repeats(frame(spark, rows)).collect()
    got = {r["doc_id"]: (r["n_words"], sum(x["end"] - x["start"] for x in r["removed"]), hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in found}
    assert got == brute.repeats(rows)


def test_packed_numbers():
    rng = np.random.default_rng(2)
    for n in (0, 1, 1000):
        h = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        assert (unpack_sorted(pack_sorted(h)) == h).all()
        c = rng.integers(0, 70_000, n)
        assert (language_model._unpack(language_model._pack(c)) == c).all()


def test_substrings_repeated_rows_and_null_ids(spark):
    rows = [(5, PASSAGE), (5, PASSAGE), (2**60 + 1, "one"), (None, PASSAGE), (None, None)]
    got = sorted((r["doc_id"] is None, len(r["removed"]), r["n_words"]) for r in substrings.remove_repeats(frame(spark, rows)).collect())
    assert got == [(False, 0, 1), (False, 0, 40), (False, 0, 40), (True, 0, 0), (True, 1, 40)]


def test_language_model_matches_brute_force(spark, docs):
    rows = docs + [(10_000 + i, t) for i, t in AWKWARD]
    want = brute.language_model(rows)
    for r in language_model.score_texts(frame(spark, rows)).collect():
        held, n, known, total, base, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)


def test_automaton_states_are_distributions(docs):
    model = brute.Automaton([brute.lower(t)[:300] for _, t in docs[:20]])
    states = [(), *[s for s in model.fails if s[-1] != "</s>"]][:400]
    for state in states:
        assert sum(model.step(state, w)[0] for w in [*model.arcs[()], b"never seen"]) == pytest.approx(1)


def test_language_model_takes_batches_apart(spark, monkeypatch):
    """Counts of n-grams that are in one batch only, in several, or in held-out texts only."""
    monkeypatch.setattr(language_model, "batch_size", lambda *_: (600, 40))
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.4, 30) % 50)) for i in range(200)]
    rows += [(i + 300, t) for i, t in rows[:20]] + [(None, "w1 w2"), (7, rows[7][1])]
    want = brute.language_model([(i if k != 221 else "7", t) for k, (i, t) in enumerate(rows)])
    want["None"] = want[None]
    got = language_model.score_texts(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_known"], r["train_tokens"]) == want[r["doc_id"]][2:4] and r["score"] == pytest.approx(want[r["doc_id"]][5], rel=1e-9)


def test_language_model_is_better_than_the_root_on_held_out_texts(spark, sf):
    found = queries.op3_language_model(spark, sf).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert found["s"] > found["b"]


def test_empty_tables(spark):
    none = frame(spark, AWKWARD).where("doc_id < 0")
    assert language_model.score_texts(none).count() == substrings.remove_repeats(none).count() == 0
    assert simhash.near_duplicates(none).count() == exact_dedup.exact_duplicates(none).count() == 0
    assert packing.pack_documents(none, queries.tokenizer_path()).count() == 0


def test_exact_dedup(spark):
    rows = [(1, "Same Text"), (2, "same text"), (3, "SAME TEXT"), (4, "Éa"), (5, "éa"), (6, None), (7, ""), (3, "same text"), (None, "same text")]
    got = exact_dedup.exact_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == 4
    same = [r for r in got if r["text_sha256"] == hashlib.sha256(b"same text").hexdigest()]
    assert len(same) == 5 and {r["keep_id"] for r in same} == {3} and {r["group_size"] for r in same} == {5}
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact_duplicates(frame(spark, rows)).collect()) == [3, 4, 5, 7]


def test_cuckoo_index_inserts_deletes_and_resizes():
    index = exact_dedup.CuckooIndex(buckets=2)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        assert index.get(k) is None
        index.insert(k, [i, 0, 1, 1])
    assert index.resizes > 0 and index.verified < 200 and all(index.get(k)[0] == i for i, k in enumerate(keys))
    assert all(index.delete(k) for k in keys[::2]) and not index.delete(keys[0])
    assert [index.get(k) is None for k in keys] == [i % 2 == 0 for i in range(3000)]


def test_drop_exact_duplicates_folds_repeated_rows(spark):
    rows = [(7, "t"), (7, "t"), (7, "T"), (3, "t"), (None, "n"), (None, "n"), (2, "u")]
    kept = exact_dedup.drop_exact_duplicates(frame(spark, rows))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"].lower()) for r in kept.collect()) == [(False, 2, "u"), (False, 7, "t"), (True, 0, "n")]
    texts = spark.createDataFrame([("null", "a"), (None, "a"), (None, "b")], "doc_id string, text string")
    assert sorted((r["doc_id"] or "", r["text"]) for r in exact_dedup.drop_exact_duplicates(texts).collect()) == [("", "b"), ("null", "a")]


def test_update_index(spark):
    start = exact_dedup.with_digest(frame(spark, [(1, "a"), (2, "b"), (3, "A")]))
    index = exact_dedup.build_index(start)
    out = exact_dedup.update_index(index, exact_dedup.with_digest(frame(spark, [(9, "b"), (5, "c"), (4, "a")])), start.where("doc_id = 1"))
    assert sorted((r["keep_id"], r["group_size"]) for r in out.collect()) == [(4, 1), (5, 1), (9, 2)]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.tokenizer_path())
    model.encode_special_tokens = True
    return lambda t: model.encode(t or "", add_special_tokens=False).ids


def test_cached_tokenizer_gives_the_same_ids(plain, docs):
    texts = [t for _, t in docs] + [t or "" for _, t in AWKWARD] + [" a", "a ", "a\n b", "a \n b", "a  b", "  x", "x 　y", "a <|endoftext|> b", "it's 'll", " ", "a\r\n b\t c", "é ​ x", "a \x1c b"]
    got = packing.WordCachedTokenizer(queries.tokenizer_path()).encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain(text), text[:60]


def test_packing_round_trip(spark, docs, plain):
    rows = docs + [(10_000 + i, t) for i, t in AWKWARD]
    pieces = packing.pack_documents(frame(spark, rows), queries.tokenizer_path()).collect()
    whole, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        whole[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append(p)
    for i, text in rows:
        ids = [*plain(text), 0]
        parts = sorted(whole[i], key=lambda p: p["start"])
        assert np.frombuffer(b"".join(bytes(p["ids"]) for p in parts), "<u4").tolist() == ids
        assert [p["start"] for p in parts] == [sum(q["length"] for q in parts[:k]) for k in range(len(parts))]
        assert {p["doc_tokens"] for p in parts} == {len(ids)}
    for parts in sequences.values():
        parts.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in parts] == [sum(q["length"] for q in parts[:k]) for k in range(len(parts))]
        size = sum(p["length"] for p in parts)
        assert size == 1024 or size & (size - 1) == 0 and size < 1024
    digest = queries.op7_packing(spark, "/root/testdata/sf0.001").first()
    assert 0 <= digest["ids_crc32"] < 1 << 32 and zlib.crc32(b"") == 0


def test_packing_null_and_repeated_ids(spark, plain):
    rows = [(None, "one two"), (None, None), (3, "same text here"), (3, "same text here"), (3, "other")]
    pieces = packing.pack_documents(frame(spark, rows), queries.tokenizer_path()).collect()
    want = sorted((i is None, i or 0, len(plain(t)) + 1) for i, t in rows)
    got = defaultdict(int)
    for p in pieces:
        got[p["doc_id"]] += p["length"]
    assert {k: got[k] for k in got} == {None: sum(n for none, _, n in want if none), 3: sum(n for none, _, n in want if not none)}


def test_packer_places_by_sum_of_squares():
    rng = np.random.default_rng(1)
    packer = packing.LevelPacker(64)
    for k in range(500):
        n = int(rng.integers(1, 64))
        before = packer.levels.copy()
        options = {}
        for h in range(0, 65 - n):
            if h == 0 or before[h]:
                after = before.copy()
                if h:
                    after[h] -= 1
                if h + n < 64:
                    after[h + n] += 1
                options[h] = int((after**2).sum())
        assert options[packer.level_for(n)] == min(options.values())
        packer.place((k, 0, bytes(4 * n), n))
