"""Language profiles: SQL on the smallest tables, held-out accuracy, a plain version on awkward rows."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from corpusloom.llm import language_id, queries


def plain_grams(text):
    out, word = Counter(), ""
    for c in [*(text or "").lower(), " "]:
        if c.isalpha():
            word += c
        elif word:
            marked = "\x01" + word + "\x01"
            out.update(word)
            out.update(marked[i : i + k] for k in (2, 3) for i in range(len(marked) - k + 1))
            word = ""
    return out


def plain_profile(counts, length=300):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), [ord(c) for c in x[0]]))[:length]]


def plain_identify(training, texts, length=300):
    counts = {}
    for lang, text in training:
        if lang is not None:
            counts.setdefault(lang, Counter()).update(plain_grams(text))
    profiles = {lang: {g: r for r, g in enumerate(plain_profile(n, length))} for lang, n in counts.items() if n}
    out = []
    for text in texts:
        own = plain_profile(plain_grams(text), length)
        far = [(sum(abs(p[g] - r) if g in p else length for r, g in enumerate(own)), lang) for lang, p in profiles.items()]
        out.append((min(far)[1], 1 - min(far)[0] / (length * len(own))) if own and far else ("und", 0.0))
    return out


def test_query_matches_sql_and_plain_python(spark, sf):
    got = sorted(tuple(r) for r in queries.op13_language_id(spark, sf).collect())
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got == sorted(duck.sql(queries.ORACLE_SQL["op13_language_id"]).fetchall())
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").collect())
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in docs]
    want = plain_identify([(lang, text) for (_, lang, text), h in zip(docs, held, strict=True) if not h], [text for _, _, text in docs])
    assert got == [(i, h, *w) for (i, _, _), h, w in zip(docs, held, want, strict=True)]


def test_held_out_accuracy(spark):
    """Texts of ten words or more that weren't learned from: at least 99 of 100 right."""
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: (r["lang"], len((r["text"] or "").split())) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [(r["lang_pred"], *lang[r["doc_id"]]) for r in queries.op13_language_id(spark, sf).collect() if r["held_out"]]
    long = [pred == true for pred, true, n in held if true is not None and n >= 10]
    assert len(long) > 150 and sum(long) / len(long) >= 0.99


TRAINING = [("en", "The cat sat on the mat, and the dog barked."), ("fr", "Le chat est assis sur le tapis et le chien aboie"), ("fr", None), (None, "xyz xyz"), ("ru", "Кошка сидит на ковре"), ("zz", "123 456"), ("el", "ΟΔΟΣ οδός")]
TEXTS = [None, "", " \t\n", "1234 !?", "a", "the", "Le Chien", "КОВЁР ковре", "日本語の文字と漢字", "İstanbul ISTANBUL ß ẞ", "cat\x00sat", "x" * 50_000, "the dog " * 20_000, "été", "le the"]


@pytest.fixture(scope="module")
def frames(spark):
    training = spark.createDataFrame([(lang, t, "y", 1) for lang, t in TRAINING], "lang string, text string, code string, n int").repartition(3)
    docs = spark.createDataFrame([(i, t, "y", 1, "z") for i, t in [*enumerate(TEXTS), (None, "the"), (5, "the")]], "doc_id long, text string, lang_pred string, score int, id string").repartition(3)
    return training, docs


def test_awkward_rows(frames):
    training, docs = frames
    for length in (300, 7):
        got = language_id.identify(docs, language_id.learn(training, length=length), length=length).collect()
        want = [*enumerate(plain_identify(TRAINING, TEXTS, length)), (None, plain_identify(TRAINING, ["the"], length)[0]), (5, plain_identify(TRAINING, ["the"], length)[0])]
        key = lambda r: (r[0] is None, r[0] or 0)
        assert sorted(map(tuple, got), key=key) == sorted(((i, *w) for i, w in want), key=key)


def test_pieces_and_sums_do_not_change_counts():
    """More letters than keys have room for are counted in pieces."""
    texts = ["".join(chr(0x4E00 + (i * 7919 + k * 31) % 20_000) for k in range(40)) + " tail" for i in range(3000)]
    numbers = np.full(len(texts), 1 << 19)
    assert not language_id.Grams(texts, numbers).fits
    total = Counter()
    for grams in language_id._all_grams(texts, numbers):
        for k, (keys, n) in enumerate(grams.parts, 1):
            for code, m in zip(grams.codes(k, keys).tolist(), n.tolist(), strict=True):
                total["".join(chr(code >> 21 * j & (1 << 21) - 1) for j in range(k))[::-1]] += m
    want = Counter()
    for t in texts:
        want.update(plain_grams(t))
    assert total == want


def test_nothing_learned_and_empty_tables(spark, frames):
    training, docs = frames
    assert language_id.learn(training.where("lang IS NULL")) == {} and language_id.learn(training.limit(0)) == {}
    assert {tuple(r)[1:] for r in language_id.identify(docs, {}).collect()} == {("und", 0.0)}
    assert language_id.identify(docs.limit(0), language_id.learn(training)).collect() == []


def test_too_many_languages_are_an_error(spark, frames, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    with pytest.raises(ValueError, match="languages"):
        language_id.learn(frames[0])
