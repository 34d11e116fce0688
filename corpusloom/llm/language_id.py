"""Language of a text by rank-order profiles (Cavnar and Trenkle, 1994).

A profile is a list of the most frequent n-grams of 1 to 3 letters, the most frequent one first, equal ones by their letters. A
language's profile comes from all its training texts, a document's from its own text. Their distance is out-of-place:
the difference of each of the document's n-grams' ranks in both lists, and the length of a profile for one that
the language doesn't list. The nearest language is the prediction, equal ones by name; the score is 1 - distance / greatest possible
distance.

Texts are lower-cased and cut into words of letters; a word carries a mark at both ends, so that its beginnings and endings are n-grams
of their own. Only trigrams are sorted and counted: pairs are the sums of the trigrams that they begin (or end, for
those that end a word), letters the sums of the pairs they begin.

Tasks add up their own part of the corpus by language before anything is shuffled, so that a language or source of a third of all
rows is one row a task and n-gram. Profiles are ``length`` n-grams for each language; they go to the tasks with the function, and more than
``LANGUAGES`` different languages raise an error instead of growing it. Documents are then judged where they lie,
without a shuffle; copies, hot sources and long texts are work in proportion to their bytes.

Null texts and texts without letters get ``und`` and score 0; so does every text where nothing was learned. A null language teaches nothing;
a null id is in training. Repeated rows count as often as they occur. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm.shared import slices

#: A profile's n-grams, and how many languages may be told apart (8,000 have codes of their own).
LENGTH, LANGUAGES = 300, 10_000
#: Bits of a code point.
_BITS = 21


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Grams:
    """The n-grams of some texts by a number given for each (its own, or its language's).

    ``parts`` has (key, count) of 1, 2 and 3 letters, each by key: the number, then the letters' places in
    ``alphabet``, ``bits`` bits each. Place 0 is the mark at both ends of a word.
    """

    def __init__(self, texts: list[str | None], numbers: np.ndarray):
        lowered = [(t or "").lower() for t in texts]
        points = np.frombuffer("\0".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _letters()[points]
        kept = letter.copy()
        kept[1:] |= letter[:-1]  # each letter, and one mark behind each word
        points = np.where(letter, points, 0)[kept]
        self.alphabet = np.flatnonzero(np.bincount(points, minlength=1) | (np.arange(max(1, int(points.max(initial=0)) + 1)) == 0))
        self.bits = max(1, int(len(self.alphabet) - 1).bit_length())
        place = np.zeros(int(self.alphabet[-1]) + 1, np.int64)
        place[self.alphabet] = np.arange(len(self.alphabet))
        stream = np.concatenate([[0], place[points], [0]])
        at = np.flatnonzero(stream)
        number = np.repeat(numbers, [len(t) + 1 for t in lowered])[letter].astype(np.int64)
        #: Whether keys have room; else there are too many texts at once.
        self.fits = 3 * self.bits + int(numbers.max(initial=0)).bit_length() <= 63
        if self.fits:
            self.parts = self._counted(((number << self.bits | stream[at - 1]) << self.bits | stream[at]) << self.bits | stream[at + 1])

    def _counted(self, trigrams: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        bits, low = self.bits, (1 << self.bits) - 1
        three, n3 = _summed(np.sort(trigrams), np.ones(len(trigrams), np.int64))
        # the pair ab: trigrams xab; the pair of a mark and a: trigrams that begin with both
        opening = three >> 2 * bits & low == 0
        two = np.concatenate([three >> 3 * bits << 2 * bits | three & (1 << 2 * bits) - 1, (three >> bits)[opening]])
        order = np.argsort(two, kind="stable")
        two, n2 = _summed(two[order], np.concatenate([n3, n3[opening]])[order])
        letters = two >> bits & low != 0
        one, n1 = _summed(two[letters] >> bits, n2[letters])
        return [(one, n1), (two, n2), (three, n3)]

    def codes(self, size: int, keys: np.ndarray) -> np.ndarray:
        """Code points of n-grams, ``_BITS`` bits each; the mark is 1."""
        points = np.where(self.alphabet == 0, 1, self.alphabet).astype(np.int64)
        out = np.zeros(len(keys), np.int64)
        for k in range(size - 1, -1, -1):
            out = out << _BITS | points[keys >> k * self.bits & (1 << self.bits) - 1]
        return out

    def numbered(self, size: int, keys: np.ndarray) -> np.ndarray:
        return keys >> size * self.bits


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different ones of sorted keys, and their counts added up."""
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], np.add.reduceat(counts, begin) if len(begin) else counts[:0]


def _all_grams(texts: list[str | None], numbers: np.ndarray) -> Iterator[Grams]:
    """n-grams of the texts, in one piece or in as many as their keys need."""
    grams, half = Grams(texts, numbers), len(texts) // 2
    if grams.fits:
        yield grams
    else:
        yield from _all_grams(texts[:half], numbers[:half])
        yield from _all_grams(texts[half:], numbers[half:])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, code, n) of a task's texts, added up as far as memory allows."""
    langs: dict[str, int] = {}
    held, size = [], 0

    def added() -> tuple[np.ndarray, ...]:
        lang, code, n = (np.concatenate([h[k] for h in held]) for k in range(3))
        order = np.lexsort((code, lang))
        lang, code, n = lang[order], code[order], n[order]
        begin = np.flatnonzero(np.append(True, (lang[1:] != lang[:-1]) | (code[1:] != code[:-1])))
        return lang[begin], code[begin], np.add.reduceat(n, begin)

    def rows() -> pa.RecordBatch:
        lang, code, n = held[0]
        names = pa.array(list(langs), pa.string())
        return pa.RecordBatch.from_arrays([names.take(pa.array(lang)), pa.array(code, pa.int64()), pa.array(n, pa.int64())], ["lang", "code", "n"])

    for batch in slices(batches, 1):
        numbers = np.array([langs.setdefault(x, len(langs)) for x in batch.column(0).to_pylist()], np.int64)
        for grams in _all_grams(batch.column(1).to_pylist(), numbers):
            for k, (keys, n) in enumerate(grams.parts, 1):
                held.append((grams.numbered(k, keys), grams.codes(k, keys), n))
                size += len(keys)
        if size > 1 << 20:
            held = [added()]
            size = len(held[0][0])
            if size > 1 << 19:
                yield rows()
                held, size = [], 0
    if size:
        held = [added()]
        yield rows()


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", length: int = LENGTH) -> dict[str, np.ndarray]:
    """Each language's profile: the codes of its ``length`` most frequent n-grams, the most frequent one first. Rows without a language are passed over."""
    rows = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text")).where("lang IS NOT NULL")
    counts = rows.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= length)
    profiles = best.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "code")))["code"].alias("codes")).limit(LANGUAGES + 1).collect()
    if len(profiles) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    return {r["lang"]: np.array(r["codes"], np.int64) for r in profiles}


class Nearest:
    """Profiles side by side, for many texts at once."""

    def __init__(self, profiles: dict[str, np.ndarray], length: int):
        self.length, self.langs = length, sorted(profiles)
        self.codes = np.unique(np.concatenate([profiles[x] for x in self.langs])) if profiles else np.zeros(0, np.int64)
        #: each language's rank of each code, -1 where it doesn't list it; one more code for all others
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, np.int32)
        for row, lang in zip(self.ranks, self.langs, strict=True):
            row[np.searchsorted(self.codes, profiles[lang])] = np.arange(len(profiles[lang]))

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        if self.langs:
            for grams in _all_grams(texts, np.arange(len(texts))):
                self._judge(grams, langs, scores)
        return langs, scores

    def _judge(self, grams: Grams, langs: list[str], scores: np.ndarray) -> None:
        text = np.concatenate([grams.numbered(k, keys) for k, (keys, _) in enumerate(grams.parts, 1)])
        if not len(text):
            return
        n = np.concatenate([n for _, n in grams.parts])
        order = np.argsort(text << 32 | (1 << 32) - 1 - n, kind="stable")  # equal ones stay by length and letters
        text = text[order]
        begin = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        rank = np.arange(len(text)) - np.repeat(begin, np.diff(np.append(begin, len(text))))
        listed = rank < self.length
        order, text, rank = order[listed], text[listed], rank[listed]
        code = np.concatenate([grams.codes(k, keys) for k, (keys, _) in enumerate(grams.parts, 1)])[order]
        at = np.searchsorted(self.codes, code)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != code] = len(self.codes)
        begin = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        least, best = np.full(len(begin), np.iinfo(np.int64).max), np.zeros(len(begin), np.int64)
        for k, ranks in enumerate(self.ranks):
            there = ranks[at]
            far = np.add.reduceat(np.where(there < 0, self.length, np.abs(there - rank)), begin)
            best[far < least] = k
            least = np.minimum(far, least)
        most = np.diff(np.append(begin, len(text))) * self.length
        found = text[begin]  # numbers of texts in the whole slice
        scores[found] = 1 - least / most
        for i, k in zip(found.tolist(), best.tolist(), strict=True):
            langs[i] = self.langs[k]


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Each row's id, lang_pred and score."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    nearest, kind = Nearest(profiles, length), to_arrow_type(rows.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            langs, scores = nearest.judge(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")
