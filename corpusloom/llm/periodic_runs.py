"""Periodic runs of words, found with a dictionary of basic factors.

A run is a stretch of consecutive words of one document with smallest period q that no neighbouring word
extends, at least ``least`` and 2*q words long.

Basic factors are the stretches of 1, 2, 4, ... words. Each gets a number, equal for equal factors of one document: a
factor of twice the length is the pair of its halves. Factors that occur once in their document are left out at
every level, so that the levels of ordinary text thin out fast. At length L the successor occurrences of a factor form
arithmetic progressions while they follow each other at one step of at most L; inside a progression nothing but
the step itself is proposed. What is left are pairs of occurrences, one of them at an end of its progression,
whose distance q is at least L and less than twice L: each proposes the period q at that place. Every run is proposed
so: of the largest L up to q its first factor occurs again q words on; if neither place ends a progression, the ends
of the two progressions lie q apart, or one end and a place within the other one do.

A proposal is extended to both sides by steps of falling powers of two, comparing the numbers of the factors there,
and equal stretches are kept once, with their smallest period.

Documents are read in slices of about 4 MB of text and worked on in arrays, in the task that reads them: no shuffle, and
nothing depends on other documents, so hot keys and groups of copies don't matter. One document is one task's work; it
takes some 4 bytes a word and level, and as many levels as the logarithm of its longest repeat.

Words are bytes between ASCII white space, compared unchanged by 64-bit hashes within a document (two different words
among a million meet with a probability below 10^-7). Null and empty texts have no words, no runs and collapse to
an empty text. Repeated rows and ids are separate rows; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm.shared import WORD, mixed, slices, span_hashes, text_buffer, word_spans

_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _numbers(values: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal numbers for equal ``values`` (at places ``at``), -1 where a value occurs once; and the places left, by number and place."""
    out = np.full(size, -1, np.int32)
    order = np.argsort(values, kind="stable")
    values, at = values[order], at[order]
    new = np.empty(len(values) + 1, bool)
    new[0] = new[-1] = True
    new[1:-1] = values[1:] != values[:-1]
    often = ~(new[:-1] & new[1:])
    at = at[often]
    out[at] = np.cumsum(new[:-1])[often] - 1
    return out, at


def _factors(words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, numbers, places of repeated factors by number and place) of every level with repeated factors."""
    size, level = len(words), 0
    numbers, places = _numbers(words, np.arange(size), size)
    while len(places):
        yield 1 << level, numbers, places
        half = 1 << level
        at = np.sort(places)
        at = at[at + half < size]
        second = numbers[at + half]
        at, second = at[second >= 0], second[second >= 0]
        pairs = numbers[at].astype(np.int64) << 32 | second
        numbers, places = _numbers(pairs, at, size)
        level += 1


def _ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every k the numbers from begin[k] up to end[k], and k beside each."""
    sizes = np.maximum(end - begin, 0)
    which = np.repeat(np.arange(len(sizes)), sizes)
    return begin[which] + np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes), which


def _proposals(length: int, numbers: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) with ``length`` <= period < 2 * ``length``."""
    keys = numbers[places].astype(np.int64) << 32 | places
    steps = np.diff(keys)
    # a progression goes on where the step stays the same and bridges no gap
    inner = np.zeros(len(keys), bool)
    inner[1:-1] = (steps[1:] == steps[:-1]) & (steps[1:] <= length)
    ends = np.flatnonzero(~inner)
    after = np.append(ends[1:], len(keys) - 1)  # the next end: up to there the steps are one progression
    before = np.insert(ends[:-1], 0, 0)
    lefts, found = [], []
    for near, far, sign in ((after, np.searchsorted(keys, keys[ends] + 2 * length, "left"), 1), (before, np.searchsorted(keys, keys[ends] - 2 * length, "right"), -1)):
        if sign > 0:
            other, which = _ranges(np.maximum(near, np.searchsorted(keys, keys[ends] + length, "left")), far)
            lefts.append(places[ends[which]])
            # the step of the progression itself, where it is proposed at its first place only
            own = np.flatnonzero((ends[:-1] + 1 < len(keys)) & (steps[ends[:-1]] >= length) & (steps[ends[:-1]] < 2 * length))
            lefts.append(places[ends[own]])
            found += [keys[other] - keys[ends[which]], steps[ends[own]]]
        else:
            other, which = _ranges(far, np.minimum(near, np.searchsorted(keys, keys[ends] - length, "right") - 1) + 1)
            lefts.append(places[other])
            found.append(keys[ends[which]] - keys[other])
    place, period = np.concatenate(lefts), np.concatenate(found)
    good = (period >= length) & (period < 2 * length)
    return place[good], period[good]


def _extended(levels: list[np.ndarray], place: np.ndarray, period: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the stretch around each place whose words equal those ``period`` further on."""
    low, high = place.copy(), place.copy()
    for k in range(len(levels) - 1, -1, -1):
        names, step = levels[k], 1 << k
        ok = np.flatnonzero(high + period < size)
        here = names[high[ok]]
        ok = ok[(here >= 0) & (here == names[high[ok] + period[ok]])]
        high[ok] += step
        ok = np.flatnonzero(low >= step)
        here = names[low[ok] - step]
        ok = ok[(here >= 0) & (here == names[low[ok] - step + period[ok]])]
        low[ok] -= step
    return low, high - low + period


def runs_of(words: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run, by start, then period. Equal words of one document are equal numbers, those of two never."""
    levels, places, periods = [], [], []
    for length, numbers, at in _factors(words):
        levels.append(numbers)
        place, period = _proposals(length, numbers, at)
        places.append(place)
        periods.append(period)
    if not levels:
        return (np.zeros(0, np.int64),) * 3
    period = np.concatenate(periods)
    start, length = _extended(levels, np.concatenate(places), period, len(words))
    good = length >= np.maximum(least, 2 * period)
    start, length, period = start[good], length[good], period[good]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _dropped(size: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words lie in a run, after its first period."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) > 0


def _kept_text(data: bytes, starts: list[int], ends: list[int]) -> bytes:
    return b" ".join([data[a:b] for a, b in zip(starts, ends, strict=True)])


def _find(least: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            data, offsets = text_buffer(batch.column(1))
            starts, ends, counts = word_spans(data, offsets)
            edges = np.concatenate([[0], np.cumsum(counts)])
            which = np.repeat(np.arange(len(counts)), counts)
            words = span_hashes(data, (starts, ends))[0] if len(starts) else np.zeros(0, np.uint64)
            start, length, period = runs_of(mixed(words ^ mixed(which.astype(np.uint64) + np.uint64(1))), least)
            keep = ~_dropped(len(words), start, length, period)
            per_doc = np.searchsorted(start, edges)
            local = start - edges[which[start]] if len(start) else start
            found = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (local, length, period)], ["start", "length", "period"])
            raw, kept = data.tobytes(), np.concatenate([[0], np.cumsum(keep)])
            a, b, cut = starts[keep].tolist(), ends[keep].tolist(), kept[edges].tolist()
            texts = [_kept_text(raw, a[x:y], b[x:y]).decode("utf-8", "replace") for x, y in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(kind), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(per_doc, pa.int32()), found), pa.array(texts, pa.string())],
                ["id", "n_words", "runs", "collapsed_text"],
            )

    return run


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """Each row's id, n_words, runs (start, length and period in words, by start, then period) and collapsed_text:
    the words that no run holds after its first period, joined by one space."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["id"].dataType
    return rows.mapInArrow(_find(least, to_arrow_type(kind)), f"id {kind.simpleString()}, n_words long, runs {_RUNS}, collapsed_text string")


def longest(runs: Column) -> Column:
    """The run of greatest length; of equal ones that of the smallest start, then period. Null if there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def run_list(runs: Column) -> Column:
    """``start,length,period`` and a line feed for each run."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text, where a tenth of the texts, by a hash of the id, goes on periodically from one of its words on.

    With h = crc32(id as text), g = floor(h / 10) and n words: if h % 10 is 0 and n > 0, each word i >= a = g % n
    becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)); those words are joined by one space. A null id plants nothing.
    """
    h = F.crc32(docs[id_col].cast("string"))
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.select("id", "text", "g", words.alias("words")).withColumn("n", F.size("words"))
    a = (F.col("g") % F.col("n")).cast("int")
    rows = rows.withColumn("a", F.when(F.col("n") > 0, a))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    cycle = F.slice("words", F.col("a") + 1, F.col("p"))
    tail = F.flatten(F.array_repeat(cycle, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    planted = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), F.lit(1), F.col("n")), " ")
    return rows.select("id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))
