"""Repeated passages found by fixed-block anchors.

A window is ``window`` consecutive words (13). It is a repeat if its words also start in a document with a
smaller id; every word that a repeat covers is removed.

Any window of 13 words holds a whole block of ``anchor`` = 7 words that starts at a multiple of 7 in its
document. So non-overlapping blocks are indexed, and every rolling run of 7 words probes the index. A hit is
extended over the neighbouring runs that occur elsewhere too; windows that lie in such a stretch, hold a hit,
and agree in all their words with one of a smaller document are the maximal repeats.

Documents are dealt into batches by size, and a batch sends each different hash once to a range of hashes,
packed into binary columns. A passage that a third of the corpus shares therefore reaches
its range as one entry a batch, and no pairs of documents are made. Answers come back as bits. The text is
shuffled once; the three steps that read it share that exchange. Messages grow in proportion to the text
(:func:`shared.batch_size`).

Words are bytes between ASCII white space, compared unchanged. Anchors are compared as 64 bits (a false hit
only costs a comparison); the words of windows as 128 bits from two hashes of every word with different seeds,
so that two different windows among 10^13 agree with a probability below 10^-12. Null or empty texts have no
words and keep an empty text. Ids are integers; a null id counts as larger than every other. Rows with one id
are one document for the comparison: none is a repeat of another. Empty tables give empty results, and columns
of other names are not read.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from corpusloom.llm.shared import batch_size, batch_table, blobs, cuts, in_batches, mixed, pack_sorted, span_hashes, text_buffer, unblobbed, unpack_sorted, word_spans

WINDOW, ANCHOR = 13, 7
_PRIME = np.uint64(0x9FB21C651E98DF25)
_SENT = "shard long, batch long, hashes binary, extra binary, ids binary"


def rolling(words: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of the ``n`` words from each position on, or from those in ``at`` (the last n - 1 have none)."""
    at = np.arange(max(0, len(words) - n + 1)) if at is None else at
    total = np.zeros(len(at), np.uint64)
    for k in range(n):
        total = total * _PRIME + words[at + k]
    return mixed(total)


class Batch:
    """The words of a batch of documents, in the order of their ids, null last; equal ids by text."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id")
        keys = pa.table({"none": ids.is_null(), "id": ids.fill_null(0), "text": table.column("text").fill_null("")})
        self.order = pc.sort_indices(keys, [("none", "ascending"), ("id", "ascending"), ("text", "ascending")])
        self.none = keys.column("none").take(self.order).to_numpy().astype(bool)
        self.ids = keys.column("id").take(self.order).to_numpy()
        self.rank = np.cumsum(np.append([0], (self.ids[1:] != self.ids[:-1]) | (self.none[1:] != self.none[:-1]))) if len(self.ids) else np.zeros(0, np.int64)
        self.data, self.offsets = text_buffer(keys.column("text").take(self.order))
        self.spans = word_spans(self.data, self.offsets)
        self.counts = self.spans[2]
        (self.words,) = span_hashes(self.data, self.spans[:2])
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.counts)
        self.within = (np.arange(len(self.words)) - np.repeat(self.first[:-1], self.counts)).astype(np.int32)

    def at(self, n: int) -> np.ndarray:
        """Positions where ``n`` words of one document start."""
        return np.flatnonzero(self.counts[self.doc] - self.within >= n)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions, the different anchor hashes, each position's place among them, whether one is a block."""
        at = self.at(ANCHOR)
        different, place = np.unique(rolling(self.words, ANCHOR, at), return_inverse=True)
        block = np.zeros(len(different), bool)
        block[place[self.within[at] % ANCHOR == 0]] = True
        return at, different, place, block

    def stretches(self, at: np.ndarray, repeated: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Windows whose anchors are all repeated, one of them a hit."""
        sums = []
        for marked in (repeated, hit):
            every = np.zeros(len(self.words) + 1, np.int32)
            every[at + 1] = marked
            sums.append(np.cumsum(every, dtype=np.int32))
        windows, inside = self.at(WINDOW), WINDOW - ANCHOR + 1
        counts = [s[windows + inside] - s[windows] for s in sums]
        return windows[(counts[0] == inside) & (counts[1] > 0)]

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different windows among those at some positions: two hashes of the words, the first position
        (the smallest id), and each position's place."""
        (again,) = span_hashes(self.data, self.spans[:2], seed=1)
        a, b = rolling(self.words, WINDOW, at), rolling(again, WINDOW, at)
        order = np.lexsort((b, a))  # stable
        new = np.ones(len(at), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        place = np.empty(len(at), np.int64)
        place[order] = np.cumsum(new) - 1
        first = order[new]
        return a[first], b[first], at[first], place


def _base(shard: int, ranges: int) -> int:
    return shard * ((1 << 64) // ranges)


def _slices(hashes: np.ndarray, ranges: int) -> list[tuple[int, slice]]:
    edges = cuts(hashes, ranges)
    return [(int(k), slice(int(edges[k]), int(edges[k + 1]))) for k in np.flatnonzero(np.diff(edges))]


def _rows(batch: int, rows: list[tuple[int, bytes, bytes, bytes | None]]) -> pa.Table:
    return pa.table({
        "shard": pa.array([r[0] for r in rows], pa.int64()), "batch": pa.array([batch] * len(rows), pa.int64()),
        **{name: blobs([r[k] for r in rows]) for k, name in ((1, "hashes"), (2, "extra"), (3, "ids"))},
    })


def _bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def _pack(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def _several(groups: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """For each group number, whether it occurs in two rows or more."""
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    np.minimum.at(low, groups, doc)
    np.maximum.at(high, groups, doc)
    return high > low


def _send_anchors(ranges: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, different, _, block = Batch(batch_table(table)).anchors()
        return _rows(key[0].as_py(), [(k, pack_sorted(different[s], _base(k, ranges)), _pack(block[s]), None) for k, s in _slices(different, ranges)])

    return run


def _match_anchors(key: tuple, table: pa.Table) -> pa.Table:
    """Bits of the anchors that several batches have, and of those of them that are a block somewhere."""
    hashes = [unpack_sorted(x) for x in unblobbed(table.column("hashes"))]
    edges = np.cumsum([len(x) for x in hashes])[:-1]
    blocks = np.concatenate([_bits(x, len(h)) for x, h in zip(unblobbed(table.column("extra")), hashes, strict=True)])
    _, group, members = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    repeated = (members > 1)[group]
    known = np.bincount(group, blocks, len(members))[group] > 0
    return _answers(table, key, [_pack(x) for x in np.split(repeated, edges)], [_pack(x) for x in np.split(known, edges)])


def _answers(table: pa.Table, key: tuple, bits: list, more: list) -> pa.Table:
    return pa.table({"batch": table.column("batch"), "shard": pa.array([key[0].as_py()] * table.num_rows, pa.int64()), "bits": blobs(bits), "more": blobs(more)})


def _marks(batch: Batch, marks: pa.Table, ranges: int) -> np.ndarray:
    """Positions of windows to compare: what lies in repeated stretches with a hit, here or in other batches."""
    at, different, place, block = batch.anchors()
    repeated = _several(place, batch.doc[at], len(different))
    known = block.copy()
    edges = cuts(different, ranges)
    for k, bits, more in zip(marks.column("shard").to_pylist(), unblobbed(marks.column("bits")), unblobbed(marks.column("more")), strict=True):
        part = slice(int(edges[k]), int(edges[k + 1]))
        n = part.stop - part.start
        repeated[part] |= _bits(bits, n)
        known[part] |= _bits(more, n)
    return batch.stretches(at, repeated[place], (repeated & known)[place])


def _send_windows(ranges: int):
    """Different windows with the smallest id that has them; and, to the batch itself, where they are."""

    def run(key: tuple, table: pa.Table, marks: pa.Table) -> pa.Table:
        number = key[0].as_py()
        if not table.num_rows:
            return _rows(number, [])
        batch = Batch(batch_table(table))
        at = _marks(batch, marks, ranges)
        if not len(at):
            return _rows(number, [])
        a, b, first, _ = batch.windows(at)
        doc = batch.doc[first]
        ids, none = batch.ids[doc], batch.none[doc]
        kind = "<u4" if ids.min() >= 0 and ids.max() < 1 << 32 else "<i8"
        rows = [(k, pack_sorted(a[s], _base(k, ranges)), b[s].tobytes(), bytes([int(kind[2])]) + ids[s].astype(kind).tobytes() + _pack(none[s])) for k, s in _slices(a, ranges)]
        here = np.zeros(len(batch.words), bool)
        here[at] = True
        return _rows(number, [*rows, (-1 - number, b"", _pack(here), None)])

    return run


def _match_windows(key: tuple, table: pa.Table) -> pa.Table:
    """For each batch, bits of the windows that a smaller id than its own smallest has."""
    if key[0].as_py() < 0:
        return _answers(table, (pa.scalar(-1),), unblobbed(table.column("extra")), [None] * table.num_rows)
    hashes = [unpack_sorted(x) for x in unblobbed(table.column("hashes"))]
    edges = np.cumsum([len(x) for x in hashes])[:-1]
    a, b = np.concatenate(hashes), np.concatenate([np.frombuffer(x, "<u8") for x in unblobbed(table.column("extra"))])
    ids, none = [], []
    for blob, h in zip(unblobbed(table.column("ids")), hashes, strict=True):
        width = blob[0]
        ids.append(np.frombuffer(blob, "<u4" if width == 4 else "<i8", len(h), 1).astype(np.int64))
        none.append(_bits(blob[1 + width * len(h) :], len(h)))
    ids, none = np.concatenate(ids), np.concatenate(none)
    order = np.lexsort((ids, none, b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    least = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = np.empty(len(a), bool)
    later[order] = (ids[order] != ids[least]) | (none[order] != none[least])
    return _answers(table, key, [_pack(x) for x in np.split(later, edges)], [None] * table.num_rows)


_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _remove(ranges: int):
    def run(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "removed": pa.array([], _RANGES), "kept_text": pa.array([], pa.string())})
        batch = Batch(batch_table(table))
        gone = np.zeros(len(batch.words), bool)
        bits = dict(zip(found.column("shard").to_pylist(), unblobbed(found.column("bits")), strict=True))
        if -1 in bits:
            at = np.flatnonzero(_bits(bits[-1], len(batch.words)))
            a, _, first, place = batch.windows(at)
            before, edges = np.zeros(len(a), bool), cuts(a, ranges)
            for k, blob in bits.items():
                if k >= 0:
                    before[edges[k] : edges[k + 1]] = _bits(blob, int(edges[k + 1] - edges[k]))
            repeat = at[before[place] | (batch.rank[batch.doc[at]] > batch.rank[batch.doc[first]][place])]
            step = np.zeros(len(batch.words) + WINDOW + 1, np.int32)
            np.add.at(step, repeat, 1)
            np.add.at(step, repeat + WINDOW, -1)
            gone = np.cumsum(step)[: len(batch.words)] > 0
        kept, removed = [], []
        for k in range(len(batch.ids)):
            words = bytes(batch.data[batch.offsets[k] : batch.offsets[k + 1]]).split()
            out = gone[batch.first[k] : batch.first[k + 1]]
            if out.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8)))
                removed.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)])
                words = compress(words, (~out).tolist())
            else:
                removed.append([])
            kept.append(b" ".join(words).decode())
        return pa.table({
            "doc_id": pa.array(batch.ids, mask=batch.none), "n_words": pa.array(batch.counts, pa.int64()),
            "removed": pa.array(removed, _RANGES), "kept_text": pa.array(kept, pa.string()),
        })

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 32 << 20) -> DataFrame:
    """Each row's ``doc_id``, ``n_words``, ``removed`` (word ranges, end exclusive) and ``kept_text``.

    ``most`` bounds a batch's bytes of text; a task needs about fifteen times as much memory.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    size, n = batch_size(docs.sparkSession, rows, "text", most)
    by_batch = in_batches(rows, size).groupBy("batch")
    answer = "batch long, shard long, bits binary, more binary"
    anchors = by_batch.applyInArrow(_send_anchors(n), _SENT)
    marks = anchors.groupBy("shard").applyInArrow(_match_anchors, answer)
    windows = by_batch.cogroup(marks.groupBy("batch")).applyInArrow(_send_windows(n), _SENT)
    found = windows.groupBy("shard").applyInArrow(_match_windows, answer)
    return by_batch.cogroup(found.groupBy("batch")).applyInArrow(_remove(n), "doc_id long, n_words long, removed array<struct<start: long, end: long>>, kept_text string")
