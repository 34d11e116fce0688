"""Scoring texts with a weighted backoff automaton over word n-grams up to three.

States are the root, a state for each word v seen in training (and the start of a text), and a state for each
pair (u, v) seen. From state h an arc for each seen n-gram (h, w) leads to the state of the last two words, with
weight

    P(w | h) = (c(h, w) + K P(w | h')) / (c(h) + K)

where h' is h without its first word; its failure arc leads to h' with weight K / (c(h) + K), the share that h
leaves to words not seen after it. So the weights of a state's arcs and failures are a distribution. The root's
arcs are P(w) = (c(w) + 1) / (N + V + 1), for unknown words too. K is one of ``strengths``, for states
of one word and of two. A text is read once from left to right: the state that the last word led to is carried along;
where it has no arc for the next word its failure arcs are followed, and all weights' logarithms are added up.

Counts cover every training text. Documents are dealt into batches by size; a batch sends
each different word and word pair once to a range of hashes, which adds the counts up and answers with the totals and
with a bit for pairs that other batches have too. Only a trigram of two such pairs can occur elsewhere, so
only those are sent; the others' counts are the batch's own. What comes back is the part of the automaton that
the batch's texts can reach, so no task holds the whole of it, and an n-gram that a third of the corpus has
arrives once a batch. The text is shuffled once; the three steps that read it share that exchange. Messages
grow in proportion to the text (:func:`shared.batch_size`).

Words are runs of bytes between ASCII white space after lower-casing A-Z; one end follows each text and
counts as a token. Null or empty texts have the end alone. A document is held out of training if
crc32(id as text) mod ``folds`` is ``held``; a null id is never held out. Repeated rows count as often as
they occur. With no training text at all every token gets the root's probability. Empty tables give empty
results. N-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm.shared import ascii_lowered, batch_size, batch_table, blobs, cuts, expand, in_batches, mixed, pack_sorted, span_hashes, text_buffer, unblobbed, unpack_sorted, word_spans

_START, _END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC2B2AE3D27D4EB4F)
_PRIME = np.uint64(0x9FB21C651E98DF25)
_SENT = "part long, batch long, hashes binary, counts binary"
_ANSWER = "batch long, part long, totals binary, others binary, tokens long, words long"


def _pack(counts: np.ndarray) -> bytes:
    """Whole numbers as bytes, all low bytes first, without high bytes that are all zero."""
    most = int(counts.max()) if len(counts) else 0
    width = max(1, (most.bit_length() + 7) // 8)
    planes = np.ascontiguousarray(counts.astype("<i8")).view(np.uint8).reshape(-1, 8)
    return bytes([width]) + np.ascontiguousarray(planes[:, :width].T).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8, offset=1).reshape(blob[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : blob[0]] = planes.T
    return out.view("<i8").ravel()


class Grams:
    """The different n-grams of one order in a batch, each token's place among them (-1: none ends there),
    a token where each ends, and how often they occur in training texts."""

    def __init__(self, hashes: np.ndarray, there: np.ndarray | None, training: np.ndarray):
        at = np.arange(len(hashes)) if there is None else np.flatnonzero(there)
        self.hashes, first, place = np.unique(hashes[at], return_index=True, return_inverse=True)
        self.first = at[first]
        self.counts = np.bincount(place, training[at], len(self.hashes)).astype(np.int64)
        self.place = np.full(len(hashes), -1, np.int32)
        self.place[at] = place


class Tokens:
    """The tokens of a batch of documents and the n-grams that end at them."""

    def __init__(self, table: pa.Table):
        data, offsets = text_buffer(table.column("text"))
        data = ascii_lowered(data)
        starts, ends, counts = word_spans(data, offsets)
        self.sizes = counts + 1
        self.train = ~table.column("held_out").to_numpy().astype(bool)
        last = np.cumsum(self.sizes) - 1
        self.begins = last - self.sizes + 1
        words = np.empty(int(self.sizes.sum()), np.uint64)
        inside = np.ones(len(words), bool)
        inside[last] = False
        words[last] = _END
        words[inside] = span_hashes(data, (starts, ends))[0]
        before = np.empty_like(words)
        before[1:] = words[:-1]
        before[self.begins] = _START
        pairs = mixed(before * _PRIME + words)
        later = np.ones(len(words), bool)
        later[self.begins] = False
        triples = np.empty_like(words)
        triples[1:] = mixed(pairs[:-1] * _PRIME + words[1:])
        training = np.repeat(self.train, self.sizes).astype(float)
        self.words, self.pairs, self.triples = Grams(words, None, training), Grams(pairs, None, training), Grams(triples, later, training)

    def before(self, grams: np.ndarray) -> np.ndarray:
        """The place of the word before the token where each pair ends; -1 at the start of a text."""
        out = self.words.place[grams - 1].copy()
        out[np.isin(grams, self.begins)] = -1
        return out


def _messages(part: int, hashes: np.ndarray, counts: np.ndarray, ranges: int, whole: bool = False) -> list[tuple]:
    """(part, hashes, counts) for each range of sorted hashes; for empty ranges too if ``whole``."""
    edges = cuts(hashes, ranges)
    step = (1 << 64) // ranges
    return [(part * ranges + int(k), pack_sorted(hashes[a:b], int(k) * step), _pack(counts[a:b])) for k, a, b in zip(range(ranges), edges[:-1], edges[1:], strict=True) if whole or b > a]


def _rows(batch: int, rows: list[tuple]) -> pa.Table:
    return pa.table({
        "part": pa.array([r[0] for r in rows], pa.int64()), "batch": pa.array([batch] * len(rows), pa.int64()),
        "hashes": blobs([r[1] for r in rows]), "counts": blobs([r[2] for r in rows]),
    })


def _send_words_and_pairs(ranges: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        batch = Tokens(batch_table(table))
        words = _messages(0, batch.words.hashes, batch.words.counts, ranges, whole=True)
        return _rows(key[0].as_py(), words + _messages(1, batch.pairs.hashes, batch.pairs.counts, ranges))

    return run


def _match(ranges: int):
    """Total counts, and which n-grams several batches have; for words also the tokens and different words of the range."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        part, n = key[0].as_py(), table.num_rows
        if part < 0:  # a batch's message to itself
            return _answers(table, part, unblobbed(table.column("counts")), unblobbed(table.column("hashes")), 0, 0)
        hashes = [unpack_sorted(x) for x in unblobbed(table.column("hashes"))]
        edges = np.cumsum([len(x) for x in hashes])[:-1]
        counts = np.concatenate([_unpack(x) for x in unblobbed(table.column("counts"))])
        different, place, members = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        total = np.bincount(place, counts, len(different)).astype(np.int64)
        totals = [_pack(x) for x in np.split(total[place], edges)]
        others = [np.packbits(x).tobytes() for x in np.split((members > 1)[place], edges)] if part >= ranges else [None] * n
        return _answers(table, part, totals, others, int(total.sum()), int((total > 0).sum()))

    return run


def _answers(table: pa.Table, part: int, totals: list, others: list, tokens: int, words: int) -> pa.Table:
    n = table.num_rows
    same = lambda x: pa.array([x] * n, pa.int64())
    return pa.table({"batch": table.column("batch"), "part": same(part), "totals": blobs(totals), "others": blobs(others), "tokens": same(tokens), "words": same(words)})


def _totals(answers: pa.Table, part: int, ranges: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Totals and bits of one kind of n-gram, in the order of its hashes."""
    edges, out, others = cuts(hashes, ranges), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    for k, totals, bits in zip(answers.column("part").to_pylist(), unblobbed(answers.column("totals")), unblobbed(answers.column("others")), strict=True):
        if k // ranges == part and k >= 0:
            a, b = int(edges[k % ranges]), int(edges[k % ranges + 1])
            out[a:b] = _unpack(totals)
            if bits is not None:
                others[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
    return out, others


def _elsewhere(batch: Tokens, others: np.ndarray) -> np.ndarray:
    """Which different trigrams may occur in other batches: those of two pairs that do."""
    at = batch.triples.first
    return others[batch.pairs.place[at]] & others[batch.pairs.place[at - 1]]


def _send_triples(ranges: int):
    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        number = key[0].as_py()
        if not table.num_rows:
            return _rows(number, [])
        batch = Tokens(batch_table(table))
        words, _ = _totals(answers, 0, ranges, batch.words.hashes)
        pairs, others = _totals(answers, 1, ranges, batch.pairs.hashes)
        first = [k < ranges for k in answers.column("part").to_pylist()]
        sums = [sum(x for x, w in zip(answers.column(c).to_pylist(), first, strict=True) if w) for c in ("tokens", "words")]
        sent = _elsewhere(batch, others)
        rows = _messages(0, batch.triples.hashes[sent], batch.triples.counts[sent], ranges)
        own = _pack(np.concatenate([np.array(sums, np.int64), words, pairs]))
        return _rows(number, [*rows, (-1 - number, np.packbits(others).tobytes(), own)])

    return run


class Automaton:
    """Log10 weights of arcs (NaN: no arc) and of failure arcs, by the place of their n-gram in a batch."""

    def __init__(self, batch: Tokens, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, tokens: int, different: int, starts: int, strengths: tuple[float, float]):
        k2, k3 = strengths
        root = (words + 1) / (tokens + different + 1)
        at = batch.pairs.first
        before = batch.before(at)
        seen = np.append(words, starts)  # place -1 is the start of a text
        second = (pairs + k2 * root[batch.words.place[at]]) / (seen[before] + k2)
        at = batch.triples.first
        context = pairs[batch.pairs.place[at - 1]]
        third = (triples + k3 * second[batch.pairs.place[at]]) / (context + k3)
        arc = lambda p, count: np.where(count > 0, np.log10(p), np.nan)
        self.root = np.log10(root)
        self.after_word, self.after_pair = arc(second, pairs), arc(third, triples)
        self.word_fails, self.pair_fails = np.log10(k2 / (seen + k2)), np.log10(k3 / (pairs + k3))
        self.is_state = words > 0

    def walk(self, batch: Tokens, begin: int, size: int, started: bool) -> float:
        """One text's log10 probability. The state is the last ``depth`` words: 2 a pair, 1 a word, 0 the root."""
        tokens = slice(begin, begin + size)
        words, pairs, triples = batch.words.place[tokens], batch.pairs.place[tokens], batch.triples.place[tokens]
        last = np.append([-1], words[:-1])
        steps = zip(
            self.root[words].tolist(), self.after_word[pairs].tolist(), self.after_pair[triples].tolist() if len(self.after_pair) else [0.0] * size,
            self.word_fails[last].tolist(), self.pair_fails[np.append([0], pairs[:-1])].tolist(), self.is_state[words].tolist(), strict=True,
        )
        depth, total = int(started), 0.0
        for root, after_word, after_pair, word_fails, pair_fails, is_state in steps:
            if depth == 2:
                if after_pair == after_pair:
                    total += after_pair
                    continue
                total, depth = total + pair_fails, 1
            if depth == 1:
                if after_word == after_word:
                    total, depth = total + after_word, 2
                    continue
                total += word_fails
            total, depth = total + root, int(is_state)
        return total


def _traverse(ranges: int, strengths: tuple[float, float], kind: pa.DataType):
    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["n_tokens", "n_known", "train_tokens"]
        if not table.num_rows:
            return pa.table({"doc_id": pa.array([], kind), "held_out": pa.array([], pa.bool_()), **{c: pa.array([], pa.int64()) for c in names}, "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        table = batch_table(table)
        batch = Tokens(table)
        own = answers.column("part").to_pylist().index(-1 - key[0].as_py())
        totals, others = (expand(answers.column(c)[own].as_py()) for c in ("totals", "others"))
        values, n = _unpack(totals), len(batch.words.hashes)
        tokens, different, words, pairs = int(values[0]), int(values[1]), values[2 : 2 + n], values[2 + n :]
        others = np.unpackbits(np.frombuffer(others, np.uint8), count=len(pairs)).astype(bool)
        triples, sent = batch.triples.counts.copy(), _elsewhere(batch, others)
        triples[sent] = _totals(answers, 0, ranges, batch.triples.hashes[sent])[0]
        starts = int(words[np.searchsorted(batch.words.hashes, _END)])  # as many as ends
        model = Automaton(batch, words, pairs, triples, tokens, different, starts, strengths)
        add = lambda x: np.add.reduceat(x[batch.words.place], batch.begins)
        score = [model.walk(batch, int(b), int(s), True) for b, s in zip(batch.begins, batch.sizes, strict=True)]
        return pa.table({
            "doc_id": table.column("doc_id"), "held_out": table.column("held_out"),
            "n_tokens": pa.array(batch.sizes, pa.int64()), "n_known": pa.array(add((words > 0).astype(np.int64)), pa.int64()),
            "train_tokens": pa.array(np.full(len(batch.sizes), tokens), pa.int64()),
            "base_score": pa.array(add(model.root)), "score": pa.array(score, pa.float64()),
        })

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, strengths: tuple[float, float] = (100.0, 8.0), most: int = 24 << 20) -> DataFrame:
    """Each row's doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    ``most`` bounds a batch's bytes of text; a task needs about thirty times as much memory.
    """
    held_out = F.coalesce(F.crc32(docs[id_col].cast("string")) % folds == held, F.lit(False))
    rows = docs.select(docs[id_col].alias("doc_id"), held_out.alias("held_out"), docs[text_col].cast("string").alias("text"))
    size, n = batch_size(docs.sparkSession, rows, "text", most)
    by_batch = in_batches(rows, size).groupBy("batch")
    first = by_batch.applyInArrow(_send_words_and_pairs(n), _SENT).groupBy("part").applyInArrow(_match(n), _ANSWER)
    second = by_batch.cogroup(first.groupBy("batch")).applyInArrow(_send_triples(n), _SENT).groupBy("part").applyInArrow(_match(n), _ANSWER)
    kind = rows.schema["doc_id"].dataType
    walk = _traverse(n, strengths, to_arrow_type(kind))
    return by_batch.cogroup(second.groupBy("batch")).applyInArrow(walk, f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
