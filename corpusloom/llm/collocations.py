"""Phrase collocations from a weighted de Bruijn graph of words.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and pieces into words; everything is counted
per language. Every word starts one longest gram: the ``LONGEST`` = 4 words from it on, fewer where its piece ends
before. Grams of full length are the edges of a graph whose nodes are their first and last three words; shorter
ones are corrections, flow that ends in a node, a pair or a word because a piece does. So

    flow of a node = weights of the edges that leave it + pieces that end there,

pairs are the flow of the nodes they begin plus the pieces they end, and words likewise. Documents are dealt into
batches by size; a batch aggregates its own edges, takes the shorter counts from its flow, and sends every
different gram once to a range of hashes. So a word, pair or passage that a third of all rows share reaches its
range as one entry a batch. Ranges add up, and tell the first batch that has a gram of at least
``least`` occurrences its total; that batch holds the words.

A node whose flow equals both the edge before and the edge behind it has no other neighbours anywhere: unary paths of such nodes
are compacted into one stretch of text with one weight, however often the passage occurs, and taken apart again
where candidates are listed. Equal weights put a path's edges into the same batches, so one batch holds all of it.

Scores use integers and decimals only. A phrase that a longer candidate holds is found by taking longer candidates apart,
three to five parts each; nothing is paired within a group. The list of each language is cut to its first rows
before they meet.

Grams are told apart by 64-bit hashes of language and words: with N different grams, one of the M frequent ones is
counted too high with a probability of about N * M / 2^64 (10^-6 for 10^8 and 10^5). Null texts are empty; a null language is
``und``; ids are not read. Repeated rows count as often as they occur; a text of one word has no phrases; an empty
table gives no rows. Columns of other names are not read. A batch takes about forty times its bytes of text in
memory; ``most`` bounds it, and a text longer than that is a batch of its own.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import ascii_lowered, batch_size, batch_table, blobs, cuts, in_batches, materialise, mixed, pack_sorted, span_hashes, text_buffer, unblobbed, unpack_sorted

LONGEST = 4
#: What ends a piece, and what parts words inside one.
_PIECE, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_PIECE[[*b".,;:!?\n\x0b\x0c\r"]] = True
_GAP[[*b" \t"]] = True
_END, _PRIME = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
_SENT = "part long, batch long, hashes binary, counts binary"
_LISTED = "lang string, words array<string>, occurrences long"


class Graph:
    """The weighted graph of a batch: hashes, counts and a first place of its different words, pairs, nodes and edges."""

    def __init__(self, table: pa.Table):
        data, offsets = text_buffer(table.column("text"))
        self.data = ascii_lowered(data)
        self.langs = table.column("lang").to_pylist()
        apart = _PIECE | _GAP
        inside = ~apart[self.data]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[offsets[:-1][offsets[:-1] < len(inside)]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.starts, self.ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        size = len(self.starts)
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        piece = np.cumsum(_PIECE[self.data], dtype=np.int32)[self.starts] if size else np.zeros(0, np.int32)
        #: Whether a word begins a piece; one more for the end.
        self.first = np.ones(size + 1, bool)
        self.first[1:-1] = (piece[1:] != piece[:-1]) | (self.doc[1:] != self.doc[:-1])
        names = sorted(set(self.langs))
        salt = {x: span_hashes(np.frombuffer(x.encode(), np.uint8), (np.array([0]), np.array([len(x.encode())])), seed=3)[0][0] for x in names}
        salts = np.array([salt[x] for x in self.langs], np.uint64)
        words = mixed(span_hashes(self.data, (self.starts, self.ends))[0] ^ salts[self.doc]) if size else np.zeros(0, np.uint64)
        # grams[k][i]: the k + 1 words from i on; real[k][i]: whether the piece has them all
        self.grams, real = [words], [np.ones(size, bool)]
        for k in range(1, LONGEST):
            there = np.zeros(size, bool)
            upto = max(0, size - k)
            there[:upto] = real[-1][:upto] & ~self.first[k:size]
            following = np.full(size, _END)
            following[there] = words[np.flatnonzero(there) + k]
            self.grams.append(mixed(self.grams[-1] * _PRIME + following))
            real.append(there)
        self.real = real
        self._aggregate()

    def _aggregate(self) -> None:
        """Longest grams first; then every shorter count from the flow of the grams that begin with it."""
        hashes, at, counts = _summed(self.grams[-1], np.arange(len(self.starts)), None)
        self.orders = [None] * LONGEST
        for k in range(LONGEST - 1, -1, -1):
            full = self.real[k][at]
            self.orders[k] = (hashes[full], counts[full], at[full])
            if k:
                hashes, at, counts = _summed(self.grams[k - 1][at], at, counts)
        del self.grams, self.real  # a task's memory holds no more than the different ones from here on

    def words_by_lang(self) -> list[tuple[str, int]]:
        out: dict[str, int] = {}
        for lang, n in zip(self.langs, np.bincount(self.doc, minlength=len(self.langs)).tolist(), strict=True):
            out[lang] = out.get(lang, 0) + n
        return sorted(out.items())

    def words(self, at: int, size: int) -> list[str]:
        """``size`` words from place ``at`` on."""
        return [self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace") for i in range(at, at + size)]


def _summed(hashes: np.ndarray, at: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different hashes, a place and the sum of counts of each."""
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    begin = np.flatnonzero(new)
    if counts is None:
        sums = np.diff(np.append(begin, len(hashes)))
    else:
        sums = np.add.reduceat(counts[order], begin) if len(begin) else counts[:0]
    return hashes[begin], at[order[begin]], sums.astype(np.int64)


def _numbers(values: np.ndarray) -> bytes:
    """Whole numbers as all their low bytes first, without high bytes that are all zero."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(values.astype("<i8")).view(np.uint8).reshape(-1, 8)
    return bytes([width]) + np.ascontiguousarray(planes[:, :width].T).tobytes()


def _unnumbered(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8, offset=1).reshape(blob[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : blob[0]] = planes.T
    return out.view("<i8").ravel()


def _rows(part: list[int], batch: list[int], hashes: list[bytes], counts: list[bytes]) -> pa.Table:
    return pa.table({"part": pa.array(part, pa.int64()), "batch": pa.array(batch, pa.int64()), "hashes": blobs(hashes), "counts": blobs(counts)})


def _send(ranges: int):
    """A batch's different grams of every order, to the ranges of their hashes."""
    step = (1 << 64) // ranges

    def run(key: tuple, table: pa.Table) -> pa.Table:
        graph, out = Graph(batch_table(table)), []
        for order, (hashes, counts, _) in enumerate(graph.orders):
            edges = cuts(hashes, ranges)
            out += [(order * ranges + k, pack_sorted(hashes[a:b], k * step), _numbers(counts[a:b])) for k, a, b in zip(range(ranges), edges[:-1], edges[1:], strict=True) if b > a]
        return _rows([r[0] for r in out], [key[0].as_py()] * len(out), [r[1] for r in out], [r[2] for r in out])

    return run


def _add_up(ranges: int, least: int):
    """Totals of at least ``least``, each told to the first batch that has the gram."""
    step = (1 << 64) // ranges

    def run(key: tuple, table: pa.Table) -> pa.Table:
        part, batches = key[0].as_py(), np.array(table.column("batch").to_pylist(), np.int64)
        base = part % ranges * step
        turn = np.argsort(batches, kind="stable")
        hashes = [unpack_sorted(x, base) for x in unblobbed(table.column("hashes").take(pa.array(turn)))]
        counts = [_unnumbered(x) for x in unblobbed(table.column("counts").take(pa.array(turn)))]
        sender = np.repeat(np.arange(len(turn)), [len(x) for x in hashes])
        different, owner, total = _summed(np.concatenate(hashes), sender, np.concatenate(counts))
        often = total >= least
        different, owner, total = different[often], owner[often], total[often]
        out = [(int(batches[turn[k]]), different[owner == k], total[owner == k]) for k in np.unique(owner).tolist()]
        return _rows([part] * len(out), [b for b, _, _ in out], [pack_sorted(h, base) for _, h, _ in out], [_numbers(c) for _, _, c in out])

    return run


def _told(graph: Graph, answers: pa.Table, ranges: int) -> list[np.ndarray]:
    """For each order the total at the place where the batch lists that gram, 0 elsewhere."""
    step, out = (1 << 64) // ranges, [np.zeros(len(graph.starts), np.int64) for _ in range(LONGEST)]
    for part, packed, totals in zip(answers.column("part").to_pylist(), unblobbed(answers.column("hashes")), unblobbed(answers.column("counts")), strict=True):
        hashes, _, at = graph.orders[part // ranges]
        out[part // ranges][at[np.searchsorted(hashes, unpack_sorted(packed, part % ranges * step))]] = _unnumbered(totals)
    return out


def _paths(graph: Graph, edges: np.ndarray, nodes: np.ndarray) -> list[tuple[int, int, int]]:
    """(first edge's place, number of edges, weight) of the compacted unary paths; every listed edge is in one.

    Edges join where the node between them has their weight. Along a unary path each different gram is listed once, at its
    first place, and those places follow each other.
    """
    at = np.flatnonzero(edges)
    if not len(at):
        return []
    weight = edges[at]
    joined = np.zeros(len(at), bool)
    joined[1:] = (at[1:] == at[:-1] + 1) & (weight[1:] == weight[:-1]) & (nodes[at[1:]] == weight[1:]) & ~graph.first[at[1:]]
    begin = np.flatnonzero(~joined)
    return list(zip(at[begin].tolist(), np.diff(np.append(begin, len(at))).tolist(), weight[begin].tolist(), strict=True))


def _list(ranges: int):
    """Rows of (lang, words, occurrences): words, pairs and nodes; compacted paths, of ``LONGEST`` words or more; and,
    with null for the words, how many the batch has."""

    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if table.num_rows:
            graph = Graph(batch_table(table))
            out += [(lang, None, n) for lang, n in graph.words_by_lang()]
            totals = _told(graph, answers, ranges)
            listed = []
            for at, edges, weight in _paths(graph, totals[3], totals[2]):
                listed.append((at, edges + LONGEST - 1, weight))
                totals[2][at + 1 : at + edges] = 0  # inner nodes have the path's weight
            for k in range(LONGEST - 1):
                listed += [(i, k + 1, int(totals[k][i])) for i in np.flatnonzero(totals[k]).tolist()]
            out += [(graph.langs[graph.doc[i]], graph.words(i, size), n) for i, size, n in listed]
        return pa.table({"lang": pa.array([r[0] for r in out], pa.string()), "words": pa.array([r[1] for r in out], pa.list_(pa.string())), "occurrences": pa.array([r[2] for r in out], pa.int64())})

    return run


def _parts(words: Column, size: int, skip: int = 0) -> Column:
    """Every stretch of ``size`` words, as one string; ``skip`` are left out at both ends."""
    return F.transform(F.sequence(F.lit(1 + skip), F.size(words) - size + 1 - skip), lambda i: F.array_join(F.slice(words, i, F.lit(size)), " "))


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, most: int = 12 << 20) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, occurrences) of all phrases of 1 to 4 words that occur ``least`` times, and (lang, n): all word occurrences.

    Written to the checkpoint folder once; both results read that.
    """
    rows = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), docs[text_col].cast("string").alias("text"))
    size, ranges = batch_size(docs.sparkSession, rows, "text", most)
    by_batch = in_batches(rows, size).groupBy("batch")
    totals = by_batch.applyInArrow(_send(ranges), _SENT).groupBy("part").applyInArrow(_add_up(ranges, least), _SENT)
    found = materialise(by_batch.cogroup(totals.groupBy("batch")).applyInArrow(_list(ranges), _LISTED))
    words = F.col("words")
    listed = lambda rows, size, phrase: rows.select("lang", phrase.alias("phrase"), F.lit(size).alias("size"), "occurrences")
    short = [listed(found.where(F.size(words) == k), k, F.array_join(words, " ")) for k in range(1, LONGEST)]
    edges = listed(found.where(F.size(words) >= LONGEST), LONGEST, F.explode(_parts(words, LONGEST)))
    inner = listed(found.where(F.size(words) > LONGEST), LONGEST - 1, F.explode(_parts(words, LONGEST - 1, 1)))
    every = reduce(DataFrame.unionByName, [*short, edges, inner])
    return every, found.where(words.isNull()).groupBy("lang").agg(F.sum("occurrences").alias("n")).where("n > 0")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, top: int = 2000, most: int = 12 << 20) -> DataFrame:
    """Each language's first ``top`` collocations: lang, rank, phrase, a, l, r, n and score.

    A candidate's score is that of its weakest cut, floor(2,000,000 * a / (l + r)); candidates inside a longer one that has
    four fifths of their occurrences are left out before ranking.
    """
    every, words = phrases(docs, text_col, lang_col, least, most)
    every = materialise(every.withColumn("words", F.split("phrase", " ")))
    candidates = every.where("size > 1").select("lang", "phrase", "words", "size", F.col("occurrences").alias("a"))
    part = lambda first, size: F.array_join(F.slice("words", first, size), " ")
    cut = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), part(F.lit(1), k).alias("left"), part(k + 1, F.col("size")).alias("right")))
    parts = every.where(f"size < {LONGEST}")
    left = parts.select("lang", F.col("phrase").alias("left"), F.col("occurrences").alias("l")).hint("shuffle_hash")
    right = parts.select("lang", F.col("phrase").alias("right"), F.col("occurrences").alias("r")).hint("shuffle_hash")
    scored = candidates.select("lang", "phrase", "a", F.inline(cut)).join(left, ["lang", "left"]).join(right, ["lang", "right"])
    score = F.expr("(CAST(a AS DECIMAL(20, 0)) * CAST(2000000 AS DECIMAL(7, 0))) div (CAST(l AS DECIMAL(20, 0)) + r)")
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    within = [candidates.where(f"size > {size}").select("lang", F.explode(_parts(F.col("words"), size)).alias("phrase"), F.col("a").alias("longer")) for size in range(2, LONGEST)]
    covered = reduce(DataFrame.unionByName, within).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = weakest.join(covered.hint("shuffle_hash"), ["lang", "phrase"], "left").where("longer IS NULL OR 5 * longer < 4 * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(words.hint("merge"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
