"""Packing token sequences by sum-of-squares online placement.

Every document becomes its token ids and one closing id. Whole windows are cut off first; what is left
goes, in arrival order, to the fill level that makes the sum of squared counts of partly filled windows
smallest (Csirik et al., "On the sum-of-squares algorithm for bin packing"). An array holds how many
windows are open at each level. Each input partition packs by itself, in one pass, without a shuffle.

At a partition's end the fullest open windows are filled with tokens cut from the emptiest; the single
window that remains is stored as pieces whose lengths are powers of two. So nothing is padded.

Null text is an empty document: the closing id alone. Repeated rows are packed as often as they occur;
ties between levels go to the fuller window. An empty table gives an empty result. Other columns,
whatever their names, are not read. Documents of any length stream through: memory holds the open
windows (under ``window`` of them in practice) and one Arrow slice.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm.shared import slices

_FALLBACK = re.compile(r" (?:\s|\Z)")
_CACHED = 250_000


class Encoder:
    """Ids of a tokenizer file, as the ``tokenizers`` library gives them without special tokens.

    A byte-level BPE file whose ids follow its merges is the same thing as a table of ranks, and ``tiktoken``
    merges by ranks several times faster. Such a file is read into one; any other is used as it is.
    Control strings inside a text are ordinary text.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ranks = self._ranks(path)
        if ranks:
            import tiktoken

            encoding = tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [np.array(encoding.encode_ordinary(t), "<u4").tobytes() for t in texts]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.encode_special_tokens = True
            self.encode = lambda texts: [np.array(e.ids, "<u4").tobytes() for e in model.encode_batch(texts, add_special_tokens=False)]

    @staticmethod
    def _ranks(path: str) -> dict[bytes, int] | None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        if model.get("type") != "BPE" or not plain or model.get("byte_fallback") or model.get("ignore_merges"):
            return None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merged = [model["vocab"][a + b] for a, b in pairs]
        if merged != sorted(merged):
            return None
        # the alphabet of byte-level files: printable bytes stand for themselves, the others follow from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in printable]
        signs = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(other)}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        return {bytes(signs[c] for c in token): k for token, k in model["vocab"].items() if token not in special}


class WordCachedTokenizer:
    """An :class:`Encoder` that remembers the ids of space-led words.

    Byte-level BPE never merges across a space that stands between two non-spaces, so such texts are cut
    there and each different word is encoded once. Any other text is encoded whole. Ids are those of
    ``tokenizers`` in both cases. The cache has two generations of bounded size, so that frequent words
    outlive a change; it affects only the speed.
    """

    def __init__(self, path: str):
        self._ids = Encoder(path).encode
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) > _CACHED:
            self.before, self.known = self.known, {}
        known, before = self.known, self.before
        parts = [None if _FALLBACK.search(t) else t.split(" ") for t in texts]
        missing: set[str] = set()
        for p in parts:
            if p is not None:
                missing.update(set(p[1:]).difference(known))
        again = missing.intersection(before)
        known.update((w, before[w]) for w in again)
        words = list(missing - again)
        known.update(zip(words, self._ids([" " + w for w in words]), strict=True))
        whole = [t if p is None else p[0] for t, p in zip(texts, parts, strict=True)]
        heads = self._ids(whole)
        return [h if p is None else h + b"".join(map(known.__getitem__, p[1:])) for h, p in zip(heads, parts, strict=True)]


_tokenizers: dict[str, WordCachedTokenizer] = {}


def tokenizer(path: str) -> WordCachedTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordCachedTokenizer(path)
    return _tokenizers[path]


Piece = tuple[object, int, bytes, int]  # document, start, ids, tokens of the document


class LevelPacker:
    """Windows of ``size`` tokens; ``levels[h]`` counts the open ones that hold h tokens."""

    def __init__(self, size: int):
        self.size = size
        self.levels = np.zeros(size + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(size + 1)]

    def level_for(self, length: int) -> int:
        """The level (0: a new window) where a piece of this length leaves the smallest sum of squares."""
        n = self.levels
        best, least = 0, 2 * n[length] + 1 if length < self.size else 0
        at = np.flatnonzero(n[1 : self.size - length + 1]) + 1
        if len(at):
            to = at + length
            change = 1 - 2 * n[at] + np.where(to < self.size, 2 * n[np.minimum(to, self.size)] + 1, 0)
            k = len(at) - 1 - int(np.argmin(change[::-1]))
            if change[k] <= least:
                best = int(at[k])
        return best

    def place(self, piece: Piece) -> list[Piece] | None:
        """Put a piece in; the window's pieces if that fills it."""
        length = len(piece[2]) // 4
        at = self.level_for(length)
        window = []
        if at:
            window = self.open[at].pop()
            self.levels[at] -= 1
        window.append(piece)
        if at + length == self.size:
            return window
        self.open[at + length].append(window)
        self.levels[at + length] += 1
        return None

    def close(self) -> Iterator[list[Piece]]:
        """Fill the fullest open windows from the emptiest, then cut the last into powers of two."""
        windows = [(h, w) for h in range(self.size - 1, 0, -1) for w in self.open[h]]
        i, j = 0, len(windows) - 1
        while i < j:
            (have, to), (left, donor) = windows[i], windows[j]
            need = min(self.size - have, left)
            to.extend(_take(donor, need))
            windows[i], windows[j] = (have + need, to), (left - need, donor)
            if have + need == self.size:
                yield to
                i += 1
            if left == need:
                j -= 1
        if i == j:
            left, window = windows[i]
            for bit in range(left.bit_length() - 1, -1, -1):
                if left >> bit & 1:
                    yield _take(window, 1 << bit)


def _take(window: list[Piece], n: int) -> list[Piece]:
    """Cut the first ``n`` tokens off a window."""
    out = []
    while n:
        doc, start, ids, total = window[0]
        k = min(n, len(ids) // 4)
        out.append((doc, start, ids[: 4 * k], total))
        if 4 * k == len(ids):
            window.pop(0)
        else:
            window[0] = (doc, start + k, ids[4 * k :], total)
        n -= k
    return out


def _packer(path: str, window: int, end_id: int, schema: pa.Schema) -> Callable:
    end = np.array([end_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, rows, made = tokenizer(path).encode, LevelPacker(window), [], 0
        base = TaskContext.get().partitionId() << 36

        def emit(pieces: list[Piece]) -> None:
            nonlocal made
            at = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids) // 4, ids, total, base + made, at))
                at += len(ids) // 4
            made += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in slices(batches, 1, 1 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                ids += end
                total = len(ids) // 4
                whole = total - total % window
                for at in range(0, whole, window):
                    emit([(doc, at, ids[4 * at : 4 * (at + window)], total)])
                if whole < total and (full := packer.place((doc, whole, ids[4 * whole :], total))):
                    emit(full)
                if len(rows) > 1000:
                    yield out()
        for pieces in packer.close():
            emit(pieces)
        if rows:
            yield out()

    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of documents in sequences of ``window`` tokens or of a power of two.

    Returns, for each piece, the document's id, ``start``, ``length``, ``ids`` (little-endian unsigned
    32-bit), ``doc_tokens``, ``sequence_id`` and ``offset``. The tokenizer file must lie at the same path
    on every executor.
    """
    kept = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    long = T.LongType()
    schema = T.StructType([T.StructField("doc_id", kept.schema["doc_id"].dataType), T.StructField("start", long), T.StructField("length", long), T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", long), T.StructField("sequence_id", long), T.StructField("offset", long)])
    from pyspark.sql.pandas.types import to_arrow_schema

    return kept.mapInArrow(_packer(tokenizer_path, window, end_id, to_arrow_schema(schema)), schema)
