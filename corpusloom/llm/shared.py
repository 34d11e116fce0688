"""What several operators need: cutting lineage, Arrow text buffers, word boundaries, hashes and messages of hashes."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE, _STEP = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes up to which spans are hashed side by side.
_LONG = 256
#: Bytes of text that one message from a batch of documents to a range of hashes stands for.
MESSAGE = 80_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and context.master.startswith("local"):
            where = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(where or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return context._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """Cut ``df``'s lineage with a reliable checkpoint, so that a lost executor costs no recomputation.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset (tests, a single
    machine) a folder of its own is made: beside the warehouse on a cluster, temporary in local mode.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def text_bytes(spark: SparkSession, docs: DataFrame, text: str) -> tuple[int, int]:
    """Rows and bytes of text: the two numbers from which partitions are counted."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    return row["n"], row["b"] or 0


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and each text's offsets in them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has about ``most`` bytes of text in column ``text``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffer(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and how many words each text has."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of ``x`` reaches every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, *spans: tuple[np.ndarray, np.ndarray], seed: int = 0) -> list[np.ndarray]:
    """64-bit hashes of byte spans (starts, ends), one array for each pair.

    A span is read eight bytes at a time; each step mixes the whole state, so that no algebraic relation
    between bytes carries over to hashes. Spans of more than ``_LONG`` bytes are hashed one by one.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    return [_span_hash(data, eight, starts, ends - starts, seed) for starts, ends in spans]


def _span_hash(data: np.ndarray, eight: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    state = mixed(sizes.astype(np.uint64) * _STEP + np.uint64(_BASE + seed * 0x632BE59BD9B4E019 & (1 << 64) - 1))
    long = np.flatnonzero(sizes > _LONG)
    live, at = np.flatnonzero((sizes > 0) & (sizes <= _LONG)), 0
    while len(live):
        left = np.minimum(sizes[live] - at, 8)
        state[live] = mixed((state[live] ^ (eight[starts[live] + at] & _MASKS[left])) * _STEP)
        at += 8
        live = live[sizes[live] > at]
    for k in long.tolist():
        state[k] ^= np.uint64(xxhash.xxh3_64_intdigest(data[starts[k] : starts[k] + sizes[k]].tobytes(), seed))
    return state


def ascii_lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def batch_size(spark: SparkSession, docs: DataFrame, text: str, most: int) -> tuple[int, int]:
    """Bytes of text in a batch of documents, and how many ranges to cut hashes into.

    A batch has the square root of the text's bytes times ``MESSAGE``, and there are as many ranges as batches; so a
    message from a batch to a range stands for ``MESSAGE`` bytes of text at every size: messages grow in
    proportion to the text, not with its square. ``most`` bounds a batch by the memory of a task. Where it takes
    hold messages get smaller; give tasks on a large cluster more memory and raise it.
    """
    _, size = text_bytes(spark, docs, text)
    batch = min(most, max(1 << 20, int((size * MESSAGE) ** 0.5)))
    return batch, max(8, -(-size // batch))


def in_batches(docs: DataFrame, size: int) -> DataFrame:
    """(batch, docs): rows of ``docs`` in the order of the scan, about ``size`` bytes of text a batch, compressed.

    The last column is the text. Batches go by size alone, so repeated or null ids are no matter; a text larger
    than ``size`` is a batch of its own. :func:`batch_table` reads one back.
    """
    names, text = docs.columns, len(docs.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, weight = TaskContext.get().partitionId(), 0, [], 0
        for piece in slices(batches, text, size):
            more = int(text_buffer(piece.column(text))[1][-1])
            if held and weight + more > size:
                yield _as_row(part << 32 | number, held)
                number, held, weight = number + 1, [], 0
            held.append(piece)
            weight += more
        if held:
            yield _as_row(part << 32 | number, held)

    return docs.select(*names).mapInArrow(run, "batch long, docs binary")


def _as_row(number: int, pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pieces[0].schema) as writer:
        for piece in pieces:
            writer.write_batch(piece)
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([squeeze(sink.getvalue())], pa.binary())], ["batch", "docs"])


def batch_table(row: pa.Table) -> pa.Table:
    """The documents of a batch's row."""
    return pa.ipc.open_stream(expand(row.column("docs")[0].as_py())).read_all()


def squeeze(data: bytes | pa.Buffer) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def blobs(values: list[bytes | None]) -> pa.Array:
    return pa.array([None if x is None else squeeze(x) for x in values], pa.binary())


def unblobbed(column: pa.ChunkedArray) -> list[bytes | None]:
    return [None if x is None else expand(x) for x in column.to_pylist()]


def cuts(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Where the part of each of ``ranges`` equal ranges starts in sorted hashes."""
    edges = np.arange(1, ranges, dtype=np.uint64) * np.uint64((1 << 64) // ranges)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def pack_sorted(hashes: np.ndarray, base: int = 0) -> bytes:
    """Rising 64-bit numbers as the bytes of their differences, low bytes first, without the high bytes that are all zero."""
    steps = np.diff(hashes, prepend=np.uint64(base))
    planes = np.ascontiguousarray(steps.astype("<u8")).view(np.uint8).reshape(-1, 8)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + np.ascontiguousarray(planes[:, :width].T).tobytes()


def unpack_sorted(blob: bytes, base: int = 0) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8, offset=1).reshape(blob[0], -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, : blob[0]] = planes.T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64) + np.uint64(base)
