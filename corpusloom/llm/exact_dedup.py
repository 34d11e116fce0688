"""Exact deduplication over a sharded cuckoo-filter index of live digests.

A text's digest is the SHA-256 of its UTF-8 bytes after lower-casing A-Z. Scan tasks fold each Arrow
batch to one row per digest, so a text that a third of the corpus repeats reaches its shard as one row
a batch. A shard then streams those rows through a :class:`CuckooIndex`: the filter answers most new
digests, a hit is verified against the content of its bucket, and a full filter is rebuilt larger from the
stored keys.

Null text counts as empty. Of equal texts the row with the largest id stays; a null id is the smallest,
and of rows repeated with one id a single one stays. An empty table gives an empty result. Columns of
the input with clashing names are safe: only the id and the text are read by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import ascii_lower, materialise

#: Digests that one shard is planned to hold.
SHARD_ROWS = 500_000


class CuckooIndex:
    """A cuckoo filter whose slots also hold the content that their tags stand for.

    A digest has two candidate buckets of four slots. A lookup compares 16-bit tags; only where one agrees is
    the whole digest stored in that slot compared, so most new digests cost two tag comparisons. Entries (digest, value)
    move with their tags. Where no slot comes free the table overflows and is rebuilt larger from the stored digests.
    """

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 64):
        self._clear(buckets)
        self.resizes = self.verified = 0

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.tags: list[list[int]] = [[] for _ in range(buckets)]
        self.content: list[list[tuple[bytes, list]]] = [[] for _ in range(buckets)]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") & self.mask
        return tag, first, self._other(first, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return (bucket ^ (tag * 0x5BD1E995)) & self.mask

    def _find(self, digest: bytes) -> tuple[int, int] | None:
        tag, a, b = self._places(digest)
        for bucket in (a, b):
            if tag in self.tags[bucket]:
                for slot, other in enumerate(self.tags[bucket]):
                    if other == tag:
                        self.verified += 1
                        if self.content[bucket][slot][0] == digest:
                            return bucket, slot
        return None

    def get(self, digest: bytes) -> list | None:
        """The value of a live digest: a tag that agrees counts only if its slot holds the whole digest."""
        found = self._find(digest)
        return None if found is None else self.content[found[0]][found[1]][1]

    def insert(self, digest: bytes, value: list) -> None:
        """Add a digest that isn't live."""
        homeless = self._place((digest, value))
        if homeless is not None:
            self._resize(homeless)

    def _place(self, entry: tuple[bytes, list]) -> tuple[bytes, list] | None:
        """None, or the entry that is left without a slot."""
        tag, a, b = self._places(entry[0])
        for bucket in (a, b):
            if len(self.tags[bucket]) < self.SLOTS:
                self.tags[bucket].append(tag)
                self.content[bucket].append(entry)
                return None
        at = b
        for k in range(self.KICKS):
            slot = k % self.SLOTS
            tags, content = self.tags[at], self.content[at]
            tags[slot], tag = tag, tags[slot]
            content[slot], entry = entry, content[slot]
            at = self._other(at, tag)
            if len(self.tags[at]) < self.SLOTS:
                self.tags[at].append(tag)
                self.content[at].append(entry)
                return None
        return entry

    def delete(self, digest: bytes) -> bool:
        """Take a live digest out; an unknown one changes nothing."""
        found = self._find(digest)
        if found is None:
            return False
        bucket, slot = found
        del self.tags[bucket][slot], self.content[bucket][slot]
        return True

    def _resize(self, homeless: tuple[bytes, list]) -> None:
        stored, buckets = [*self.items(), homeless], self.mask + 1
        while True:
            buckets *= 2
            self.resizes += 1
            self._clear(buckets)
            if all(self._place(entry) is None for entry in stored):
                return

    def items(self) -> Iterator[tuple[bytes, list]]:
        for bucket in self.content:
            yield from bucket


def with_digest(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_digest``, the normalised text's SHA-256 in lower-case hex, and a row number ``_row``.

    Null text has the digest of an empty one.
    """
    return docs.withColumns({"_digest": F.sha2(ascii_lower(F.coalesce(docs[text_col].cast("string"), F.lit(""))), 256), "_row": F.monotonically_increasing_id()})


_ENTRY = "digest binary, keep_id {id}, keep_row long, group_size long, same_id long"


def _larger(a: list | tuple, b: list | tuple) -> bool:
    """Whether (id, row) comes after another; null is the smallest id."""
    return (a[0] is not None, a[0], a[1]) > (b[0] is not None, b[0], b[1])


def _merge(have: list, more: tuple) -> None:
    """Add an entry's (id, row, rows, rows with this id) to those of its digest."""
    key, row, n, same = more
    have[2] += n
    if key == have[0]:
        have[1], have[3] = max(have[1], row), have[3] + same
    elif _larger((key, row), have):
        have[0], have[1], have[3] = key, row, same


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each digest of a batch: its largest (id, row), and how many rows have it, in all and with this id."""
    for batch in batches:
        best: dict[bytes, list] = {}
        for digest, *value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if digest in best:
                _merge(best[digest], value)
            else:
                best[digest] = value
        yield _entries(best.items(), batch.schema)


def _entries(items, schema: pa.Schema) -> pa.RecordBatch:
    rows = [(d, *v) for d, v in items]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], schema.field(k).type) for k in range(5)], schema=schema)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, schema = CuckooIndex(), None
    for batch in batches:
        schema = batch.schema
        for digest, *value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if value[2] < 0:
                index.delete(digest)
            elif (have := index.get(digest)) is None:
                index.insert(digest, value)
            else:
                _merge(have, value)
    rows = []
    for item in index.items():
        rows.append(item)
        if len(rows) == 10_000:
            yield _entries(rows, schema)
            rows = []
    if rows:
        yield _entries(rows, schema)


def build_index(digests: DataFrame, id_col: str = "doc_id", rows: int | None = None) -> DataFrame:
    """Index entries (digest, keep_id, keep_row, group_size) of what :func:`with_digest` gives."""
    kind = dict(digests.dtypes)[id_col]
    entry = _ENTRY.format(id=kind)
    keys = digests.select(F.unhex("_digest").alias("digest"), F.col(id_col).alias("keep_id"), F.col("_row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"), F.lit(1).cast("long").alias("same_id"))
    shards = max(8, -(-(rows if rows is not None else digests.count()) // SHARD_ROWS))
    return keys.mapInArrow(_fold, entry).repartition(shards, "digest").mapInArrow(_index, entry)


def update_index(index: DataFrame, inserts: DataFrame | None = None, deletes: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """A stored index after some digests left and others came: deletions first, then insertions.

    ``deletes`` has a column ``_digest``; a digest that isn't live is passed over. Deleting removes the
    whole entry, however many rows stood for it.
    """
    kind = dict(index.dtypes)["keep_id"]
    parts = index.select("digest", "keep_id", "keep_row", "group_size", "same_id", F.lit(0).alias("_turn"))
    if deletes is not None:
        parts = parts.unionByName(deletes.select(F.unhex("_digest").alias("digest"), F.lit(None).cast(kind).alias("keep_id"), F.lit(0).cast("long").alias("keep_row"), F.lit(-1).cast("long").alias("group_size"), F.lit(0).cast("long").alias("same_id"), F.lit(1).alias("_turn")).dropDuplicates(["digest"]))
    if inserts is not None:
        keys = inserts.select(F.unhex("_digest").alias("digest"), F.col(id_col).cast(kind).alias("keep_id"), F.col("_row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"), F.lit(1).cast("long").alias("same_id"))
        parts = parts.unionByName(keys.mapInArrow(_fold, _ENTRY.format(id=kind)).withColumn("_turn", F.lit(2)))
    entry = _ENTRY.format(id=kind)
    return parts.repartition("digest").sortWithinPartitions("_turn").drop("_turn").mapInArrow(_index, entry)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Digests are written once and joined with the index by sort and merge, which lets Spark split a text
    that very many rows share.
    """
    digests = materialise(with_digest(docs.select(docs[id_col], docs[text_col].alias("text"))).select(id_col, "_digest", "_row"))
    index = build_index(digests, id_col).select(F.lower(F.hex("digest")).alias("_digest"), "keep_id", "keep_row", "group_size")
    return digests.join(index.hint("merge"), "_digest").select(id_col, "keep_id", "group_size", (F.col("_row") == F.col("keep_row")).alias("kept"), F.col("_digest").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts.

    Index and table meet on digest and id together, so that no key has more rows than one id. Only where the
    id that stays has several rows are they folded, to the one with the smallest hash.
    """
    packed = docs.select(F.struct("*").alias("doc"), docs[id_col].alias("id"), docs[text_col].alias("text"))
    marked = with_digest(packed)
    index = materialise(build_index(marked.select("id", "_digest", "_row"), "id", docs.count()))
    key = lambda digest, key: F.concat(digest, F.when(key.isNull(), F.lit("-")).otherwise(F.concat(F.lit(":"), key.cast("string")))).alias("_key")
    keep = index.select(key(F.lower(F.hex("digest")), F.col("keep_id")), "same_id")
    found = marked.select("doc", key(F.col("_digest"), F.col("id"))).join(keep.hint("merge"), "_key")
    single = found.where("same_id = 1").select("doc.*")
    if index.where("same_id > 1").isEmpty():
        return single
    folded = found.where("same_id > 1").groupBy("_key").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc"))
    return single.unionByName(folded.select("doc.*"))
