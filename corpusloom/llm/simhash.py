"""SimHash near-duplicates found by multi-index hashing.

Fingerprints: A-Z lower-cased, three-word shingles with repeats, XXH64 with seed 42, a bit is 1 if set in
over half the hashes. Two documents link if their fingerprints differ in two bits or fewer.

Search (Norouzi et al., "Fast exact search in Hamming space with multi-index hashing"): the fingerprint is
cut into a high and a low half. If two differ in at most two bits, either the high halves differ in at
most one, or the low halves are equal. So the high half is probed with its Hamming ball of radius one and
the low half with radius zero; whole distances are then verified. Only bits that are 0 are flipped, so
each pair is found from one side. Documents with one fingerprint are one class and enter once.

A table bucket with over ``CROWD`` members isn't paired: its probes enumerate the rest of the ball in the
other half and look the whole fingerprint up, so the work follows true links, whatever a bucket's size.

Null and white-space texts have fingerprint zero and link like any other. A null id is passed through and
counts as larger than every other. Repeated rows share a fingerprint. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import components
from corpusloom.llm.shared import materialise, slices

#: Members of a bucket up to which its pairs are verified one by one.
CROWD = 256


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    votes, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(np.array(hashes[at : at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            known: dict[str | None, int] = {}
            out = []
            for t in batch.column(2).to_pylist():
                if t not in known:
                    known[t] = fingerprint((t or "").encode(), shingle)
                out.append(known[t])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(out, np.uint64).view(np.int64))], ["id", "row", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, row, fp): ``fp`` is the fingerprint as a signed long, ``row`` numbers the rows of the table."""
    rows = docs.select(docs[id_col].alias("id"), F.monotonically_increasing_id().alias("row"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), f"id {dict(rows.dtypes)['id']}, row long, fp long")


def _high(fp: str) -> Column:
    return F.shiftrightunsigned(fp, 32)


def _low(fp: str) -> Column:
    return F.col(fp).bitwiseAND(F.lit(0xFFFFFFFF))


def _flips(value: Column, most: int, exactly: bool = False) -> Column:
    """``value`` with up to (or exactly) ``most`` of its low 32 bits flipped, the unchanged value first."""
    masks = [1 << i for i in range(32)]
    two = [1 << i | 1 << j for i in range(32) for j in range(i)]
    chosen = (two if most == 2 else masks) if exactly else [0, *(masks if most else []), *(two if most == 2 else [])]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in chosen]), lambda m: value.bitwiseXOR(m))


def _verified(found: DataFrame) -> DataFrame:
    return found.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= 2).select(F.col("fp").alias("u"), F.col("other").alias("v"))


def _half(classes: DataFrame, probes: DataFrame, key: Column, rest: Column) -> DataFrame:
    """Links of ``probes`` (fp, key, spread) into the table of ``classes`` keyed by one half.

    ``spread`` is how many bits of the probed half are flipped; ``rest`` gives, for a crowded bucket, the
    whole fingerprints that may still match.
    """
    table = classes.select(F.col("fp").alias("other"), key.alias("key"))
    sizes = table.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
    hits = materialise(probes.join(sizes.hint("merge"), "key").where("spread > 0 OR members > 1"))
    near = hits.where(F.col("members") <= CROWD).join(table.hint("merge"), "key")
    far = hits.where(F.col("members") > CROWD).select("fp", "spread", F.explode(rest).alias("other"))
    far = far.join(classes.select(F.col("fp").alias("other")).hint("merge"), "other").select("fp", "spread", "other")
    return _verified(near.select("fp", "spread", "other").union(far).where("spread > 0 OR fp < other"))


def links(classes: DataFrame) -> DataFrame:
    """Pairs (u, v) of different fingerprints of ``classes`` (fp, unique) that differ in two bits or fewer.

    A pair may come twice, from either half; none is missed and none is capped.
    """
    zero_bits = F.filter(F.array(*[F.lit(1 << i).cast("long") for i in range(32)]), lambda m: _high("fp").bitwiseAND(m) == 0)
    ball = F.concat(F.array(F.struct(_high("fp").alias("key"), F.lit(0).alias("spread"))), F.transform(zero_bits, lambda m: F.struct(_high("fp").bitwiseOR(m).alias("key"), F.lit(1).alias("spread"))))
    probes = classes.select("fp", F.inline(ball))
    whole = lambda low: F.shiftleft("key", 32).bitwiseOR(low)
    rest = F.transform(F.when(F.col("spread") > 0, _flips(_low("fp"), 1)).otherwise(_flips(_low("fp"), 2)), whole)
    high = _half(classes, probes, _high("fp"), rest)
    exact = classes.select("fp", _low("fp").alias("key"), F.lit(0).alias("spread"))
    low_rest = F.transform(_flips(_high("fp"), 2, exactly=True), lambda h: F.shiftleft(h, 32).bitwiseOR(F.col("key")))
    low = _half(classes, exact, _low("fp"), low_rest)
    return high.union(low)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, row, fingerprint, component_id, keep_row) of every row of ``docs``.

    ``component_id`` is the smallest id reachable by links; ``keep_row`` is the row of that document, the
    first if several rows have the id.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, shingle))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    classes = materialise(rows.groupBy("fp").agg(first))
    roots = components(links(classes.select("fp")))
    rooted = classes.join(roots.select(F.col("node").alias("fp"), "root").hint("merge"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    groups = rooted.groupBy("root").agg(F.min("first").alias("least"))
    named = rooted.select("fp", "root").join(groups.hint("merge"), "root").select("fp", F.col("least.id").alias("component_id"), F.col("least.row").alias("keep_row"))
    found = rows.join(named.hint("merge"), "fp")
    return found.select("id", "row", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "keep_row")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, find: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """``docs`` with one document of each component of ``find``: the one with the smallest id.

    Rows that repeat this document's id and text count once; other texts under its id stay with it.
    """
    packed = docs.select(F.struct("*").alias("doc"), docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    key = F.coalesce(F.concat(F.lit("id:"), F.col("id").cast("string")), F.lit("none")).alias("key")
    rows = materialise(find(packed, "id", "text", shingle).where("id <=> component_id").groupBy(key).agg(F.count(F.lit(1)).alias("n")))
    kept = packed.select("doc", "text", key).join(rows.select("key").hint("merge"), "key", "left_semi")
    if not rows.where("n > 1").isEmpty():
        kept = kept.groupBy("key", F.xxhash64("text").alias("hash")).agg(F.first("doc").alias("doc"))
    return kept.select("doc.*")
