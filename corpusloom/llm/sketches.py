"""Document fingerprints as invertible Bloom lookup sketches. DataFrame and SQL operations only.

A text is taken as pieces, which end at spaces, line ends and some CJK stops, and cut into
paragraphs after those pieces whose hash, taken over the piece and the next one, is among the lowest share. So cuts go
by content alone: an edit moves the cuts next to it and no others, and versions keep the paragraphs that the edit leaves
alone. The share follows from the text without any step: ``FINE`` paragraphs, or ``GROWTH`` times the root of its
code points where that is more, divided by its different pairs of neighbouring pieces; one more code point
changes it hardly at all. Texts of some hundred code points, or of one line many times, are cut nearly at every word.

A digest has 40 bits of a hash and 24 bits of a hash of those. A sketch has parts, as many as the smallest power of two that
is a quarter of the digests or more; a part has three subtables of 8 cells, each the
exclusive-or of the digests that fall there. A comparison takes both texts' sketches with the larger number of parts
and subtracts them (again by exclusive-or) cell by cell; then a cell that holds a digest that checks gives it up:
it is taken out of its other cells, and so on (Goodrich and Mitzenmacher, "Invertible Bloom lookup tables"; the check stands in
for their counts, and a false one leaves cells over). If cells of
a part are left over the difference was too large for it: the part is compared again with subtables of 16, then
32, then 64 cells, and only where all four fail by the digests themselves. Small parts keep the work in proportion to
the digests; under one part in twenty needs a second try.

A fingerprint is the number of different paragraphs and the cells of all parts. The likeness of two
fingerprints is the share of paragraphs that both have among those that either has; two empty texts are alike (1).
Paragraphs count once, in no order: a text that repeats one line is one or two paragraphs.

Null text is an empty text. The order of documents is by descending id, null last, ties by a hash of the
text; the next of the last is the first. Repeated rows follow each other, and give a row each. Empty tables
give empty results; columns of other names are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import materialise

FINE, GROWTH, BITS, ROUNDS = 20, 0.15, 3, 8
#: Pieces end at spaces; a space is put behind these first, so that they end pieces too.
_STOPS = ["\n", "。", "，", "、"]
#: Marks a cut while pieces are put together. A text that has this control character is cut there too.
_CUT = "\x01"
#: Digests that a part is planned for.
PLANNED = 4
#: Bits of a digest's hash; the others check it.
_HASH, _CHECK = (1 << 40) - 1, (1 << 24) - 1
_NONE = "cast(array() as array<bigint>)"


def _bind(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def paragraphs(text: Column) -> Column:
    """The text cut into paragraphs, with a space behind each line end and CJK stop."""
    low = F.lit((1 << 20) - 1)
    share = F.greatest(F.lit(float(FINE)), GROWTH * F.sqrt(F.length(text))) * F.lit(float(1 << 20))
    spaced = text
    for stop in _STOPS:
        spaced = F.replace(spaced, F.lit(stop), F.lit(stop + " "))

    def marked(words: Column, chances: Column) -> Column:
        put = lambda limit: F.zip_with(words, chances, lambda w, c: F.when(c.bitwiseAND(low) < limit, F.concat(w, F.lit(_CUT))).otherwise(w))
        return F.array_join(_bind((share / F.size(F.array_distinct(chances))).cast("long"), put), " ")

    def cut(words: Column) -> Column:
        pairs = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1)))
        return _bind(pairs, lambda chances: marked(words, chances))

    return F.filter(F.split(_bind(F.split(spaced, " "), cut), _CUT), lambda p: p != "")


def paragraph_digests(text: Column) -> Column:
    """Different digests of a text's paragraphs."""
    low = F.transform(paragraphs(text), lambda p: F.xxhash64(p).bitwiseAND(F.lit(_HASH)))
    return F.array_distinct(F.transform(low, lambda d: F.shiftleft(F.xxhash64(d), 40).bitwiseOR(d)))


def _place(digest: str, table: str, level: int) -> str:
    """The cell of a digest in subtable 0, 1 or 2."""
    bits = BITS + level
    source = digest if level == 0 else f"xxhash64({digest} & {_HASH}L, {level})"
    return f"(shiftright({source}, {bits} * ({table})) & {2**bits - 1}L)"


def cells_sql(digests: str, level: int = 0) -> str:
    """The sketch of an array of digests: 3 x 2^(3 + level) cells."""
    last = 2 ** (BITS + level) - 1
    tables = (f"transform(sequence(0L, {last}L), at -> aggregate({digests}, 0L, (a, k) -> IF({_place('k', str(j), level)} = at, a ^ k, a)))" for j in range(3))
    return f"flatten(array({', '.join(tables)}))"


def subtract_sql(left: str, right: str) -> str:
    return f"zip_with({left}, {right}, (a, b) -> a ^ b)"


def peel_sql(cells: str, level: int = 0) -> str:
    """The digests of one side only; null if cells are left over."""
    width = 2 ** (BITS + level)
    here = lambda x: f"{_place(x, f'i div {width}', level)} = i % {width}"
    pure = f"array_distinct(filter(s.z, (q, i) -> q <> 0 AND shiftrightunsigned(q, 40) = (xxhash64(q & {_HASH}L) & {_CHECK}L) AND {here('q')}))"
    taken = f"transform(s.z, (q, i) -> aggregate(p, q, (a, e) -> IF({here('e')}, a ^ e, a)))"
    step = f"element_at(transform(array({pure}), p -> IF(size(p) = 0, s, named_struct('z', {taken}, 'k', concat(s.k, p)))), 1)"
    empty = "array_distinct(s.z) = array(0L)"
    return f"aggregate(sequence(1, {ROUNDS + 2 * level}), named_struct('z', {cells}, 'k', {_NONE}), (s, n) -> IF({empty}, s, {step}), s -> IF({empty}, s.k, NULL))"


def differing_sql(left: str, right: str, level: int = 0) -> str:
    """What peeling recovers from the sketches of two digest arrays."""
    return peel_sql(subtract_sql(cells_sql(left, level), cells_sql(right, level)), level)


def parts_sql(digests: str) -> str:
    """How many parts the sketch of an array of digests has: a power of two."""
    return f"cast(pow(2, ceil(log2(greatest(1.0D, size({digests}) / {PLANNED}.0D)))) AS bigint)"


def _part(digests: str, count: str) -> str:
    """The digests of part ``p`` of ``count``, a power of two, by bits that no cell goes by."""
    return f"filter({digests}, k -> (shiftright(k, 20) & ({count} - 1)) = p)"


def difference_sql(left: str, right: str) -> str:
    """How many digests only one of two arrays has, part by part, each with larger subtables until it can be peeled."""
    tries = ", ".join(differing_sql("d.l", "d.r", level) for level in range(4))
    exact = "concat(array_except(d.l, d.r), array_except(d.r, d.l))"  # only where four tables have failed
    each = f"named_struct('l', {_part(left, 'm')}, 'r', {_part(right, 'm')})"
    count = f"aggregate(transform(sequence(0L, m - 1), p -> {each}), 0, (n, d) -> n + size(coalesce({tries}, {exact})))"
    return f"element_at(transform(array(greatest({parts_sql(left)}, {parts_sql(right)})), m -> {count}), 1)"


def fingerprint(digests: str) -> Column:
    """Number of digests, then the cells of all parts in hexadecimal, nothing for an empty one."""
    each = f"transform(sequence(0L, m - 1), p -> element_at(transform(array({_part(digests, 'm')}), k -> {cells_sql('k')}), 1))"
    cells = F.expr(f"element_at(transform(array({parts_sql(digests)}), m -> flatten({each})), 1)")
    return F.concat(F.size(digests).cast("string"), F.lit("|"), F.array_join(F.transform(cells, lambda q: F.when(q == 0, F.lit("")).otherwise(F.lower(F.hex(q)))), ","))


def likeness(left: Column, right: Column, differing: Column) -> Column:
    """Of the sizes of two digest sets and of their difference."""
    either = (left + right + differing) / 2
    return F.when(either > 0, (either - differing) / either).otherwise(1.0)


def neighbours(ids: DataFrame) -> DataFrame:
    """``ids`` (id, mark, n, ...) with next_id and next_mark, in descending order of id.

    Range partitions are numbered and written; inside one a window gives the next row, and a table with one
    row a partition links their ends.
    """
    order = [F.col("id").desc_nulls_last(), F.col("mark")]
    parts = max(1, min(5000, ids.count() // 200_000 + 1))
    dealt = materialise(ids.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*order)
    lead = dealt.withColumns({"place": F.row_number().over(inside), "next": F.lead(F.struct("id", "mark")).over(inside)})
    heads = lead.where("place = 1").select("part", F.struct("id", "mark").alias("head"))
    along = Window.orderBy("part")  # one row a partition
    ends = heads.select("part", F.coalesce(F.lead("head").over(along), F.first("head").over(along)).alias("after"))
    joined = lead.join(F.broadcast(ends), "part").withColumn("next", F.coalesce("next", "after"))
    return joined.select(*ids.columns, F.col("next.id").alias("next_id"), F.col("next.mark").alias("next_mark"))


def _key(key: str) -> Column:
    """A key of an id; null is told from every text."""
    return F.when(F.col(key).isNull(), F.lit("-")).otherwise(F.concat(F.lit(":"), F.col(key).cast("string")))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next text's are.

    The edited text has the last third (rounded down) of its code points replaced by the first as many of
    the next document. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited
    and near_next. Of the next text only the part that is needed, and its digests, travel.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    ids = materialise(rows.groupBy("id", "mark", F.length("text").alias("n")).agg(F.count(F.lit(1)).alias("copies")))
    following = F.array(F.struct("next_id", "next_mark", F.lit(1).cast("long").alias("times")), F.struct(F.col("id").alias("next_id"), F.col("mark").alias("next_mark"), (F.col("copies") - 1).alias("times")))
    chain = materialise(neighbours(ids).select("id", "mark", "n", F.inline(following)).where("times > 0"))
    texts = rows.select(_key("id").alias("k"), "mark", "text")
    if not ids.where("copies > 1").isEmpty():
        texts = texts.dropDuplicates(["k", "mark"])
    wanted = chain.select(_key("next_id").alias("k"), F.col("next_mark").alias("mark"), F.col("id").alias("to_id"), F.col("mark").alias("to_mark"), F.floor(F.col("n") / 3).cast("int").alias("need"), "times", "n")
    gave = texts.hint("merge").join(wanted.hint("merge"), ["k", "mark"])
    gave = gave.select(F.col("to_id").alias("id"), _key("to_id").alias("k"), F.col("to_mark").alias("mark"), "n", "need", "times", F.substring(F.col("text"), F.lit(1), F.col("need")).alias("tail"), paragraph_digests(F.col("text")).alias("next_keys"))
    met = texts.hint("merge").join(gave.hint("merge"), ["k", "mark"])
    edited = met.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n") - F.col("need")).cast("int")), "tail"))
    keyed = edited.select("id", "n", "times", F.sha2("edited", 256).alias("edited_sha256"), paragraph_digests(F.col("text")).alias("keys"), paragraph_digests(F.col("edited")).alias("edited_keys"), "next_keys")
    found = keyed.withColumns({f"diff_{w}": F.expr(difference_sql("keys", f"{w}_keys")) for w in ("edited", "next")})
    found = found.withColumns({f"near_{w}": likeness(F.size("keys"), F.size(f"{w}_keys"), F.col(f"diff_{w}")) for w in ("edited", "next")})
    done = found.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_chars"), "edited_sha256", fingerprint("keys").alias("fingerprint"), fingerprint("edited_keys").alias("edited_fingerprint"), "near_edited", "near_next", "times")
    return done.withColumn("time", F.explode(F.expr("sequence(1L, times)"))).drop("time", "times")
