"""Personal data: generators propose spans, boosted trees choose among them. DataFrame operations only.

Generators are patterns of high recall whose spans may overlap: for each kind the base pattern, and looser
ones (spelled-out addresses, numbers without a plus sign, dotted card numbers, addresses with bracketed dots). A base span that passes its
check (octets, Luhn, number of digits) is always kept. The others are scored by gradient-boosted trees over
format and context features, and the trees alone decide about them. They are taught by base spans that pass and that fail
their checks, by passing ones as the looser generators would see them, and by candidates of the looser generators: one whose
value stands in a passing base span of the same text too, in plain spelling, is a person's; one that isn't and has its context
against it (a version or page before it, a bare "at" in running prose, digits that go on, a failed check) is not. So labels come
from outside the candidate: where a corpus shows loose spellings beside plain ones the trees take them elsewhere as well.
``octets`` says for an address whether it has an @ or a bracketed at. All features are
small whole numbers, so one aggregation over every candidate gives the complete training set as a table of
at most a few thousand different feature rows with counts; trees are fitted to those counts and scored as a
SQL expression. Each kind's threshold is the lowest at which loose spans of the other half of the documents, real and
rewritten ones, show a precision of ``precision`` or more, 0.5 for a kind without failures there; one without passes adds nothing. Added spans never
overlap base spans; of those that overlap each other the best one stays, then the best that doesn't overlap it,
and so on.

Offsets are code points, end exclusive. Null and empty texts have no spans. Repeated rows are separate rows.
Patterns use possessive quantifiers and start at the edge of a run, so a very long run of one character
class costs linear time. Empty tables give empty results; columns of other names are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import materialise

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
#: A dot between octets that is written so that it isn't read as one.
_DOT = r"(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\x20dot\x20)"

#: (kind, whether it is the base pattern, a character the text must have, pattern)
GENERATORS = (
    ("email", True, "@", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", True, "[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", True, "[0-9]", r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"),
    ("phone", True, "[+]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("email", False, r"[\[(]|\bat\b", rf"(?<![{_LOCAL}])[{_LOCAL}]++ ?(?:\[at\]|\(at\)|(?<= )at(?= )) ?[A-Za-z0-9-]++ ?(?:\[dot\]|\(dot\)|(?<= )dot(?= )|\.) ?[A-Za-z]{{2,24}}"),
    ("card", False, "[0-9]", r"(?<![0-9.])[0-9]{4}([.\x20_/-]{1,2})[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}(?![0-9.])"),
    ("phone", False, "[0-9]", r"(?<![0-9A-Za-z.])\(?[0-9]{2,4}\)?[\x20.-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])"),
    ("ip", False, "[0-9]", rf"(?<![0-9.])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])"),
    ("phone", False, "[0-9]", r"(?<![0-9A-Za-z.])00[1-9][0-9 ()-]{8,16}[0-9](?![0-9A-Za-z])"),
)

FEATURES = ("kind", "digits", "luhn", "groups", "before", "after", "letters", "dots", "plus", "octets", "cue", "runs_on")
_CUE_AGAINST = r"(?i)(version|section|isbn|chapter|page|\bv|no)\W*$"
_CUE_FOR = r"(?i)(mail|phone|tel|call|fax|mobile|contact|card|visa|host|server|address|\bip)\W*$"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _class(c: Column) -> Column:
    """0: white space or the text's edge, 1: letter or digit, 2: other."""
    return F.when(c.rlike(r"[\p{L}\p{N}]"), 1).when(c.rlike(r"\S"), 2).otherwise(0)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every proposed span of every text: row, id, mark, kind, base, start, end, features, and ``valid``: the check of a
    base span; for another true if its value is that of a passing base span of the text, else false if format or context is against it
    (a bare "at" in running prose, a wrong number of digits, a failed Luhn check, a version or page before it), else null.

    A text without any gives one row of nulls. ``mark`` is a hash of the text.
    """
    text = docs[text_col].cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    found = []
    for number, (kind, base, sign, pattern) in enumerate(GENERATORS):
        there = F.col("text").rlike(sign) & F.col("text").rlike(pattern)
        gaps = F.when(there, F.split("text", pattern, -1))
        hits = F.when(there, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
        found.append(F.struct(F.lit(number).alias("generator"), F.lit(KINDS.index(kind)).alias("kind"), F.lit(base).alias("base"), gaps.alias("gaps"), hits.alias("hits")))
    proposing = F.when(F.col("text").rlike(r"[@0-9]|\bat\b|[\[(]at[\])]"), F.filter(F.array(*found), lambda g: g["hits"].isNotNull()))
    lists = rows.select("row", "id", "mark", F.inline_outer(proposing))
    spans = lists.select(
        "row", "id", "mark", "generator", "kind", "base",
        F.posexplode_outer(F.expr("transform(hits, (h, i) -> struct(h AS hit, length(gaps[i]) AS gap, right(gaps[i], 24) AS prior, left(gaps[i + 1], 2) AS next))")).alias("at", "s"),
    ).select("row", "id", "mark", "generator", "kind", "base", "at", "s.*")
    order = Window.partitionBy("row", "generator").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("hit")
    spans = spans.withColumn("end", F.sum(F.col("gap") + size).over(order)).withColumn("start", F.col("end") - size)
    digits = F.regexp_replace("hit", "[^0-9]", "")
    plain = F.when(F.col("kind") == 1, F.regexp_replace("hit", _DOT, ".")).otherwise(F.col("hit"))
    octets = F.forall(F.split(plain, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.right(F.concat(F.lit("00"), p), F.lit(3)).try_cast("int") <= 255))
    n = F.length(digits)
    made = spans.select(
        "row", "id", "mark", "kind", "base", "start", "end",
        F.least(n, F.lit(20)).alias("digits"),
        F.when(n.between(12, 19), _luhn(digits).cast("int")).otherwise(0).alias("luhn"),
        F.least(F.regexp_count("hit", F.lit("[0-9]+")), F.lit(8)).alias("groups"),
        F.when(F.col("gap") == 0, 0).otherwise(_class(F.right("prior", F.lit(1)))).alias("before"),
        _class(F.left(F.coalesce("next", F.lit("")), F.lit(1))).alias("after"),
        F.least(F.length(F.regexp_replace("hit", "[^A-Za-z]", "")), F.lit(3)).alias("letters"),
        F.least(F.length(F.regexp_replace("hit", r"[^.]", "")), F.lit(4)).alias("dots"),
        F.col("hit").startswith("+").cast("int").alias("plus"),
        F.when(F.col("kind") == 0, F.col("hit").rlike(r"@|[\[(]at[\])]").cast("int")).when(plain.rlike(r"^[0-9]+(\.[0-9]+){3}$"), octets.cast("int")).otherwise(0).alias("octets"),
        F.when(F.col("prior").rlike(_CUE_FOR), 2).when(F.col("prior").rlike(_CUE_AGAINST), 1).otherwise(0).alias("cue"),
        n.alias("n"),
        F.coalesce(F.col("next").rlike(r"^[\x20.-][0-9]") | F.col("prior").rlike(r"[0-9][\x20.-]$"), F.lit(False)).cast("int").alias("runs_on"),
        F.when(F.col("kind") == 0, F.lower(F.regexp_replace(F.regexp_replace(F.col("hit"), r" ?(?:[\[(]at[\])]|\bat\b) ?", "@"), r" ?(?:[\[(]dot[\])]|\bdot\b) ?", ".")))
        .when(F.col("kind") == 1, plain).when(F.col("kind") == 2, digits).otherwise(F.right(digits, F.lit(10))).alias("value"),
    )
    valid = (F.when(F.col("kind") == 0, F.lit(True)).when(F.col("kind") == 1, F.col("octets") == 1)
             .when(F.col("kind") == 2, F.col("n").between(14, 19) & (F.col("luhn") == 1)).otherwise(F.col("n").between(10, 15)))
    against = (F.when(F.col("cue") == 1, True).when(F.col("kind") == 0, (F.col("octets") == 0) & (F.col("cue") != 2))
               .when(F.col("kind") == 1, F.col("octets") == 0)
               .when(F.col("kind") == 2, ~F.col("n").between(14, 19) | (F.col("luhn") == 0)).otherwise(~F.col("n").between(10, 15) | (F.col("runs_on") == 1)))
    passed = F.col("base") & valid
    alike = Window.partitionBy("row", "kind", "value")  # a part of the base span itself isn't another spelling
    plainly = F.coalesce(F.min(F.when(passed, F.col("end"))).over(alike) <= F.col("start"), F.lit(False)) | F.coalesce(F.max(F.when(passed, F.col("start"))).over(alike) >= F.col("end"), F.lit(False))
    return made.withColumn("valid", F.when(F.col("base"), valid).when(plainly, True).when(against, False)).drop("n", "value")


# A tree is a leaf's value or (feature, threshold, left, right): left if feature <= threshold.


def _leaf(cells: list) -> float:
    g, h = sum(c["g"] for c in cells), sum(c["h"] for c in cells)
    return g / (h + 1.0)


def _grow(cells: list, depth: int) -> float | tuple:
    best, gain = None, 1e-6
    g, h = sum(c["g"] for c in cells), sum(c["h"] for c in cells)
    for k in range(len(FEATURES)) if depth else ():
        for t in sorted({c["x"][k] for c in cells})[:-1]:
            lg, lh = sum(c["g"] for c in cells if c["x"][k] <= t), sum(c["h"] for c in cells if c["x"][k] <= t)
            won = lg * lg / (lh + 1) + (g - lg) ** 2 / (h - lh + 1) - g * g / (h + 1)
            if won > gain:
                best, gain = (k, t), won
    if best is None:
        return _leaf(cells)
    k, t = best
    return (k, t, _grow([c for c in cells if c["x"][k] <= t], depth - 1), _grow([c for c in cells if c["x"][k] > t], depth - 1))


def _value(tree: float | tuple, x: tuple) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def _sql(tree: float | tuple) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    return f"(CASE WHEN {FEATURES[tree[0]]} <= {tree[1]} THEN {_sql(tree[2])} ELSE {_sql(tree[3])} END)"


@dataclass
class BoostedTrees:
    """Additive trees on the log-odds, and for each kind the probability from which a span is taken."""

    trees: list
    rate: float
    start: float
    thresholds: list[float]

    def probability(self, x: tuple) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.start + self.rate * sum(_value(t, x) for t in self.trees)))))

    def expression(self) -> Column:
        total = " + ".join([f"{self.start!r}D", *(f"{self.rate!r}D * {_sql(t)}" for t in self.trees)])
        return F.expr(f"1 / (1 + exp(-({total})))")


def fit(counts: list[tuple[tuple, int, int, int]], rounds: int = 20, depth: int = 3, rate: float = 0.4, precision: float = 0.98) -> BoostedTrees:
    """Fit to (features, half, failed, passed) counts: trees on half 0, thresholds on half 1."""
    cells = [{"x": x, "n": p + q, "y": q} for x, half, p, q in counts if half == 0 and p + q]
    total, hits = sum(c["n"] for c in cells), sum(c["y"] for c in cells)
    model = BoostedTrees([], rate, math.log((hits + 0.5) / (total - hits + 0.5)), [2.0] * len(KINDS))
    score = {c["x"]: model.start for c in cells}
    for _ in range(rounds if 0 < hits < total else 0):
        for c in cells:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, score[c["x"]]))))
            c["g"], c["h"] = c["y"] - c["n"] * p, c["n"] * p * (1 - p)
        tree = _grow(cells, depth)
        model.trees.append(tree)
        for x in score:
            score[x] += rate * _value(tree, x)
    for kind in range(len(KINDS)):
        held = sorted(((model.probability(x), p, q) for x, half, p, q in counts if half == 1 and x[0] == kind), reverse=True)
        if not sum(q for _, _, q in held):
            continue
        if not sum(p for _, p, _ in held):
            model.thresholds[kind] = 0.5
            continue
        wrong = right = 0
        for k, (chance, p, q) in enumerate(held):
            wrong, right = wrong + p, right + q
            last = k + 1 == len(held) or held[k + 1][0] < chance
            if last and chance >= 0.5 and right >= precision * (wrong + right):
                model.thresholds[kind] = chance
    return model


def _loosened(x: tuple) -> list[tuple]:
    """How a base span's features read where it is written as the looser generators find it, with and without its cue."""
    row = dict(zip(FEATURES, x, strict=True))
    kind = KINDS[row["kind"]]
    if kind == "email":
        forms = [{"dots": dots} for dots in (0, 1)]
    elif kind == "card":
        forms = [{"groups": 4, "dots": dots} for dots in (0, 3)]
    elif kind == "phone":
        fewer = [{"digits": row["digits"] - 1, "groups": row["groups"] - 1, "plus": 0}] if row["digits"] > 10 else []
        forms = [{"plus": 0}, *fewer]
    else:
        forms = [{"letters": letters, "dots": dots} for letters, dots in ((0, 3), (3, 0))]
    return [tuple((row | form | {"cue": cue}).values()) for form in forms for cue in sorted({0, row["cue"]})]


def train(found: DataFrame, **how: float) -> BoostedTrees:
    """Trees from base candidates, these in looser spelling, and the labelled candidates of the looser generators.

    Base spans as they are only teach: thresholds go by what the looser generators find. Candidates that run on into
    other digits may be the rest of a base span; they teach too, as such. The driver sees counts of different
    feature rows only.
    """
    half = (F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % 2).cast("int").alias("half")
    rows = found.where("valid IS NOT NULL AND kind IS NOT NULL").groupBy(*FEATURES, "base", half).agg(F.count_if(~F.col("valid")).alias("failed"), F.count_if("valid").alias("passed"))
    counts: Counter = Counter()
    for r in rows.toLocalIterator():
        x = tuple(int(r[f]) for f in FEATURES)
        if not r["base"] or not r["half"]:
            counts[x, r["half"], False] += r["failed"]
            counts[x, r["half"], True] += r["passed"]
        for each in _loosened(x) if r["base"] and r["passed"] else []:
            counts[each, r["half"], True] += r["passed"]
    keys = sorted({key[:2] for key in counts})
    return fit([(x, h, counts[x, h, False], counts[x, h, True]) for x, h in keys], **how)


def choose(found: DataFrame, model: BoostedTrees) -> DataFrame:
    """The spans to redact: row, id, kind, start, end, base, score."""
    limit = F.element_at(F.array(*[F.lit(float(t)) for t in model.thresholds]), F.col("kind") + 1)
    taken = found.withColumn("score", F.when(F.col("base"), 1.0).otherwise(model.expression())).where((F.col("base") & F.col("valid")) | (~F.col("base") & (F.col("score") >= limit)))
    by_start = Window.partitionBy("row").orderBy("start")
    taken = taken.withColumn("reach", F.max(F.when(F.col("base"), F.col("end"))).over(by_start.rangeBetween(Window.unboundedPreceding, 0)))
    taken = taken.withColumn("next_base", F.min(F.when(F.col("base"), F.col("start"))).over(by_start.rangeBetween(0, Window.unboundedFollowing)))
    clear = F.coalesce(F.col("reach") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("next_base") >= F.col("end"), F.lit(True))
    taken = taken.where(F.col("base") | clear)
    kept = ["row", "id", "kind", "start", "end", "base", "score"]
    added = taken.where(~F.col("base"))
    each = Window.partitionBy("row").orderBy("start", "end", "kind")
    added = added.withColumn("fresh", (F.coalesce(F.max("end").over(each.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) <= F.col("start")).cast("int"))
    added = added.withColumn("island", F.sum("fresh").over(each.rowsBetween(Window.unboundedPreceding, 0)))
    # an island is a chain of overlapping spans; it is emptied from the best span down
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("loss"), "start", (-F.col("end")).alias("back"), "kind")))
    free = "NOT exists(a, y -> y.start < -x.back AND -y.back > x.start)"
    islands = added.groupBy("row", "id", "island").agg(best.alias("s")).select("row", "id", F.expr(f"inline(aggregate(s, slice(s, 1, 0), (a, x) -> IF({free}, concat(a, array(x)), a)))"))
    chosen = islands.select("row", "id", "kind", "start", (-F.col("back")).alias("end"), F.lit(False).alias("base"), (-F.col("loss")).alias("score"))
    return taken.where("base").select(*kept).unionByName(chosen.select(*kept))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: float) -> DataFrame:
    """(row, id, mark, spans) of every row: spans are kind, start, end, base and score, by start and kind."""
    found = materialise(candidates(docs, id_col, text_col))
    chosen = choose(found, train(found, **how)).select("row", F.struct("start", "kind", "end", "base", "score").alias("span"))
    everyone = found.select("row", "id", "mark").dropDuplicates(["row"])
    spans = chosen.groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("s"))
    names = F.array(*[F.lit(k) for k in KINDS])
    named = F.transform("s", lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), s["score"].alias("score")))
    joined = everyone.join(spans.hint("merge"), "row", "left").withColumn("s", F.coalesce("s", F.expr("slice(array(struct(0L AS start, 0 AS kind, 0L AS end, true AS base, 0D AS score)), 1, 0)")))
    return joined.select("row", "id", "mark", named.alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: float) -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets; overlapping spans become one mark."""
    spans = find(docs, id_col, text_col, **how).select(F.struct("id", "mark").alias("key"), "spans").dropDuplicates(["key"])
    text = docs[text_col].cast("string")
    packed = docs.select(F.struct(docs[id_col].alias("id"), F.xxhash64(text).alias("mark")).alias("key"), F.struct("*").alias("doc"), text.alias("text"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.array(F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    joined = packed.join(spans.hint("merge"), "key")
    kept = [F.col(f"doc.`{c}`") for c in docs.columns if c != text_col]
    return joined.select(*kept, done.alias(text_col)).select(*docs.columns)


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
