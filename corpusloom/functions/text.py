"""Column builders for text: token estimates, sentences, query gates, citations, ids.

All are plain expressions, evaluated in the JVM. Null text gives null unless said otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns and word lists that results depend on.
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
CJK = r"[㐀-鿿぀-ヿ가-힯]"
SENTENCE = r"(?s).+?(?:\n+|[。！？；]\s*|[.!?;](?:\s+|\z)|\z)"
GATE_TOKEN = r"[A-Za-z0-9_./:-]+"
TOPIC_TOKEN = r"[A-Za-z][A-Za-z0-9_.:/-]{2,}"
WORD_TOKEN = r"[A-Za-z][A-Za-z0-9-]{2,}"
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "does", "for", "from", "how", "i", "in", "into", "is", "it",
    "its", "itself", "me", "of", "on", "or", "please", "say", "should", "show", "summarize", "tell", "that", "their",
    "them", "the", "there", "these", "this", "those", "they", "to", "us", "using", "what", "when", "where", "which",
    "why", "with", "work",
]
GENERIC_TERMS = [
    "about", "difference", "differences", "discussed", "explain", "handle", "help", "limitation", "limitations",
    "mention", "mentioned", "overview", "problem", "problems", "risk", "risks", "said", "summary", "tell", "why",
]
PRONOUN = r"(?i)\b(it|its|this|that|they|them|their|these|those|he|she|his|her|itself)\b"
FOLLOW_UP = (
    r"(?i)\b(what about|how about|why (?:this|that)|why so|how does that work|how does this work|where is that mentioned|"
    r"where is this mentioned|does the document mention|is there anything about)\b"
)
SUMMARY = r"(?i)\b(summarize|summary|recap|overview|tl;dr)\b|总结一下|总结|概括一下|概括|这个怎么说|为什么这样"
QUERY_LABEL = r"(?i)^(rewritten query|rewrite|query|standalone query|search query)\s*:\s*"
EXPLANATION = r"(?i)^(because|reason|explanation|this query|i rewrote|i would rewrite|here(?:'s| is) the rewritten query)"
STRATEGIES = ["no_rewrite", "reference_resolution", "standalone_expansion", "keyword_enrichment"]
UNKNOWN = {"en": "I don't have enough information", "zh": "我没有足够的信息"}
STEP_MESSAGES = {
    "cancelled": "Ingestion was cancelled.",
    "fetch": "Ingestion failed while loading the source.",
    "parse": "Ingestion failed while parsing the source.",
    "chunk": "Ingestion failed while preparing chunks.",
    "snapshot": "Ingestion failed during snapshot generation.",
    "embed": "Ingestion failed while generating embeddings.",
    "save": "Ingestion failed while saving processed chunks.",
}
QUOTA_WORDS = ["quota", "credit", "balance", "insufficient", "resource package", "余额不足", "无可用资源包", "1113"]
SAFETY_WORDS = ["content policy", "policy", "violative", "violation", "违规", "safety", "content_filter", "sensitive"]
UPSTREAM_WORDS = ["timeout", "timed out", "connection", "temporarily unavailable", "service unavailable", "gateway", "overloaded"]
COMPARISON = r"(?i)\b(compare|comparison|difference|differences|versus|vs\.?)\b|区别|对比"
EVIDENCE = r"(?i)\b(where|mention|mentioned|evidence|source|sources|quote|quoted)\b|哪里提到|有没有说|文档里有没有|文档中有没有"
CODE_OR_ERROR = (
    r"(?i)`[^`]+`|[A-Za-z_][A-Za-z0-9_]*\([^)]*\)|[A-Za-z0-9_./-]+/[A-Za-z0-9_./-]+|\b[A-Z][A-Za-z]+Error\b|"
    r"\b[A-Z][A-Za-z]+Exception\b|::|Traceback|stack trace|\bline \d+\b|[A-Za-z0-9_./-]+\.(py|ts|tsx|js|json|md)\b"
)


def token_estimate(text: Column) -> Column:
    """Tokens without a tokenizer: ASCII / 4 and other / 2, rounded half to even, and one for each CJK character."""
    return F.when(F.octet_length(text) == F.length(text), F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(F.length(text) / 4).cast("int")))).otherwise(_mixed_estimate(text))


def _mixed_estimate(text: Column) -> Column:
    """The estimate of a text that isn't all ASCII (as many bytes as characters)."""
    n = F.length(text)
    return _estimate(n, n - F.length(F.regexp_replace(text, CJK, "")), n - F.length(F.regexp_replace(text, r"[\x00-\x7F]", "")))


def _estimate(n: Column, cjk: Column, ascii_: Column) -> Column:
    """The estimate of ``n`` characters, of these ``cjk`` and ``ascii_`` of the two kinds."""
    ascii_tokens = F.when(ascii_ > 0, F.greatest(F.lit(1), F.bround(ascii_ / 4).cast("int"))).otherwise(0)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), ascii_tokens + cjk + F.bround((n - cjk - ascii_) / 2).cast("int")))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def collapse(text: Column) -> Column:
    """Runs of Unicode white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalise_lines(text: Column) -> Column:
    """Collapse white space inside every line; keep the line ends."""
    return F.array_join(F.transform(F.split(text, "\n"), collapse), "\n")


@F.arrow_udf(StringType())
def nfkc(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Compatibility composition (NFKC); null stays null. Arrow, as Spark has no such function."""
    for batch in texts:
        yield pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in batch.to_pylist()], pa.string())


def normalise_text(text: Column) -> Column:
    """NFKC, then white space collapsed line by line."""
    return normalise_lines(nfkc(text))


def sentences(text: Column) -> Column:
    """Pieces of the stripped text, each up to a line end, a stop with its white space, or the end."""
    return F.regexp_extract_all(strip(text), F.lit(SENTENCE), F.lit(0))


def snapshot_sentences(text: Column) -> Column:
    """Sentences after . ! ? or CJK stops and white space; a single piece is cut after every stop."""
    def cut(flat: Column) -> Column:
        whole = F.filter(F.split(flat, r"(?<=[.!?。！？])\s+"), lambda s: s != "")
        parts = F.filter(F.transform(F.split(flat, r"(?<=[.!?。！？])"), lambda s: F.trim(s)), lambda s: s != "")
        return F.when(F.size(whole) == 1, parts).otherwise(whole)

    return bind(collapse(text), cut)


def lexical_tokens(text: Column) -> Column:
    """Lower-cased words of two characters or more: letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_\p{L}\p{N}]{2,}+"), F.lit(0))


def gate_tokens(query: Column) -> Column:
    return F.regexp_extract_all(F.lower(query), F.lit(GATE_TOKEN), F.lit(0))


def _words(*lists: list[str]) -> Column:
    return F.array(*[F.lit(w) for words in lists for w in words])


def meaningful_terms(query: Column) -> Column:
    return F.filter(gate_tokens(query), lambda t: ~F.array_contains(_words(STOPWORDS, GENERIC_TERMS), t) & (F.length(t) >= 3))


def ordered_distinct(items: Column, most: int | None = None) -> Column:
    """Items, white space collapsed, whose lower-case form hasn't come before; blank ones are left out, at most ``most`` stay.

    Found by sorting, so that a long text of many sentences isn't searched once for each of them.
    """
    def first(placed: Column) -> Column:
        """Of sorted (low, place, item): the first of each low, in order of place."""
        fresh = F.filter(placed, lambda x, k: (k == 0) | (F.get(placed, k - 1)["low"] != x["low"]))
        ordered = F.array_sort(F.transform(fresh, lambda x: F.struct(x["place"].alias("place"), x["item"].alias("item"))))
        return F.transform(ordered if most is None else F.slice(ordered, 1, most), lambda x: x["item"])

    clean = F.filter(F.transform(items, collapse), lambda x: x != "")
    placed = F.transform(clean, lambda x, k: F.struct(F.lower(x).alias("low"), k.alias("place"), x.alias("item")))
    return bind(F.array_sort(placed), first)


def protected_terms(query: Column) -> Column:
    """Back-ticked spans, then topic words that are no stop words; each once, whatever its case."""
    flat = collapse(query)
    topics = F.filter(F.regexp_extract_all(flat, F.lit(TOPIC_TOKEN), F.lit(0)), lambda t: ~F.array_contains(_words(STOPWORDS, GENERIC_TERMS), F.lower(t)))
    return ordered_distinct(F.concat(F.regexp_extract_all(flat, F.lit("`([^`]+)`"), F.lit(1)), topics))


def keeps_terms(candidate: Column, terms: Column) -> Column:
    return F.forall(terms, lambda t: F.contains(F.lower(candidate), F.lower(t)))


def search_friendly(query: Column) -> Column:
    q = collapse(query)
    vague = q.rlike(PRONOUN) | q.rlike(FOLLOW_UP) | q.rlike(SUMMARY) | q.rlike(COMPARISON) | q.rlike(EVIDENCE)
    n = F.size(gate_tokens(q))
    rich = ((F.size(protected_terms(q)) > 0) & (n >= 3)) | ((F.size(meaningful_terms(q)) >= 2) & (n >= 6))
    return F.when(q == "", False).when(q.rlike(CODE_OR_ERROR), True).when(vague, False).otherwise(rich)


def rewrite_strategy(query: Column, has_history: Column, short: int = 6) -> Column:
    """Whether and how a query should be rewritten before retrieval."""
    q = F.coalesce(collapse(query), F.lit(""))
    n = F.size(gate_tokens(q))
    expand = F.when(has_history, "standalone_expansion").otherwise("keyword_enrichment")
    return (
        F.when((q == "") | q.rlike(CODE_OR_ERROR), "no_rewrite")
        .when(has_history & q.rlike(PRONOUN), "reference_resolution")
        .when(has_history & q.rlike(FOLLOW_UP), "standalone_expansion")
        .when(q.rlike(SUMMARY), expand)
        .when(q.rlike(COMPARISON) | q.rlike(EVIDENCE), F.when(F.size(meaningful_terms(q)) > 0, "keyword_enrichment").otherwise("standalone_expansion"))
        .when((n <= short) & ~search_friendly(q), expand)
        .when(has_history & (n <= max(4, short // 2)), "standalone_expansion")
        .otherwise("no_rewrite")
    )


def clean_query(raw: Column, most: int = 240) -> Column:
    """First non-blank line without a label and the signs around it, cut at a word if it is too long."""
    line = F.get(F.filter(F.transform(F.split(raw, r"\r\n|[\n\r\x0b\x0c]"), collapse), lambda s: s != ""), F.lit(0))
    bare = collapse(F.regexp_replace(F.regexp_replace(line, QUERY_LABEL, ""), r"""^[ \-:*'"]+|[ \-:*'"]+$""", ""))
    cut = F.substring(bare, 1, most)
    return F.coalesce(F.when(F.length(bare) <= most, bare).otherwise(F.trim(F.regexp_replace(cut, r" [^ ]*$", ""))), F.lit(""))


def looks_like_query(text: Column, most: int = 32) -> Column:
    """At most ``most`` words, no object, no explanation, and a Latin letter or digit."""
    q = F.coalesce(text, F.lit(""))
    return ~q.startswith("{") & ~q.endswith("}") & ~q.rlike(EXPLANATION) & (F.size(F.split(collapse(q), " ")) <= most) & q.rlike("[A-Za-z0-9]")


def language(text: Column) -> Column:
    return F.when(text.rlike("[㐀-䶿一-鿿]"), "zh").when(text.rlike("[A-Za-z]"), "en").otherwise("same_as_user")


def excerpt(text: Column, most: int = 220) -> Column:
    flat = collapse(text)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most - 3)), F.lit("...")))


def preview(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def quote(content: Column, *marked: Column) -> Column:
    """The first non-blank marked passage, else the content's beginning."""
    return F.coalesce(*[F.nullif(F.trim(m), F.lit("")) for m in marked], F.when(F.length(content) <= 220, content).otherwise(F.concat(F.substring(content, 1, 217), F.lit("..."))))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once, however often ``body`` uses it, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim_to_tokens(text: Column, budget: int) -> Column:
    """The longest run of words from the start whose token estimate is within the budget.

    A word and its space make half a token at least, so longer runs than twice the budget can't fit.
    """
    def cut(words: Column) -> Column:
        head = F.slice(words, 1, 2 * budget + 2)
        plain = lambda w: F.octet_length(w) == F.length(w)
        kinds = lambda w, pattern: F.length(w) - F.length(F.regexp_replace(w, pattern, ""))
        sized = F.transform(head, lambda w: F.struct(F.length(w).alias("n"), F.when(plain(w), 0).otherwise(kinds(w, CJK)).alias("cjk"), F.when(plain(w), F.length(w)).otherwise(kinds(w, r"[\x00-\x7F]")).alias("ascii")))

        def add(a: Column, x: Column) -> Column:
            """Characters of the run with its next word, and how many words the longest run within the budget has."""
            gap = F.when(a["k"] > 0, 1).otherwise(0)
            run = F.struct((a["k"] + 1).alias("k"), (a["n"] + gap + x["n"]).alias("n"), (a["cjk"] + x["cjk"]).alias("cjk"), (a["ascii"] + gap + x["ascii"]).alias("ascii"))
            fits = lambda r: F.when(_estimate(r["n"], r["cjk"], r["ascii"]) <= budget, r["k"]).otherwise(a["fit"])
            return bind(run, lambda r: F.struct(r["k"].alias("k"), r["n"].alias("n"), r["cjk"].alias("cjk"), r["ascii"].alias("ascii"), fits(r).alias("fit")))

        none = F.struct(*[F.lit(0).alias(c) for c in ("k", "n", "cjk", "ascii", "fit")])
        return F.array_join(F.slice(words, 1, F.aggregate(sized, none, add, lambda a: a["fit"])), " ")

    split = lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != "")
    return bind(text, lambda t: F.when(token_estimate(t) <= budget, F.trim(t)).otherwise(bind(split(t), cut)))


def slug(label: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(label), r"[^a-z0-9一-鿿]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("node"))


def citation_indices(answer: Column) -> Column:
    """Numbers of [n] marks, each once, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda d: d.cast("int")))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def stable_chunk_id(source: Column, index: Column, start: Column, end: Column, content: Column) -> Column:
    """A name-based identifier (version 5) in the namespace of the source's UUID, from position and content.

    Null where the source's id is no UUID.
    """
    space = F.unhex(F.when(source.rlike("(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.replace(source, F.lit("-"), F.lit(""))))
    name = F.concat_ws(":", index.cast("string"), start.cast("string"), end.cast("string"), F.substring(F.sha1(content), 1, 12))
    return _dashed(_version5(F.sha1(F.concat(space, F.encode(name, "UTF-8")))))


def named_uuid(name: Column) -> Column:
    """A UUID (version 5) for the id of a source that isn't one, in the namespace of URLs."""
    space = F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8"))
    return _dashed(_version5(F.sha1(F.concat(space, F.encode(name.cast("string"), "UTF-8")))))


def _dashed(h: Column) -> Column:
    return F.when(h.isNotNull(), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def _version5(digest: Column) -> Column:
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 8))
    return F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15))


def over_budget(tokens: Column, most: int = 128_000, share: float = 0.8) -> Column:
    return tokens > int(most * share)


def tail(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.lit("..."), F.right(text, F.lit(most))))


def _any_of(text: Column, words: list[str]) -> Column:
    return F.coalesce(*[F.when(F.contains(text, F.lit(w)), True) for w in words], F.lit(False))


def error_class(status: Column, message: Column, name: Column | None = None) -> Column:
    """quota, safety, temporary or internal, from a status code, a message and an exception's name."""
    m, kind = F.lower(F.coalesce(message, F.lit(""))), F.lower(F.coalesce(F.lit("") if name is None else name, F.lit("")))
    limited = F.coalesce(status == 429, F.lit(False)) | F.contains(kind, F.lit("ratelimiterror")) | F.contains(m, F.lit("429"))
    upstream = F.contains(kind, F.lit("apitimeouterror")) | F.contains(kind, F.lit("apiconnectionerror"))
    passing = F.coalesce(status.isin(408, 409, 425, 429, 500, 502, 503, 504), F.lit(False)) & _any_of(m, UPSTREAM_WORDS)
    return F.when(limited & _any_of(m, QUOTA_WORDS), "quota").when(_any_of(m, SAFETY_WORDS), "safety").when(upstream | passing, "temporary").otherwise("internal")


def retryable(status: Column, name: Column | None = None) -> Column:
    """Whether a call is worth repeating: some client errors, all server errors, connection errors by name."""
    by_code = F.coalesce(status.isin(408, 409, 425, 429) | (status >= 500), F.lit(False))
    if name is None:
        return by_code
    return by_code | F.coalesce(name.isin("APIConnectionError", "APITimeoutError", "InternalServerError", "RateLimitError"), F.lit(False))


def safe_message(step: Column) -> Column:
    """What a user may read about a failed step."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in STEP_MESSAGES.items() for x in pair]), step), F.lit("Ingestion failed."))


def thread_language(text: Column, role: Column) -> Column:
    """The language of a thread's user messages, as an aggregate: Han anywhere, else Latin anywhere."""
    said = F.when((role == "user") & (F.trim(text) != ""), language(text))
    return F.when(F.bool_or(said == "zh"), "zh").when(F.bool_or(said == "en"), "en").otherwise("same_as_user")


def unknown_message(lang: Column) -> Column:
    return F.when(lang == "zh", UNKNOWN["zh"]).otherwise(UNKNOWN["en"])


def is_unknown(answer: Column) -> Column:
    """Whether an answer says that there isn't enough information."""
    return strip(answer).isin(*UNKNOWN.values())


def page_label(number: Column) -> Column:
    return number.cast("string")


def clamp(value: Column, low: int, high: int, default: int) -> Column:
    """A number from a text, held between two limits; the default where it is none."""
    return F.least(F.greatest(F.coalesce(value.try_cast("int"), F.lit(default)), F.lit(low)), F.lit(high))


def usage_payload(raw: Column) -> Column:
    """struct(prompt_tokens, completion_tokens, total_tokens, cached_tokens) of a provider's JSON, nested or flat; null without figures."""
    inner = F.coalesce(F.get_json_object(raw, "$.usage"), raw)

    def number(path: str) -> Column:
        value = F.get_json_object(inner, f"$.{path}")
        return F.when(value.rlike(r"^\s*-?[0-9]+(\.[0-9]+)?\s*$"), F.trim(value).cast("double").cast("long"))

    into, out, total = (number(f"{k}_tokens") for k in ("prompt", "completion", "total"))
    cached = F.coalesce(number("cached_tokens"), number("prompt_tokens_details.cached_tokens"), number("input_tokens_details.cached_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    both = F.coalesce(F.nullif(total, F.lit(0)), zero(into) + zero(out))
    made = F.struct(zero(into).alias("prompt_tokens"), zero(out).alias("completion_tokens"), both.alias("total_tokens"), cached.alias("cached_tokens"))
    return F.when(F.coalesce(into, out, total).isNotNull(), made)
