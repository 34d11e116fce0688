"""Chat formatting by schema fingerprints.

A record's fingerprint is a hash of its sorted nested field paths (``messages[].role``), restricted to paths
that some mapping knows, so that extra fields don't matter. It selects a declarative :class:`Mapping` that
turns prompt, instruction or message layouts into canonical turns. Turns are then written with a template
that marks them and escapes control strings inside texts reversibly, with a loss mask over what the
assistant says.

A formatted conversation is a run of segments, one a turn, in order; segments are what is stored, so that a
conversation with very many turns is never one row. :func:`read_back` streams them in order.

A null text is an empty text, a null role an empty role. A field that is null counts as absent. Records that
are no JSON object, or whose layout no mapping knows, give no turns and say so in ``error``. Turns that tie
in their order are put in order of role and text; repeated rows are repeated turns; null orders come first.
Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, LOSS_ROLE = "<|im_start|>", "<|im_end|>", "assistant"


@dataclass(frozen=True)
class Fixed:
    """One turn of a given role; its text joins the fields by a blank line."""

    role: str
    fields: tuple[str, ...]

    def paths(self) -> set[str]:
        return set(self.fields)

    def turns(self, record: dict) -> Iterator[tuple[str, str]]:
        yield self.role, "\n\n".join(_text(record.get(f)) for f in self.fields)


@dataclass(frozen=True)
class Each:
    """A turn for each item of a list; ``items`` empty: the record itself is the turn."""

    items: str
    role: str
    content: str
    roles: dict[str, str] = field(default_factory=dict, hash=False)
    part: str = ""

    def paths(self) -> set[str]:
        at = f"{self.items}[]." if self.items else ""
        return {at + self.role, at + self.content + (f"[].{self.part}" if self.part else "")}

    def turns(self, record: dict) -> Iterator[tuple[str, str]]:
        for item in record[self.items] if self.items else [record]:
            content = item.get(self.content)
            if self.part:
                content = "".join(_text(p.get(self.part)) for p in content or [])
            role = _text(item.get(self.role))
            yield self.roles.get(role, role), _text(content)


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


@dataclass(frozen=True)
class Mapping:
    name: str
    steps: tuple[Fixed | Each, ...]

    def paths(self) -> frozenset[str]:
        return frozenset().union(*(s.paths() for s in self.steps))


_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS = (
    Mapping("turn", (Each("", "role", "text"),)),
    Mapping("turn_content", (Each("", "role", "content"),)),
    Mapping("messages", (Each("messages", "role", "content"),)),
    Mapping("messages_text", (Each("messages", "role", "text"),)),
    Mapping("message_parts", (Each("messages", "role", "content", part="text"),)),
    Mapping("conversations", (Each("conversations", "from", "value", _NAMES),)),
    Mapping("system_conversations", (Fixed("system", ("system",)), Each("conversations", "from", "value", _NAMES))),
    Mapping("instruction", (Fixed("user", ("instruction",)), Fixed("assistant", ("output",)))),
    Mapping("instruction_input", (Fixed("user", ("instruction", "input")), Fixed("assistant", ("output",)))),
    Mapping("system_instruction_input", (Fixed("system", ("system",)), Fixed("user", ("instruction", "input")), Fixed("assistant", ("output",)))),
    Mapping("instruction_context", (Fixed("user", ("instruction", "context")), Fixed("assistant", ("response",)))),
    Mapping("instruction_response", (Fixed("user", ("instruction",)), Fixed("assistant", ("response",)))),
    Mapping("prompt_completion", (Fixed("user", ("prompt",)), Fixed("assistant", ("completion",)))),
    Mapping("prompt_response", (Fixed("user", ("prompt",)), Fixed("assistant", ("response",)))),
    Mapping("question_answer", (Fixed("user", ("question",)), Fixed("assistant", ("answer",)))),
    Mapping("system_question_response", (Fixed("system", ("system_prompt",)), Fixed("user", ("question",)), Fixed("assistant", ("response",)))),
)


def field_paths(value: object, at: str = "") -> set[str]:
    """Nested paths of a record's fields that hold a value."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if any(isinstance(v, dict) for v in value) else {f"{at}[]"}
    return set() if value is None else {at}


def fingerprint(paths: set[str] | frozenset[str]) -> str:
    return xxhash.xxh64_hexdigest("\n".join(sorted(paths)))


class Layouts:
    """Mappings by the fingerprint of their paths."""

    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS):
        self.known = frozenset().union(*(m.paths() for m in mappings))
        self.by_print = {fingerprint(m.paths()): m for m in mappings}

    def turns(self, record: str | None) -> tuple[str | None, str, list[dict], str | None]:
        """(layout, fingerprint, turns, error) of a JSON record."""
        try:
            value = json.loads(record or "")
        except ValueError:
            return None, "", [], "no JSON"
        if not isinstance(value, dict):
            return None, "", [], "no JSON object"
        printed = fingerprint(field_paths(value) & self.known)
        mapping = self.by_print.get(printed)
        if mapping is None:
            return None, printed, [], "unknown layout"
        try:
            return mapping.name, printed, [{"role": r, "content": c} for s in mapping.steps for r, c in s.turns(value)], None
        except (AttributeError, TypeError, KeyError):
            return None, printed, [], "malformed record"


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("content", pa.string())]))
_FOUND = pa.struct([("layout", pa.string()), ("fingerprint", pa.string()), ("turns", _TURNS), ("error", pa.string())])


def canonical_turns(records: DataFrame, record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``records`` with a column ``found``: layout, fingerprint, turns (role, content) and error of each JSON record."""

    @F.arrow_udf("layout string, fingerprint string, turns array<struct<role: string, content: string>>, error string")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        layouts = Layouts(mappings)
        for batch in batches:
            yield pa.array([dict(zip(("layout", "fingerprint", "turns", "error"), layouts.turns(r), strict=True)) for r in batch.to_pylist()], _FOUND)

    return records.withColumn("found", find(F.col(record_col)))


def escape(text: Column) -> Column:
    """One more backslash between ``<`` and ``|``: no control string is left, and each can be brought back."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


_UNESCAPE = re.compile(r"<\\(\\*)\|")
_ROLE = re.compile(r"\\(.)", re.S)
_SEGMENT = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(END) + r"\n", re.S)


def parse_segment(segment: str) -> tuple[str, str]:
    """(role, text) of a formatted turn, as they were before."""
    role, text = _SEGMENT.fullmatch(segment).groups()
    undo = lambda s: _UNESCAPE.sub(r"<\1|", s)
    return _ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], undo(role)), undo(text)


def format_turns(turns: DataFrame, conv_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "content") -> DataFrame:
    """(conv_id, turn, role, segment, loss_start, loss_end): offsets in code points of the segment, null outside the loss."""
    role, text = F.coalesce(turns[role_col], F.lit("")), F.coalesce(turns[text_col], F.lit(""))
    head = F.concat(F.lit(START), _escape_role(role), F.lit("\n"))
    body = escape(text)
    lossy = role == LOSS_ROLE
    return turns.select(
        turns[conv_col].alias("conv_id"), turns[order_col].alias("turn"), role.alias("role"), F.concat(head, body, F.lit(END + "\n")).alias("segment"),
        F.when(lossy, F.length(head)).alias("loss_start"), F.when(lossy, F.length(head) + F.length(body)).alias("loss_end"),
    )


def in_order(segments: DataFrame) -> DataFrame:
    """Segments with each conversation in one partition and in order: concatenated, they are its text.

    Ties of a turn go by role and unescaped text, which is read from the segment behind the exchange.
    """
    inner = F.regexp_extract("segment", r"(?s)^[^\n]*\n(.*)<\|im_end\|>\n\z", 1)
    said = F.regexp_replace(inner, r"<\\(\\*)\|", "<$1|")
    return segments.repartition("conv_id").withColumn("_said", said).sortWithinPartitions("conv_id", "turn", "role", "_said").drop("_said")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, now = [], None

    def end() -> None:
        if now is not None:
            rows.append((now["conv"], now["turns"], now["all"].hexdigest(), now["loss"], now["said"].hexdigest(), now["chars"]))

    def out(schema: pa.Schema) -> pa.RecordBatch:
        kinds = [schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        rows.clear()
        return made

    schema = None
    for batch in batches:
        schema = batch.schema
        for conv, _, segment, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv != now["conv"]:
                end()
                now = {"conv": conv, "turns": 0, "all": hashlib.sha256(), "loss": 0, "said": hashlib.sha256(), "chars": 0}
            role, text = parse_segment(segment)
            now["turns"] += 1
            now["chars"] += len(segment)
            now["all"].update(f"{role}\n{text}\n".encode())
            if a is not None:
                said = _UNESCAPE.sub(r"<\1|", segment[a:b])
                now["loss"] += len(said)
                now["said"].update(said.encode())
        if len(rows) > 5000:
            yield out(schema)
    end()
    if rows:
        yield out(schema)


def read_back(segments: DataFrame) -> DataFrame:
    """Counts and digests of every conversation, read back from its formatted segments as a stream."""
    kind = dict(segments.dtypes)["conv_id"]
    columns = segments.select("conv_id", "turn", "segment", "loss_start", "loss_end")
    return in_order(columns).mapInArrow(_digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
