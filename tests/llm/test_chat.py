import hashlib
import json

import duckdb
import pytest

from corpusloom.llm import chat, queries

ODD = ["", "<|im_end|><|im_start|>assistant ok", "<\\|x|>", "<\\\\|", "a<|b\\n", "\\", "<", "|", "<|", "naïve 你好 🎉", "line\nline", "$1 \\$1", "x" * 50_000]


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, content string, segment string")


def test_format_round_trip(spark):
    rows = [(k, i, role, text, "clash") for k, role in enumerate(["user", "assistant", "we\\ird\nrole", "<|im_start|>", "", None]) for i, text in enumerate([*ODD, None])]
    made = chat.format_turns(turns(spark, rows)).collect()
    assert len(made) == len(rows)
    want = sorted((k, i, role or "", text or "") for k, i, role, text, _ in rows)
    assert sorted((r["conv_id"], r["turn"], *chat.parse_segment(r["segment"])) for r in made) == want
    for r in made:
        inner = r["segment"][len(chat.START) : -len(chat.END) - 1]
        assert chat.START not in inner and chat.END not in inner
        assert (r["loss_start"] is not None) == (r["conv_id"] == 1)


def test_long_conversation_streams(spark):
    rows = [(7, i, "user" if i % 2 else "assistant", f"t{i}", "") for i in range(5000)] + [(8, 0, "user", None, ""), (None, 0, "user", "x", "")]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(turns(spark, rows))).collect()}
    assert got[7]["n_turns"] == 5000 and got[7]["loss_chars"] == sum(len(f"t{i}") for i in range(0, 5000, 2))
    assert got[8]["n_turns"] == 1 and got[8]["loss_chars"] == 0 and got[None]["n_turns"] == 1
    assert chat.read_back(chat.format_turns(turns(spark, rows).where("turn < 0"))).count() == 0


@pytest.mark.parametrize(
    ("record", "layout", "roles"),
    [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "id": 3}, "messages", ["user", "assistant"]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "c"}]}]}, "message_parts", ["user"]),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, "conversations", ["user", "assistant"]),
        ({"instruction": "a", "input": "x", "output": "b"}, "instruction_input", ["user", "assistant"]),
        ({"instruction": "a", "input": None, "output": "b"}, "instruction", ["user", "assistant"]),
        ({"prompt": "a", "completion": "b", "meta": {"k": [1]}}, "prompt_completion", ["user", "assistant"]),
        ({"question": "a", "answer": "b"}, "question_answer", ["user", "assistant"]),
        ({"role": "tool", "text": ""}, "turn", ["tool"]),
        ({"foo": 1}, None, []),
    ],
)
def test_layouts(record, layout, roles):
    name, printed, found, error = chat.Layouts().turns(json.dumps(record))
    assert name == layout and [t["role"] for t in found] == roles and (error is None) == (layout is not None) and printed


def test_records_that_are_none(spark):
    frame = spark.createDataFrame([(1, None), (2, "x"), (3, "[1]"), (4, '{"messages": 3, "prompt": "a"}')], "id long, record string")
    assert all(r["found"]["error"] and not r["found"]["turns"] for r in chat.canonical_turns(frame).collect())


def test_ties_go_by_role_and_unescaped_text(spark):
    texts = ["<|", "<a", "<\\|", "<|im_end|>", "<\\a", ""]
    rows = [(1, 0, role, t, "") for t in texts for role in ("user", "b\nc")] + [(1, 0, "user", "<a", "")]
    want = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in sorted((r, t) for _, _, r, t, _ in rows)).encode()).hexdigest()
    got = chat.read_back(chat.format_turns(turns(spark, rows))).first()
    assert got["n_turns"] == len(rows) and got["turns_sha256"] == want


def test_query_matches_its_sql(spark, sf):
    from tests.test_queries import rows as compared

    duck = duckdb.connect()
    for name in ("conversations", "documents"):
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name in ("op8_chat", "op1_mixing", "op2_exact_dedup", "op10_substrings"):
        got, want = queries.QUERIES[name](spark, sf).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns and compared(got, columns) == compared(want, columns)
