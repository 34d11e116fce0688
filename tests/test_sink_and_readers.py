"""The chunk table in files, and sources of every type."""

import os

from corpusloom.operators import sink
from corpusloom.sources import readers

CHUNK = "source_id string, chunk_index int, content string, embedding array<double>"


def stored(spark, path):
    return sorted((r["source_id"], r["chunk_index"], r["content"], r["embedding"]) for r in spark.read.parquet(path).drop("bucket").collect())


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_chunks_are_replaced_source_by_source(spark, tmp_path):
    path = str(tmp_path / "chunks")
    made = lambda rows: spark.createDataFrame(rows, CHUNK)
    first = [(f"s{k}", i, f"text {k} {i}", [3.0, 4.0]) for k in range(40) for i in range(3)] + [("zero", 0, "z", [0.0, 0.0]), ("none", 0, "n", None), ("empty", 0, "e", [])]
    assert sink.read_chunks(spark, path) is None
    assert sink.save_chunks(made(first), path) > 20
    unit = lambda rows: sorted((s, i, t, [0.6, 0.8] if v == [3.0, 4.0] else v) for s, i, t, v in rows)
    assert stored(spark, path) == unit(first)
    before = files(path)
    assert sink.save_chunks(made(first), path) == 0 and files(path) == before  # the same again changes nothing
    one = [("s7", 0, "new text", [3.0, 4.0])]
    assert sink.save_chunks(made(one), path) == 1
    now = unit([r for r in first if r[0] != "s7"] + one)
    assert stored(spark, path) == now
    changed = {f for f in files(path) if f not in before}
    assert len({os.path.dirname(f) for f in changed}) == 1 and all(files(path)[f] == before[f] for f in files(path) if f in before)
    gone = spark.createDataFrame([("s7",), ("zero",), ("unknown",)], "source_id string")
    assert sink.save_chunks(made([]), path, gone) >= 1 and stored(spark, path) == [r for r in now if r[0] not in ("s7", "zero")]
    assert sink.save_chunks(made([]), path, gone) == 0
    assert sink.save_chunks(made(first), path) > 0 and stored(spark, path) == unit(first)


def test_sources_of_every_type(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "my_first-note.txt").write_bytes("Café au lait.\r\nMore.".encode())
    (tmp_path / "in" / "sub" / "latin.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "in" / "blank.txt").write_bytes(b" \n\t")
    here, url, doc, video = str(tmp_path / "in"), "https://a.example/x", "https://docs.google.com/document/d/AbC_123/edit", "https://youtu.be/abcdefghijk"
    rows = [
        (1, "text", f"{here}/my_first-note.txt", None), (2, "text", f"file:{here}/sub/latin.txt", None), (3, "text", f"{here}/blank.txt", None), (4, "text", f"{here}/absent.txt", None), (5, "text", None, None),
        (6, "url", None, url), (7, "url", None, "https://a.example/none"), (8, "url", None, None), (9, "document", None, doc), (10, "video", None, video), (11, "video", None, "https://youtu.be/zzzzzzzzzzz"),
        (12, "pdf", f"{here}/a.pdf", None), (13, "mail", None, "x"), (14, None, None, None), (15, "url", None, url), (16, "document", None, "https://b.example"),
    ]
    sources = spark.createDataFrame(rows, "source_id int, source_type string, file_path string, original_url string")
    table = lambda key, rows: spark.createDataFrame(rows, f"{key} string, {'html' if key == 'url' else 'text'} string")
    read = readers.read_sources(
        sources, readers.file_contents(spark, here), table("url", [(url, "<title> T </title><p>Page &amp; text</p>"), (url, "<p>zz</p>"), ("https://other", "x")]),
        table("document_id", [("AbC_123", "Shared text")]), table("video_id", [("abcdefghijk", "Said\nmore"), ("unasked", "x")]),
    )
    good, bad = readers.readable(read)
    assert {r["source_id"]: (r["title"], r["text"]) for r in good.collect()} == {
        1: ("my first note", "Café au lait.\nMore."), 2: ("latin", "café"), 6: ("T", "T Page & text"), 9: ("Shared text", "Shared text"), 10: ("Said", "Said\nmore"), 15: ("T", "T Page & text"),
    }
    assert {r["source_id"]: (r["step"], r["message"]) for r in bad.collect()} == {
        3: ("parse", "no text content"), 4: ("fetch", "file not found"), 5: ("fetch", "missing file path"), 7: ("fetch", "page not fetched"), 8: ("fetch", "missing URL"), 11: ("fetch", "transcript not fetched"),
        12: ("parse", "no reader for PDF layout"), 13: ("fetch", "unsupported type"), 14: ("fetch", "unsupported type"), 16: ("fetch", "document not fetched"),
    }
    assert read.count() == len(rows) and readers.read_sources(sources.limit(0)).collect() == []
    assert {r["message"] for r in readers.readable(readers.read_sources(sources))[1].where("source_type = 'text'").collect()} == {"file not found", "missing file path"}
