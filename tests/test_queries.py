"""Every query with SQL against DuckDB on the smallest tables, and the rest against plain Python."""

import os
import re

import duckdb
import pytest

from corpusloom.plans import registry


def value(v):
    if v is None or str(v) in ("<NA>", "NaT", "nan"):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.shape == ():
        return float(f"{float(v):.7g}") + 0.0
    return str(v)


def rows(frame, columns):
    return sorted(repr([value(v) for v in r]) for r in frame[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for file in os.listdir(sf):
        connection.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf}/{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, sf, duck, name):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    assert rows(got, columns) == rows(want, columns)


WITHOUT_SQL = {
    "approximate_search": ["query_id", "id", "score", "rank"],
    "normalised_digests": ["id", "overview", "themes", "assertions", "passages", "gaps", "keywords"],
    "snapshot_summaries": ["id", "overview", "themes", "top_keywords"],
    "source_digests": ["id", "overview", "themes", "assertions", "passages", "gaps"],
    "source_outlines": ["id", "node", "depth", "label", "parent", "path", "chunks", "place"],
    "source_snapshots": ["id", "schema_version", "source_content_hash", "generation_method", "deterministic", "semantic"],
}


def test_every_other_query_has_sql():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == set(WITHOUT_SQL)


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_columns_and_keys(spark, sf, name):
    """Their operators have golden cases in test_operators."""
    found = registry.QUERIES[name](spark, sf)
    assert sorted(found.columns) == sorted(WITHOUT_SQL[name])
    rows = found.collect()
    keys = {"approximate_search": ("query_id", "id"), "source_outlines": ("id", "node")}.get(name, ("id",))
    assert rows and len({tuple(r[k] for k in keys) for r in rows}) == len(rows)


def test_digests_against_plain_python(spark, sf):
    """Overviews, assertions and gaps of every document, from a plain reading of the rules."""
    for r in registry.QUERIES["source_digests"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id AS id", "text"), "id").collect():
        flat = " ".join(r["text"].split())
        said = [s for s in re.split(r"(?<=[.!?。！？])\s+", flat) if s]
        if len(said) == 1:
            said = [s.strip() for s in re.split(r"(?<=[.!?。！？])", flat) if s.strip()]
        seen, kept = set(), []
        for s in said:
            if s.lower() not in seen:
                seen.add(s.lower())
                kept.append(s)
        assert r["assertions"] == kept[:5] and " ".join(said[:2]).startswith(r["overview"]) and r["overview"]
        assert len(r["themes"]) <= 8 and len(r["passages"]) <= 3 and len({t.lower() for t in r["themes"]}) == len(r["themes"])
