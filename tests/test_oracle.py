"""Every query with SQL against that SQL on the smallest tables; the others must run."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def _plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    cell = lambda v: f"{v + 0.0:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _plain(got) == _plain(want)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", ["strength_scores", "pattern_stats", "evaluation_reports", "utf8_decode"])
def test_queries_without_sql_give_rows(spark, name):
    assert QUERIES[name](spark, SF).limit(5).count() > 0


def test_pieces_of_pages_decode_as_python_does(spark):
    import re

    from credlens.queries import PIECE

    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["utf8_decode"](spark, SF).collect()
    assert len(rows) == sum(max(1, -(-len(p) // PIECE)) for p in pages.values())
    for r in rows:
        raw = pages[r.page_id][r.piece * PIECE : (r.piece + 1) * PIECE].decode("utf-8", "replace")
        assert r.value == re.sub(r"(?:\r\n|\n|\r)\Z", "", raw) and r.had_invalid == ("�" in raw)
