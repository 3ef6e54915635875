"""Every registered query against its DuckDB oracle on the smallest tables,
and the driver's entry smoke check."""

import pytest

import __spark_entry__ as entry_mod
from docforge import queries
from scripts.check_oracles import duck, rows_of
from tests.conftest import SF_SMALL

# the queries of docforge.llm have their own tests
QUERIES = {k: v for k, v in entry_mod.queries().items() if k in queries.QUERIES}
ORACLES = {k: v for k, v in entry_mod.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) == set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLES[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows and rows_of(df.columns, rows) == rows_of(dcols, res.fetchall())


def test_entry(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["doc_id", "chunk_no", "instruction", "input", "output"]
    assert df.count() == QUERIES["harvest_documents"](spark, SF_SMALL).count() > 0


def test_parameters_bite(spark, con):
    """The rows of these queries differ from what they would be without the filter."""
    links = con.execute("SELECT count(*) FROM (" + ORACLES["link_discovery"] + ")").fetchone()[0]
    everything = spark.read.parquet(f"{SF_SMALL}/pages.parquet").selectExpr(
        "size(regexp_extract_all(html, 'href=', 0)) AS n").agg({"n": "sum"}).first()[0]
    assert 0 < links < everything
    rules = [r[0] for r in con.execute("SELECT DISTINCT rule FROM (" + ORACLES["contract_violations"] + ")").fetchall()]
    assert sorted(rules) == ["input_ok", "instruction_ok", "keys_ok", "round_trip_ok", "types_ok"]
