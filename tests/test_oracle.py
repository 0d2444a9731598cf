"""Every registered query with an oracle equals DuckDB at sf0.01; the rest run."""

import pytest

from conftest import SF01
from oracle import compare, duck
from passkit.plans.registry import ORACLE, QUERIES, load_all

load_all()


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF01).toPandas()
    want = con.execute(ORACLE[name]).df()
    diff = compare(got, want)
    assert diff is None, f"{name}: {diff}"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only(spark, name):
    df = QUERIES[name](spark, SF01)
    assert df.count() >= 0


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
                 "array<string>": "VARCHAR[]", "array<float>": "FLOAT[]", "array<int>": "INTEGER[]"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle_types_match(spark, con, name):
    """Same column names and the same types in both engines (no HUGEINT/DECIMAL/JSON drift)."""
    got = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
           for f in QUERIES[name](spark, SF01).schema.fields}
    want = {r[0]: r[1] for r in con.execute(f"DESCRIBE ({ORACLE[name]})").fetchall()}
    assert got == want
