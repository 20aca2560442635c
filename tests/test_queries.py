"""Every registered query against its check SQL on the smallest tables."""

import os

import pytest
from compare import connect, difference

import __spark_entry__ as entry
from claimlens.plans.oracle import ORACLE_SQL
from claimlens.plans.queries import QUERIES

NAMES = list(QUERIES)

SF = os.environ.get("CLAIMLENS_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(entry.queries()) >= set(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    assert difference(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


def test_checks_are_not_vacuous(con):
    sql = entry.oracle_sql()
    outcomes = con.execute(
        f"SELECT count(DISTINCT (label, confidence)), min(confidence) FROM ({sql['verdict_rules']})"
    ).fetchall()[0]
    assert outcomes[0] >= 4
    labels = con.execute(f"SELECT DISTINCT label FROM ({sql['parse_output']})").fetchall()
    assert {r[0] for r in labels} >= {"True", "Fake", "Uncertain", None}
