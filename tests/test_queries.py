"""Every registered query against its SQL; queries without SQL must give rows."""

import pytest

from tests.oracle import compare, connect
from tidemark.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES, key=lambda n: (n not in ORACLES, n)))
def test_query(spark, con, sf_dir, name):
    problem, _ = compare(spark, con, sf_dir, name)
    assert problem is None, f"{name}: {problem}"


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
