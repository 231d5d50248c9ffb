"""Every registered query against its SQL twin at the smallest scale."""

import os

import pytest

from checks.compare import connect, differences
from checks.queries import REGISTERED
from checks.sql import ORACLE

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(ORACLE) == set(REGISTERED)


@pytest.mark.parametrize("name", sorted(REGISTERED))
def test_query_equals_sql(spark, connection, name):
    assert differences(spark, connection, FOLDER, name) == []
