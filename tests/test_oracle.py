from pathlib import Path

import pytest

from stridewell import catalogue

from .oracle import FOLDER, compare, connect

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_sql_agrees(spark, con, name):
    compare(spark, con, catalogue.queries()[name], catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_others_run(spark, name):
    catalogue.queries()[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
