import os

import pytest
from compare import connect, difference

from scorewright.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    assert difference(spark, connect(FOLDER), QUERIES[name], ORACLE_SQL[name], FOLDER) == ""
