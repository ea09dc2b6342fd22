import os

import pytest

import catalogue
import oracle

FOLDER = os.environ.get("CATALOGUE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    assert not [c for c in df.columns if c.startswith("_")]
    if name in catalogue.SQL:
        assert oracle.difference(df, con, catalogue.SQL[name]) is None
    else:
        assert df.count() > 0


def test_every_query_but_file_hashing_has_sql():
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == {"file_weights"}
