import pytest

from keyloom.plans import behaviour, catalog, runtime  # noqa: F401

from .oracle import duck, spark_rows


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    got = spark_rows(catalog.QUERIES[name](spark, sf_dir))
    if name in catalog.ORACLES:
        assert got == duck(sf_dir, catalog.ORACLES[name])
    else:
        assert got[1]


def test_every_query_has_a_check():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
