"""Every registered query against its SQL; those without SQL give rows of a stable shape."""

import pytest

from chronodiff.plans import all as _all  # noqa: F401
from chronodiff.plans import registry
from tests.oracle import same, views


@pytest.fixture(scope="module")
def con(sf_dir):
    return views(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, sf_dir, con, name):
    same(registry.QUERIES[name](spark, sf_dir), registry.ORACLES[name], con)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_gives_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_stream_gate_is_the_batch_gate(spark, sf_dir):
    key = lambda r: tuple(r)[0:2]
    batch = sorted((tuple(r) for r in registry.QUERIES["d6_cumulative_gate"](spark, sf_dir).collect()), key=key)
    stream = sorted((tuple(r) for r in registry.QUERIES["g1_stream_gate"](spark, sf_dir).collect()), key=key)
    assert stream == batch and batch
