"""Every registered query beside its SQL on the smallest tables."""

import pytest

from tests.conftest import SMALL
from tests.oracle import compare
from tidemark.catalog import REGISTRY

# Further tables of the same verification and the same receipts are left to tests/oracle.py, which runs everything.
SLOW = {"verdict", "report_tables", "anchor_rollup", "anchor_candidates", "input_attestation", "stream_heads"}


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - SLOW))
def test_query(spark, name):
    # The smallest tables leave some results empty.
    assert compare(spark, SMALL, name, allow_empty=True) == []


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(REGISTRY) <= set(entry.queries())
