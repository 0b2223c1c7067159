"""Queries beside the checking engine at the smallest scale; the whole set runs with ``python -m checks.verify``."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.catalog import ORACLE, QUERIES
from checks.verify import compare, connect

NAMES = [
    "d11_span_match_hipaa2026_rules", "d13_required_context_credentials_rules", "l01_acknowledge", "l13_triage_candidates",
    "a01_group_findings", "a07_compliance_score", "w02_compare_with_previous", "d29_dependency_inventory", "d31_stack_detection",
    "f01_scrub", "f05_evidence", "a15_registry_counts",
]


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, sf, name):
    ok, rows, _, _, note = compare(spark, connect(sf), name, queries()[name], oracle_sql()[name], sf)
    assert ok and rows > 0, note


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and "score" in df.columns


def test_every_query_of_the_scan_has_sql():
    """Training-data queries come on top; SQL can't express most of them, so their tests hold them against brute force."""
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())
