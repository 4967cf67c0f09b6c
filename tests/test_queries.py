"""A choice of registered queries against their SQL; `python tests/compare.py <folder>` runs all of them."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import compare  # noqa: E402

SF = "/root/testdata/sf0.001"
CHOSEN = [
    "cross_coverage", "region_ranking", "audit_counts", "digest_input", "resolve_citations", "strip_unknown_links", "evidence_bundle",
    "fidelity_counts", "feed_parse", "provider_cascade", "gazetteer_join", "same_event_groups", "optin_lifecycle", "token_bucket", "budget_gate",
    "gazetteer_join_large", "gazetteer_yaml", "outlet_yaml", "optin_busy", "score_cascade", "version_intervals", "edition_as_of", "bucket_refills",
    "bucket_sweep_stream", "feed_landing", "edition_window", "signup_cap",
]


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(spark, con, name):
    import __spark_entry__ as entry

    assert name in entry.queries()
    ok, note = compare.compare(spark, con, name, SF)
    assert ok, note


def test_sql_belongs_to_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
