"""A query of each area beside its SQL on the small tables; ``compare.py`` runs them all."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import compare, connect  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

SAMPLE = (
    "detect_payment_cards detect_phones resolve_overlaps merge_touching_spans preview_rows build_vault_corpus restore_documents "
    "redact_paths scrub_telemetry apply_policy align_texts summarize_conversations list_page current_exchange_findings "
    "detect_long_secrets segment_nested_results pseudonymize_null_scope delete_interaction detect_languages search_texts list_page_by_language "
    "summarize_exchanges segment_requests parse_transcript_turns parse_rollout_turns import_counters flush_remainders stream_usage"
).split()


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf, name):
    diff, _ = compare(spark, connect(sf), sf, name, queries()[name], oracle_sql()[name])
    assert diff is None, diff


def test_entry(spark):
    assert entry(spark).columns == ["lang", "label", "spans", "distinct_values", "documents"]


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
