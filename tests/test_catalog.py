"""Registered queries against their SQL at the smallest scale (a part of them, to stay quick;
`python tests/oracle_check.py 0.01` runs all)."""
import os

import pytest

from loomtrace import catalog

ROOT = "/root/testdata/sf0.001"
QUICK = ["event_window", "tool_entropy", "active_time_union", "capped_gap_durations", "longest_burst", "error_recovery", "grounded_writes", "strict_recovery_classes", "edit_run_depth",
         "carry_forward", "timeline_sample", "depth_stats_nearest_rank", "fanout_stats", "cumulative_to_delta", "coverage_months", "backfill_plan", "nested_coverage", "server_prefix_names",
         "human_prompts", "safe_quotes", "cli_heads", "shell_writes", "span_dedup", "dedup_rank", "goto_phrase", "classify_targets", "scorecard_axes", "pooled_planning",
         "reader_canonical", "reader_opencode", "reader_codex_usage", "report_months", "report_sources", "prompt_heat", "payload_budget", "window_overlap", "pooled_names", "prompt_markers"]


@pytest.fixture(scope="module")
def con():
    from tests.oracle_check import duck
    return duck(ROOT)


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="driver tables are not here")
@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, con, name):
    from tests.oracle_check import compare
    assert compare(spark, con, ROOT, catalog.load()[name]) is None


def test_every_query_is_registered_once_and_has_a_callable():
    reg = catalog.load()
    assert len(reg) > 80 and all(callable(q.run) for q in reg.values())
    assert sum(q.sql is not None for q in reg.values()) > 65
