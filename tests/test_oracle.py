"""Registered queries against their DuckDB oracles on the smallest tables."""
import pytest

import __spark_entry__ as E
from splitcraft.oracle import compare
from tests.conftest import SF_SMALL

FAST = ["template_typed", "template_abstract", "fold_value_arithmetic", "ascii_fold", "exclude_eval_templates",
        "template_freq", "uat_cli", "uniform_splits", "validate_and_fix", "cap_per_template", "two_phase_sample",
        "compositional_split", "nearest_templates", "quoted_spans", "exact_match", "sequence_accuracy",
        "best_candidate", "bleu", "rouge", "shard_round_robin", "merge_shards", "read_raw_pairs"]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, name):
    r = compare(spark, SF_SMALL, name, E.queries()[name], E.oracle_sql().get(name))
    assert r["match"], r


def test_every_query_has_an_oracle_or_is_declared():
    qs, sql = E.queries(), E.oracle_sql()
    missing = set(qs) - set(sql)
    assert all(k.startswith(("op", "pipeline")) for k in missing), missing


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["split_name", "example_id", "label"]
    assert df.count() > 0
