"""Plan properties: pruned scans, no pool-wide single-partition windows."""
import re

import __spark_entry__ as E
from splitcraft.operators import shaping as SH
from splitcraft.operators import splits as S
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_program_scan_reads_only_needed_columns(spark):
    plan = _plan(E.queries()["template_abstract"](spark, SF_SMALL))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all(set(c.split(":")[0] for c in s.split(",")) <=
                           {"o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"} for s in schemas)


def test_single_partition_exchanges_only_above_partial_aggregates(spark):
    plan = _plan(E.queries()["uat_cli"](spark, SF_SMALL)).splitlines()
    for i, line in enumerate(plan):
        if "SinglePartition" in line:
            assert "partial_" in plan[i + 1], plan[i + 1]


def test_select_split_quirks_and_pivot(spark):
    pool = spark.createDataFrame([("a", "q1", "p1"), ("b", "q2", "p2"), ("c", "q3", "p3")],
                                 "example_id string, question string, query string")
    a = spark.createDataFrame([("s1", "a", 1), ("s1", "b", 2), ("s2", "a", 2)],
                              "split_name string, example_id string, label int")
    assert [r.example_id for r in SH.select_split(a, pool, "example_id", "s1", 1).collect()] == ["a"]
    assert SH.select_split(a, pool, "example_id", "s1", None).count() == 0   # name without value
    assert SH.select_split(a, pool, "example_id", None, 1).count() == 3     # no name: no filter
    wide = {r.example_id: (r.s1, r.s2) for r in S.pivot_labels(pool, a, "example_id", ["s1", "s2"]).collect()}
    assert wide == {"a": (1, 2), "b": (2, None), "c": (None, None)}
