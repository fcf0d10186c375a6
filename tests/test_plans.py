"""Plans that must hold at any size: pruned scans, pushed filters, no nested loops over tables."""

import re

import pytest

import __spark_entry__ as entry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j3_fuzzy_accept", "j3_fuzzy_candidates", "j4_subname_pairs", "r_resolve_all", "f7_touching", "j8_orphans", "u7_reset_orphans", "u3_relationships", "w1_contested_with_snapshot"])
def test_no_nested_loops(spark, small, name):
    assert not re.search("NestedLoop|CartesianProduct", plan(entry.queries()[name](spark, small)))


@pytest.mark.parametrize("name,columns", [("l2_page_info", 0), ("t8_tokens", 1), ("w1_contested_running", 5), ("a12_rescan_rollup", 4), ("s10_iso", 2)])
def test_scans_read_what_is_asked(spark, small, name, columns):
    read = [x.count(":") for x in re.findall(r"ReadSchema: struct<([^>]*)>", plan(entry.queries()[name](spark, small)))]
    assert read and max(read) <= columns


@pytest.mark.parametrize("name", ["s16_point_lookup", "q3_people_keyset"])
def test_filters_reach_the_scan(spark, small, name):
    assert re.search(r"PushedFilters: \[[^\]]+\]", plan(entry.queries()[name](spark, small)))


@pytest.mark.parametrize("name", ["t1_sentences", "t6_normalize", "f1_org_filter", "r_resolve_all", "u4_provenance", "w2_recency", "q4_person_detail"])
def test_no_python_where_expressions_do(spark, small, name):
    assert not re.search("Python|Pandas|Arrow", plan(entry.queries()[name](spark, small)))
