"""Physical plans: what is read, shuffled, windowed and broadcast."""

import re

import pytest

from __spark_entry__ import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plan(spark):
    def text(name):
        return queries()[name](spark, SF_DIR)._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    return text


def operators(text):
    """Operator names of the tree that is printed first."""
    tree = text.split("\n\n")[0]
    return re.findall(r"(?:[-+: ]*)?(?:\* )?([A-Z]\w+)[^\n]*\(\d+\)", tree)


def schemas(text):
    return re.findall(r"ReadSchema: struct<([^>]*)>", text)


def test_scans_read_only_what_a_query_needs(plan):
    assert {s for s in schemas(plan("M1_inventory_diff"))} == {"o_orderkey:bigint,o_orderstatus:string"}
    assert all("text" not in s for s in schemas(plan("M7_compare_sides")))
    assert {s for s in schemas(plan("I5_distinct_hashes"))} == {"text:string"}


def test_first_wins_merges_shuffle_once_and_never_sort_a_group(plan):
    for name in ("H1_prefer_first", "H1_prefer_first_media", "H3_latest_message", "H6_keep_first", "H7_best_copy"):
        found = operators(plan(name))
        assert found.count("Exchange") == 1 and "Window" not in found, (name, found)


def test_no_cartesian_or_nested_loop_joins(plan, spark):
    for name in sorted(queries()):
        if name[0] in "ABT" or name.startswith(("K6", "G4_byte", "G2_media_by_session", "L3_materialize", "L11_apply", "L11_second", "L11_dry")):
            continue  # these run jobs of their own while they are built
        found = operators(plan(name))
        assert not {"CartesianProduct", "BroadcastNestedLoopJoin"} & set(found), (name, found)


def test_no_window_over_a_whole_table(plan):
    for name in ("H4_preceding_user", "H5_prompt_navigator", "G4_row_pages", "L3_payload_versions", "T2_state_changes"):
        text = plan(name)
        assert "_block" in text and "SinglePartition" not in text, name


def test_top_k_is_cut_before_the_shuffle(plan):
    found = operators(plan("F12_sampled_size"))
    assert "WindowGroupLimit" in found
    for name in ("G1_recent_conversations", "K7_search_captures", "G2_media_by_name"):
        assert "TakeOrderedAndProject" in operators(plan(name)), name
