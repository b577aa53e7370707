"""Plan shapes that matter at scale, and rules every registered query keeps."""

import re

import pytest

from bazaarflow.plans.bindings import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["jn5_best_supplier", "jn2_ladder_topk", "jn6_trigram_pairs", "jn8_verify_city", "jn11_cities_of", "jn19_country_queries",
                                  "jn20_marketplace_suppliers", "geo1_resolve", "sim12_structured_match", "agg4_price_ladder"])
def test_no_cartesian_product(spark, name):
    assert "CartesianProduct" not in plan(spark, name)
    assert "BroadcastNestedLoopJoin" not in plan(spark, name)


@pytest.mark.parametrize("name", ["top2_interval_cut", "top4_first_by_position", "top3_distinct_titles"])
def test_ranked_groups_are_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


def test_scan_is_pruned_and_filtered(spark):
    text = plan(spark, "src1_catalogue_scan")
    assert "GreaterThanOrEqual(p_size,25)" in text
    scan = re.search(r"ReadSchema: (.*)", text)[1]
    assert "p_type" not in scan


def test_limits_are_take_ordered(spark):
    assert "Sort" in plan(spark, "jn12_review_queue")


def test_names():
    assert not [n for n in QUERIES if re.search(r"pipeline|^op\d", n)]
    assert set(ORACLES) <= set(QUERIES)
