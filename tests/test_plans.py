import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def plan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return entry.queries()[name](spark, FOLDER)._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(spark, "flt_chapter")
    assert "EqualTo(book_osis" in p and "EqualTo(translation_id,1)" in p and "EqualTo(chapter,1)" in p
    p = plan(spark, "agg_needs_review")
    assert "EqualTo(state,NEEDS_REVIEW)" in p and "ReadSchema: struct<job_id:bigint,state:string>" in p


def test_no_cross_joins(spark):
    for name in ("join_library", "join_interval_speaker", "str_parse_reference", "agg_stats", "join_recent_highlights", "p4_found", "prj_highlight_label"):
        p = plan(spark, name)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_top_k_is_one_pass(spark):
    assert "TakeOrderedAndProject" in plan(spark, "topk_library")


def test_references_are_merged(spark):
    assert "SortMergeJoin" in plan(spark, "p4_found")
