"""Texts are read and searched once, by the plans of the queries on sections."""

import pytest
from lamina.functions.rules import CORPUS
from lamina.plans import registry as Q

SF = "/root/testdata/sf0.001"


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_previews_read_documents_once(spark):
    plan = optimised(Q.chunk_preview(spark, SF))
    assert plan.count("Relation [") == 1


@pytest.mark.parametrize("name", ["coverage_items", "category_histogram", "chunk_preview"])
def test_filters_do_not_search_again(spark, name):
    plan = optimised(Q.QUERIES[name](spark, SF))
    filters = [line for line in plan.splitlines() if " Filter " in line or line.lstrip(" :+-").startswith("Filter ")]
    assert filters and not any("Contains(" in line or "split(" in line for line in filters)


def test_a_form_is_made_once_for_all_keywords(spark):
    df = spark.createDataFrame([("a", "b")], "title string, text string")
    found = df.select(CORPUS.category(df.title, df.text).alias("c"), CORPUS.coverage_type(df.title, df.text).alias("k"))
    assert optimised(found).count("lower(") == 2
