"""What the plans of the training-data queries must not have."""

import os
import re

import pytest

from lodestrata.llm import registry

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_products_and_no_python_rows(spark, name):
    p = plan(registry.QUERIES[name](spark, D))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", p)


def test_scans_read_what_they_need(spark):
    # p5 and p7 scan texts and ids only; what is written in between is not the table.
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(registry.p7_found(spark, D))


def test_words_of_blocks_are_joined_not_occurrences(spark):
    p = plan(registry.p5_ids(spark, D))
    assert len(re.findall("Exchange hashpartitioning", p)) <= 5 and "Window" not in p
