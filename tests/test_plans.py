"""What the plans of all registered queries must not have, and what scans must push down."""

import os
import re

import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not re.match(r"p[24567]_", n)))
def test_no_products_of_rows(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(entry.queries()[name](spark, D)))


@pytest.mark.parametrize("name,columns,filters", [
    ("issue_list", "o_orderkey:bigint,o_orderstatus:string", "EqualTo(o_orderstatus,O)"), ("pr_since", "o_orderkey:bigint,o_orderdate:timestamp", "GreaterThanOrEqual(o_orderdate,1996-06-01"), ("page_target_kind", "source_url:string>", ""),
    ("url_output_name", "requested_url:string>", ""), ("capability_gap", "l_orderkey:bigint,l_returnflag:string,l_linestatus:string>", ""), ("package_totals", "text:string,origin:string>", "")])
def test_pushdown(spark, name, columns, filters):
    p = plan(entry.queries()[name](spark, D))
    assert columns in p and filters in p


def test_one_shuffle_of_the_records(spark):
    """Snapshot changes move the records by group and key once, then once to their buckets; nothing else is shuffled."""
    p = plan(entry.queries()["p3_found"](spark, D))
    assert len(re.findall(r"Exchange hashpartitioning", p)) <= 3
