import os

import pytest

registry = pytest.importorskip("lodestrata.llm.registry")
D = "/root/testdata/sf0.001"
COLUMNS = {"p2_found": ["id", "para_no"], "p4_found": ["id", "page_no", "line_no", "kind"], "p5_ids": ["doc_id", "ids"], "p7_found": ["doc_id"]}


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_runs_with_its_columns(spark, name):
    df = registry.QUERIES[name](spark, D)
    n = df.count()
    assert n > 0 and df.distinct().count() == n and df.columns == COLUMNS.get(name, df.columns)
