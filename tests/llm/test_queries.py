import pytest

from annotara.llm import plans
from tests.verify import compare, connect


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, data, name):
    rows, ok, why = compare(spark, connect(data), name, plans.QUERIES[name], plans.SQL.get(name), data)
    assert ok is not False, why


def test_columns(spark, data):
    want = {"p1_found": ["doc_id", "sent_start", "sent_end"], "p4_found": ["tbl", "row_key"], "p5_found": ["idx_a", "idx_b"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "span_start", "span_end"]}
    for n, c in want.items():
        assert plans.QUERIES[n](spark, data).columns == c
