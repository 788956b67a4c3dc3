"""Rows of one doc_id with different texts keep the links of each text."""

from codeweft.llm import jaccard_join
from tests.llm.test_operators import passage


def test_repeated_ids(spark):
    rows = []
    for k in range(8):
        near, other = passage(100 + k, 80), passage(200 + k, 80)
        rows += [(3 * k, near), (3 * k, other), (3 * k + 1, near + " the end"), (3 * k + 2, other + " the end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join.jaccard_components(docs, 3, (90, 100)).collect()
    assert len(got) == len(rows) and all(r.component_id == r.doc_id // 3 * 3 for r in got)
