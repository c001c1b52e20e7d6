"""The graph queries without SQL read every line item, supplier and part."""

from sparkmat.plans import analysis
from sparkmat.plans.tables import table, whole_graph

SF = "/root/testdata/sf0.001"


def test_graph_queries_keep_every_line_item(spark):
    items = table(spark, SF, "lineitem")
    want = {2 * r.k for r in items.selectExpr("l_suppkey AS k").distinct().collect()} | {2 * r.k + 1 for r in items.selectExpr("l_partkey AS k").distinct().collect()}
    assert whole_graph(spark, SF).agg({"weight": "sum"}).first()[0] == 2 * items.count()
    got = {n: analysis.ALL[n][0](spark, SF) for n in ("local_pagerank", "coreness", "label_propagation", "layout_network")}
    assert all({r.node for r in df.collect()} == want for df in got.values())
