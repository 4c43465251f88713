"""Closures have no bound of depth."""

from emberline.operators import graph


def test_reach_follows_a_long_chain_to_its_end(spark):
    links = [(f"n{k:02}", f"n{k + 1:02}") for k in range(15)] + [("n15", "n12")]
    edges = spark.createDataFrame(links, "source string, target string")
    got = {r.node: r.depth for r in graph.reach(edges, spark.createDataFrame([("n00",)], "root string")).collect()}
    assert got == {f"n{k:02}": k for k in range(1, 16)}
    assert graph.reach(edges, spark.createDataFrame([("n00",)], "root string"), 3).count() == 3
