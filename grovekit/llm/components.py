"""Connected components of an edge table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.llm.common import staged


def connected(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges(a, b): root is the least node reachable. Each round takes the least root
    of all neighbours and then the root's root, so long chains shorten by half; rounds end when nothing changes.
    Roots are written out each round; the aggregations combine before the exchange, so a node with very many
    neighbours is no hot group."""
    both = edges.select("a", "b").filter("a <> b").distinct()
    both = staged(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    roots = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        heard = both.join(roots, both["b"] == roots["node"]).groupBy("a").agg(F.min("root").alias("heard"))
        told = roots.join(heard, roots["node"] == heard["a"]).select("node", "root", F.least("root", "heard").alias("now"))
        # a root that hears of a lesser one passes it to all that it stands for
        hook = told.groupBy(F.col("root").alias("r")).agg(F.min("now").alias("least"))
        hooked = told.join(hook, told["root"] == hook["r"]).select("node", "root", F.least("now", "least").alias("now"))
        jump = hooked.select(F.col("node").alias("n2"), F.col("now").alias("now2"))
        new = staged(hooked.join(jump, F.col("now") == F.col("n2"), "left").select("node", "root", F.least("now", F.coalesce("now2", "now")).alias("now")), "roots")
        if not new.filter("root <> now").limit(1).count():
            return new.select("node", "root")
        roots = new.select("node", F.col("now").alias("root"))
